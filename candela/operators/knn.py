"""Exact k-nearest-neighbour classification (M15) without all-pairs joins.

Training points of a fold are indexed in a multi-resolution grid: level L
has cubic cells of side h_L = h_0 / 2^L over the bounding box of the fold.
For a test point q, let L* be the finest level whose cell around q holds at
least k training points. The k-th smallest distance R from q to the points
of that cell bounds the k-th neighbour distance (R is at most the cell
diameter), so every true neighbour lies in the box [q-R, q+R]. The
candidates are the training points in the level-L* cells that cover that
box (at most 2*ceil(diam)+1 cells per dimension). Distances are computed only for those candidate pairs, whose
number follows the local point density around q, not the size of the fold;
a group holding a third of all rows does not make every pair meet.

Ties at the k-th distance are broken by the training row key (Ticker, Date).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_LEVEL = 24


def _cell(cols: list[str], origin: list[float], h: F.Column) -> F.Column:
    return F.array(*[F.floor((F.col(c) - F.lit(o)) / h).cast("long") for c, o in zip(cols, origin)])


def knn_fold(train: DataFrame, test: DataFrame, cols: list[str], k: int = 10, metric: str = "euclidean",
             weights: str = "uniform") -> DataFrame:
    """Class-1 probability of every test row from its k nearest training rows.

    ``train``: Ticker, Date, Target + cols; ``test``: Ticker, Date + cols.
    Returns Ticker, Date, probability.
    """
    p = len(cols)
    # grid over the bounding box of training and test points: level 0 is one cell holding everything
    box = train.select(*cols).unionByName(test.select(*cols))
    stats = box.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
                    *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)]).first()   # 2p numbers
    origin = [float(stats[f"lo{i}"]) for i in range(p)]
    h0 = max(max(float(stats[f"hi{i}"]) - float(stats[f"lo{i}"]) for i in range(p)), 1e-12) * (1 + 1e-9)
    diam = math.sqrt(p) if metric == "euclidean" else float(p)
    h_at = lambda lvl: F.lit(h0) / F.pow(F.lit(2.0), lvl.cast("double"))

    levels = F.explode(F.sequence(F.lit(0), F.lit(MAX_LEVEL))).alias("lvl")
    tr = train.select(F.col("Ticker").alias("t_ticker"), F.col("Date").alias("t_date"),
                      F.col("Target").alias("y"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(cols)])
    tcols = [f"t{i}" for i in range(p)]
    tr_cells = tr.select("*", levels).withColumn("cell", _cell(tcols, origin, h_at(F.col("lvl"))))
    counts = tr_cells.groupBy("lvl", "cell").agg(F.count(F.lit(1)).alias("n"))

    te = test.select("Ticker", "Date", *[F.col(c).alias(f"q{i}") for i, c in enumerate(cols)])
    qcols = [f"q{i}" for i in range(p)]
    te_cells = te.select("Ticker", "Date", levels).join(te, ["Ticker", "Date"]) \
                 .withColumn("cell", _cell(qcols, origin, h_at(F.col("lvl"))))
    finest = (te_cells.join(counts, ["lvl", "cell"]).where(F.col("n") >= k)
              .groupBy("Ticker", "Date").agg(F.max("lvl").alias("lstar")))
    q = te.join(finest, ["Ticker", "Date"]).withColumn("lvl", F.col("lstar"))
    diff = [F.col(f"q{i}") - F.col(f"t{i}") for i in range(p)]
    if metric == "euclidean":
        dist = F.sqrt(reduce(lambda a, b: a + b, [d * d for d in diff]))
    else:
        dist = reduce(lambda a, b: a + b, [F.abs(d) for d in diff])
    # first pass: the k-th distance to the points of q's own cell bounds the k-th
    # neighbour distance; it is never larger than the cell diameter
    own = q.withColumn("cell", _cell(qcols, origin, h_at(F.col("lvl")))).join(tr_cells, ["lvl", "cell"]) \
           .select("Ticker", "Date", dist.alias("dist"))
    kth = (own.withColumn("rk", F.row_number().over(Window.partitionBy("Ticker", "Date").orderBy("dist")))
              .where(F.col("rk") == k).select("Ticker", "Date", F.col("dist").alias("R")))
    q = q.join(kth, ["Ticker", "Date"])
    hl = h_at(F.col("lvl"))
    ranges = [F.sequence(F.floor((F.col(qc) - F.col("R") - F.lit(o)) / hl).cast("long"),
                         F.floor((F.col(qc) + F.col("R") - F.lit(o)) / hl).cast("long"))
              for qc, o in zip(qcols, origin)]
    # all cell keys covering the box: product of the per-dimension index ranges
    keys = reduce(lambda acc, r: F.flatten(F.transform(acc, lambda a: F.transform(r, lambda v: F.concat(a, F.array(v))))),
                  ranges[1:], F.transform(ranges[0], lambda v: F.array(v)))
    qc = q.select("Ticker", "Date", "lvl", *qcols, F.explode(keys).alias("cell"))
    cand = qc.join(tr_cells, ["lvl", "cell"])
    cand = cand.select("Ticker", "Date", "t_ticker", "t_date", "y", dist.alias("dist"))
    w = Window.partitionBy("Ticker", "Date").orderBy("dist", "t_ticker", "t_date")
    nn = cand.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    if weights == "uniform":
        prob = F.avg(F.col("y").cast("double"))
    else:
        # inverse-distance vote; if any neighbour is at distance 0, only those vote
        zero = F.max((F.col("dist") == 0).cast("int"))
        w_exact = F.sum(F.when(F.col("dist") == 0, F.col("y").cast("double")))
        n_exact = F.sum(F.when(F.col("dist") == 0, F.lit(1.0)))
        inv = F.when(F.col("dist") > 0, 1.0 / F.col("dist"))
        prob = F.when(zero == 1, w_exact / n_exact).otherwise(
            F.sum(inv * F.col("y").cast("double")) / F.sum(inv))
    return nn.groupBy("Ticker", "Date").agg(prob.alias("probability"))


def knn_backtest(df: DataFrame, cols: list[str], wf, k: int = 10, metric: str = "euclidean",
                 weights: str = "uniform", threshold: float = 0.51, name: str = "KNN") -> DataFrame:
    """Walk-forward KNN predictions (same fold rules as the other models)."""
    from candela.operators import folds as fo
    df = df.persist()
    cal = fo.calendar(df).persist()
    data = fo.with_date_ordinal(df, cal).persist()
    fold_table = fo.folds(cal, wf).persist()
    tests = fo.assign_test(data, fold_table)
    out = None
    for r in fold_table.collect():
        tr = fo.train_rows(data, r["train_end"]).select("Ticker", "Date", "Target", *cols)
        te = tests.where(F.col("fold_id") == r["fold_id"])
        if tr.limit(k).count() < k:
            raise ValueError(f"fold {r['fold_id']} has fewer than k = {k} training rows")
        pr = knn_fold(tr, te.select("Ticker", "Date", *cols), cols, k, metric, weights)
        part = te.join(pr, ["Ticker", "Date"]).select(
            F.lit(name).alias("model"), "fold_id", "Ticker", "Date", "Target", "probability",
            (F.col("probability") >= threshold).cast("int").alias("Predictions"))
        out = part if out is None else out.unionByName(part)
    # no fold survives its rules: an empty table of the same columns
    return out if out is not None else tests.select(
        F.lit(name).alias("model"), "fold_id", "Ticker", "Date", "Target", F.lit(None).cast("double").alias("probability"),
        F.lit(None).cast("int").alias("Predictions")).limit(0)
