"""Classification metrics, strategy Sharpe, ranking (D-1...D-8, D-21...D-25).

Metrics are one grouped aggregate over a long prediction table
(``model, fold_id, Ticker, Date, Target, Predictions[, fwd_return]``): one
pass for all models, partial aggregation before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "total_trades", "sharpe")


def _ratio(num: Column, den: Column) -> Column:
    """num/den with 0 when den is 0 (zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def confusion_counts(preds: DataFrame, group: list[str] | None = None) -> DataFrame:
    """D-1: tp, fp, fn, tn per group."""
    group = group or ["model"]
    y, p = F.col("Target"), F.col("Predictions")
    return preds.groupBy(*group).agg(
        F.count_if((y == 1) & (p == 1)).cast("bigint").alias("tp"),
        F.count_if((y == 0) & (p == 1)).cast("bigint").alias("fp"),
        F.count_if((y == 1) & (p == 0)).cast("bigint").alias("fn"),
        F.count_if((y == 0) & (p == 0)).cast("bigint").alias("tn"),
        F.sum(p).cast("bigint").alias("total_trades"),
        F.count(F.lit(1)).cast("bigint").alias("n"),
    )


def classification_metrics(preds: DataFrame, group: list[str] | None = None,
                           with_sharpe: bool = False) -> DataFrame:
    """D-2...D-6: accuracy, precision, recall, F1, label ROC-AUC, trades [, Sharpe]."""
    group = group or ["model"]
    cc = confusion_counts(preds, group)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = cc.select(
        *group,
        _ratio(tp + tn, F.col("n")).alias("accuracy"),
        _ratio(tp + tn, F.col("n")).alias("directional_accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.when((tp + fn > 0) & (tn + fp > 0),
               (tp.cast("double") / (tp + fn) + tn.cast("double") / (tn + fp)) / 2).alias("roc_auc"),
        "total_trades", "tp", "fp", "fn", "tn",
        F.array(F.array(tn, fp), F.array(fn, tp)).alias("confusion_matrix"),
    )
    if with_sharpe:
        out = out.join(sharpe(preds, group), group, "left")
    return out


def sharpe(preds: DataFrame, group: list[str] | None = None, periods: int = 252) -> DataFrame:
    """D-6: mean/std (ddof 1) * sqrt(periods) of fwd_return * (2p - 1); 0 when std is 0."""
    group = group or ["model"]
    sr = F.col("fwd_return") * (2 * F.col("Predictions") - 1)
    a = preds.groupBy(*group).agg(F.avg(sr).alias("_m"), F.stddev_samp(sr).alias("_s"))
    return a.select(*group, F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.lit(math.sqrt(periods)))
                    .otherwise(F.lit(0.0)).alias("sharpe"))


def roc_auc(preds: DataFrame, score: str = "probability", group: list[str] | None = None, chunks: int = 1024) -> DataFrame:
    """D-3: area under the ROC curve of a score, ties counting a half: ``group, n_pos, n_neg, auc`` (null with one class).

    Rows combine to one per distinct score first, then the scores are cut into value ranges: negatives below a score are those of
    lower ranges (running sums over the small table of ranges) and those below it in its own range. No task
    sorts all scores of a model. Null and NaN scores don't count.
    """
    group = group or ["model"]
    s, y = F.col(score).cast("double"), F.col("Target")
    d = (preds.where(s.isNotNull() & ~F.isnan(s) & y.isNotNull()).groupBy(*group, s.alias("_s"))
         .agg(F.count_if(y == 1).alias("_p"), F.count_if(y != 1).alias("_n")))
    finite = F.when(F.abs("_s") != F.lit(float("inf")), F.col("_s"))
    ranges = d.groupBy(*group).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    width = (F.col("_hi") / chunks - F.col("_lo") / chunks)
    inner = F.when(width > 0, F.least(F.floor((finite - F.col("_lo")) / width), F.lit(chunks - 1))).otherwise(F.lit(0))
    chunk = F.when(F.col("_s") == float("-inf"), F.lit(-1)).when(F.col("_s") == float("inf"), F.lit(chunks)).otherwise(inner).cast("int")
    same = lambda cols, other: [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in cols]
    named = lambda df, cols, other: df.select(*[F.col(c).alias(f"{other}{c}") for c in cols], *[c for c in df.columns if c not in cols])
    d = d.join(named(ranges, group, "_r_"), same(group, "_r_")).withColumn("_c", chunk)
    per = d.groupBy(*group, "_c").agg(F.sum("_n").alias("_t"))
    below = Window.partitionBy(*group).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*group, "_c", F.coalesce(F.sum("_t").over(below), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_c").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    d = d.join(named(per, [*group, "_c"], "_x_"), same([*group, "_c"], "_x_"))
    wins = F.sum(F.col("_p") * (F.col("_before") + F.col("_in") + F.col("_n") / 2.0))
    out = d.groupBy(*group, "n_pos", "n_neg").agg(wins.alias("_w"))
    return out.select(*group, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_w") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def metric_column(metrics: DataFrame, metric: str) -> str:
    """Case-insensitive, validated metric name."""
    for c in metrics.columns:
        if c.lower() == metric.lower() and c.lower() in METRICS:
            return c
    raise ValueError(f"unknown metric {metric!r}; choose one of {METRICS}")


def rank_models(metrics: DataFrame, metric: str = "precision", order_col: str = "ordinal") -> DataFrame:
    """D-21: descending by metric, ties by registry order; adds ``rank`` (1 = best).

    The window has no partition: its input is one row per model.
    """
    m = metric_column(metrics, metric)
    w = Window.orderBy(F.col(m).desc_nulls_last(), F.col(order_col).asc())
    return metrics.withColumn("rank", F.row_number().over(w).cast("int"))


def best_model(metrics: DataFrame, metric: str = "precision", order_col: str = "ordinal") -> DataFrame:
    """D-22: the top-ranked model."""
    return rank_models(metrics, metric, order_col).where(F.col("rank") == 1)


def top_k(metrics: DataFrame, k: int = 5, metric: str = "precision", order_col: str = "ordinal") -> DataFrame:
    """D-23: the k best models."""
    return rank_models(metrics, metric, order_col).where(F.col("rank") <= k)


def highlight_best(metrics: DataFrame, metric: str = "precision") -> DataFrame:
    """D-25: ``is_best`` where the metric equals its column maximum."""
    m = metric_column(metrics, metric)
    return metrics.withColumn("is_best", F.col(m) == F.max(m).over(Window.partitionBy()))


def empty_safe(metrics: DataFrame, models: DataFrame) -> DataFrame:
    """D-7: every registered model gets a row; models without predictions score 0."""
    j = models.join(metrics, "model", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("accuracy", "precision", "recall", "f1", "sharpe")
            if c in j.columns}
    zero["total_trades"] = F.coalesce(F.col("total_trades"), F.lit(0).cast("bigint"))
    return j.withColumns(zero)


def report_table(metrics: DataFrame, extended: bool = False, digits: int = 4) -> DataFrame:
    """D-28: rounded benchmark table (basic, or extended with AUC and confusion counts)."""
    cols = ["model", F.round("accuracy", digits).alias("accuracy"), F.round("precision", digits).alias("precision"),
            F.round("recall", digits).alias("recall"), F.round("f1", digits).alias("f1"), "total_trades"]
    if extended:
        cols += [F.round("roc_auc", digits).alias("roc_auc"), "tp", "fp", "fn", "tn"]
    return metrics.select(*cols)
