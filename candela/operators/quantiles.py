"""Exact quantiles of many groups and columns by distributed selection (B11, D-14).

No group's values meet in one buffer. A pass counts the values of every group and column in ``BINS`` equal ranges between their least and
greatest value. The ranges that hold a wanted rank are kept, with the values in them; their least and greatest values
bound the next pass. When every kept range has one value or at most ``TASK_ROWS`` values, a sort inside each range finds the ranks.
All groups, columns and ranks go through each pass together; a pass keeps about (ranks / BINS) of the values, and outliers, which squeeze
the others into one range, are gone after it.

A quantile p of n values lies at place p (n - 1), interpolated linearly. Nulls and NaN don't count; a group without values
has null quantiles; null keys are a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.session import written

BINS, TASK_ROWS = 512, 50_000


def _same(keys: list[str], other: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{other}{k}"))
    return cond


def _named(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}{k}") for k in keys], *[c for c in df.columns if c not in keys])


def exact_quantiles(df: DataFrame, keys: list[str], columns: list[str], probs: list[float]) -> DataFrame:
    """Rows ``keys, <column>_n, <column>_q0, <column>_q1, ...``, one per group; quantiles in the order of ``probs``."""
    names, keys = keys, [f"key{i}" for i in range(len(keys))]  # apart from the columns used here
    pair = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")
    values = written(df.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], pair).select(*keys, "x.c", "x.v"), "values")
    groups = values.select(*keys).distinct()
    by = [*keys, "c"]
    live = values.where(F.col("v").isNotNull() & ~F.isnan("v"))
    # the one range of every group and column to begin with, and its wanted places (0-based)
    ranges = live.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.lit(0.0)
    spots = []
    for p in probs:
        place = F.lit(float(p)) * (F.col("n") - 1)
        spots += [F.floor(place), F.ceil(place)]
    size = written(ranges, "sizes")
    ranges = size.select(*by, F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("before"), F.col("n").alias("k"), "lo", "hi",
                         F.array_sort(F.array_distinct(F.array(*[s.cast("long") for s in spots]))).alias("want"))
    live = live.withColumn("part", F.lit(0).cast("long"))
    by_part = [*by, "part"]
    while True:
        wide = ranges.where((F.col("k") > TASK_ROWS) & (F.col("lo") < F.col("hi"))).limit(1).count()
        if not wide:
            break
        # halves first: the width of a range may overflow
        width = F.col("hi") / BINS - F.col("lo") / BINS
        bin_ = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("long")
        placed = live.join(_named(ranges.select(*by_part, "lo", "hi", "before", "want"), by_part, "_"), _same(by_part, "_"))
        placed = placed.select(*by, "v", "before", "want", (F.col("part") * BINS + bin_).alias("part"), F.col("part").alias("up"))
        counts = placed.groupBy(*by_part, "up").agg(F.count("*").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                                                    F.first("before").alias("before"), F.first("want").alias("want"))
        run = Window.partitionBy(*by, "up").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
        counts = counts.withColumn("before", F.col("before") + F.coalesce(F.sum("k").over(run), F.lit(0)))
        inside = F.filter("want", lambda w: (w >= F.col("before")) & (w < F.col("before") + F.col("k")))
        ranges = written(counts.withColumn("want", inside).where(F.size("want") > 0).drop("up"), "ranges")
        live = written(placed.select(*by_part, "v").join(_named(ranges.select(*by_part), by_part, "_"), _same(by_part, "_"), "left_semi"), "values")
    rest = live.join(_named(ranges, by_part, "_"), _same(by_part, "_"))
    # a range of one value needs no sort: each wanted place has it
    flat = ranges.where(F.col("lo") == F.col("hi")).select(*by, F.explode("want").alias("at"), F.col("lo").alias("v"))
    order = F.row_number().over(Window.partitionBy(*by_part).orderBy("v")) - 1 + F.col("before")
    ranked = rest.where(F.col("lo") < F.col("hi")).withColumn("at", order.cast("long")).where(F.array_contains("want", F.col("at"))).select(*by, "at", "v")
    found = ranked.union(flat.select(*by, "at", "v")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    found = size.select(*by, "n").join(_named(found, by, "_"), _same(by, "_"))
    agg = []
    for i, c in enumerate(columns):
        mine = lambda e: F.max(F.when(F.col("c") == i, e))
        agg.append(F.coalesce(mine(F.col("n")), F.lit(0)).cast("long").alias(f"{c}_n"))
        for j, p in enumerate(probs):
            at = F.lit(float(p)) * (F.col("n") - 1)
            lo, hi = F.element_at("m", F.floor(at).cast("long")), F.element_at("m", F.ceil(at).cast("long"))
            # of equal neighbours, infinite ones too, no difference is taken
            agg.append(mine(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (at - F.floor(at)))).alias(f"{c}_q{j}"))
    out = found.groupBy(*keys).agg(*agg)
    return groups.join(_named(out, keys, "_"), _same(keys, "_"), "left").select(
        *[F.col(k).alias(n) for n, k in zip(names, keys)], *[F.coalesce(F.col(f"{c}_n"), F.lit(0).cast("long")).alias(f"{c}_n") if q is None else F.col(f"{c}_q{q}")
                 for c in columns for q in (None, *range(len(probs)))])
