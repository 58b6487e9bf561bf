"""Halo partitioning: run finite-lookback window operators on row buckets of a
series instead of on the whole series.

A series (one ticker) is cut into buckets of ``rows_per_bucket`` consecutive
rows. Each bucket also receives a copy of the ``lookback`` rows before it
(leading halo) and of the first row after it (trailing halo, for next-row
labels). Windows partitioned by (Ticker, bucket) then see, for every real
row, exactly the frame they would see on the whole series; halo rows are
dropped afterwards. One hot or very long series is spread over many tasks.

Row positions come from ``global_row_index`` without a whole-series window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_row_index(df: DataFrame, order: str = "Date", chunk: Column | None = None) -> DataFrame:
    """Adds ``_g``, the 0-based position of each row in its series by ``order``.

    Rows are counted per (Ticker, chunk) with an aggregate (partial
    aggregation spreads a hot ticker over many tasks), chunk offsets are a
    running sum over that small table, and the position inside a chunk is a
    window over the chunk only. ``chunk`` must be monotone in ``order``
    (default: the calendar month of ``order``).
    """
    chunk = chunk if chunk is not None else F.date_trunc("month", F.col(order))
    c = df.withColumn("_chunk", chunk)
    counts = c.groupBy("Ticker", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select(F.col("Ticker").alias("_off_t"), F.col("_chunk").alias("_off_c"), F.coalesce(F.sum("_n").over(
        Window.partitionBy("Ticker").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    rn = F.row_number().over(Window.partitionBy("Ticker", "_chunk").orderBy(order)) - 1
    same = F.col("Ticker").eqNullSafe(F.col("_off_t")) & F.col("_chunk").eqNullSafe(F.col("_off_c"))  # a null ticker is a series too
    return c.join(offs, same).withColumn("_g", F.col("_off") + rn).drop("_chunk", "_off", "_off_t", "_off_c")


def halo_parts(df: DataFrame, lookback: int, rows_per_bucket: int, order: str = "Date",
               chunk: Column | None = None, trailing: bool = True, ahead: int = 1) -> DataFrame:
    """Rows tagged with ``_bucket``, ``_halo`` (any copy) and ``_lead_halo``.

    ``lookback`` rows before each bucket are copied in as the leading halo;
    with ``trailing``, the ``ahead`` rows after it as the trailing halo.
    """
    b = rows_per_bucket
    g = global_row_index(df, order, chunk)
    own = (g.withColumn("_bucket", F.floor(F.col("_g") / b)).withColumn("_halo", F.lit(False))
            .withColumn("_lead_halo", F.lit(False)))
    first_next = F.floor(F.col("_g") / b) + 1
    last_next = F.floor((F.col("_g") + lookback) / b)
    lead = (g.withColumn("_bucket", F.explode(F.sequence(first_next, F.greatest(first_next, last_next))))
             .where(F.col("_bucket") * b - lookback <= F.col("_g"))
             .withColumn("_halo", F.lit(True)).withColumn("_lead_halo", F.lit(True)))
    parts = own.unionByName(lead)
    if trailing and ahead > 0:
        # row g feeds buckets b' < its own with (b'+1) B <= g < (b'+1) B + ahead
        first_prev = F.floor((F.col("_g") - ahead) / b)
        last_prev = F.floor(F.col("_g") / b) - 1
        trail = (g.withColumn("_bucket", F.explode(F.sequence(F.greatest(first_prev, F.lit(0).cast("long")),
                                                               F.greatest(last_prev, F.lit(-1).cast("long")))))
                  .where((F.col("_bucket") >= 0) & (F.col("_bucket") <= last_prev)
                         & (F.col("_g") < (F.col("_bucket") + 1) * b + ahead))
                  .withColumn("_halo", F.lit(True)).withColumn("_lead_halo", F.lit(False)))
        parts = parts.unionByName(trail)
    return parts.drop("_g")
