"""Walk-forward validation folds (E1-E5, E15) on a panel calendar.

Folds are cut on the ordinal ``d`` of the panel's distinct dates, so every
ticker shares the same train/test boundaries (no leakage across tickers with
different calendars). With one ticker, ``d`` is the row position.

Fold i (test start, from ``start`` by ``step``) has
  train: d <  train_end = i - gap        (expanding window)
  test:  i <= d < test_end = min(i + step, n)
and is skipped when train_end <= 0, train_end < min_train or the test span
is shorter than min_test.

The calendar has one row per distinct date (bounded by the length of the
date range, not by the number of rows or tickers); its ordinal comes from a
window over that small table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WalkForward:
    ratio: float = 0.7
    step: int = 250
    gap: int = 21
    min_train: int = 50
    min_test: int = 10
    start: int | None = None


PIPELINE_WF = WalkForward()                                   # purge gap 21, skip rule
PLAIN_WF = WalkForward(gap=0, min_train=1, min_test=1)        # expanding, no gap, no skip


def calendar(df: DataFrame, date_col: str = "Date") -> DataFrame:
    """Distinct dates with their 0-based ordinal ``d``."""
    dates = df.select(date_col).distinct()
    return dates.withColumn("d", (F.row_number().over(Window.orderBy(date_col)) - 1).cast("int"))


def folds(cal: DataFrame, wf: WalkForward = PIPELINE_WF) -> DataFrame:
    """Fold table ``fold_id, test_start, test_end, train_end, n_dates``."""
    n = cal.agg(F.count(F.lit(1)).cast("int").alias("n"))
    start = F.lit(wf.start) if wf.start is not None else F.floor(F.col("n") * F.lit(wf.ratio)).cast("int")
    seq = F.when(start <= F.col("n") - 1, F.sequence(start, F.col("n") - 1, F.lit(wf.step))).otherwise(
        F.array().cast("array<int>"))
    f = n.select("n", F.posexplode(seq).alias("fold_id", "test_start"))
    f = f.select(
        F.col("fold_id").cast("int"), F.col("test_start").cast("int"),
        F.least(F.col("test_start") + wf.step, F.col("n")).cast("int").alias("test_end"),
        (F.col("test_start") - wf.gap).cast("int").alias("train_end"),
        F.col("n").alias("n_dates"))
    keep = ((F.col("train_end") > 0) & (F.col("train_end") >= wf.min_train)
            & ((F.col("test_end") - F.col("test_start")) >= wf.min_test))
    return f.where(keep)


def with_date_ordinal(df: DataFrame, cal: DataFrame) -> DataFrame:
    """Attach ``d``; the calendar side is small and AQE broadcasts it from its measured size."""
    return df.join(cal, "Date")


def test_map(fold_table: DataFrame) -> DataFrame:
    """(d, fold_id) for every date ordinal inside a kept fold's test span.

    At most one row per calendar date: the size is bounded by the calendar.
    """
    return fold_table.select(
        "fold_id", "train_end",
        F.explode(F.sequence(F.col("test_start"), F.col("test_end") - 1)).alias("d"))


def assign_test(df: DataFrame, fold_table: DataFrame) -> DataFrame:
    """E5: rows of kept test spans, tagged with ``fold_id`` and ``train_end``
    (an equi-join on the date ordinal; no range join)."""
    return df.join(test_map(fold_table), "d")


def train_rows(df: DataFrame, train_end: int) -> DataFrame:
    """The expanding training window of one fold (``d < train_end``)."""
    return df.where(F.col("d") < F.lit(train_end))


def fold_train_counts(df: DataFrame, fold_table: DataFrame, label: str = "Target") -> DataFrame:
    """Per fold: training rows, training positives and test rows.

    Training sets are nested (expanding), so per-date counts are summed
    cumulatively over the calendar and read at ``d = train_end - 1``: an
    equi-join on the date ordinal instead of a rows x folds range join.
    Every ordinal of the calendar has rows, because the calendar is built
    from the same frame.
    """
    per_d = df.groupBy("d").agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_pos"))
    run = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    cum = per_d.select((F.col("d") + 1).alias("train_end"),
                       F.sum("_n").over(run).alias("train_rows"),
                       F.sum("_pos").over(run).alias("train_pos"))
    tests = assign_test(df, fold_table).groupBy("fold_id").agg(F.count(F.lit(1)).alias("test_rows"))
    return (fold_table.select("fold_id", "train_end", "test_start", "test_end")
            .join(cum, "train_end", "left").join(tests, "fold_id", "left")
            .select("fold_id", "train_end", "test_start", "test_end",
                    F.coalesce("train_rows", F.lit(0)).cast("bigint").alias("train_rows"),
                    F.coalesce("train_pos", F.lit(0)).cast("bigint").alias("train_pos"),
                    F.coalesce("test_rows", F.lit(0)).cast("bigint").alias("test_rows")))
