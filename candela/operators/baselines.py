"""Rule models M1 (naive) and M2 (moving average) over walk-forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.operators import folds as fo
from candela.functions.expr import pct_change
from candela.operators.features import moving_average, w_series


def with_forward_return(df: DataFrame) -> DataFrame:
    """Next-row return of each series (the return a position taken today earns)."""
    return df.withColumn("fwd_return", pct_change(F.lead("Close", 1).over(w_series()), F.col("Close")))


def naive_predictions(feats: DataFrame, wf: fo.WalkForward = fo.PLAIN_WF) -> DataFrame:
    """M1: yesterday's direction, restarting at 0 on the first row of every test fold."""
    df = with_forward_return(feats.na.drop())
    cal = fo.calendar(df)
    t = fo.assign_test(fo.with_date_ordinal(df, cal), fo.folds(cal, wf))
    w = Window.partitionBy("Ticker", "fold_id").orderBy("Date")
    return t.select(F.lit("NaiveBaseline").alias("model"), "fold_id", "Ticker", "Date", "Target",
                    F.lag("Target", 1, 0).over(w).cast("int").alias("Predictions"), "fwd_return")


def ma_predictions(feats: DataFrame, n: int = 60, wf: fo.WalkForward = fo.PLAIN_WF) -> DataFrame:
    """M2: 1 when Close is above its n-row moving average."""
    df = with_forward_return(moving_average(feats, n).na.drop(subset=[f"MA_{n}"]).na.drop())
    cal = fo.calendar(df)
    t = fo.assign_test(fo.with_date_ordinal(df, cal), fo.folds(cal, wf))
    return t.select(F.lit("MovingAverage").alias("model"), "fold_id", "Ticker", "Date", "Target",
                    (F.col("Close") > F.col(f"MA_{n}")).cast("int").alias("Predictions"), "fwd_return")


def rule_predictions(df: DataFrame, wf: fo.WalkForward, ratio: str = "Close_Ratio_60") -> DataFrame:
    """M1 and M2 on the very rows, calendar and folds that a model's back-test of ``df`` uses.

    ``ratio`` is Close over its moving average, so the moving-average rule is ``ratio > 1``.
    """
    cal = fo.calendar(df)
    t = fo.assign_test(fo.with_date_ordinal(df, cal), fo.folds(cal, wf))
    w = Window.partitionBy("Ticker", "fold_id").orderBy("Date")
    keep = ["fold_id", "Ticker", "Date", "Target", F.lit(None).cast("double").alias("probability")]
    naive = t.select(F.lit("NaiveBaseline").alias("model"), *keep, F.lag("Target", 1, 0).over(w).cast("int").alias("Predictions"), "fwd_return")
    return naive.unionByName(t.select(F.lit("MovingAverage").alias("model"), *keep, (F.col(ratio) > 1).cast("int").alias("Predictions"), "fwd_return"))
