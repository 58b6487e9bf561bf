"""Technical-indicator features over a bar panel.

One window spec ``w = partitionBy(Ticker).orderBy(Date)`` is used for every
feature, so Catalyst plans a single shuffle and sort for the whole stage
(adjacent Window nodes with the same spec are merged). Features that read
other window results are computed in later ``select`` stages over the same
spec, which adds Window nodes but no exchange.

Four profiles fix names, horizons and lags:
``pipeline`` (Returns, Signal_Line, horizons 5/60, trend shift 2, OHLV dropped,
only Target must be non-null), ``prep`` (returns, Signal_line, 2/5/60/250,
shift 2, OHLCV kept, all-null drop), ``app`` (as pipeline but 2/5/60/250,
shift 1, all-null drop) and ``backend`` (every feature lagged one day).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from candela.functions.expr import (
    fdiv, pct_change, rolling_mean, rolling_std, rolling_sum, series_window,
)
from candela.operators.scan import affine_scan, ema_map

DEFAULT_HORIZONS = (2, 5, 60, 250)


@dataclass(frozen=True)
class Profile:
    name: str
    returns: str
    signal: str
    horizons: tuple
    trend_shift: int
    keep_ohlcv: bool
    dropna_all: bool


PIPELINE = Profile("pipeline", "Returns", "Signal_Line", (5, 60), 2, False, False)
PREP = Profile("prep", "returns", "Signal_line", DEFAULT_HORIZONS, 2, True, True)
APP = Profile("app", "Returns", "Signal_Line", DEFAULT_HORIZONS, 1, False, True)
PROFILES = {p.name: p for p in (PIPELINE, PREP, APP)}


def w_series() -> WindowSpec:
    return series_window("Ticker", "Date")


# ------------------------------------------------------------------ primitives

def target(w: WindowSpec | None = None) -> Column:
    """1 when the next close is higher, else 0 (the last row is 0)."""
    w = w or w_series()
    return F.coalesce((F.lead("Close", 1).over(w) > F.col("Close")).cast("int"), F.lit(0))


def returns(c: str = "Close", k: int = 1, w: WindowSpec | None = None) -> Column:
    """K-period percentage change."""
    w = w or w_series()
    return pct_change(F.col(c), F.lag(c, k).over(w))


def log_returns(w: WindowSpec | None = None) -> Column:
    """ln(Close / previous Close)."""
    w = w or w_series()
    return F.log(fdiv(F.col("Close"), F.lag("Close", 1).over(w)))


def rsi_parts(w: WindowSpec, n: int = 14) -> tuple[Column, Column]:
    """Mean gain and mean loss over n rows; the first row's change counts as 0."""
    delta = F.col("Close") - F.lag("Close", 1).over(w)
    gain = F.when(delta > 0, delta).otherwise(F.lit(0.0))
    loss = F.when(delta < 0, -delta).otherwise(F.lit(0.0))
    return gain, loss


def rsi_from(avg_gain: Column, avg_loss: Column) -> Column:
    """100 - 100/(1+gain/loss); 100 when loss is 0 < gain, null when both are 0."""
    return (F.when(avg_loss == 0, F.when(avg_gain > 0, F.lit(100.0)))
            .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + avg_gain / avg_loss)))


def close_ratio(h: int, w: WindowSpec | None = None) -> Column:
    """C20: Close / mean of the last h closes."""
    w = w or w_series()
    return fdiv(F.col("Close"), rolling_mean(F.col("Close"), h, w))


def trend(h: int, shift: int, w: WindowSpec | None = None, col: str = "Target") -> Column:
    """Sum of ``Target`` over h rows ending ``shift`` rows back."""
    w = w or w_series()
    return rolling_sum(F.col(col), h, w, shift).cast("double")


def calendar(date_col: str = "Date") -> dict[str, Column]:
    """Monday=0 weekday, month, year."""
    return {"Day_of_Week": F.weekday(date_col), "Month": F.month(date_col), "Year": F.year(date_col)}


def obv_step(w: WindowSpec | None = None) -> Column:
    """C18 step: sign(Close change) * Volume, 0 on the first row.

    OBV is the running sum of this step; it needs its own select stage
    (``F.sum(step).over(running frame)``).
    """
    w = w or w_series()
    return F.coalesce(F.signum(F.col("Close") - F.lag("Close", 1).over(w)) * F.col("Volume"), F.lit(0.0))


def cum_return(r: str, w: WindowSpec | None = None) -> Column:
    """Running product of (1 + r); 0 from the first r <= -1 on."""
    w = w or w_series()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    wiped = F.min(F.col(r)).over(run) <= -1
    return F.when(wiped, F.lit(0.0)).otherwise(F.exp(F.sum(F.log1p(F.col(r))).over(run)))


def with_emas(bars: DataFrame, position: str | None = None, spread: bool = False) -> DataFrame:
    """``EMA_12``, ``EMA_26`` and ``_signal``, the EMA-9 of their difference, by affine scans over whole series."""
    x = affine_scan(bars, {"EMA_12": ema_map(F.col("Close"), 12), "EMA_26": ema_map(F.col("Close"), 26)}, position=position, spread=spread)
    return affine_scan(x, {"_signal": ema_map(F.col("EMA_12") - F.col("EMA_26"), 9)}, position=position, spread=spread)


# ------------------------------------------------------------------ profiles

def technical_features(bars: DataFrame, profile: Profile = PIPELINE, keys: tuple = ("Ticker",)) -> DataFrame:
    """C1-C25, C28 for the ``pipeline``, ``prep`` and ``app`` profiles.

    ``bars`` come from ``with_emas``. Stages: (1) window values read once each (lags, lead, rolling
    means); (2) row arithmetic on them; (3) windows over stage-2 columns;
    (4) final arithmetic. Each window aggregate is evaluated exactly once.
    ``keys`` partitions the windows (``halo_features`` adds a bucket key).
    """
    w = series_window(list(keys), "Date")
    p = profile
    s1 = bars.select(
        "*",
        F.lag("Close", 1).over(w).alias("_pc"),
        F.lag("Volume", 1).over(w).alias("_pv"),
        F.lead("Close", 1).over(w).alias("_nc"),
        rolling_mean(F.col("Close"), 20, w).alias("BB_Middle"),
        rolling_std(F.col("Close"), 20, w).alias("BB_Std"),
        *[rolling_mean(F.col("Close"), h, w).alias(f"_m{h}") for h in p.horizons],
    )
    pc = F.col("_pc")
    delta = F.col("Close") - pc
    upper = F.col("BB_Middle") + 2 * F.col("BB_Std")
    lower = F.col("BB_Middle") - 2 * F.col("BB_Std")
    s2 = s1.select(
        "*",
        F.coalesce((F.col("_nc") > F.col("Close")).cast("int"), F.lit(0)).alias("Target"),
        pct_change(F.col("Close"), pc).alias("_ret"),
        F.log(fdiv(F.col("Close"), pc)).alias("Log_Returns"),
        fdiv(F.col("High") - F.col("Low"), F.col("Close")).alias("High_Low_Pct"),
        fdiv(F.col("Open") - pc, pc).alias("Gap_Pct"),
        pct_change(F.col("Volume"), F.col("_pv")).alias("Volume_Pct_Change"),
        F.when(delta > 0, delta).otherwise(F.lit(0.0)).alias("_gain"),
        F.when(delta < 0, -delta).otherwise(F.lit(0.0)).alias("_loss"),
        (F.col("EMA_12") - F.col("EMA_26")).alias("MACD"),
        fdiv(F.col("Close") - lower, upper - lower).alias("BB_Position"),
        *[fdiv(F.col("Close"), F.col(f"_m{h}")).alias(f"Close_Ratio_{h}") for h in p.horizons],
    )
    s3 = s2.select(
        "*",
        rolling_mean(F.col("_gain"), 14, w).alias("_ag"),
        rolling_mean(F.col("_loss"), 14, w).alias("_al"),
        rolling_std(F.col("_ret"), 10, w).alias("Volatility_10"),
        F.col("_signal").alias(p.signal),
        *[trend(h, p.trend_shift, w).alias(f"Trend_{h}") for h in p.horizons],
    )
    s4 = s3.withColumn("RSI", rsi_from(F.col("_ag"), F.col("_al"))).withColumnRenamed("_ret", p.returns)
    horizon_cols = []
    for h in p.horizons:
        horizon_cols += [f"Close_Ratio_{h}", f"Trend_{h}"]
    head = ["Ticker", "Date"] + (["Open", "High", "Low", "Close", "Volume"] if p.keep_ohlcv else ["Close"])
    body = ["Target", p.returns] if p.name == "prep" else [p.returns]
    body += ["Log_Returns", "High_Low_Pct", "Gap_Pct", "Volume_Pct_Change", "RSI", "MACD",
             p.signal, "BB_Middle", "BB_Std", "BB_Position", "Volatility_10"]
    if p.name != "prep":
        body += ["Target"]
    extra = [k for k in keys if k != "Ticker"] + [c for c in bars.columns if c.startswith("_halo")]
    out = s4.select(*head, *body, *horizon_cols,
                    F.weekday("Date").alias("Day_of_Week"), F.month("Date").alias("Month"), *extra)
    if extra:                                        # halo rows leave before the null drop
        out = out.where(~F.col("_halo")).drop(*extra)
    return out.na.drop() if p.dropna_all else out.na.drop(subset=["Target"])


# Longest lookback of the windows: 250 rows of a trend, shifted by 2, and some rows for lags. EMAs are scanned before.
TECH_LOOKBACK = max(DEFAULT_HORIZONS) + 10


from candela.operators.halo import global_row_index, halo_parts  # noqa: E402


def halo_features(bars: DataFrame, profile: str = "pipeline", rows_per_bucket: int = 4096,
                  lookback: int = TECH_LOOKBACK) -> DataFrame:
    """``technical_features`` computed on buckets of ``rows_per_bucket`` rows
    per series, each with a copy of the ``lookback`` rows before it and of the
    first row after it. EMAs, which have no finite lookback, are scanned over whole series before. Every real row sees the same frames as in the
    unbucketed series, so results are identical, while one long series is
    spread over many tasks (a hot ticker no longer lands in one task).
    """
    placed = global_row_index(bars, "Date").withColumnRenamed("_g", "_place")
    parts = halo_parts(with_emas(placed, "_place", spread=True).drop("_place"), lookback, rows_per_bucket, "Date")
    if profile == "backend":
        return backend_features(parts, keys=("Ticker", "_bucket"))
    return technical_features(parts.drop("_lead_halo"), PROFILES[profile], keys=("Ticker", "_bucket"))


BACKEND_RETURN_LAGS = (1, 3, 5, 10, 21)
BACKEND_VOL_WINDOWS = (5, 10, 21)
BACKEND_MA_WINDOWS = (5, 10, 20, 50)
BACKEND_EXCLUDE = ("Close", "Target", "Day_of_Week", "Month")


def backend_features(bars: DataFrame, keys: tuple = ("Ticker",)) -> DataFrame:
    """C2-C21 of the ``backend`` profile: every feature lagged one day except
    Log_Returns and the calendar; Open/High/Low/Volume dropped; all-null drop.
    Staged like ``technical_features`` so each window value is read once.
    With a bucket key (``halo_features``) the running OBV gets the step total
    of earlier buckets added and the leading halo's steps removed."""
    w = series_window(list(keys), "Date")
    bucketed = "_bucket" in keys
    lags = sorted({1} | {1 + k for k in BACKEND_RETURN_LAGS})
    s1 = bars.select(
        "*",
        *[F.lag("Close", k).over(w).alias(f"_c{k}") for k in lags],
        F.lead("Close", 1).over(w).alias("_nc"),
        F.lag(fdiv(F.col("High") - F.col("Low"), F.col("Close")), 1).over(w).alias("High_Low_Pct"),
        rolling_mean(F.col("Close"), 20, w).alias("_bb_mid"),
        rolling_std(F.col("Close"), 20, w).alias("_bb_std"),
        rolling_mean(F.col("Volume"), 20, w).alias("_vol_mean"),
        *[rolling_mean(F.col("Close"), m, w).alias(f"_mean{m}") for m in BACKEND_MA_WINDOWS],
    )
    pc = F.col("_c1")
    delta = F.col("Close") - pc
    upper = F.col("_bb_mid") + 2 * F.col("_bb_std")
    lower = F.col("_bb_mid") - 2 * F.col("_bb_std")
    s2 = s1.select(
        "*",
        F.coalesce((F.col("_nc") > F.col("Close")).cast("int"), F.lit(0)).alias("Target"),
        *[pct_change(F.col("_c1"), F.col(f"_c{1 + k}")).alias(f"Returns_{k}d") for k in BACKEND_RETURN_LAGS],
        F.log(fdiv(F.col("Close"), pc)).alias("Log_Returns"),
        F.when(delta > 0, delta).otherwise(F.lit(0.0)).alias("_gain"),
        F.when(delta < 0, -delta).otherwise(F.lit(0.0)).alias("_loss"),
        F.coalesce(F.signum(delta) * F.col("Volume"), F.lit(0.0)).alias("_obv_step"),
        fdiv(F.col("Open") - pc, pc).alias("_gap"),
        (F.col("EMA_12") - F.col("EMA_26")).alias("_macd"),
        fdiv(F.col("Close") - lower, upper - lower).alias("_bb_pos"),
        fdiv(upper - lower, F.col("_bb_mid")).alias("_bb_width"),
        fdiv(F.col("Volume"), F.col("_vol_mean")).alias("_vol_ratio"),
        *[fdiv(F.col("Close"), F.col(f"_mean{m}")).alias(f"_ma{m}") for m in BACKEND_MA_WINDOWS],
    )
    running = F.sum("_obv_step").over(w.rowsBetween(Window.unboundedPreceding, -1))
    if bucketed:
        # steps of real rows per bucket -> running total of all earlier buckets (small table)
        tot = (s2.where(~F.col("_halo")).groupBy("Ticker", "_bucket").agg(F.sum("_obv_step").alias("_bt")))
        prev = tot.select("Ticker", "_bucket", F.coalesce(F.sum("_bt").over(
            Window.partitionBy("Ticker").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0.0)).alias("_before"))
        s2 = s2.join(prev, ["Ticker", "_bucket"], "left")
        whole = Window.partitionBy(*keys)
        lead_sum = F.sum(F.when(F.col("_lead_halo"), F.col("_obv_step")).otherwise(F.lit(0.0))).over(whole)
        first = F.row_number().over(w) == 1
        # the partition's first row has no running sum: the series start (bucket 0),
        # or the oldest halo row, which no real row reads
        running = F.when(first, F.lit(None)).otherwise(
            F.coalesce(F.col("_before"), F.lit(0.0)) - lead_sum + F.coalesce(running, F.lit(0.0)))
    s3 = s2.select(
        "*",
        *[rolling_std(F.col("Returns_1d"), k, w, shift=1).alias(f"Volatility_{k}d") for k in BACKEND_VOL_WINDOWS],
        rolling_mean(F.col("_gain"), 14, w).alias("_ag"),
        rolling_mean(F.col("_loss"), 14, w).alias("_al"),
        running.alias("OBV"),
        F.lag("_gap", 1).over(w).alias("Gap_Pct"),
    )
    s4 = s3.select(
        "*",
        rsi_from(F.col("_ag"), F.col("_al")).alias("_rsi"),
        F.lag("OBV", 1).over(w).alias("_obv1"),
        F.lag("OBV", 6).over(w).alias("_obv6"),
    )
    out = s4.select(
        "Ticker", "Date", "Close",
        *[f"Returns_{k}d" for k in BACKEND_RETURN_LAGS],
        "Log_Returns",
        *[f"Volatility_{k}d" for k in BACKEND_VOL_WINDOWS],
        F.lag("_rsi", 1).over(w).alias("RSI_14"),
        F.lag("_macd", 1).over(w).alias("MACD"),
        F.lag("_signal", 1).over(w).alias("MACD_Signal"),
        F.lag(F.col("_macd") - F.col("_signal"), 1).over(w).alias("MACD_Hist"),
        F.lag("_bb_pos", 1).over(w).alias("BB_Position"),
        F.lag("_bb_width", 1).over(w).alias("BB_Width"),
        F.lag("_vol_ratio", 1).over(w).alias("Volume_Ratio_20d"),
        "OBV",
        pct_change(F.col("_obv1"), F.col("_obv6")).alias("OBV_Change_5d"),
        "High_Low_Pct", "Gap_Pct",
        *[F.lag(f"_ma{m}", 1).over(w).alias(f"Close_MA_{m}_Ratio") for m in BACKEND_MA_WINDOWS],
        "Target",
        F.weekday("Date").alias("Day_of_Week"), F.month("Date").alias("Month"),
        *(["_halo"] if bucketed else []),
    )
    if bucketed:
        out = out.where(~F.col("_halo")).drop("_halo")
    return out.na.drop()


def features(bars: DataFrame, profile: str = "pipeline", rows_per_task: int | None = None) -> DataFrame:
    """Indicator features of a profile.

    With ``rows_per_task`` the longest series is measured (one small grouped
    count); if it exceeds the bound, the halo-bucketed execution is used so
    no window task holds more than about ``rows_per_task`` + lookback rows.
    """
    if rows_per_task:
        longest = bars.groupBy("Ticker").count().agg(F.max("count")).first()[0] or 0
        if longest > rows_per_task:
            return halo_features(bars, profile, rows_per_bucket=rows_per_task)
    if profile == "backend":
        return backend_features(with_emas(bars))
    return technical_features(with_emas(bars), PROFILES[profile])


def backend_predictors(df: DataFrame) -> list[str]:
    """Every column except keys, Close, Target and calendar."""
    return [c for c in df.columns if c not in BACKEND_EXCLUDE + ("Ticker", "Date")]


def engineer_features(df: DataFrame, horizons=(5, 60), trend_shift: int = 2,
                      dropna: bool = True) -> tuple[DataFrame, list[str]]:
    """(re)compute Close_Ratio_h and Trend_h on the given rows, drop nulls.

    Windows run over the rows of ``df`` as given, so on an already filtered
    frame the horizons restart from its first row (as the reference does).
    """
    w = w_series()
    cols, preds = {}, []
    for h in horizons:
        cols[f"Close_Ratio_{h}"] = close_ratio(h, w)
        cols[f"Trend_{h}"] = trend(h, trend_shift, w)
        preds += [f"Close_Ratio_{h}", f"Trend_{h}"]
    out = df.withColumns(cols)
    return (out.na.drop() if dropna else out), preds


def moving_average(df: DataFrame, n: int = 60, col: str = "Close") -> DataFrame:
    """``MA_n`` column (null until n rows)."""
    return df.withColumn(f"MA_{n}", rolling_mean(F.col(col), n, w_series()))
