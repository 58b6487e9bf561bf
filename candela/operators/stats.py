"""Descriptive statistics and chart-ready tables (D-13...D-19, D-24, G2-G7, C26).

Everything is per ticker: aggregates grouped by ``Ticker`` (partial
aggregation before the shuffle) or windows partitioned by ``Ticker``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.expr import inv_normal
from candela.operators.features import w_series
from candela.operators.quantiles import exact_quantiles
from candela.operators.scan import affine_scan, product_map


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """D-13: equal-width bins over [min, max] per ticker, last bin closed;
    empty bins are present with count 0. Output: Ticker, bin, lo, hi, count, mean."""
    x = df.where(F.col(col).isNotNull())
    rng = x.groupBy("Ticker").agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"), F.avg(col).alias("mean"))
    width = (F.col("_mx") - F.col("_mn")) / bins
    b = x.join(rng, "Ticker").select(
        "Ticker",
        F.when(F.col("_mx") == F.col("_mn"), F.lit(0)).otherwise(
            F.least(F.floor((F.col(col) - F.col("_mn")) / width), F.lit(bins - 1))).cast("int").alias("bin"))
    counts = b.groupBy("Ticker", "bin").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    grid = rng.select("Ticker", "_mn", "_mx", "mean", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counts, ["Ticker", "bin"], "left")
            .select("Ticker", "bin",
                    (F.col("_mn") + F.col("bin") * (F.col("_mx") - F.col("_mn")) / bins).alias("lo"),
                    (F.col("_mn") + (F.col("bin") + 1) * (F.col("_mx") - F.col("_mn")) / bins).alias("hi"),
                    F.coalesce("count", F.lit(0).cast("bigint")).alias("count"), "mean"))


def box_by_year(df: DataFrame, col: str) -> DataFrame:
    """D-14/D-15/D-16: quartiles, 1.5 IQR whiskers (to the last datum inside) and
    flier counts per ticker and year."""
    x = df.where(F.col(col).isNotNull()).withColumn("year", F.year("Date"))
    q = exact_quantiles(x, ["Ticker", "year"], [col], [0.25, 0.5, 0.75])
    q = q.select(F.col("Ticker").alias("_t"), F.col("year").alias("_y"), F.col(f"{col}_n").alias("n"), F.col(f"{col}_q0").alias("q1"),
                 F.col(f"{col}_q1").alias("median"), F.col(f"{col}_q2").alias("q3"))
    lo_f = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    j = x.join(q, F.col("Ticker").eqNullSafe(F.col("_t")) & F.col("year").eqNullSafe(F.col("_y")))
    inside = (F.col(col) >= lo_f) & (F.col(col) <= hi_f)
    return j.groupBy("Ticker", "year", "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(col))).alias("whisker_lo"),
        F.max(F.when(inside, F.col(col))).alias("whisker_hi"),
        F.count_if(~inside).cast("bigint").alias("fliers"))


def pivot_day_month(df: DataFrame, col: str) -> DataFrame:
    """D-17: mean of ``col`` by weekday (rows) and month (columns m1..m12)."""
    x = df.withColumn("_dow", F.weekday("Date")).withColumn("_m", F.month("Date"))
    p = x.groupBy("Ticker", F.col("_dow").alias("Day_of_Week")).pivot("_m", list(range(1, 13))).agg(F.avg(col))
    return p.select("Ticker", "Day_of_Week", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


def autocorrelation(df: DataFrame, col: str, max_lag: int = 50, rows_per_bucket: int | None = None) -> DataFrame:
    """D-18: r_h = sum (x_t - m)(x_{t+h} - m) / sum (x_t - m)^2 with the full-series
    mean m, for h = 1..max_lag, plus the 95% / 99% bands +-z/sqrt(n).

    The lagged partners are ``lead`` columns of one window stage (no self-join).
    With ``rows_per_bucket`` the series is cut into row buckets that carry
    the next ``max_lag`` rows as a halo, so a long series is spread over
    many tasks; products start from real rows only.
    """
    x = df.where(F.col(col).isNotNull()).select("Ticker", "Date", col)
    m = x.groupBy("Ticker").agg(F.avg(col).alias("_m"), F.count(F.lit(1)).alias("_n"))
    c = x.join(m, "Ticker").withColumn("_c", F.col(col) - F.col("_m"))
    if rows_per_bucket:
        from candela.operators.halo import halo_parts
        c = halo_parts(c, 0, rows_per_bucket, "Date", trailing=True, ahead=max_lag)
        w = Window.partitionBy("Ticker", "_bucket").orderBy("Date")
        real = ~F.col("_halo")
    else:
        w = w_series()
        real = F.lit(True)
    prods = c.select("Ticker", "_n", F.when(real, F.col("_c") * F.col("_c")).alias("_c0"),
                     *[F.when(real, F.col("_c") * F.lead("_c", h).over(w)).alias(f"_p{h}")
                       for h in range(1, max_lag + 1)])
    s = prods.groupBy("Ticker").agg(F.first("_n").alias("n"), F.sum("_c0").alias("_den"),
                                    *[F.sum(f"_p{h}").alias(f"_p{h}") for h in range(1, max_lag + 1)])
    stack = "stack({}, {}) as (lag, _num)".format(max_lag, ", ".join(f"{h}, _p{h}" for h in range(1, max_lag + 1)))
    long = s.selectExpr("Ticker", "n", "_den", stack)
    sq = F.sqrt(F.col("n").cast("double"))
    return long.select("Ticker", F.col("lag").cast("int").alias("lag"),
                       F.when(F.col("_den") != 0, F.coalesce(F.col("_num"), F.lit(0.0)) / F.col("_den")).alias("acf"),
                       (F.lit(1.96) / sq).alias("band95"), (F.lit(2.58) / sq).alias("band99"))


def qq_points(df: DataFrame, col: str, value_chunks: int = 4096) -> DataFrame:
    """D-19: ordered sample vs normal quantiles of Filliben's order-statistic medians,
    with the least-squares line per ticker.

    Ranks come from ``global_row_index`` ordered by the value, chunked by
    value range per ticker, so no task sorts a whole series.
    """
    from candela.operators.halo import global_row_index
    x = df.where(F.col(col).isNotNull()).select("Ticker", F.col(col).alias("sample"))
    rng = x.groupBy("Ticker").agg(F.min("sample").alias("_lo"), F.max("sample").alias("_hi"),
                                  F.count(F.lit(1)).alias("n"))
    x = x.join(rng, "Ticker")
    width = F.greatest((F.col("_hi") - F.col("_lo")) / value_chunks, F.lit(1e-300))
    chunk = F.least(F.floor((F.col("sample") - F.col("_lo")) / width), F.lit(value_chunks - 1))
    r = global_row_index(x, "sample", chunk).withColumn("i", F.col("_g") + 1).drop("_g", "_lo", "_hi")
    med = (F.when(F.col("i") == 1, 1 - F.pow(F.lit(0.5), 1 / F.col("n")))
           .when(F.col("i") == F.col("n"), F.pow(F.lit(0.5), 1 / F.col("n")))
           .otherwise((F.col("i") - 0.3175) / (F.col("n") + 0.365)))
    r = r.withColumn("theoretical", inv_normal(med))
    line = r.groupBy("Ticker").agg(F.regr_slope("sample", "theoretical").alias("slope"),
                                   F.regr_intercept("sample", "theoretical").alias("intercept"))
    return r.join(line, "Ticker").select("Ticker", F.col("i").cast("int").alias("i"), "theoretical", "sample",
                                         "slope", "intercept")


def tail_n(df: DataFrame, n: int = 100) -> DataFrame:
    """D-24: the last n rows of every series (planned as a per-partition window limit)."""
    w = Window.partitionBy("Ticker").orderBy(F.col("Date").desc())
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def candlesticks(bars: DataFrame, n: int = 100) -> DataFrame:
    """Last n bars with the candle colour."""
    t = tail_n(bars, n)
    return t.withColumn("candle", F.when(F.col("Close") >= F.col("Open"), "up").otherwise("down"))


def indicator_panel(feats: DataFrame, signal: str = "Signal_line", overbought: float = 70, oversold: float = 30) -> DataFrame:
    """Bollinger bands rebuilt from mid/std, RSI zone flags, MACD histogram,
    volume in millions."""
    return feats.select(
        "Ticker", "Date", "Close",
        (F.col("BB_Middle") + 2 * F.col("BB_Std")).alias("BB_Upper"), "BB_Middle",
        (F.col("BB_Middle") - 2 * F.col("BB_Std")).alias("BB_Lower"),
        "RSI", (F.col("RSI") > overbought).alias("overbought"), (F.col("RSI") < oversold).alias("oversold"),
        "MACD", F.col(signal).alias("Signal"), (F.col("MACD") - F.col(signal)).alias("MACD_Hist"),
        (F.col("Volume") / 1e6).alias("Volume_M"))


def price_range(bars: DataFrame) -> DataFrame:
    """High/Low envelope with Close."""
    return bars.select("Ticker", "Date", "High", "Low", "Close")


def cumulative_return(df: DataFrame, col: str, position: str | None = None, spread: bool = False) -> DataFrame:
    """Running product of (1 + r) per ticker, 0 from the first r <= -1 on (an affine scan, exact for any length)."""
    grown = F.when(F.col(col) <= -1, F.lit(0.0)).otherwise(1 + F.col(col))
    return affine_scan(df, {"cum_return": product_map(grown)}, position=position, spread=spread).select("Ticker", "Date", col, "cum_return")
