"""Hand-computed edge vectors (expected values worked out by hand / with pandas rules)."""

import datetime as dt
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import bars_frame
from candela.functions.expr import ema, fdiv, quantile_of_sorted, rolling_mean, sorted_frame
from candela.operators import cleaning as cl
from candela.operators import features as fe
from candela.sources.reference import business_days

CLOSES = [10, 11, 11, 9, 12, 12]


def _col(df, c):
    return [r[c] for r in df.orderBy("Date").collect()]


def test_gain_loss_target(spark):
    b = bars_frame(spark, CLOSES)
    w = fe.w_series()
    gain, loss = fe.rsi_parts(w)
    out = b.select("Date", gain.alias("g"), loss.alias("l"), fe.target(w).alias("t"))
    assert _col(out, "g") == [0, 1, 0, 0, 3, 0]
    assert _col(out, "l") == [0, 0, 0, 2, 0, 0]
    assert _col(out, "t") == [1, 0, 0, 1, 0, 0]


def test_obv_before_lag(spark):
    b = bars_frame(spark, CLOSES, volumes=[1, 2, 3, 4, 5, 6])
    w = fe.w_series()
    step = fe.obv_step(w)
    out = b.select("Date", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("obv"))
    assert _col(out, "obv") == [0, 2, 2, -2, 3, 3]


def test_flat_and_rising_rsi(spark):
    w = fe.w_series()
    for closes, expect in (([5.0] * 20, [None] * 20), (list(range(1, 21)), [None] * 13 + [100.0] * 7)):
        b = bars_frame(spark, closes)
        g, l = fe.rsi_parts(w)
        s = b.select("Ticker", "Date", g.alias("g"), l.alias("l"))
        out = s.select("Date", fe.rsi_from(rolling_mean("g", 14, w), rolling_mean("l", 14, w)).alias("rsi"))
        assert _col(out, "rsi") == expect


def test_volume_change_ieee(spark):
    b = bars_frame(spark, [1, 1, 1, 1], volumes=[0, 5, 0, 0])
    out = b.select("Date", fe.returns("Volume", 1).alias("v"))
    v = _col(out, "v")
    assert v[0] is None and v[1] == math.inf and v[2] == -1.0 and v[3] is None


def test_fdiv_signs(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(fdiv("a", "b")).collect()]
    assert got == [math.inf, -math.inf, None, 1.5]


def test_rolling_quantile_and_null_mean(spark):
    b = bars_frame(spark, [1, 2, 3, 10])
    w = fe.w_series()
    s = b.select("Date", sorted_frame("Close", 4, w).alias("a"))
    q = s.select("Date", quantile_of_sorted("a", 4, 0.25).alias("q"))
    assert _col(q, "q") == [None, None, None, 1.75]
    df = spark.createDataFrame([("T", dt.date(2020, 1, i + 1), v) for i, v in enumerate([1.0, None, 3.0, 10.0, 4.0])],
                               "Ticker string, Date date, x double")
    m = df.select("Date", rolling_mean("x", 2, w).alias("m"))
    assert _col(m, "m") == [None, None, None, 6.5, 7.0]


def test_ema_matches_recursion(spark):
    closes = [float(x) for x in [3, 5, 4, 8, 7, 9, 12, 11, 10, 13]]
    b = bars_frame(spark, closes)
    got = _col(b.select("Date", ema("Close", 3, fe.w_series()).alias("e")), "e")
    a, y, exp = 0.5, None, []
    for x in closes:
        y = x if y is None else a * x + (1 - a) * y
        exp.append(y)
    assert got == exp


def test_business_days_from_saturday(spark):
    last = spark.createDataFrame([("T", dt.date(2024, 1, 5))], "Ticker string, Date date")  # Friday
    got = [r["Date"] for r in business_days(last, 3).orderBy("step").collect()]
    assert got == [dt.date(2024, 1, 8), dt.date(2024, 1, 9), dt.date(2024, 1, 10)]


def test_keep_first(spark):
    rows = [("T", dt.date(2020, 1, 1), 1.0, 0), ("T", dt.date(2020, 1, 1), 2.0, 1), ("T", dt.date(2020, 1, 2), 3.0, 2)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, Close double, _ord long")
    assert [r["Close"] for r in cl.dedup_keep_first(df).orderBy("Date").collect()] == [1.0, 3.0]


def test_type_report_reports_missing(spark):
    df = spark.createDataFrame([("2020-01-01", 1.0, 1.1)], "Date string, Open double, Close double")
    rep = dict((c, (a, e)) for c, a, e in cl.type_report(df))
    assert rep["Date"] == ("string", "date")
    assert rep["High"][0] == "missing" and rep["Volume"][0] == "missing"


def test_missing_profile_hole(spark):
    rows = [("T", dt.date(2020, 1, i + 1), o, 1.0, 1.0, c, 1) for i, (o, c) in
            enumerate([(1.0, 1.1), (2.0, 2.1), (None, 3.1), (4.0, 4.1), (5.0, 5.1)])]
    from candela.schema import BAR
    df = spark.createDataFrame(rows, BAR)
    prof = {r["column"]: r["missing"] for r in cl.missing_profile(df).collect()}
    assert prof["Open"] == 1 and sum(prof.values()) == 1
