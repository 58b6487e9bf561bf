"""File sources/sinks (A1-A5) and their physical plans: partition pruning on
Ticker, date predicates pushed to the Parquet scan, column pruning."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from candela.sources import bars as src


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitioned_bars_prune_and_push(spark):
    out = tempfile.mkdtemp(prefix="candela-bars-", dir="/tmp") + "/bars"
    bars = src.bars_daily(spark, SF_SMALL)
    src.write_bars(bars, out)
    got = src.read_bars(spark, out, tickers=["A", "R"], start="1996-01-01", end="1998-01-01")
    plan = _plan(got.select("Ticker", "Date", "Close"))
    import re
    assert re.search(r"PartitionFilters: \[Ticker#\d+ IN \(A,R\)\]", plan)
    assert "PushedFilters: [IsNotNull(Date), GreaterThanOrEqual(Date,1996-01-01), LessThan(Date,1998-01-01)]" in plan
    assert "ReadSchema: struct<Date:date,Close:double>" in plan
    expect = bars.where(F.col("Ticker").isin("A", "R") & (F.col("Date") >= "1996-01-01") & (F.col("Date") < "1998-01-01"))
    assert got.exceptAll(expect.select(*got.columns)).count() == 0
    assert expect.select(*got.columns).exceptAll(got).count() == 0


def test_csv_round_trip_with_ingest_order(spark):
    out = tempfile.mkdtemp(prefix="candela-csv-", dir="/tmp")
    bars = src.bars_daily(spark, SF_SMALL).where(F.col("Ticker") == "A")
    bars.drop("Ticker").coalesce(1).write.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(f"{out}/a_stock_data")
    got = src.read_bar_csv(spark, f"{out}/a_stock_data/*.csv")
    assert got.count() == bars.count()
    assert got.select(F.countDistinct("_ord")).first()[0] == bars.count()


def test_feature_scan_prunes_columns(spark):
    from candela.operators import features as fe
    f = fe.features(src.bars_daily(spark, SF_SMALL), "pipeline").select("Ticker", "Date", "RSI")
    plan = _plan(f)
    # lineitem columns not needed by the bars are never read
    assert "l_discount" not in plan and "l_tax" not in plan and "l_suppkey" not in plan
