"""Invariants: no look-ahead, partition independence, panel = union of series, bounds."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from candela.operators import cleaning as cl
from candela.operators import features as fe
from candela.plans import catalog
from candela.sources import bars as src


def _feats(spark, bars, profile="backend"):
    return fe.features(cl.clean_stock_data(bars), profile)


def test_no_lookahead(spark):
    bars = src.bars_daily(spark, SF_SMALL).where(F.col("Ticker") == "A").cache()
    cut = F.lit("1999-06-01").cast("date")
    full = _feats(spark, bars).where(F.col("Date") < cut).drop("Target")
    # change every row after the cut: features before it must not move
    changed = bars.withColumn("Close", F.when(F.col("Date") > cut, F.col("Close") * 3).otherwise(F.col("Close")))
    part = _feats(spark, changed).where(F.col("Date") < cut).drop("Target")
    assert full.exceptAll(part).count() == 0 and part.exceptAll(full).count() == 0


def test_partition_count_independent(spark):
    bars = src.bars_daily(spark, SF_SMALL).cache()
    a = _feats(spark, bars.repartition(1), "pipeline")
    b = _feats(spark, bars.repartition(7), "pipeline")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_panel_equals_union_of_series(spark):
    bars = src.bars_daily(spark, SF_SMALL).cache()
    panel = _feats(spark, bars, "prep")
    single = None
    for t in [r[0] for r in bars.select("Ticker").distinct().collect()]:
        one = _feats(spark, bars.where(F.col("Ticker") == t), "prep")
        single = one if single is None else single.unionByName(one)
    assert panel.exceptAll(single).count() == 0 and single.exceptAll(panel).count() == 0


def test_rsi_and_metric_bounds(spark):
    f = catalog.QUERIES["features_pipeline"](spark, SF_SMALL)
    mn, mx = f.agg(F.min("RSI"), F.max("RSI")).first()
    assert 0 <= mn <= mx <= 100
    m = catalog.QUERIES["metrics"](spark, SF_SMALL)
    for r in m.collect():
        for c in ("accuracy", "precision", "recall", "f1"):
            assert 0.0 <= r[c] <= 1.0


def test_forecast_band_contains_path(spark):
    p = catalog.QUERIES["forecast_path"](spark, SF_SMALL)
    assert p.where(~((F.col("Lower") <= F.col("Close")) & (F.col("Close") <= F.col("Upper")))).count() == 0
    assert p.groupBy("Ticker").count().where("count != 30").count() == 0


def test_halo_buckets_equal_whole_series(spark):
    bars = cl.clean_stock_data(src.bars_daily(spark, SF_SMALL)).cache()
    for prof in ("pipeline", "app", "backend"):
        a = fe.features(bars, prof)
        h = fe.halo_features(bars, prof, rows_per_bucket=200)
        assert a.exceptAll(h).count() == 0 and h.exceptAll(a).count() == 0
    plan = fe.halo_features(bars, "prep", 200)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(Ticker" in plan and "_bucket" in plan


def test_qq_ranks_and_quantiles(spark):
    from statistics import NormalDist
    from pyspark.sql import Window
    q = catalog.QUERIES["qq_points"](spark, SF_SMALL).cache()
    f = catalog._pipe(spark, SF_SMALL).where(F.col("Returns").isNotNull())
    ref = f.select("Ticker", F.row_number().over(Window.partitionBy("Ticker").orderBy("Returns")).alias("i"),
                   F.col("Returns").alias("sample"))
    assert q.select("Ticker", "i", "sample").exceptAll(ref).count() == 0
    rows = q.where("Ticker = 'A'").collect()
    n = len(rows)
    for r in rows:
        i = r["i"]
        m = 1 - 0.5 ** (1 / n) if i == 1 else (0.5 ** (1 / n) if i == n else (i - 0.3175) / (n + 0.365))
        assert abs(NormalDist().inv_cdf(m) - r["theoretical"]) < 1e-8


def test_acf_halo_equals_whole_series(spark):
    from candela.operators import stats as stt
    f = catalog._pipe(spark, SF_SMALL)
    a = stt.autocorrelation(f, "Returns", 50).select("Ticker", "lag", F.round("acf", 9).alias("acf"))
    b = stt.autocorrelation(f, "Returns", 50, rows_per_bucket=128).select("Ticker", "lag", F.round("acf", 9).alias("acf"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_features_switch_to_halo_for_long_series(spark):
    bars = cl.clean_stock_data(src.bars_daily(spark, SF_SMALL)).cache()
    a = fe.features(bars, "prep")
    b = fe.features(bars, "prep", rows_per_task=300)      # series are ~1,400 rows: bucketed
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_quality_paths_equal_with_halo(spark):
    raw = src.with_defects(src.bars_daily(spark, SF_SMALL)).cache()
    a, b = cl.quality_report(raw), cl.quality_report(raw, rows_per_task=300)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    c, d = cl.clean_data(raw), cl.clean_data(raw, rows_per_task=300)
    assert c.exceptAll(d).count() == 0 and d.exceptAll(c).count() == 0
