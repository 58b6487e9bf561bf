import datetime as dt

from pyspark.sql import functions as F

from candela.operators import folds as fo
from candela.operators import metrics as me


def test_all_zero_predictions(spark):
    df = spark.createDataFrame([("m", 0, 0)] * 4, "model string, Target int, Predictions int")
    r = me.classification_metrics(df).first()
    assert r["accuracy"] == 1.0 and r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0
    assert r["roc_auc"] is None and r["total_trades"] == 0


def test_metrics_bounds_and_values(spark):
    rows = [("m", 1, 1), ("m", 1, 0), ("m", 0, 1), ("m", 0, 0), ("m", 1, 1)]
    r = me.classification_metrics(spark.createDataFrame(rows, "model string, Target int, Predictions int")).first()
    assert r["tp"] == 2 and r["fp"] == 1 and r["fn"] == 1 and r["tn"] == 1
    assert abs(r["precision"] - 2 / 3) < 1e-12 and abs(r["recall"] - 2 / 3) < 1e-12
    assert abs(r["roc_auc"] - (2 / 3 + 1 / 2) / 2) < 1e-12


def test_rank_metric_is_validated(spark):
    m = spark.createDataFrame([("a", 0.5, 1), ("b", 0.7, 0)], "model string, precision double, ordinal int")
    assert me.best_model(m, "PRECISION").first()["model"] == "b"
    try:
        me.rank_models(m, "nope")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def _calendar(spark, n):
    d0 = dt.date(2020, 1, 1)
    return spark.createDataFrame([(d0 + dt.timedelta(days=i),) for i in range(n)], "Date date")


def test_fold_shape_like_reference(spark):
    # n=500, start=350, step=50: at most 150 test rows, no gap
    cal = fo.calendar(_calendar(spark, 500))
    wf = fo.WalkForward(step=50, gap=0, min_train=1, min_test=1, start=350)
    f = fo.folds(cal, wf).orderBy("fold_id").collect()
    assert [r["test_start"] for r in f] == [350, 400, 450]
    assert sum(r["test_end"] - r["test_start"] for r in f) == 150


def test_gap_and_skip_rule(spark):
    cal = fo.calendar(_calendar(spark, 100))
    f = fo.folds(cal, fo.WalkForward(ratio=0.5, step=30, gap=21)).orderBy("fold_id").collect()
    # starts 50, 80 -> train_end 29 (<50 skipped), 59 kept; test of fold 80 is 20 rows
    assert [(r["test_start"], r["train_end"], r["test_end"]) for r in f] == [(80, 59, 100)]


def test_train_test_disjoint_with_gap(spark):
    df = fo.calendar(_calendar(spark, 300)).withColumn("Target", F.lit(1)).withColumn("Ticker", F.lit("T"))
    ft = fo.folds(fo.calendar(df), fo.PIPELINE_WF)
    counts = fo.fold_train_counts(df, ft).collect()
    for r in counts:
        assert r["train_rows"] == r["train_end"] and r["train_end"] <= r["test_start"] - 21
        assert r["test_rows"] == r["test_end"] - r["test_start"]
