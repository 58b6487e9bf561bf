"""Models, comparison and forecasts: closed forms, no leakage, equal recursions, empty cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.operators import cleaning as cl
from candela.operators import folds as fo
from candela.operators import forecast as fc
from candela.operators import knn as kn
from candela.operators import models as mo
from candela.plans import evaluate as ev
from candela.plans import report as rp

X = ["Close_Ratio_5", "Trend_5", "Close_Ratio_60", "Trend_60"]
WF = fo.WalkForward(step=60)  # one fold of the panel


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    rows = []
    for t in ("A", "B"):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 121)))
        for i in range(120):
            x = [float(rng.normal(1, 0.02)), float(rng.integers(0, 6)) / 5, float(rng.normal(1, 0.05)), float(rng.uniform())]
            rows.append((t, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(close[i]), float(close[i] / close[i - 1] - 1) if i else 0.0,
                         int(rng.uniform() < 0.3 + 0.4 * x[1]), float(close[i + 1] / close[i] - 1), *x))
    return spark.createDataFrame(rows, "Ticker string, Date date, Close double, Returns double, Target int, fwd_return double, "
                                 + ", ".join(f"{c} double" for c in X)).persist()


def arrays(df):
    pdf = df.toPandas()
    return pdf[X].to_numpy(float), pdf["Target"].to_numpy(float)


def test_least_squares_and_ridge_closed_form(panel):
    x, y = arrays(panel)
    one = np.column_stack([x, np.ones(len(x))])
    lin = mo.fit(mo.REGISTRY["LinearRegression"], panel, X).stages[-1]
    np.testing.assert_allclose([*lin.coefficients.toArray(), lin.intercept], np.linalg.lstsq(one, y, rcond=None)[0], rtol=1e-8)
    xc, yc = x - x.mean(0), (2 * y - 1) - (2 * y - 1).mean()
    ridge = mo.fit(mo.REGISTRY["Ridge"], panel, X).stages[-1]
    np.testing.assert_allclose(ridge.coefficients.toArray(), np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc), rtol=1e-8)


def test_logistic_and_lasso_optimality(panel):
    x, y = arrays(panel)
    m = mo.fit(mo.REGISTRY["LogisticRegression"], panel, X).stages[-1]
    p = 1 / (1 + np.exp(-(x @ m.coefficients.toArray() + m.intercept)))
    np.testing.assert_allclose(x.T @ (p - y) + m.coefficients.toArray(), 0, atol=0.05)
    m = mo.fit(mo.REGISTRY["Lasso"], panel, X).stages[-1]
    g = x.T @ (x @ m.coefficients.toArray() + m.intercept - y) / len(y)
    assert (np.abs(g) <= 0.001 + 1e-4).all()


def test_random_features_approximate_the_kernel(panel):
    _, cols, rff = mo._prepare(mo.REGISTRY["KernelRidge"], panel, X)
    x, _ = arrays(panel)
    z = (x - x.mean(0)) / x.std(0)
    f = np.sqrt(2 / rff[0].shape[1]) * np.cos(z @ rff[0] + rff[1])
    k = np.exp(-0.1 * ((z[:80, None] - z[None, :80]) ** 2).sum(-1))
    assert np.abs(f[:80] @ f[:80].T - k).mean() < 0.08
    svc = mo.REGISTRY["SVC"].build(mo.FitContext(100, 0.5))
    assert svc.getStandardization() is False
    assert mo.REGISTRY["KernelRidge"].build(mo.FitContext(100, 0.5)).getRegParam() == pytest.approx(0.005)


@pytest.mark.parametrize("name", ["SVC", "SVCBalanced", "SVR", "GaussianProcess", "RegimeMixture", "LogisticRegressionZ", "LogisticRegressionBalanced"])
def test_other_models_run_twice_alike(panel, name):
    wf = WF
    a, b = (mo.backtest(panel, X, [mo.REGISTRY[name]], wf).orderBy("fold_id", "Ticker", "Date").collect() for _ in range(2))
    assert len(a) == len(b) > 0 and {r.Predictions for r in a} <= {0, 1}
    assert np.mean([r.Predictions == s.Predictions for r, s in zip(a, b)]) > 0.99


def test_folds_do_not_leak(panel):
    cal = fo.calendar(panel)
    first = fo.folds(cal, WF).orderBy("fold_id").first()
    edge = cal.where(F.col("d") == first["train_end"]).first()["Date"]
    changed = panel.withColumn("Target", F.when(F.col("Date") >= F.lit(edge), 1 - F.col("Target")).otherwise(F.col("Target")))
    spec = [mo.REGISTRY["LinearRegression"]]
    a, b = (mo.backtest(p, X, spec, WF).where(F.col("fold_id") == first["fold_id"]).orderBy("Ticker", "Date").collect() for p in (panel, changed))
    assert a and [r.Predictions for r in a] == [r.Predictions for r in b]


def test_threshold_is_monotone(panel):
    n = [mo.backtest(panel, X, [mo.REGISTRY["LogisticRegression"]], WF, t).agg(F.sum("Predictions")).first()[0] for t in (0.3, 0.5, 0.7)]
    assert n[0] >= n[1] >= n[2]


def test_no_fold_left_gives_empty_tables(panel):
    short = panel.where(F.col("Date") < "2020-02-01")
    wf = fo.WalkForward(gap=400)
    assert mo.backtest(short, X, [mo.REGISTRY["Ridge"]], wf).count() == 0
    assert mo.sarima_hr_backtest(panel, wf=wf).count() == 0
    assert kn.knn_backtest(panel, X, wf).count() == 0
    with pytest.raises(ValueError, match="fewer than k"):
        kn.knn_backtest(panel, X, WF, k=10_000)


def test_comparison_uses_the_same_rows(panel):
    comp = ev.compare_models(panel, X, [mo.REGISTRY["Ridge"], mo.REGISTRY["LinearRegression"]], WF).collect()
    assert {r.model for r in comp} == {"Ridge", "LinearRegression", "NaiveBaseline", "MovingAverage"}
    assert len({r.tp + r.fp + r.tn + r.fn for r in comp}) == 1 and sorted(r["rank"] for r in comp) == [1, 2, 3, 4]


def test_guards_keep_the_schema(panel):
    specs = [mo.REGISTRY["Ridge"]]
    full, few = ev.evaluate_models(panel, X, specs, WF), ev.evaluate_models(panel.limit(20), X, specs, WF)
    assert full.columns == few.columns and few.first()["status"] == "insufficient_data" and few.first()["precision"] is None
    bad = ev.evaluate_models(panel, X, specs + [mo.ModelSpec("Broken", 9, lambda ctx: 1 / 0)], WF)
    assert {r.model: r.status for r in bad.collect()} == {"Ridge": "ok", "Broken": "failed"}


def test_winner_fold_equals_step_loop_and_document(spark, panel):
    specs = [mo.REGISTRY["LinearRegression"]]
    comp, path = ev.winner_forecast(panel, X, specs, [5, 60], 5, WF)
    rows = path.orderBy("Ticker", "step").collect()
    assert len(rows) == 10 and {r.model for r in rows} == {"LinearRegression"}
    cal = fo.calendar(panel)
    model = mo.fit(specs[0], fo.train_rows(fo.with_date_ordinal(panel, cal), int(120 * 0.7)), X)
    state, last = fc.series_state(panel, 0.7), fc.last_rows(panel.select("Ticker", "Date", *X)).drop("Date")
    loop = fc.recursive_directions(specs[0], model, last, state, [5, 60], 5).orderBy("Ticker", "step").collect()
    assert [r.Prediction for r in rows] == [r.Prediction for r in loop]
    end = panel.groupBy("Ticker").agg(F.max_by("Close", "Date").alias("last_price")).withColumn("end_price", F.lit(1.0)).withColumn("change_pct", F.lit(0.0))
    doc = rp.result_lines(panel.select("Ticker", "Date", "Close"), path, comp, end).groupBy("section").count().collect()
    assert {r.section: r["count"] for r in doc} == {"historical": 240, "predictions": 10, "metrics": 2, "model_comparison": 3,
                                                     **{r.section: r["count"] for r in doc if r.section == "best_model"}}


def test_null_dates_are_one_date(spark):
    df = spark.createDataFrame([("T", None, 1.0, 2.0, 0.5, 1.5, 10, 0), ("T", None, 9.0, 9.0, 9.0, 9.0, 10, 1), ("T", dt.date(2020, 1, 1), 1.0, 2.0, 0.5, 1.5, 10, 2)],
                               "Ticker string, Date date, Open double, High double, Low double, Close double, Volume long, _ord long")
    assert sorted(r._ord for r in cl.dedup_keep_first(df).collect()) == [0, 2]
    assert cl.duplicate_count(df).first()["duplicate_count"] == 1


SMALL = [
    mo.ModelSpec("RandomForest", 0, trees=mo.Forest(8, 5, leaf=4, split=8)),
    mo.ModelSpec("GradientBoosting", 1, trees=mo.Boost(4, 3, first_order=True)),
    mo.ModelSpec("ExtraTrees", 2, trees=mo.Forest(8, 5, bootstrap=False, random_cuts=True)),
    mo.ModelSpec("HistGradientBoosting", 3, trees=mo.Boost(4, 4, growth="leaf", leaves=7, leaf=5)),
    mo.REGISTRY["LogisticRegression"], mo.REGISTRY["Ridge"], mo.REGISTRY["KNN"], mo.REGISTRY["SVC"],
    mo.ModelSpec("XGBoost", 8, trees=mo.Boost(4, 3, l2=1.0, hessian=1.0)),
    mo.ModelSpec("LightGBM", 9, trees=mo.Boost(4, 4, growth="leaf", leaves=5, leaf=5, hessian=1.0)),
    mo.ModelSpec("CatBoost", 10, trees=mo.Boost(4, 3, growth="oblivious", l2=3.0, prior=False)),
]


def test_registries_have_eleven_models():
    for reg in (mo.PIPELINE_REGISTRY, mo.COMPARISON_REGISTRY):
        assert [s.ordinal for s in reg] == list(range(11)) and len({s.name for s in reg}) == 11
    assert [s.name for s in SMALL] == [s.name for s in mo.PIPELINE_REGISTRY]
    boosted = {s.name: s.trees for s in mo.PIPELINE_REGISTRY if isinstance(s.trees, mo.Boost)}
    assert len(boosted) == 5 and len(set(boosted.values())) == 5


def test_eleven_models_on_the_same_rows(panel):
    preds = mo.backtest(panel, X, SMALL, WF)
    assert preds.schema.simpleString() == panel.sparkSession.createDataFrame([], mo.PREDICTION_SCHEMA).schema.simpleString()
    pdf = preds.toPandas()
    rows = {n: g.sort_values(["Ticker", "Date"])[["Ticker", "Date"]].values.tolist() for n, g in pdf.groupby("model")}
    assert set(rows) == {s.name for s in SMALL} and all(r == rows["Ridge"] for r in rows.values())
    some = pdf[pdf.model != "Ridge"]
    assert some.probability.between(0, 1).all() and ((some.probability >= 0.51).astype(int) == some.Predictions).all()
    boosted = [pdf[pdf.model == n].sort_values(["Ticker", "Date"]).probability.tolist() for n in ("GradientBoosting", "HistGradientBoosting", "XGBoost", "LightGBM", "CatBoost")]
    assert len({tuple(b) for b in boosted}) == 5
    comp = ev.evaluate_models(panel, X, SMALL, WF).collect()
    assert len(comp) == 11 and {r.status for r in comp} == {"ok"}


@pytest.mark.parametrize("name", ["RandomForest", "ExtraTrees", "GradientBoosting", "CatBoost"])
def test_fitted_model_scores_as_the_backtest_and_forecasts_in_one_pass(panel, name):
    spec = next(s for s in SMALL if s.name == name)
    cal = fo.calendar(panel)
    data = fo.with_date_ordinal(panel, cal)
    fold = fo.folds(cal, WF).orderBy("fold_id").first()
    model = mo.fit(spec, fo.train_rows(data, fold["train_end"]), X)
    test = data.where((F.col("d") >= fold["test_start"]) & (F.col("d") < fold["test_end"]))
    got = {(r.Ticker, r.Date): r.probability for r in mo.score(spec, model, test).collect()}
    want = {(r.Ticker, r.Date): r.probability for r in mo.backtest(panel, X, [spec], WF).where(F.col("fold_id") == fold["fold_id"]).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9
    state, last = fc.series_state(panel, 0.7), fc.last_rows(panel.select("Ticker", "Date", *X)).drop("Date")
    one = fc.model_directions(spec, model, last, state, X, [5, 60], 6).orderBy("Ticker", "step").collect()
    loop = fc.recursive_directions(spec, model, last, state, [5, 60], 6).orderBy("Ticker", "step").collect()
    assert [(r.step, r.Prediction) for r in one] == [(r.step, r.Prediction) for r in loop]
    np.testing.assert_allclose([r.Probability for r in one], [r.Probability for r in loop], atol=1e-9)


def test_fits_have_partitions_by_rows(spark):
    ticks = spark.range(1000).repartition(60)
    assert mo.sized(ticks, 1000).rdd.getNumPartitions() == 1 and mo.sized(ticks, 1000).count() == 1000
    assert mo.sized(ticks, 3 * mo.PARTITION_ROWS).rdd.getNumPartitions() == 3


def test_trees_leave_the_shared_rows_cached(panel):
    rows, held = panel.withColumn("d", F.lit(0)).persist(), panel.withColumn("more", F.lit(1)).persist()
    try:
        bo_spec, rf_spec = mo.Boost(2, 2), mo.Forest(2, 2)
        mo.bo.boost(rows, X, [bo_spec], [mo.Fold(0, 1)], ["Ticker", "Date"])[-1].unpersist()
        mo.fr.grow(rows, X, [rf_spec], [mo.Fold(0, 1)], ["Ticker", "Date"])[-1].unpersist()
        mo.backtest(held, X, [mo.REGISTRY["Ridge"]], WF)
        assert rows.storageLevel.useMemory and held.storageLevel.useMemory  # else every later model makes the features anew
    finally:
        rows.unpersist()
        held.unpersist()


def test_an_ensemble_is_walked_once_a_step(panel):
    spec = mo.ModelSpec("Few", 0, trees=mo.Forest(3, 3))
    model = mo.fit(spec, panel, X)
    state, last = fc.series_state(panel, 0.7), fc.last_rows(panel.select("Ticker", "Date", *X)).drop("Date")
    out = fc.model_directions(spec, model, last, state, X, [5, 60], 4)
    roots = " ".join(map(repr, model.model.roots))
    assert out._jdf.queryExecution().analyzed().toString().count(f"split({roots}") == 1
    loop = fc.recursive_directions(spec, model, last, state, [5, 60], 4).orderBy("Ticker", "step").collect()
    rows = out.orderBy("Ticker", "step").collect()
    assert [(r.Prediction, r.Probability) for r in rows] == [(r.Prediction, r.Probability) for r in loop]
