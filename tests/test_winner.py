"""The winner queries' work: short plans under the fits, trees that are not walked anew at every level, shares of the cores."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from candela.operators import baselines as bl
from candela.operators import boosting as bo
from candela.operators import folds as fo
from candela.operators import forest as fr
from candela.operators import models as mo
from candela.operators import trees as tr
from candela.plans import catalog
from candela.sources import bars as src

X = ["a", "b", "c", "e"]


def rows_frame(spark, n=160, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for t in ("A", "B", None):
        for i in range(n):
            x = [float(v) for v in rng.normal(size=4)]
            rows.append((t, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(rng.uniform(1, 2)), int(rng.uniform() < 0.5 + 0.2 * np.sign(x[0])), *x))
    return spark.createDataFrame(rows, "Ticker string, Date date, Close double, Target int, " + ", ".join(f"{c} double" for c in X))


def block(n=400, seed=1):
    rng = np.random.default_rng(seed)
    raw = rng.normal(size=(n, 4))
    edges = [np.unique(np.quantile(raw[:, k], np.arange(1, fr.BINS) / fr.BINS)) for k in range(4)]
    x = np.stack([np.stack([np.searchsorted(edges[k], raw[:, k]) for k in range(4)], axis=1).astype(np.uint8)])
    return {"x": x, "raw": raw, "y": (rng.uniform(size=n) < 0.5 + 0.3 * np.sign(raw[:, 0])).astype(float), "d": np.arange(n), "h": np.arange(n).astype(np.uint64)}


def test_fits_carry_no_plan_of_the_features(spark, monkeypatch):
    df, seen, plain = bl.with_forward_return(rows_frame(spark)), [], mo.fit

    def fit(spec, train, predictors):
        seen.append(train._jdf.queryExecution().toRdd().toDebugString())
        return plain(spec, train, predictors)

    monkeypatch.setattr(mo, "fit", fit)
    out = mo.backtest(df, X, [mo.REGISTRY["Ridge"]], fo.WalkForward(step=60))
    assert out.count() > 0 and seen
    # windows and the calendar's join are not part of any job of a solver
    assert all("ShuffledRowRDD" not in s and "ReliableCheckpointRDD" in s for s in seen)


def test_winner_input_is_a_table(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_model_input", lambda s, d: bl.with_forward_return(rows_frame(s)))
    df, want = catalog._winner_input(spark, ""), bl.with_forward_return(rows_frame(spark))
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.schema.simpleString() == want.schema.simpleString()
    assert df.count() == want.count() and df.exceptAll(want).count() == 0


def test_winner_queries_read_the_ticks_once(spark, monkeypatch):
    made, plain = [], bl.with_forward_return(rows_frame(spark))
    monkeypatch.setattr(catalog, "_model_input", lambda s, d: plain)
    monkeypatch.setattr(catalog.ev, "winner_forecast", lambda df, *a: made.append(df) or (df, df))
    monkeypatch.setattr(catalog.rp, "result_lines", lambda history, *a: history)
    monkeypatch.setattr(catalog, "_headline", lambda df, path: df)
    for name in ("forecast_winner", "result_winner"):
        history = catalog.QUERIES[name](spark, "")
        # the document's history comes from the same table, not from the ticks again
        assert all("Window" not in x._jdf.queryExecution().executedPlan().toString() for x in (made[-1], history))


def test_forest_draws_rows_once_a_tree(monkeypatch):
    for spec in (fr.Forest(3, 6, leaf=2, split=4), fr.Forest(3, 6, bootstrap=False, random_cuts=True)):
        grown, draws, plain = [], [], fr.multiplicity
        monkeypatch.setattr(fr, "multiplicity", lambda s, t, h: (draws.append(t), plain(s, t, h))[1])
        for kept in (False, True):
            b = block()
            g = fr._Growth([spec], [tr.Fold(0, 300)], np.array([[300.0, b["y"][:300].sum()]]), 4)
            draws.clear()
            for k in sorted(g.open):
                if kept:
                    b["kept"] = {}
                g.open = {k: [0]}
                fr._grow_all(g, [300], lambda tables, added, n: fr._summed(tables([b]), added).items())
            grown.append([(t.feature, [float(c) for c in t.cut], t.left, t.value, t.count) for t in g.trees])
            assert len(draws) == 3 if kept else len(draws) > 3
        assert grown[0] == grown[1] and all(len(t[0]) > 7 for t in grown[0])
        monkeypatch.undo()


def test_boosting_keeps_gradients_through_the_levels():
    for spec in (bo.Boost(1, 5), bo.Boost(1, 6, growth="leaf", leaves=9, leaf=4), bo.Boost(1, 4, growth="oblivious", l2=3.0), bo.Boost(1, 5, rows=0.7, seed=3)):
        grown, whole = [], {0} if spec.growth == "oblivious" else set()
        for kept in (False, True):
            b = block() | ({"kept": {}} if kept else {})
            margin = {0: np.linspace(-1, 1, 400)}

            def summed(work, units, used):
                return map(bo._best([spec], [(0, 0)], used, units), bo._histograms(work, [(0, 0)], [spec], [300], 0, units)([(b, margin)]))

            t = bo._round([0], 0, [spec], [(0, 0)], whole, 4, summed)[0]
            grown.append((t.feature, t.cut, t.left, t.value, t.count))
            assert not kept or 0 in b["kept"]
        assert grown[0] == grown[1] and len(grown[0][0]) > 5


def test_shares_of_the_cores_grow_the_same_trees(spark):
    rows = rows_frame(spark).withColumn("d", F.datediff("Date", F.lit("2020-01-01")))
    folds, keep = [mo.Fold(0, 100), mo.Fold(1, 130)], ["Ticker", "Date"]
    boosts, forests = [bo.Boost(3, 3), bo.Boost(3, 3, growth="oblivious", l2=3.0)], [fr.Forest(3, 4), fr.Forest(3, 4, bootstrap=False, random_cuts=True)]
    flat = lambda found: [[(t.feature, [float(c) for c in t.cut], t.value) for t in ts] for per in found for ts in per]
    for grow, specs in ((bo.boost, boosts), (fr.grow, forests)):
        found = []
        for share in (None, 1, 3):
            fitted = grow(rows, X, specs, folds, keep, share)
            fitted[-1].unpersist()
            found.append(flat(fitted[0]))
        assert found[0] == found[1] == found[2]


def test_bars_of_null_tickers_and_dates(spark):
    ticks = spark.createDataFrame([(None, None, 1.0, 1), (None, None, 3.0, 2), ("T", None, 2.0, 1), (None, dt.date(2020, 1, 1), 5.0, 1), ("T", dt.date(2020, 1, 1), 4.0, 2),
                                   ("T", dt.date(2020, 1, 1), 6.0, 1)], "t string, day date, p double, o int")
    got = src.ticks_to_bars(ticks, F.col("t"), F.col("day"), F.col("p"), F.lit(1), [F.col("o")])
    assert got.columns == src.BAR_COLUMNS
    assert {(r.Ticker, r.Date, r.Open, r.High, r.Low, r.Close, r.Volume) for r in got.collect()} == {
        (None, None, 1.0, 3.0, 1.0, 3.0, 2), ("T", None, 2.0, 2.0, 2.0, 2.0, 1), (None, dt.date(2020, 1, 1), 5.0, 5.0, 5.0, 5.0, 1), ("T", dt.date(2020, 1, 1), 6.0, 6.0, 4.0, 4.0, 2)}
