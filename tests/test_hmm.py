"""Hidden Markov model against a plain forward-backward, with chunks of a few rows and of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.operators import hmm
from candela.operators.trees import Fold

FOLDS = [Fold(0, 150, 150, 200), Fold(1, 200, 210, 260)]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t, n in (("A", 260), ("B", 170), (None, 260), ("D", 1)):
        s = 0
        for i in range(n):
            s = s if rng.uniform() < 0.95 else int(rng.integers(0, 3))
            x = rng.normal([s, 2 * s], [0.4, 0.7])
            rows.append((t, i, i, float(x[0]), float("nan") if i == 20 else float(x[1]), 1, 0.0))
    df = spark.createDataFrame(rows, "Ticker string, day int, d int, a double, b double, Target int, fwd_return double")
    return df.withColumn("Date", F.date_add(F.lit("2020-01-01").cast("date"), "day")).persist()


def plain(h, x, on):
    """Log likelihood, posteriors and expected moves of one sequence, row by row."""
    x = x[on]
    k, n = len(h.start), len(x)
    b = np.array([[np.exp(-0.5 * (v - m) @ np.linalg.solve(c, v - m)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for m, c in zip(h.mean, h.cov)] for v in x]).reshape(n, k)
    alpha, beta, logs = np.zeros((n, k)), np.ones((n, k)), 0.0
    for t in range(n):
        a = (h.start if t == 0 else alpha[t - 1] @ h.move) * b[t]
        logs += np.log(a.sum())
        alpha[t] = a / a.sum()
    for t in range(n - 2, -1, -1):
        v = h.move @ (b[t + 1] * beta[t + 1])
        beta[t] = v / v.sum()
    g = alpha * beta
    g /= g.sum(axis=1, keepdims=True) if n else 1
    moves = np.zeros((k, k))
    for t in range(1, n):
        m = alpha[t - 1][:, None] * h.move * (b[t] * beta[t])[None]
        moves += m / m.sum()
    return logs, g, moves


def series(panel):
    pdf = panel.toPandas()
    for t in ("A", "B", None, "D"):
        mine = pdf[pdf.Ticker.isna()] if t is None else pdf[pdf.Ticker == t]
        mine = mine.sort_values("d")
        yield t, mine["d"].to_numpy(), mine[["a", "b"]].to_numpy()


@pytest.mark.parametrize("size", [(7, 3), (4096, 64)])
def test_equals_plain_forward_backward(spark, panel, monkeypatch, size):
    monkeypatch.setattr(hmm, "CHUNK", size[0])
    monkeypatch.setattr(hmm, "BLOCK", size[1])
    post, models, held = hmm.backtest(panel, ["a", "b"], FOLDS, 3, 12)
    for h in models:  # the likelihood rises each round, the states are in order
        assert len(h.log_likelihood) > 3 and (np.diff(h.log_likelihood) > -1e-6).all()
        assert (np.diff(h.mean[:, 0]) > 0).all() and np.allclose(h.move.sum(axis=1), 1)
    one = hmm.fit(held, FOLDS, 3, 1)
    two = hmm.fit(held, FOLDS, 3, 2)
    for f, fold in enumerate(FOLDS):
        start = hmm.initial(held, FOLDS, 3)[f]
        logs, moves, n, first = 0.0, 0, 0, 0
        for _, d, x in series(panel):
            on = (d < fold.train_end) & np.isfinite(x).all(axis=1)
            a, g, m = plain(start, x, on)
            logs, moves, n, first = logs + a, moves + m, n + g.sum(axis=0), first + g[0]
        assert one[f].log_likelihood[0] == pytest.approx(logs, abs=1e-6) == two[f].log_likelihood[0]
        order = np.argsort(one[f].mean[:, 0])
        np.testing.assert_allclose(one[f].move[order], (moves / moves.sum(axis=1, keepdims=True)), atol=1e-8)
        np.testing.assert_allclose(one[f].start, first / first.sum(), atol=1e-8)
    got = post.toPandas()
    for f, fold in enumerate(FOLDS):
        for t, d, x in series(panel):
            mine = got[(got.fold_id == fold.fold_id) & (got.Ticker.isna() if t is None else got.Ticker == t)].sort_values("Date")
            on = (d >= fold.test_start) & (d < fold.test_end)
            assert len(mine) == on.sum()
            if on.any():
                np.testing.assert_allclose(np.stack(mine["posterior"]), plain(models[f], x, on)[1], atol=1e-8)


def test_learns_the_regimes(panel):
    _, models, _ = hmm.backtest(panel, ["a", "b"], FOLDS)
    np.testing.assert_allclose(models[1].mean, [[0, 0], [1, 2], [2, 4]], atol=0.3)
    assert (np.diag(models[1].move) > 0.85).all()


def test_few_chunks_make_few_partitions(spark, panel):
    held = hmm.chunks(panel.repartition(40), ["a", "b"], ["Ticker", "Date"])
    n = held.count()
    # as many as spark.sql.shuffle.partitions before, each a task in every step of every round
    assert n == len({t for t, _, _ in series(panel)}) and held.getNumPartitions() <= n
    few = held.getNumPartitions()
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    try:
        again = hmm.chunks(panel, ["a", "b"], ["Ticker", "Date"])
        assert again.getNumPartitions() == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    held.unpersist()
    again.unpersist()
