"""Kernel machines against their optimality conditions: duality gap, posterior mode and covariance, averaged probability."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.operators import kernel as ke
from candela.operators import trees as tr
from candela.operators.trees import Fold

P = ["a", "b"]
FOLDS = [Fold(0, 60, 60, 80), Fold(1, 80, 80, 100)]
SPECS = [ke.Kernel("svr", 30), ke.Kernel("svr", 30, 0.7, c=3.0, epsilon=0.3, seed=1), ke.Kernel("gp", 40, 0.5)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(500):
        a, b = float(rng.normal(3, 2)), float(rng.uniform())
        rows.append((i, float("nan") if i == 7 else a, b, int(rng.uniform() < 0.2 + 0.6 * (a > 3)), i % 100))
    return spark.createDataFrame(rows, "id int, a double, b double, Target int, d int").repartition(3).persist()


@pytest.fixture(scope="module")
def fitted(table):
    return ke.backtest(table, P, SPECS, FOLDS, ["id"], "id int")


def rows(table, fold):
    pdf = table.toPandas()
    pdf = pdf[pdf.d < fold.train_end]
    return pdf[P].to_numpy(), pdf["Target"].to_numpy(float)


@pytest.mark.parametrize("i", [0, 1])
def test_regression_is_optimal(table, fitted, i):
    s = SPECS[i]
    for m, fold in zip(fitted[1][i], FOLDS):
        x, y = rows(table, fold)
        phi = m.phi(x)
        r = phi @ m.w - y
        primal = 0.5 * (m.w[:-1] ** 2).sum() + s.c * np.maximum(np.abs(r) - s.epsilon, 0).sum()
        # a dual point (within its bounds, sum 0) bounds the optimum from below; the solution's slopes are one
        alpha = -ke.loss(s, y, phi @ m.w, m.mu)[1]
        assert abs(alpha.sum()) < 1e-4
        v = phi[:, :-1].T @ alpha
        best = alpha @ y - s.epsilon * np.abs(alpha).sum() - 0.5 * v @ v
        assert primal - best <= 1e-6 * primal and best <= primal + 1e-4


def test_classification_is_laplace(table, fitted):
    for m, fold in zip(fitted[1][2], FOLDS):
        x, y = rows(table, fold)
        phi = m.phi(x)
        w = np.zeros(phi.shape[1])
        for _ in range(50):  # plain Newton
            p = 1 / (1 + np.exp(-phi @ w))
            h = np.eye(len(w)) + (phi * (p * (1 - p))[:, None]).T @ phi
            w = w - np.linalg.solve(h, phi.T @ (p - y) + w)
        np.testing.assert_allclose(m.w, w, atol=1e-5)
        np.testing.assert_allclose(m.cov, np.linalg.inv(h), atol=1e-5)
        f, v = phi @ w, np.einsum("ij,jk,ik->i", phi, np.linalg.inv(h), phi)
        got = m.score(x)
        np.testing.assert_allclose(got, 1 / (1 + np.exp(-f / np.sqrt(1 + np.pi * v / 8))), atol=1e-5)
        assert (np.abs(got - 0.5) <= np.abs(1 / (1 + np.exp(-f)) - 0.5) + 1e-9).all()  # averaging moves towards a half


def test_scored_rows(table, fitted):
    got = fitted[0].toPandas()
    pdf = table.toPandas().set_index("id")
    for i in range(3):
        for m, fold in zip(fitted[1][i], FOLDS):
            mine = got[(got.spec == i) & (got.fold_id == fold.fold_id)].set_index("id").sort_index()
            want = pdf[(pdf.d >= fold.test_start) & (pdf.d < fold.test_end)].sort_index()
            assert mine.index.tolist() == want.index.tolist()
            np.testing.assert_allclose(mine["score"], m.score(want[P].to_numpy()), atol=1e-12)
    # partitions change the order of sums only
    blocks = tr.binned_blocks(table, P, [], [], ["id"], raw=True, spread=1)
    again = ke.fit(blocks, [SPECS[2]], FOLDS)
    np.testing.assert_allclose(again[0][0].w, fitted[1][2][0].w, atol=1e-6)


def test_the_kernel_is_approximated(table, fitted):
    wide = ke.Fitted(ke.Kernel("gp", 4000, 0.5), *(lambda r: (np.zeros(2), np.ones(2), r.normal(0, 1.0, (2, 4000)), r.uniform(0, 2 * np.pi, 4000)))(np.random.default_rng(0)), np.zeros(4000))
    z = np.random.default_rng(1).normal(size=(40, 2))
    k = np.exp(-0.5 * ((z[:, None] - z[None]) ** 2).sum(-1))
    assert np.abs(wide.phi(z) @ wide.phi(z).T - k).max() < 0.08
