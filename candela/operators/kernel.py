"""Kernel machines on random Fourier features, solved by Newton steps (M17, M19): one aggregate per step for all folds.

Inputs are z-scored per training fold (non-finite ones become 0) and mapped to ``sqrt(2/D) cos(z W + b)``, whose inner products
approximate an RBF kernel. A pass adds up the objective, its gradient and its Hessian (D x D, D is a parameter) of
every fold over blocks of rows; the driver solves the D x D systems. A second pass tries step lengths side by side.

* ``svr``: epsilon-insensitive regression, ``|w|^2 / 2 + C sum max(0, |y - f| - epsilon)`` with a free intercept. Both hinges are rounded
  off (softplus of width mu), and mu goes down until the rounding is worth less than ``GAP`` of the objective, each stage starting at the
  last one's solution. At a stage's solution ``w`` is a combination of rows within the dual's bounds, so the duality gap bounds the error.
* ``gp``: Gaussian process classification by Laplace's approximation: the mode of the logistic posterior under a standard
  normal prior on ``w``, its inverse Hessian as covariance, and the probability averaged over it (MacKay's formula).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame

from candela.operators import trees as tr
from candela.operators.trees import Fold
from candela.session import checkpoint_dir

GAP = 1e-7
STEPS = np.array([1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 1e-3, 1e-4])
ROUNDS = 60


@dataclass(frozen=True)
class Kernel:
    loss: str                       # svr | gp
    features: int = 200
    gamma: float | None = None      # None: 1 / number of inputs
    c: float = 1.0
    epsilon: float = 0.1
    seed: int = 42


@dataclass
class Fitted:
    spec: Kernel
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    w: np.ndarray                   # the last one is the intercept (svr)
    cov: np.ndarray | None = None   # gp: inverse Hessian
    objective: float = 0.0
    mu: float = 0.0                 # svr: the width of the rounding at the end

    def phi(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        z = np.where(np.isfinite(z), z, 0.0)
        out = math.sqrt(2.0 / len(self.phase)) * np.cos(z @ self.omega + self.phase)
        return np.column_stack([out, np.ones(len(x))]) if self.spec.loss == "svr" else out

    def score(self, x: np.ndarray) -> np.ndarray:
        """The regression value (svr) or the averaged probability (gp)."""
        phi = self.phi(x)
        f = phi @ self.w
        if self.spec.loss == "svr":
            return f
        var = np.einsum("ij,jk,ik->i", phi, self.cov, phi)
        return 1.0 / (1.0 + np.exp(-f / np.sqrt(1.0 + math.pi * var / 8.0)))


def loss(s: Kernel, y: np.ndarray, f: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each row, and its first and second derivative in f."""
    if s.loss == "gp":
        t = np.where(y > 0, 1.0, -1.0)
        p = 1.0 / (1.0 + np.exp(-f))
        return np.logaddexp(0.0, -t * f), p - (t > 0), p * (1.0 - p)
    up, down = (f - y - s.epsilon) / mu, (y - f - s.epsilon) / mu
    a, b = (1.0 / (1.0 + np.exp(-np.clip(t, -500, 500))) for t in (up, down))
    return s.c * mu * (np.logaddexp(0.0, up) + np.logaddexp(0.0, down)), s.c * (a - b), s.c * (a * (1 - a) + b * (1 - b)) / mu


def rounding(s: Kernel, y: np.ndarray, f: np.ndarray, mu: float) -> float:
    """By how much the rounded hinge exceeds the hinge itself."""
    if s.loss == "gp":
        return 0.0
    return float((loss(s, y, f, mu)[0] - s.c * np.maximum(np.abs(f - y) - s.epsilon, 0.0)).sum())


def _ridge(s: Kernel, d: int) -> np.ndarray:
    out = np.ones(d)
    if s.loss == "svr":
        out[-1] = 0.0
    return out


def fit(blocks: RDD, specs: list[Kernel], folds: list[Fold]) -> list[list[Fitted]]:
    """Fits every spec on every fold's training rows; ``blocks`` hold ``raw, y, d`` (``trees.binned_blocks`` with ``raw``)."""
    def sums(b):
        out = []
        for f in folds:
            x = b["raw"][b["d"] < f.train_end]
            ok = np.isfinite(x)
            v = np.where(ok, x, 0.0)
            out.append([ok.sum(axis=0), v.sum(axis=0), (v * v).sum(axis=0)])
        return np.array(out, float)

    stats = blocks.map(sums).reduce(lambda a, b: a + b)
    models, mus = [], []
    for s in specs:
        for n, one, two in stats:
            n = np.maximum(n, 1)
            mean = one / n
            sd = np.sqrt(np.maximum(two / n - mean * mean, 0))
            p = len(mean)
            gamma = s.gamma if s.gamma is not None else 1.0 / p
            rng = np.random.default_rng(s.seed)
            omega, phase = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(p, s.features)), rng.uniform(0.0, 2 * math.pi, size=s.features)
            models.append(Fitted(s, mean, np.where(sd > 0, sd, 1.0), omega, phase, np.zeros(s.features + (s.loss == "svr"))))
            mus.append(1.0 if s.loss == "svr" else 0.0)
    which = [f for _ in specs for f in folds]
    live = list(range(len(models)))
    for _ in range(ROUNDS * 4):
        some = [(models[i], which[i], mus[i]) for i in live]

        def derivatives(b):
            out = []
            for m, f, mu in some:
                on = b["d"] < f.train_end
                phi = m.phi(b["raw"][on])
                v, g, h = loss(m.spec, b["y"][on], phi @ m.w, mu)
                out.append([np.array([v.sum(), len(v), rounding(m.spec, b["y"][on], phi @ m.w, mu)]), phi.T @ g, (phi * h[:, None]).T @ phi])
            return out

        total = blocks.map(derivatives).treeReduce(lambda a, b: [[x + y for x, y in zip(p, q)] for p, q in zip(a, b)])
        moves, values = [], []
        for (m, _, _), (v, g, h) in zip(some, total):
            ridge = _ridge(m.spec, len(m.w))
            values.append(v[0] + 0.5 * (ridge * m.w * m.w).sum())
            g, h = g + ridge * m.w, h + np.diag(ridge)
            # the intercept has no curvature where no row lies on the rounded part: then a step of its own scale
            flat = np.where(ridge == 0, np.where(np.diag(h) > 1e-6, 1e-9, max(v[1], 1.0)), 0.0)
            moves.append((-np.linalg.solve(h + np.diag(flat), g), g, h))

        def trials(b):
            out = np.zeros((len(some), len(STEPS)))
            for i, ((m, f, mu), (move, _, _)) in enumerate(zip(some, moves)):
                on = b["d"] < f.train_end
                phi = m.phi(b["raw"][on])
                a, c = phi @ m.w, phi @ move
                for k, t in enumerate(STEPS):
                    out[i, k] = loss(m.spec, b["y"][on], a + t * c, mu)[0].sum()
            return out

        tried = blocks.map(trials).treeReduce(lambda a, b: a + b)
        nxt = []
        for j, i in enumerate(live):
            m, (move, g, h) = models[i], moves[j]
            ridge = _ridge(m.spec, len(m.w))
            after = np.array([tried[j, k] + 0.5 * (ridge * (m.w + t * move) ** 2).sum() for k, t in enumerate(STEPS)])
            k = int(after.argmin())
            gain = values[j] - after[k]
            if gain > 0:
                m.w = m.w + STEPS[k] * move
            m.objective, m.mu = min(values[j], after[k]), mus[i]
            if gain <= 1e-12 * max(1.0, abs(values[j])):  # this stage is solved
                if m.spec.loss == "gp":
                    # column by column: threaded LAPACK calls with many right sides were seen to hang beside busy cores
                    m.cov = np.column_stack([np.linalg.solve(h, e) for e in np.eye(len(h))])
                    continue
                if total[j][0][2] <= GAP * max(m.objective, 1e-9) or mus[i] < 1e-12:
                    continue
                mus[i] = mus[i] / 4
            nxt.append(i)
        live = nxt
        if not live:
            break
    for m in models:
        if m.spec.loss == "gp" and m.cov is None:
            raise RuntimeError("the posterior's mode was not found")
    return [models[i * len(folds): (i + 1) * len(folds)] for i in range(len(specs))]


def backtest(data: DataFrame, predictors: list[str], specs: list[Kernel], folds: list[Fold], keep: list[str], schema: str):
    """Test rows ``spec, fold_id, score`` and the kept columns, the models, and the persisted blocks."""
    spark = data.sparkSession
    checkpoint_dir(spark)
    blocks = tr.persisted(tr.binned_blocks(data, predictors, [], [], keep, raw=True, spread=spark.sparkContext.defaultParallelism))
    models = fit(blocks, specs, folds)
    flat = [m for per in models for m in per]
    state = blocks.map(lambda b: (b, np.array([m.score(b["raw"]) for m in flat])))
    return tr.scored_rows(state, folds, len(specs), schema, spark), models, blocks
