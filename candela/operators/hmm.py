"""Gaussian hidden Markov model with transitions (M20): forward-backward as a scan of K x K matrices over chunks of rows.

A row's step is the matrix ``A diag(b_t)`` (transitions, then the row's emission densities), and steps multiply. Each series is cut into chunks
of ``CHUNK`` consecutive rows. An EM round:

1. every chunk multiplies its steps to one matrix (blocks of ``BLOCK`` rows side by side, then the blocks);
2. the chunks' matrices of a series are scanned forward and backward, which gives each chunk the state probabilities before it and
   the evidence after it; only these small matrices are shuffled, chunks stay where they are;
3. every chunk runs forward-backward inside and adds up expected counts, one aggregate for all chunks.

All folds are fitted in the same rounds: a fold sees the rows with ``lo <= d < hi`` and passes over the others. A series starts from the
start probabilities at its first row of the fold. Results don't depend on how rows are cut into chunks.

States are ordered by the mean of the first input. Rows with a null or non-finite input are passed over and get the
posterior that their neighbours imply.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.operators.halo import global_row_index
from candela.operators.trees import Fold

CHUNK, BLOCK = 4096, 64
#: chunks of a task, where there are more chunks than cores
CHUNKS_A_TASK = 8


@dataclass
class Hmm:
    """Parameters of one fold."""
    start: np.ndarray       # K
    move: np.ndarray        # K x K
    mean: np.ndarray        # K x p
    cov: np.ndarray         # K x p x p
    log_likelihood: list = field(default_factory=list)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.mean)))
        for k, (m, c) in enumerate(zip(self.mean, self.cov)):
            low = np.linalg.cholesky(c)
            z = np.linalg.solve(low, (x - m).T)
            out[:, k] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out


def _norm(m: np.ndarray, axes: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Scaled to a largest element of 1, and the logarithm of the scale."""
    top = m.max(axis=axes, keepdims=True)
    return m / top, np.log(top).reshape(m.shape[:-len(axes)])


class _Chunk:
    """One chunk under one fold's model: the steps in blocks (block, row, ...), identities at rows that don't count."""

    def __init__(self, h: Hmm, x: np.ndarray, on: np.ndarray):
        k = len(h.start)
        n = len(x)
        self.n, self.on, self.h = n, on, h
        self.first = int(np.argmax(on)) if on.any() else None
        dens = np.zeros((n, k))
        dens[on] = h.log_density(x[on])
        top = dens.max(axis=1)
        b = np.exp(dens - top[:, None])
        self.scale = float(top[on].sum())
        step = np.where(on[:, None, None], h.move[None] * b[:, None, :], np.eye(k)[None])
        blocks = -(-n // BLOCK)
        pad = blocks * BLOCK - n
        self.step = np.concatenate([step, np.broadcast_to(np.eye(k), (pad, k, k))]).reshape(blocks, BLOCK, k, k)
        self.b = b

    def started(self) -> np.ndarray:
        """The steps if no row counted before: the first that counts draws from the start probabilities."""
        if self.first is None:
            return self.step
        s = self.step.copy()
        i, j = divmod(self.first, BLOCK)
        s[i, j] = np.broadcast_to(self.h.start * self.b[self.first], s[i, j].shape)
        return s

    def product(self, steps: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        """The chunk's matrix and its log scale; the blocks' ones."""
        p = np.broadcast_to(np.eye(steps.shape[-1]), (len(steps), *steps.shape[2:])).copy()
        logs = np.zeros(len(steps))
        for t in range(BLOCK):
            p, s = _norm(p @ steps[:, t], (1, 2))
            logs += s
        whole, total = np.eye(steps.shape[-1]), 0.0
        for q, s in zip(p, logs):
            whole = whole @ q
            top = whole.max()
            whole, total = whole / top, total + np.log(top) + s
        return whole, total, p, logs

    def run(self, before: np.ndarray | None, after: np.ndarray) -> tuple:
        """Forward and backward vectors of every row (normalised), the steps used, and the log scale of the forward pass."""
        steps = self.started() if before is None else self.step
        k = steps.shape[-1]
        _, _, p, logs = self.product(steps)
        a = np.full(k, 1 / k) if before is None else before
        heads, tails, total = [], [], 0.0
        for q, s in zip(p, logs):
            heads.append(a)
            a = a @ q
            total += np.log(a.sum()) + s
            a = a / a.sum()
        b = after
        for q in p[::-1]:
            tails.append(b)
            b = q @ b
            b = b / b.max()
        alpha = np.empty((len(steps), BLOCK, k))
        beta = np.empty((len(steps), BLOCK, k))
        a, b = np.array(heads), np.array(tails[::-1])
        for t in range(BLOCK):
            a = np.einsum("ni,nij->nj", a, steps[:, t])
            a = a / a.sum(axis=1, keepdims=True)
            alpha[:, t] = a
            beta[:, BLOCK - 1 - t] = b
            b = np.einsum("nij,nj->ni", steps[:, BLOCK - 1 - t], b)
            b = b / b.max(axis=1, keepdims=True)
        cut = lambda v: v.reshape(-1, k)[: self.n]
        previous = np.concatenate([np.array(heads)[:1], cut(alpha)[:-1]])
        return cut(alpha), cut(beta), previous, total + self.scale

    def posterior(self, before, after) -> np.ndarray:
        alpha, beta, _, _ = self.run(before, after)
        g = alpha * beta
        return g / g.sum(axis=1, keepdims=True)

    def counts(self, x: np.ndarray, before, after) -> dict:
        alpha, beta, previous, total = self.run(before, after)
        g = alpha * beta
        g = (g / g.sum(axis=1, keepdims=True))[self.on]
        v = x[self.on]
        moves = self.on.copy()
        if before is None and self.first is not None:
            moves[self.first] = False
        xi = previous[moves][:, :, None] * self.h.move[None] * (self.b[moves] * beta[moves])[:, None, :]
        xi = xi / xi.sum(axis=(1, 2), keepdims=True)
        return {"start": g[0] if before is None and len(g) else np.zeros(alpha.shape[1]), "move": xi.sum(axis=0), "n": g.sum(axis=0), "x": g.T @ v,
                "xx": np.einsum("tk,ti,tj->kij", g, v, v), "log": total if len(g) else 0.0}


def chunks(df: DataFrame, predictors: list[str], keep: list[str]) -> RDD:
    """``((Ticker, chunk), {x, d, rows})`` hash-partitioned by key and persisted, rows of a series in order."""
    size = CHUNK
    placed = global_row_index(df.select("Ticker", "Date", "d", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(predictors)],
                                        *[F.col(c).alias(f"k_{c}") for c in keep]), "Date")
    names = [f"x{i}" for i in range(len(predictors))]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_g")
        item = {"x": pdf[names].to_numpy(float), "d": pdf["d"].to_numpy(np.int64), "rows": pdf[[f"k_{c}" for c in keep]]}
        return pd.DataFrame({"Ticker": [pdf["Ticker"].iloc[0]], "chunk": [int(pdf["_g"].iloc[0]) // size], "item": [pickle.dumps(item)]})

    packed = placed.groupBy("Ticker", F.floor(F.col("_g") / size).alias("_c")).applyInPandas(pack, "Ticker string, chunk long, item binary")
    # each EM round goes over the chunks: few of them a task, and no tasks without any, however finely the input is cut
    packed = packed.persist()
    n, cores = packed.count(), df.sparkSession.sparkContext.defaultParallelism
    held = packed.rdd.map(lambda r: ((r[0], r[1]), pickle.loads(r[2]))).partitionBy(max(1, min(n, cores), math.ceil(n / CHUNKS_A_TASK)))
    held.persist(StorageLevel.MEMORY_AND_DISK).count()
    packed.unpersist()
    return held


def _on(item: dict, f: Fold, test: bool) -> np.ndarray:
    inside = (item["d"] >= f.test_start) & (item["d"] < f.test_end) if test else item["d"] < f.train_end
    return inside & np.isfinite(item["x"]).all(axis=1)


def _messages(data: RDD, models: list[Hmm], folds: list[Fold], test: bool) -> RDD:
    """Per chunk and fold the state before it (None: no row counted yet) and the evidence after it."""
    def matrices(item):
        (ticker, c), v = item
        out = []
        for h, f in zip(models, folds):
            q = _Chunk(h, v["x"], _on(v, f, test))
            whole = q.product(q.step)[0]
            out.append((whole, q.product(q.started())[0][0] if q.first is not None else None))
        return ticker, (c, out)

    def scanned(item):
        ticker, parts = item
        parts = sorted(parts, key=lambda p: p[0])
        k = len(models[0].start)
        before = [[None] * len(models) for _ in parts]
        after = [[None] * len(models) for _ in parts]
        for f in range(len(models)):
            a, b = None, np.ones(k)
            for i, (_, out) in enumerate(parts):
                before[i][f] = a
                whole, start = out[f]
                if a is not None:
                    a = a @ whole
                elif start is not None:
                    a = start
                a = None if a is None else a / a.sum()
            for i in range(len(parts) - 1, -1, -1):
                after[i][f] = b
                b = parts[i][1][f][0] @ b
                b = b / b.max()
        return [((ticker, c), (p, q)) for (c, _), p, q in zip(parts, before, after)]

    return data.map(matrices).groupByKey(data.getNumPartitions()).flatMap(scanned)


def _add(a: list, b: list) -> list:
    return [{k: x[k] + y[k] for k in x} for x, y in zip(a, b)]


def initial(data: RDD, folds: list[Fold], k: int) -> list[Hmm]:
    """Means of ``k`` equal value ranges of the first input between its training mean +- 1.5 deviations, common covariance."""
    def sums(item):
        out = []
        for f in folds:
            x = item[1]["x"][_on(item[1], f, False)]
            out.append({"n": len(x), "x": x.sum(axis=0), "xx": x.T @ x})
        return out

    total = data.map(sums).reduce(_add)
    p = len(total[0]["x"])
    out, cuts, spread = [], [], []
    for t in total:
        n = max(t["n"], 1)
        m = t["x"] / n
        cov = t["xx"] / n - np.outer(m, m)
        spread.append(cov + np.eye(p) * (1e-6 * max(np.trace(cov) / p, 1e-12)))
        cuts.append(m[0] + np.sqrt(max(cov[0, 0], 0)) * 1.5 * (2 * np.arange(1, k) / k - 1))

    def groups(item):
        out = []
        for f, c in zip(folds, cuts):
            x = item[1]["x"][_on(item[1], f, False)]
            g = np.searchsorted(c, x[:, 0])
            one = (g[:, None] == np.arange(k)).astype(float)
            out.append({"n": one.sum(axis=0), "x": one.T @ x})
        return out

    parts = data.map(groups).reduce(_add)
    for t, g, cov in zip(total, parts, spread):
        mean = np.where(g["n"][:, None] > 0, g["x"] / np.maximum(g["n"], 1)[:, None], t["x"] / max(t["n"], 1))
        out.append(Hmm(np.full(k, 1 / k), np.full((k, k), 0.5 / k) + 0.5 * np.eye(k), mean, np.repeat(cov[None], k, axis=0)))
    return out


def fit(data: RDD, folds: list[Fold], k: int = 3, rounds: int = 100, tol: float = 0.01) -> list[Hmm]:
    """EM for all folds together, until each fold's likelihood gains less than ``tol`` in a round."""
    models = initial(data, folds, k)
    live = list(range(len(folds)))
    for _ in range(rounds):
        some, where = [models[i] for i in live], [folds[i] for i in live]

        def counts(item):
            v, (before, after) = item[1]
            return [_Chunk(h, v["x"], on).counts(v["x"], b, a) for h, on, b, a in zip(some, [_on(v, f, False) for f in where], before, after)]

        total = data.join(_messages(data, some, where, False), data.getNumPartitions()).map(counts).reduce(_add)
        nxt = []
        for i, t in zip(live, total):
            old = models[i]
            gained = t["log"] - old.log_likelihood[-1] if old.log_likelihood else np.inf
            history = [*old.log_likelihood, float(t["log"])]
            if t["n"].sum() == 0 or gained < tol:
                models[i] = Hmm(old.start, old.move, old.mean, old.cov, history)
                continue
            n = np.maximum(t["n"], 1e-10)
            mean = t["x"] / n[:, None]
            cov = t["xx"] / n[:, None, None] - np.einsum("ki,kj->kij", mean, mean)
            floor = 1e-6 * max(np.trace(old.cov.mean(axis=0)) / mean.shape[1], 1e-12)
            cov = cov + np.eye(mean.shape[1]) * floor
            share = lambda a: (a + 1e-12) / (a + 1e-12).sum(axis=-1, keepdims=True)
            models[i] = Hmm(share(t["start"]), share(t["move"]), mean, cov, history)
            nxt.append(i)
        live = nxt
        if not live:
            break
    for h in models:
        order = np.argsort(h.mean[:, 0], kind="stable")
        h.start, h.move, h.mean, h.cov = h.start[order], h.move[np.ix_(order, order)], h.mean[order], h.cov[order]
    return models


def posteriors(data: RDD, models: list[Hmm], folds: list[Fold], schema: str, spark) -> DataFrame:
    """Rows ``fold_id, posterior`` (array by state) and the kept columns, of each fold's test rows: forward-backward over the test window."""
    def run(item):
        v, (before, after) = item[1]
        out = []
        for h, f, b, a in zip(models, folds, before, after):
            inside = (v["d"] >= f.test_start) & (v["d"] < f.test_end)
            if inside.any():
                g = _Chunk(h, v["x"], _on(v, f, True)).posterior(b, a)[inside]
                out.append(pickle.dumps((f.fold_id, g, v["rows"][inside])))
        return [(bytearray(o),) for o in out]

    packed = spark.createDataFrame(data.join(_messages(data, models, folds, True), data.getNumPartitions()).flatMap(run), "item binary")

    def rows(batches):
        for pdf in batches:
            for item in pdf["item"]:
                fold_id, g, keep = pickle.loads(item)
                out = keep.rename(columns=lambda c: c[2:]).reset_index(drop=True)
                out.insert(0, "fold_id", fold_id)
                out.insert(1, "posterior", list(g))
                yield out

    return packed.mapInPandas(rows, f"fold_id int, posterior array<double>, {schema}")


def backtest(data: DataFrame, predictors: list[str], folds: list[Fold], k: int = 3, rounds: int = 100) -> tuple[DataFrame, list[Hmm], RDD]:
    """Walk-forward fits on ``data`` (Ticker, Date, d, Target, fwd_return, inputs): test posteriors, models, and the persisted chunks."""
    keep = ["Ticker", "Date", "Target", "fwd_return"]
    held = chunks(data, predictors, keep)
    models = fit(held, folds, k, rounds)
    schema = ", ".join(f"{c} {data.schema[c].dataType.simpleString()}" for c in keep)
    return posteriors(held, models, folds, schema, data.sparkSession), models, held
