"""What tree models share: binned blocks of rows, trees as arrays, split search over histograms, ensembles as Spark expressions.

* ``binned_blocks``: each fold's inputs are cut at quantiles of its own training rows into at most ``MAX_BINS``
  bins; rows travel as numpy blocks of ``BLOCK_ROWS`` with their label, date ordinal, a hash of their key (for row
  sampling that no partitioning changes) and their output columns.
* Gradients are summed as 30-bit fixed point numbers. Integer sums don't depend on their order, so a fit gives the same
  trees on any number of partitions, and after the loss of an executor.
* ``Ensemble``: the fitted trees as flat arrays, walked by a Spark expression, so scoring needs no Python worker.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BINS = 255
BLOCK_ROWS = 1 << 16
LEAST_ROWS = 1 << 10
#: fixed point of gradients
ONE = float(1 << 30)
#: rounds between two reliable checkpoints of the state
CHECKPOINT_EVERY = 25
#: histogram cells (24 bytes each) that one pass fills
MAX_CELLS = 1 << 23


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the public splitmix64 finaliser)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(*keys) -> np.ndarray:
    """Numbers in [0, 1) from hashes of the keys (arrays broadcast)."""
    h = np.zeros(1, np.uint64)  # an array: its overflow is silent
    for k in keys:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.asarray(k).astype(np.uint64))
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


@dataclass(frozen=True)
class Fold:
    """Rows with ``d < train_end`` train, those with ``test_start <= d < test_end`` are scored."""
    fold_id: int
    train_end: int
    test_start: int = 0
    test_end: int = 0


def quantile_edges(df: DataFrame, predictors: list[str], folds: list[Fold], bins: int = MAX_BINS) -> list[list[np.ndarray]]:
    """Per fold and input the ascending upper edges of its bins but the last, from the fold's training rows.

    One aggregate for all folds and inputs (sketches with partial aggregation); at most ``bins`` numbers each reach the driver.
    """
    at = [float(q) for q in np.arange(1, bins) / bins]
    out = []
    for some in [folds[i:i + 8] for i in range(0, len(folds), 8)]:
        aggs = []
        for f in some:
            for c in predictors:
                x = F.when((F.col("d") < f.train_end) & ~F.isnan(F.col(c)), F.col(c).cast("double"))
                aggs.append(F.percentile_approx(x, F.lit(at) if len(at) > 1 else F.array(F.lit(at[0])), 10_000).alias(f"q{len(aggs)}"))
        row = df.agg(*aggs).first()
        for i in range(len(some)):
            out.append([np.unique(np.array(row[i * len(predictors) + k] or [], float)) for k in range(len(predictors))])
    return out


def binned_blocks(df: DataFrame, predictors: list[str], folds: list[Fold], edges: list[list[np.ndarray]], keep: list[str],
                  raw: bool = False, spread: int = 1) -> RDD:
    """Blocks ``x (fold, row, input), y, d, h, rows (an Arrow stream of the keep columns)`` of ``df`` (inputs, Target, d, keep).

    A null or NaN input lies in the lowest bin. With ``raw`` the values (null and NaN: -inf) come along. A table of
    few blocks is cut into up to ``spread`` partitions of ``LEAST_ROWS`` rows or more.
    """
    p = len(predictors)

    def pack(batches):
        held, n = [], 0

        def close():
            t = pa.Table.from_batches(held).combine_chunks()
            x, values = np.empty((len(folds), len(t), p), np.uint8), np.empty((len(t), p))
            for k in range(p):
                v = t.column(k).to_numpy(zero_copy_only=False).astype(float)
                v = np.where(np.isnan(v), -np.inf, v)
                values[:, k] = v
                for f in range(len(folds)):
                    x[f, :, k] = np.searchsorted(edges[f][k], v)
            sink = pa.BufferOutputStream()
            rest = t.select(range(p + 3, t.num_columns))
            with pa.ipc.new_stream(sink, rest.schema) as w:
                w.write_table(rest)
            block = {"x": x, "y": t.column(p).to_numpy().astype(np.float64), "d": t.column(p + 1).to_numpy().astype(np.int64),
                     "h": t.column(p + 2).to_numpy().astype(np.uint64), "rows": sink.getvalue().to_pybytes()} | ({"raw": values} if raw else {})
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK_ROWS:
                yield close()
                held, n = [], 0
        if n:
            yield close()

    y, d = F.col("Target").cast("double"), F.col("d").cast("long")
    key = F.xxhash64(*[F.col(c) for c in keep[:2]])  # the first kept columns name a row
    x = df.where(y.isNotNull()).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(predictors)], y.alias("y_"), d.alias("d_"), key.alias("h_"), *keep)
    n = x.count()
    parts = max(1, math.ceil(n / BLOCK_ROWS), min(spread, n // LEAST_ROWS))
    return x.repartition(parts).mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0]))


# ------------------------------------------------------------------ trees

@dataclass
class Tree:
    """Nodes as parallel lists. A node with ``feature`` -1 is a leaf, else bins up to ``cut`` go left."""
    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)
    depth: list = field(default_factory=list)
    count: list = field(default_factory=list)
    gain: list = field(default_factory=list)

    def add(self, value: float, depth: int, count: int) -> int:
        for a, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, value), (self.depth, depth),
                     (self.count, count), (self.gain, 0.0)):
            a.append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut, gain: float, left: tuple, right: tuple) -> tuple[int, int]:
        """Children from their ``(value, count)``."""
        self.feature[node], self.cut[node], self.gain[node] = int(feature), cut, float(gain)
        d = self.depth[node] + 1
        self.left[node], self.right[node] = self.add(left[0], d, left[1]), self.add(right[0], d, right[1])
        return self.left[node], self.right[node]

    def arrays(self) -> dict:
        return {"feature": np.array(self.feature, np.int32), "cut": np.array(self.cut), "left": np.array(self.left, np.int32),
                "right": np.array(self.right, np.int32), "value": np.array(self.value, np.float64), "steps": max(self.depth, default=0)}

    def compact(self) -> "Tree":
        """Without nodes that can't be reached."""
        out = Tree()
        queue, place = [0], {}
        for i in queue:
            place[i] = out.add(self.value[i], self.depth[i], self.count[i])
            out.feature[-1], out.cut[-1], out.gain[-1] = self.feature[i], self.cut[i], self.gain[i]
            if self.feature[i] >= 0:
                queue += [self.left[i], self.right[i]]
        for i, k in place.items():
            if self.feature[i] >= 0:
                out.left[k], out.right[k] = place[self.left[i]], place[self.right[i]]
        return out


def walk(tree: dict, x: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
    """The node that each row of ``x`` (rows x inputs, bins or values) comes to; from the nodes ``node``, one step."""
    steps = tree["steps"] if node is None else 1
    node = np.zeros(len(x), np.int32) if node is None else node
    at = np.arange(len(x)) * x.shape[1]
    flat = x.ravel()
    for _ in range(steps):
        f = tree["feature"][node]
        go = flat[at + np.maximum(f, 0)] <= tree["cut"][node]
        node = np.where(f >= 0, np.where(go, tree["left"][node], tree["right"][node]), node)
    return node


# ------------------------------------------------------------------ histograms

def cells(slot: np.ndarray, x: np.ndarray, weights: list[np.ndarray], slots: int, bins: int = MAX_BINS + 1) -> tuple[np.ndarray, np.ndarray]:
    """Filled cells of the histogram (slot, input, bin) and their integer sums, a column for the rows and one per weight."""
    p = x.shape[1]
    size = slots * p * bins
    key = ((slot[:, None] * p + np.arange(p)) * bins + x).ravel()
    n = np.bincount(key, minlength=size)
    at = np.flatnonzero(n)
    sums = [n[at]] + [np.bincount(key, weights=np.repeat(w, p), minlength=size)[at].astype(np.int64) for w in weights]
    return at, np.stack(sums, axis=1)


def added(a: tuple, b: tuple) -> tuple:
    """Two cell lists as one."""
    at = np.union1d(a[0], b[0])
    out = np.zeros((len(at), a[1].shape[1]), np.int64)
    out[np.searchsorted(at, a[0])] += a[1]
    out[np.searchsorted(at, b[0])] += b[1]
    return at, out


def dense(c: tuple, slots: int, p: int, bins: int = MAX_BINS + 1) -> np.ndarray:
    """Cells as an array (column, slot, input, bin)."""
    out = np.zeros((c[1].shape[1], slots * p * bins), np.int64)
    out[:, c[0]] = c[1].T
    return out.reshape(-1, slots, p, bins)


# ------------------------------------------------------------------ ensembles as data

def _array(values, kind: str) -> Column:
    """An array literal; the text is parsed once, when the plan is optimised."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast(f"array<{kind}>")


@dataclass
class Ensemble:
    """Fitted trees as flat arrays: node i goes left where ``inputs[feature[i]] <= threshold[i]``; leaves have feature -1."""
    feature: list
    threshold: list
    left: list
    right: list
    value: list
    roots: list
    steps: int
    prior: float                    # added to the sum over the trees
    link: str                       # 'logistic' (margins) or 'identity' (probabilities)
    importance: np.ndarray

    @staticmethod
    def of(trees: list[Tree], edges: list[np.ndarray] | None, inputs: int, prior: float, link: str, scale: float = 1.0) -> "Ensemble":
        out = Ensemble([], [], [], [], [], [], 0, prior, link, np.zeros(inputs))
        for t in trees:
            base = len(out.feature)
            out.roots.append(base)
            out.steps = max(out.steps, max(t.depth))
            for i, f in enumerate(t.feature):
                out.feature.append(f)
                out.threshold.append(0.0 if f < 0 else float(edges[f][t.cut[i]]) if edges else float(t.cut[i]))
                out.left.append(base + t.left[i])
                out.right.append(base + t.right[i])
                out.value.append(scale * float(t.value[i]))
                if f >= 0:
                    out.importance[f] += t.gain[i]
        total = out.importance.sum()
        out.importance = out.importance / total if total > 0 else out.importance
        return out

    def probability(self, inputs: list[Column]) -> Column:
        """P(class 1), an expression over the inputs (null or NaN ones go left, as in the fit)."""
        feature, threshold, left, right, value = (_array(a, k) for a, k in (
            (self.feature, "int"), (self.threshold, "double"), (self.left, "int"), (self.right, "int"), (self.value, "double")))
        x = F.array(*[F.coalesce(F.nanvl(c.cast("double"), F.lit(float("-inf"))), F.lit(float("-inf"))) for c in inputs])
        get = lambda a, i: F.get(a, i)

        def step(node, _):
            f = get(feature, node)
            return F.when(f < 0, node).otherwise(F.when(get(x, f) <= get(threshold, node), get(left, node)).otherwise(get(right, node)))

        def leaf(root):
            return F.aggregate(F.sequence(F.lit(1), F.lit(max(self.steps, 1))), root, step)

        total = F.aggregate(_array(self.roots, "int"), F.lit(float(self.prior)), lambda acc, r: acc + get(value, leaf(r)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total)) if self.link == "logistic" else total


def persisted(rdd: RDD) -> RDD:
    return rdd.persist(StorageLevel.MEMORY_AND_DISK)


def scored_rows(state: RDD, folds: list[Fold], specs: int, keep_schema: str, spark) -> DataFrame:
    """Rows ``spec, fold_id, score`` and the kept columns, of every fold's test rows.

    ``state`` holds (block, scores by spec and fold).
    """
    spans = [(f.fold_id, f.test_start, f.test_end) for f in folds]
    packed = spark.createDataFrame(state.map(lambda item: (bytearray(pickle.dumps((item[0]["d"], item[0]["rows"], item[1]))),)), "b binary")

    def run(batches):
        for batch in batches:
            for v in batch.column(0):
                d, rows, score = pickle.loads(v.as_py())
                with pa.ipc.open_stream(rows) as reader:
                    table = reader.read_all()
                for m in range(specs):
                    for f, (fold_id, a, e) in enumerate(spans):
                        at = np.flatnonzero((d >= a) & (d < e))
                        part = table.take(at)
                        n = len(at)
                        cols = [pa.array(np.full(n, m, np.int32)), pa.array(np.full(n, fold_id, np.int32)), pa.array(score[m * len(spans) + f][at])]
                        yield from pa.table(cols + part.columns, names=["spec", "fold_id", "score", *part.column_names]).combine_chunks().to_batches()

    return packed.mapInArrow(run, f"spec int, fold_id int, score double, {keep_schema}")
