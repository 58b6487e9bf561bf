"""Boosting against a plain numpy version that searches every node's cuts on its own rows."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.operators import boosting as bo
from candela.operators import trees as tr
from candela.operators.trees import Fold

P = ["a", "b", "c"]
FOLDS = [Fold(0, 60, 60, 80), Fold(1, 80, 80, 100)]
SPECS = {
    "classic": bo.Boost(4, 4, first_order=True),
    "newton": bo.Boost(4, 5, l2=1.0, hessian=1.0),
    "l1_gamma": bo.Boost(3, 4, l2=0.5, l1=0.2, gain=0.1, leaf=5, split=20),
    "leafwise": bo.Boost(4, 6, growth="leaf", leaves=7, leaf=10, hessian=1e-3),
    "oblivious": bo.Boost(4, 3, growth="oblivious", l2=3.0, prior=False),
    "sampled": bo.Boost(3, 3, l2=1.0, rows=0.7, columns=0.67),
}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(600):
        x = [float(rng.normal()), float(rng.integers(0, 6)), float(rng.uniform())]
        if i % 97 == 0:
            x[0] = float("nan")
        rows.append((i, *x, int(rng.uniform() < 0.2 + 0.5 * (x[1] > 2) * (x[2] > 0.4)), i % 100))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, Target int, d int").repartition(3).persist()


def plain_tree(s, x, g, h, cols):
    """``(feature, cut, left, right)`` or a leaf value, nested."""
    t = lambda a: np.sign(a) * max(abs(a) - s.l1, 0)
    score = lambda a, c: t(a) ** 2 / (c + s.l2) if c + s.l2 > 0 else 0.0
    value = lambda at: s.rate * t(g[at].sum()) / (h[at].sum() + s.l2) if h[at].sum() + s.l2 > 1e-12 else 0.0

    def gain_of(at, k, b):
        go = x[at, k] <= b
        l, r = at[go], at[~go]
        if s.growth != "oblivious" and (len(l) < s.leaf or len(r) < s.leaf or h[l].sum() < s.hessian or h[r].sum() < s.hessian):
            return None
        if s.growth == "oblivious" and len(at) == 0:
            return 0.0
        if s.first_order:
            return (g[l].mean() - g[r].mean()) ** 2 * len(l) * len(r) / len(at) if len(l) and len(r) else None
        return score(g[l].sum(), h[l].sum()) + score(g[r].sum(), h[r].sum()) - score(g[at].sum(), h[at].sum())

    def best(at):
        found = None
        for k in cols:
            for b in np.unique(x[at, k]).tolist():
                gain = gain_of(at, k, b)
                if gain is not None and (found is None or gain > found[0] + 1e-12):
                    found = (gain, k, b)
        if found and (found[0] if s.first_order else found[0] / 2 - s.gain) > bo.LEAST_GAIN:
            return found

    if s.growth == "oblivious":
        cuts, parts = [], [np.arange(len(x))]
        for _ in range(s.depth):
            found = max(((sum(gain_of(at, k, b) for at in parts), -k, -b) for k in cols for b in range(256)))
            if found[0] / 2 <= bo.LEAST_GAIN:
                break
            k, b = -found[1], -found[2]
            cuts.append((k, b))
            parts = [q for at in parts for q in (at[x[at, k] <= b], at[x[at, k] > b])]

        def nest(i, at):
            if i == len(cuts):
                return value(at)
            k, b = cuts[i]
            return k, b, nest(i + 1, at[x[at, k] <= b]), nest(i + 1, at[x[at, k] > b])
        return nest(0, np.arange(len(x)))

    if s.growth == "leaf":
        taken, order = {}, 0
        found = best(np.arange(len(x)))
        heap = [(-found[0], 0, (), np.arange(len(x)), found)] if found else []
        while heap and len(taken) < s.leaves - 1:
            _, _, path, at, (_, k, b) = heapq.heappop(heap)
            taken[path] = (k, b)
            for side, part in ((0, at[x[at, k] <= b]), (1, at[x[at, k] > b])):
                if len(path) + 1 < s.depth and len(part) >= max(s.split, 2 * s.leaf) and (f := best(part)):
                    order += 1
                    heapq.heappush(heap, (-f[0], order, (*path, side), part, f))

        def nest(path, at):
            if path not in taken:
                return value(at)
            k, b = taken[path]
            return k, b, nest((*path, 0), at[x[at, k] <= b]), nest((*path, 1), at[x[at, k] > b])
        return nest((), np.arange(len(x)))

    def grow(at, depth):
        found = best(at) if depth < s.depth and (depth == 0 or len(at) >= max(s.split, 2 * s.leaf)) else None
        if not found:
            return value(at)
        _, k, b = found
        return k, b, grow(at[x[at, k] <= b], depth + 1), grow(at[x[at, k] > b], depth + 1)
    return grow(np.arange(len(x)), 0)


def follow(tree, x):
    out = np.empty(len(x))
    for i, row in enumerate(x):
        t = tree
        while isinstance(t, tuple):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        out[i] = t
    return out


def plain_boost(s, x, y, train, h_key):
    pos, n = y[train].sum(), train.sum()
    margin = np.full(len(y), np.log(pos / (n - pos)) if s.prior else 0.0)
    for r in range(s.rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = np.rint((y - q) * tr.ONE) / tr.ONE, np.rint(q * (1 - q) * tr.ONE) / tr.ONE
        rows = train & (tr.uniform(s.seed + 1, r, h_key) < s.rows) if s.rows < 1 else train
        order = np.argsort(tr.uniform(s.seed, r, np.arange(x.shape[1])), kind="stable")
        cols = sorted(order[: max(1, int(round(s.columns * x.shape[1])))].tolist())
        margin = margin + follow(plain_tree(s, x[rows], g[rows], h[rows], cols), x)
    return margin


@pytest.fixture(scope="module")
def fitted(spark, table):
    return bo.boost(table, P, list(SPECS.values()), FOLDS, ["id"])


@pytest.mark.parametrize("name", SPECS)
def test_equals_plain_version(spark, table, fitted, name):
    m = list(SPECS).index(name)
    got = tr.scored_rows(fitted[3], FOLDS, len(SPECS), "id int", spark).filter(F.col("spec") == m).toPandas()
    data = table.withColumn("h", F.xxhash64("id")).toPandas().sort_values("id").reset_index(drop=True)
    for f, fold in enumerate(FOLDS):
        x = np.stack([np.searchsorted(fitted[2][f][k], np.where(np.isnan(data[c]), -np.inf, data[c])) for k, c in enumerate(P)], axis=1)
        want = plain_boost(SPECS[name], x, data["Target"].to_numpy(float), (data["d"] < fold.train_end).to_numpy(), data["h"].to_numpy().astype(np.uint64))
        mine = got[got.fold_id == fold.fold_id].sort_values("id")
        test = ((data["d"] >= fold.test_start) & (data["d"] < fold.test_end)).to_numpy()
        assert mine["id"].tolist() == data["id"][test].tolist()
        np.testing.assert_allclose(mine["score"], want[test], atol=1e-6)


def test_ensemble_expression_equals_state(spark, table, fitted):
    for m, s in enumerate(SPECS.values()):
        e = bo.ensembles(fitted, 3)[m][1]
        got = tr.scored_rows(fitted[3], FOLDS, len(SPECS), "id int", spark).filter((F.col("spec") == m) & (F.col("fold_id") == 1))
        both = got.join(table, "id").select((1 / (1 + F.exp(-F.col("score")))).alias("want"), e.probability([F.col(c) for c in P]).alias("got")).toPandas()
        np.testing.assert_allclose(both["got"], both["want"], atol=1e-9)
        assert abs(e.importance.sum() - 1) < 1e-9


def test_partitions_and_passes_do_not_matter(spark, table, monkeypatch):
    specs = [SPECS["newton"], SPECS["leafwise"], SPECS["oblivious"]]
    one = bo.boost(table, P, specs, FOLDS, ["id"])
    monkeypatch.setattr(tr, "BLOCK_ROWS", 100)
    monkeypatch.setattr(tr, "MAX_CELLS", 4000)
    monkeypatch.setattr(bo, "CHUNK", 3)
    monkeypatch.setattr(tr, "CHECKPOINT_EVERY", 2)
    many = bo.boost(table, P, specs, FOLDS, ["id"])
    assert many[3].getNumPartitions() == 6 and one[3].getNumPartitions() == 1
    assert one[0] == many[0]


def test_leaf_limits_and_loss(spark, table, fitted):
    trees = fitted[0]
    for t in trees[list(SPECS).index("leafwise")][0]:
        leaves = [i for i, f in enumerate(t.feature) if f < 0]
        assert len(leaves) <= 7 and min(t.count[i] for i in leaves) >= 10 and max(t.depth) <= 6
    for t in trees[list(SPECS).index("oblivious")][0]:
        for d in range(max(t.depth)):
            assert len({(t.feature[i], t.cut[i]) for i in range(len(t.feature)) if t.depth[i] == d}) == 1
    four = {tuple(map(tuple, (t.feature for t in trees[m][0]))) for m in range(5)}
    assert len(four) == 5


def test_one_class_and_no_rows(spark, table):
    folds = [Fold(0, 0, 60, 70), Fold(1, 50, 60, 70)]
    trees, prior, _, state = bo.boost(table.withColumn("Target", F.lit(1)), P, [SPECS["newton"]], folds, ["id"])
    assert trees == [[[], []]] and prior == [[0.0, 0.0]]
    assert tr.scored_rows(state, folds, 1, "id int", spark).count() == 120


def test_a_small_table_takes_few_jobs(spark, table):
    sc = spark.sparkContext
    sc.setJobGroup("small-boost", "")
    try:
        bo.boost(table, P, [SPECS["newton"], SPECS["leafwise"]], FOLDS, ["id"])[3].unpersist()
        # a job for each tree level before
        assert 0 < len(sc.statusTracker().getJobIdsForGroup("small-boost")) <= 14 < SPECS["newton"].rounds * SPECS["newton"].depth
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
