"""Forests and randomised trees against a plain numpy version under the same hashes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.operators import forest as fr
from candela.operators import trees as tr
from candela.operators.trees import Fold

P = ["a", "b", "c", "e"]
FOLDS = [Fold(0, 60, 60, 80), Fold(1, 80, 80, 100)]
SPECS = {
    "forest": fr.Forest(6, 5, leaf=4),
    "split": fr.Forest(6, 5, leaf=4, split=60),
    "balanced": fr.Forest(6, 5, leaf=4, balanced=True),
    "extra": fr.Forest(6, 6, leaf=3, split=12, bootstrap=False, random_cuts=True),
    "extra_balanced": fr.Forest(5, 4, bootstrap=True, random_cuts=True, balanced=True),
}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(700):
        x = [float(rng.normal()), float(rng.integers(0, 6)), float(rng.uniform()), 1.0]
        if i % 97 == 0:
            x[0] = float("nan") if i % 2 else float("inf")
        rows.append((i, *x, int(rng.uniform() < 0.1 + 0.5 * (x[1] > 2) * (x[2] > 0.4)), i % 100))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, e double, Target int, d int").repartition(3).persist()


def plain_tree(s, t, x, y, m, w):
    """Rows of ``x`` (bins, or values for random cuts) drawn ``m`` times; nodes numbered as they are opened, level by level."""
    def sums(at):
        return len(at), w[0] * m[at][y[at] == 0].sum(), w[1] * m[at][y[at] == 1].sum()

    score = lambda q: (q[1] ** 2 + q[2] ** 2) / (q[1] + q[2]) if q[1] + q[2] else 0.0
    nodes = [{"at": np.flatnonzero(m > 0), "depth": 0}]
    i = 0
    level = [0]
    while level:
        nxt = []
        for i in level:
            n = nodes[i]
            at = n["at"]
            q = sums(at)
            if n["depth"] >= s.depth or len(at) < max(s.split, 2 * s.leaf if i else s.split) or not q[1] or not q[2]:
                continue
            feats = fr.looked_at(s, t, np.array([i]), x.shape[1])[0]
            best = None
            for k in feats.tolist():
                v = x[at, k]
                if s.random_cuts:
                    fine = v[np.isfinite(v)]
                    if not len(fine) or fine.min() == fine.max():
                        continue
                    u = tr.uniform(s.seed + 2, t, np.array([i]), np.array([k]))[0]
                    cuts = [fine.min() + u * (fine.max() - fine.min())]
                else:
                    cuts = np.unique(v).tolist()
                for c in cuts:
                    l, r = at[v <= c], at[v > c]
                    if min(len(l), len(r)) >= max(s.leaf, 1):
                        gain = score(sums(l)) + score(sums(r)) - score(q)
                        if gain > fr.LEAST_GAIN and (best is None or gain > best[0] + 1e-12):
                            best = (gain, k, c, l, r)
            if best:
                n["cut"] = best[1:3]
                n["kids"] = len(nodes), len(nodes) + 1
                nodes += [{"at": best[3], "depth": n["depth"] + 1}, {"at": best[4], "depth": n["depth"] + 1}]
                nxt += list(n["kids"])
        level = nxt

    def value(row):
        n = nodes[0]
        while "cut" in n:
            k, c = n["cut"]
            n = nodes[n["kids"][0] if row[k] <= c else n["kids"][1]]
        q = sums(n["at"])
        return q[2] / (q[1] + q[2])

    return nodes, value


@pytest.fixture(scope="module")
def grown(table):
    return fr.grow(table, P, list(SPECS.values()), FOLDS, ["id"])


@pytest.mark.parametrize("name", SPECS)
def test_equals_plain_version(spark, table, grown, name):
    trees, edges, blocks = grown
    s, m = SPECS[name], list(SPECS).index(name)
    got = tr.scored_rows(fr.scores(trees, list(SPECS.values()), blocks), FOLDS, len(SPECS), "id int", spark).filter(F.col("spec") == m).toPandas()
    data = table.withColumn("h", F.xxhash64("id")).toPandas().sort_values("id").reset_index(drop=True)
    raw = np.stack([np.where(np.isnan(data[c]), -np.inf, data[c]) for c in P], axis=1)
    y, h = data["Target"].to_numpy(), data["h"].to_numpy().astype(np.uint64)
    for f, fold in enumerate(FOLDS):
        train = (data["d"] < fold.train_end).to_numpy()
        x = raw if s.random_cuts else np.stack([np.searchsorted(edges[f][k], raw[:, k]) for k in range(len(P))], axis=1)
        n, pos = train.sum(), y[train].sum()
        w = (n / (2 * (n - pos)), n / (2 * pos)) if s.balanced else (1.0, 1.0)
        test = np.flatnonzero((data["d"] >= fold.test_start) & (data["d"] < fold.test_end))
        want = np.zeros(len(test))
        for t in range(s.trees):
            mult = fr.multiplicity(s, t, h[train])
            nodes, value = plain_tree(s, t, x[train], y[train], mult, w)
            assert sum("cut" in q for q in nodes) == sum(g >= 0 for g in trees[m][f][t].feature)
            want += [value(x[i]) for i in test]
        mine = got[got.fold_id == fold.fold_id].sort_values("id")
        assert mine["id"].tolist() == data["id"].to_numpy()[test].tolist()
        np.testing.assert_allclose(mine["score"], want / s.trees, atol=1e-9)


def test_limits_change_the_tree(grown):
    trees, names = grown[0], list(SPECS)
    pick = lambda n: trees[names.index(n)][1]
    for name in SPECS:
        for t in pick(name):
            inner = [i for i, f in enumerate(t.feature) if f >= 0]
            assert all(t.count[i] >= SPECS[name].split for i in inner)
            assert all(t.count[i] >= SPECS[name].leaf for i, f in enumerate(t.feature) if f < 0) and max(t.depth) <= SPECS[name].depth
    assert sum(len(t.feature) for t in pick("split")) < sum(len(t.feature) for t in pick("forest"))
    assert [t.value for t in pick("balanced")] != [t.value for t in pick("forest")]
    mean = lambda n: np.mean([t.value[0] for t in pick(n)])
    assert abs(mean("balanced") - 0.5) < 0.1 < abs(mean("forest") - 0.5)


def test_ensemble_expression_equals_scores(spark, table, grown):
    trees, edges, blocks = grown
    specs = list(SPECS.values())
    rows = tr.scored_rows(fr.scores(trees, specs, blocks), FOLDS, len(specs), "id int", spark).join(table, "id")
    for m, per in enumerate(fr.ensembles(trees, specs, edges, len(P))):
        both = rows.filter((F.col("spec") == m) & (F.col("fold_id") == 0)).select("score", per[0].probability([F.col(c) for c in P]).alias("got")).toPandas()
        np.testing.assert_allclose(both["got"], both["score"], atol=1e-9)


def test_partitions_do_not_matter(table, grown, monkeypatch):
    monkeypatch.setattr(tr, "BLOCK_ROWS", 90)
    monkeypatch.setattr(tr, "MAX_CELLS", 3000)
    many = fr.grow(table, P, list(SPECS.values()), FOLDS, ["id"])
    assert many[2].getNumPartitions() == 8 > grown[2].getNumPartitions()
    assert many[0] == grown[0]


def test_no_training_rows(spark, table):
    trees, edges, blocks = fr.grow(table, P, [fr.Forest(2, 3)], [Fold(0, 0, 60, 70)], ["id"])
    out = tr.scored_rows(fr.scores(trees, [fr.Forest(2, 3)], blocks), [Fold(0, 0, 60, 70)], 1, "id int", spark).collect()
    assert {r.score for r in out} == {0.5}


def test_a_small_table_takes_few_jobs(spark, table):
    sc = spark.sparkContext
    sc.setJobGroup("small-forest", "")
    try:
        fr.grow(table, P, [fr.Forest(3, 15), fr.Forest(3, 15, random_cuts=True)], FOLDS, ["id"])[2].unpersist()
        # one to three jobs for each tree level before
        assert 0 < len(sc.statusTracker().getJobIdsForGroup("small-forest")) <= 14
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
