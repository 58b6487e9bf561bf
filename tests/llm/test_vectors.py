"""Embedding near-duplicates: counts and components against brute force."""

import numpy as np

from candela.llm import vectors
from candela.llm.common import components, table

from conftest import SF_ORACLE


def brute(ids, m, threshold=0.95):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    link = u @ u.T >= threshold
    up = np.arange(len(ids))
    for i, j in zip(*np.nonzero(np.triu(link, 1))):
        a, b = up[i], up[j]
        if a != b:
            up[up == max(a, b)] = min(a, b)
    return {ids[i]: (int(link[i].sum()) - 1, min(ids[j] for j in np.flatnonzero(up == up[i]))) for i in range(len(ids))}


def result(df, **kw):
    return {(r.vec_id): (r.n_links, r.component_id) for r in vectors.near_duplicates(df, **kw).collect()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(25):  # groups from tight to loose, chains too
        centre = rng.standard_normal(32)
        for _ in range(rng.integers(1, 40)):
            rows.append(centre + rng.standard_normal(32) * (0.05, 0.2, 0.3, 0.33)[c % 4])
    chain = rng.standard_normal(32)
    for _ in range(60):
        chain = chain + rng.standard_normal(32) * 0.25
        rows.append(chain.copy())
    rows = np.array(rows + [rows[0], rows[0] * 1e200, rows[1] * 1e-200])
    ids = rng.permutation(len(rows)).tolist()
    odd = [(10_000, None), (10_001, [0.0] * 32), (10_002, [float("nan")] * 32), (10_003, [None] * 32), (10_004, [float("inf")] + [1.0] * 31), (10_005, []), (10_006, [1.0, 2.0])]
    df = spark.createDataFrame([(i, r.tolist(), 1, 2) for i, r in zip(ids, rows)] + [(*o, 1, 2) for o in odd] + [(10_007, [1.0, 2.0], 3, 4)],
                               "vec_id long, embedding array<double>, v int, component_id int")
    got, want = result(df.repartition(4)), brute(ids, np.array([r / np.abs(r).max() for r in rows]))
    assert all(got[i] == (0, i) for i, _ in odd[:-1]) and got[10_006] == (1, 10_006) == got[10_007][:1] + (10_006,)
    found, all_links = sum(got[i][0] for i in ids), sum(want[i][0] for i in ids)
    assert found >= 0.99 * all_links and all(got[i][0] <= want[i][0] for i in ids)
    assert sum(got[i][1] == want[i][1] for i in ids) >= 0.97 * len(ids)
    assert result(df.limit(0)) == {}


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    assert rows == [(False, 1, 1, 1, True), (False, 1, 1, 1, True), (False, 2, 1, 1, False), (True, 0, 0, None, True)]


def test_documents_table(spark):
    df = table(spark, SF_ORACLE, "embeddings")
    rows = df.collect()
    ids = [r.vec_id for r in rows]
    assert result(df) == brute(ids, np.array([r.embedding for r in rows], float))


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, i) for i in range(1001, 1400)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(path + star + [(5000, 5000)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1400)}}


def test_dense_source(spark):
    """20,000 vectors of mean cosine 0.8 with planted pairs: no link is lost."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre, n, planted = unit(rng.standard_normal(64)), 18_000, 2_000
    rows = np.sqrt(0.8) * centre + np.sqrt(0.2) * unit(rng.standard_normal((n, 64)))
    side = rng.standard_normal((planted, 64))
    side = unit(side - (side * rows[:planted]).sum(1, keepdims=True) / (rows[:planted] ** 2).sum(1, keepdims=True) * rows[:planted])
    rows = unit(np.concatenate([rows, rows[:planted] * np.sqrt(0.92) + side * np.sqrt(0.08) * np.linalg.norm(rows[:planted], axis=1, keepdims=True)]))
    want = sum(int((rows[i: i + 2000] @ rows.T >= 0.95).sum()) for i in range(0, len(rows), 2000)) - len(rows)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)
    found = sum(v[0] for v in result(df).values())
    print("links", found, want)
    assert want >= 2 * planted and 0.999 * want <= found <= want
