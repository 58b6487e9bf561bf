"""N-gram Jaccard join against brute force on hostile rows and on the documents."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from candela.llm import jaccard
from candela.llm.common import BATCH_BYTES, table

from conftest import SF_ORACLE


def brute(rows, percent=85, k=4):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    seen = set()
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        for j in {j for g in s for j in where[g] if j > i}:
            a, b = rows[i][0], rows[j][0]
            if b is None or (both := len(s & sets[j])) * 100 < percent * (len(s) + len(sets[j]) - both):
                continue
            seen.add((a, b))
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return sorted((d is None, d or 0, len(s), None if d is None else root(d)) for (d, _), s in zip(rows, sets))


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.ngram_join(df).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 7)
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 6, 9, 14, 30, 80, 300, 900]))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 25)):  # around the threshold: each change touches four shingles
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < .3:
                w = w[rng.randint(0, len(w) // 12):]
            rows.append((len(rows) * 3 % 1009, rng.choice([" ", "\n", "\t "]).join(w).upper() if rng.random() < .2 else " ".join(w)))
    rows += [(2001, None), (2002, ""), (2003, "a b"), (2004, "A  B"), (2005, "b a"), (2006, "x " * 60_000), (2007, "X " * 50), (None, "a b"), (2008, "one"), (2009, "ONE"), (5, "a b"), (5, "q")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n int, id string").repartition(5)
    assert result(df) == brute(rows)
    assert result(df.limit(0)) == []


def test_documents(spark):
    df = table(spark, SF_ORACLE, "documents").select("doc_id", "text")
    assert result(df.repartition(6)) == brute([tuple(r) for r in df.collect()])


def test_a_strip_takes_little_memory():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(5000)]
    texts = pa.array([" ".join(rng.choices(vocab, k=400)) for _ in range(jaccard.STRIP // 2300)])
    assert jaccard.STRIP * 0.8 < sum(map(len, texts.to_pylist())) < jaccard.STRIP * 1.2
    list(jaccard.shingle_sets(texts[:1], 5))  # tables of powers
    bands, size = jaccard.Bands(80), texts.nbytes
    tracemalloc.start()
    try:
        sets = list(jaccard.shingle_sets(texts, 5))
        made = tracemalloc.get_traced_memory()[1]
        flat, n = np.concatenate(sets), np.array([len(s) for s in sets])
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        keys, whose = jaccard._keys(flat, n, bands.of(n), bands)
        keyed = tracemalloc.get_traced_memory()[1] - held
    finally:
        tracemalloc.stop()
    assert made < 5 * size and keyed < 5 * size, (made / size, keyed / size)
    one, _ = jaccard._piece_keys(flat, n, bands.of(n), bands)  # in pieces as at once
    assert (keys == one).all() and whose[-1] == len(n) - 1 and (np.diff(whose) >= 0).all()


def test_long_rows_reach_python_in_small_batches(spark, monkeypatch):
    key, real, seen = "spark.sql.execution.arrow.maxBytesPerBatch", jaccard._groups, []
    spark.conf.set(key, "64m")
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat('some long text ', 600) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    def spy(docs, percent, size):
        seen.append(docs.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0])
        return real(docs, percent, size)

    monkeypatch.setattr(jaccard, "_groups", spy)
    try:
        _, linked = jaccard.near_groups(docs)
        assert linked.filter("component_id = 0").count() == 3000
        assert seen[0] <= BATCH_BYTES + 20_000
        assert spark.conf.get(key) == "64m"  # the session's own setting is back
    finally:
        spark.conf.unset(key)
