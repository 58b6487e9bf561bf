"""Importance resampling against a plain Python version with zlib's CRC over whole n-gram strings."""

import hashlib
import math
import random
import re
import zlib

import numpy as np

from candela.llm import resample
from candela.llm.common import table, text_bytes

from conftest import SF_ORACLE, SF_SMALL

UP = {i: i + 32 for i in range(65, 91)}


def grams(text, orders=3):
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    return w, [" ".join(w[i:i + k]) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, buckets=10_000, percent=5, min_words=20):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for g in grams(x)[1]:
                side[bucket(g)] += 1
    up, down = sum(s) + buckets, sum(t) + buckets
    gain = [math.floor(1000 * math.log((b + 1) * up / ((a + 1) * down))) for a, b in zip(s, t)]
    rows = []
    for d, x in docs:
        w, g = grams(x)
        weight = sum(gain[bucket(y)] for y in g)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(g), weight, score, len(w) >= min_words and d is not None])
    free = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0], r[1]))
    rank = {id(r): i for i, r in enumerate(free[: 5 * len(free) // 100 if percent == 5 else percent * len(free) // 100], 1)}
    return order([(*r[:4], rank.get(id(r))) for r in rows])


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is not None, x or 0) for x in r])


def test_crcs_of_any_stretch():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    p = resample.running_crcs(data)
    assert p.tolist() == [zlib.crc32(data[:i].tobytes()) for i in range(5001)]
    s = rng.integers(0, 5001, 3000)
    e = rng.integers(s, 5001)
    got = p[e] ^ resample.shift(p[s], e - s)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(s, e)]
    assert resample.running_crcs(data[:0]).tolist() == [0]


def test_features_are_the_n_grams():
    import pyarrow as pa
    texts = ["Ab-c d", None, "", "é9 --", "x", "--", "Z" * 700 + " end", "\x00\x7f", "a b c d e"]
    owner, crcs, whose = resample.features(*text_bytes(pa.array(texts)))
    for d, t in enumerate(texts):
        mine = [c for cs, w in zip(crcs, whose) for c in cs[(w >= owner[d]) & (w < owner[d + 1])].tolist()]
        assert mine == [zlib.crc32(g.encode()) for g in grams(t)[1]]


def hostile():
    rng = random.Random(5)
    vocab = ["The", "of", "é", "x9", "ÀB", " ", "A-b", "_", "the"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(150)]
    docs += [(None, text(40)), (None, None), (7, None), (8, ""), (9, text(30_000)), (11, docs[3][1])]
    docs += [(500, "a b " * 30)] * 40 + [(500, "c " * 50)]
    return docs


def test_against_brute_force(spark):
    docs, target = hostile(), ["the of x9", None, "", "b the of", "b the of"]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs], "doc_id long, text string, rank string, score int, bucket int").repartition(5)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert order(resample.resample(df, aim).collect()) == brute(docs, target)
    assert order(resample.resample(df, aim, percent=50).collect()) == brute(docs, target, percent=50)
    assert order(resample.resample(df, aim.limit(0), percent=30).collect()) == brute(docs, [], percent=30)
    assert resample.resample(df.limit(0), aim).collect() == []
    out = resample.drawn(df, aim, percent=50)
    assert out.columns == ["doc_id", "text", "rank", "score", "bucket", "rank_"]
    assert {r.doc_id for r in out.collect()} == {r[0] for r in brute(docs, target, percent=50) if r[4]}


def test_whole_documents(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF_ORACLE, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in table(spark, SF_ORACLE, "benchmark").collect()]
    got = resample.op11_resample(spark, SF_ORACLE)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert order(got.collect()) == brute(docs, target)


def test_draw_follows_the_target(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    german = spark.createDataFrame([(r.text,) for r in docs.filter("lang = 'de'").collect()], "text string")
    got = resample.drawn(docs, german).collect()
    assert len(got) >= 5 and sum(r.lang == "de" for r in got) >= 0.8 * len(got), rows[:1]
