"""The bigram model against a plain Python version; it must beat the base on held-out text."""

import math
import re
import zlib
from collections import Counter

import pytest

from candela.llm import lm
from candela.llm.common import table, written

from conftest import SF_SMALL


def brute(rows, weights):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(d, zlib.crc32(b"" if d is None else str(d).encode()) % 10, re.findall("[^\x20\x09-\x0D]+", (t or "").translate(low)) + [0]) for d, t in rows]
    c, pair = Counter(), Counter()
    for _, part, w in docs:
        if part:
            c.update(w)
            pair.update(zip([0] + w, w))
    n, v = sum(c.values()), len(c)
    out = []
    for d, part, w in docs:
        base = [(c[x] + .1) / (n + .1 * (v + 1)) for x in w]
        full = [weights[c[a].bit_length()] * pair[a, x] / max(c[a], 1) + (1 - weights[c[a].bit_length()]) * u for a, x, u in zip([0] + w, w, base)]
        out.append((d is None, d or 0, part == 0, len(w), sum(c[x] > 0 for x in w), n, sum(map(math.log10, base)), sum(map(math.log10, full))))
    return sorted(out)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    model = lm.fit(df)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(df, model).collect())
    want = brute(rows, model.weights)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    for g, w in zip(got, want):
        assert g[6:] == pytest.approx(w[6:], rel=1e-9)
    return model, got


def test_edges(spark):
    rows = [(i, "A b\x1cc  the\nTHE É é " * (i % 7)) for i in range(200)] + [(None, "the a"), (5, None), (5, ""), (6, "word " * 50_000), (7, "tie"), (7, "tie")]
    df = written(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, chunk int, kind string").repartition(3), "t")
    check(df)
    empty = written(df.limit(0), "t")
    assert lm.score(empty, lm.fit(empty)).count() == 0


def test_documents(spark, monkeypatch):
    df = table(spark, SF_SMALL, "documents")
    model, got = check(df)
    held = [g for g in got if g[2]]
    assert sum(g[7] for g in held) > sum(g[6] for g in held)
    assert 0 < max(model.weights) < 1


def test_top_context_crosses_a_power_of_two(spark):
    part = lambda i: zlib.crc32(str(i).encode()) % 10
    fitted = lambda n: sum(part(i) > 1 for i in range(n))
    seen = lambda n: sum(part(i) > 0 for i in range(n))
    n = next(n for n in range(20, 2000) if fitted(n).bit_length() < seen(n).bit_length() and any(part(i) == 1 for i in range(n)))
    df = written(spark.createDataFrame([(i, f"the same w{i}") for i in range(n)], "doc_id long, text string"), "t")
    model, got = check(df)
    assert model.weights[seen(n).bit_length()] == model.weights[fitted(n).bit_length()] > 0 == model.weights[0]
    assert all(g[7] > g[6] for g in got if g[2])  # bigrams after "the" and the end token count
