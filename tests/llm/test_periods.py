"""Periodic runs against a quadratic search; the grammar's extensions against word by word ones."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from candela.llm import periods
from candela.llm.common import table

from conftest import SF_ORACLE


def brute_runs(w, least=6, times=4):
    found = {}
    n = len(w)
    x = np.unique(np.array(w, dtype=object).astype(str), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // times + 1):
        same = np.concatenate([[False], x[q:] == x[:-q], [False]])
        edge = np.flatnonzero(np.diff(same.view(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + q >= max(least, times * q):
                found.setdefault((a, b + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute(rows, plant=True):
    out = []
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0D]+", t or "")
        h = 1 if d is None else zlib.crc32(str(d).encode())
        n, g = len(w), h // 10
        if plant and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        r = brute_runs(w)
        gone = {i for s, k, q in r for i in range(s + q, s + k)}
        best = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else (None, None, None)
        out.append((d, len(r), *best, 1000 * best[1] // best[2] if r else None,
                    hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in r).encode()).hexdigest(),
                    hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return order(out)


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r])


def texts(rng):
    """Words that repeat at many scales."""
    out = []
    while len(out) < rng.randint(0, 300):
        k = rng.random()
        if k < .3 or not out:
            out += [rng.randint(0, 3) for _ in range(rng.randint(1, 10))]
        elif k < .6:
            p = rng.randint(1, min(len(out), 25))
            out += (out[-p:] * 9)[: rng.randint(1, 6 * p)]
        else:
            a = rng.randrange(len(out))
            out += out[a: a + rng.randint(1, 60)] * rng.randint(1, 4)
    return out


def test_extensions():
    rng = random.Random(1)
    for _ in range(60):
        w = np.array(texts(rng) or [0], np.int64)
        n = len(w)
        g = periods.Grammar(w)
        i = np.array([rng.randint(0, n) for _ in range(300)])
        j = np.array([rng.randint(0, n) for _ in range(300)])
        for got, step in ((g.forward(i, j), 1), (g.backward(i, j), -1)):
            for a, b, k in zip(i.tolist(), j.tolist(), got.tolist()):
                want = 0
                while (0 <= a + want < n and 0 <= b + want < n and w[a + want] == w[b + want]) if step > 0 else (a - want > 0 and b - want > 0 and w[a - want - 1] == w[b - want - 1]):
                    want += 1
                assert k == want, (w.tolist(), a, b, step)


def test_grammar_is_shallow():
    for w in (np.zeros(100_000, np.int64), np.arange(100_000) % 7, np.random.default_rng(0).integers(0, 50, 100_000)):
        g = periods.Grammar(w)
        assert len(g.symbols) < 80 and sum(map(len, g.symbols)) < 10 * len(w)


def test_runs_against_quadratic_search():
    rng = random.Random(2)
    for least, times in ((6, 4), (2, 2), (9, 3)):
        for _ in range(150):
            w = texts(rng)
            got = periods.runs(np.array([*w, -1], np.int64), len(w), least, times) if w else np.zeros((0, 3))
            assert list(map(tuple, got.tolist())) == brute_runs(w, least, times), (w, least, times)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=80), st.integers(1, 9))
def test_binary_words(w, k):
    w = w * k
    got = periods.runs(np.array([*w, 7], np.int64), len(w))
    assert list(map(tuple, got.tolist())) == brute_runs(w)


def test_hostile_rows(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice([" ", "\n", "\t "]).join(f"{'é' if x == 2 else 'w'}{x}" for x in texts(rng))) for i in range(200)]
    docs += [(None, "a b " * 20), (None, None), (7, None), (8, ""), (9, " \n"), (1010, "a " * 60_000), (1011, "x\x1cy \x85 x\x1cy \x85 " * 12), (12, docs[4][1]), (12, docs[4][1])]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, runs int, start string, n_words int").repartition(4)
    rows = periods.digest(periods.periodic_runs(df)).collect()
    small = [d for d in docs if d[0] != 1010]
    assert order(r for r in rows if r.doc_id != 1010) == brute(small, plant=False)
    long_ = [r for r in rows if r.doc_id == 1010]
    assert [(r.n_runs, r.start, r.length, r.period) for r in long_] == [(1, 0, 60_000, 1)]
    assert periods.digest(periods.periodic_runs(df.limit(0))).collect() == []
    out = periods.periodic_runs(df).filter("doc_id = 1011").first()
    assert out.n_words == 48 and out.collapsed == "x\x1cy \x85" and out.runs[0].period == 2


def test_whole_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF_ORACLE, "documents").select("doc_id", "text").collect()]
    got = periods.op13_periods(spark, SF_ORACLE)
    assert got.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    assert order(got.collect()) == brute(rows)
