"""Substring dedup against a plain Python version, on hostile rows and on the documents."""

import random
import re

from candela.llm import passages
from candela.llm.common import table

from conftest import SF_SMALL


def brute(rows, k=13):
    least, split = {}, []
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0D]+", t or "")
        key = float("-inf") if d is None else d
        split.append((d, key, w))
        for i in range(len(w) - k + 1):
            g = tuple(w[i:i + k])
            least[g] = min(least.get(g, key), key)
    out = []
    for d, key, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if least[tuple(w[i:i + k])] < key:
                gone[i:i + k] = [True] * k
        out.append((d is None, d or 0, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in passages.dedup_passages(df).collect())


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = ["a", "b", "çé", "the", "\x85", "of", "x\x1cy", "word"]
    blanks = [" ", "  ", "\n", "\t\r", "\x0b", "\x0c "]
    passage = [" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passage) if rng.random() < .4 else "".join(rng.choice(vocab) + rng.choice(blanks) for _ in range(rng.randint(0, 40)))
                 for _ in range(rng.randint(0, 5))]
        rows.append((rng.randint(0, 120), " ".join(parts)))
    rows += [(None, passage[0]), (None, None), (7, None), (8, ""), (9, "a " * 20_000), (3, "a " * 100), (500, passage[1]), (500, passage[1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, first string, n int").repartition(5)
    assert result(df) == brute(rows)
    assert result(df.limit(0)) == []


def test_documents(spark):
    df = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    assert result(df.repartition(6)) == brute([tuple(r) for r in df.collect()])
