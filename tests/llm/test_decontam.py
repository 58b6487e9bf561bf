"""Decontamination: every planted passage within the budget is found, clean texts stay."""

import pickle
import random
import re

import numpy as np
import pyarrow as pa

from candela.llm import decontam
from candela.llm.common import table, text_bytes

from conftest import SF_ORACLE


def fold(t):
    return re.sub(rb"[^a-z0-9\x80-\xff]+", b" ", (t or "").lower().encode()).strip(b" ")


def least_edits(seg, text):
    """Semi-global edit distance, plain."""
    row = np.zeros(len(text) + 1, int)
    x = np.frombuffer(text, np.uint8)
    for i, c in enumerate(seg):
        new = np.concatenate([[i + 1], np.minimum(row[:-1] + (x != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def passages_of(items):
    """(item, passage) by the stated rule, plainly."""
    out = set()
    for i, text in items:
        x = fold(text)
        if len(x) < decontam.MIN_BYTES:
            continue
        words, found = x.split(b" "), set()
        for a in range(len(words) - decontam.WORDS + 1):
            for b in range(a + decontam.WORDS, len(words) + 1):
                p = b" ".join(words[a:b])
                if len(p) >= decontam.MIN_BYTES:
                    found.add(p[: decontam.LONGEST])
                    break
        out |= {(i, p) for p in found or {x[: decontam.LONGEST]}}
    return out


def brute(texts, items):
    return {(r, i, p) for r, t in enumerate(texts) for i, p in passages_of(items) if least_edits(p, fold(t)) <= int(decontam.EDITS * len(p))}


def found(passages, texts):
    row, some, _ = passages.search(pa.array([t and t.lower() for t in texts]))
    out = set()
    for r, s in zip(row.tolist(), some.tolist()):
        o = passages.owner[s]
        a = passages.base[o] + passages.head[s]
        out.add((r, passages.item[o], passages.text[a: a + passages.size[s]].tobytes()))
    return out


def test_normalisation():
    texts = ["", "  A--b ", "...", "é!É", "x", " ", "a  b\n\n"]
    x, off = decontam.normalised(*text_bytes(pa.array(texts)))
    assert [x[a:b].tobytes() for a, b in zip(off, off[1:])] == [re.sub(rb"[^a-z0-9\x80-\xff]+", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())).strip(b" ") for t in texts]


def test_equal_to_plain_alignment():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 12, 20, 45])))) for i in range(12)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        t = list(rng.choice(items)[1])
        if rng.random() < .3:
            t = t[rng.randint(0, len(t) // 3):]
        for _ in range(rng.randint(0, max(1, len(t) // 9))):
            at, kind = rng.randrange(len(t)), rng.random()
            t[at:at + 1] = [] if kind < .3 else [rng.choice("xyz")] if kind < .6 else [t[at], "q"]
        parts.insert(rng.randint(0, 1), "".join(t).upper() if rng.random() < .3 else "".join(t).replace(" ", ", "))
        texts.append(" ".join(parts))
    texts += ["", None, "a", "the " * 30_000, items[0][1] * 400]
    assert found(decontam.Passages(items), texts) == brute(texts, items)


def test_every_length_and_edit_count():
    rng = random.Random(4)
    for n in range(24, 201):
        item = "".join(rng.choice("abcdefghijklmnop") for _ in range(n))  # one word
        k = int(decontam.EDITS * min(n, decontam.LONGEST))
        passages = decontam.Passages([(1, item)])
        texts = []
        for edits in range(k + 2):
            for _ in range(3):
                t = list(item)
                for at in rng.sample(range(min(n, decontam.LONGEST)), edits):
                    t[at] = rng.choice(["", "z", t[at] + "z"])
                texts.append("x " + "".join(t) + " y")
        assert found(passages, texts) == brute(texts, [(1, item)]), n


def test_thirteen_words_from_every_place():
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    other = ["".join(rng.choice("bcdfghkm") for _ in range(6)) for _ in range(40)]
    passages = decontam.Passages([(7, " ".join(words))])
    texts = [" ".join(other[:20] + words[a:a + decontam.WORDS] + other[20:]) for a in range(48)]
    row, _, _ = passages.search(pa.array(texts))
    assert set(row.tolist()) == set(range(48))
    none, _, _ = passages.search(pa.array([" ".join(other[:20] + words[a:a + 8] + other[20:]) for a in range(52)]))
    assert not len(none)


def test_index_is_bounded():
    rng = random.Random(6)
    items = [(i, " ".join("".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(2, 9))) for _ in range(60))) for i in range(600)]
    fixed = len(pickle.dumps(decontam.Passages(items[:1])))
    assert len(pickle.dumps(decontam.Passages(items))) - fixed <= decontam.INDEX_PER_BYTE * sum(len(t) for _, t in items)


def test_queries_and_edges(spark):
    docs, bench = table(spark, SF_ORACLE, "documents"), table(spark, SF_ORACLE, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontam.find(docs, bench).collect()}
    items = {r.item_id: fold(r.text) for r in bench.collect()}
    texts = {r.doc_id: fold(r.text) for r in docs.collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert whole and whole <= got
    for d, i in got - whole:  # anything else holds one passage within the budget
        assert any(least_edits(p, texts[d]) <= int(decontam.EDITS * len(p)) for _, p in passages_of([(i, items[i].decode())]))
    kept = decontam.drop_contaminated(docs.withColumn("item_id", docs["doc_id"]).withColumn("_folded", docs["lang"]), bench)
    assert {r.doc_id for r in kept.collect()} == texts.keys() - {d for d, _ in got}
    odd = spark.createDataFrame([(None, "the short item that is long enough to be found here", 1), (1, None, 2), (1, "", 3), (1, "the short item that is long enough to be found here", 1)],
                                "doc_id long, text string, item_id int")
    some = spark.createDataFrame([(1, "The SHORT item, that is long enough to be found here!"), (1, None), (None, "tiny"), (2, "")], "item_id long, text string")
    assert sorted((r.doc_id is None, r.item_id, r.edits) for r in decontam.find(odd, some).collect()) == [(False, 1, 0), (True, 1, 0)]
    assert decontam.find(odd.limit(0), some).count() == 0 and decontam.find(odd, some.limit(0)).count() == 0
    assert decontam.drop_contaminated(odd, some.limit(0)).count() == 4
