"""Packing: every token once, gapless sequences, few of them; the rule against a plain version."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from candela.llm import packing
from candela.llm.common import table
from candela.llm.token_files import default_tokenizer

from conftest import SF_ORACLE


def expected(docs, capacity=2048):
    tok = Tokenizer.from_file(default_tokenizer())
    out = []
    for d, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            cut = ids[k:k + capacity]
            out.append((d, k // capacity, k, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))))
    return out


def check(rows, docs, capacity=2048):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    want = expected(docs, capacity)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs), -(-sum(r[3] for r in want) // capacity)


def plain_rule(lengths, capacity):
    bins, out = [], []
    for s in lengths:
        best = None
        for b, used in enumerate(bins):
            if used + s <= capacity:
                after = Counter(capacity - (u + s if i == b else u) for i, u in enumerate(bins))
                cost = sum(n * n for g, n in after.items() if g)
                left = capacity - used - s
                if best is None or (cost, left) < best[:2]:
                    best = (cost, left, b)
        if best is None:
            bins.append(s)
        else:
            bins[best[2]] += s
        out.append(sorted(bins))
    return out[-1] if out else []


def test_rule():
    rng = random.Random(3)
    for _ in range(40):
        lengths = np.array(sorted((rng.randint(1, 29) for _ in range(rng.randint(0, 60))), reverse=True), np.int64)
        head, offset, fill = packing.sum_of_squares(lengths, 30)
        assert sorted(fill[fill >= 0].tolist()) == plain_rule(lengths.tolist(), 30)
        for h in set(head.tolist()):
            mine = np.flatnonzero(head == h)
            assert offset[mine].tolist() == np.concatenate([[0], np.cumsum(lengths[mine])[:-1]]).tolist() and fill[h] == lengths[mine].sum()


def test_hostile_rows_in_many_groups(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["alpha", "Beta", "é", "7", "<|endoftext|>", "x\x1cy"]) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    docs += [(None, None), (None, "a"), (3, ""), (5, "word " * 9000), (7, "same text")] + [(9, "same text")] * 200
    docs += [(11, "word " * 63), (12, "word " * 127)]  # exactly one and two pieces of 64
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, piece int, uid string").repartition(5)
    n, least = check(packing.pack(df, 64, group=60).collect(), docs, 64)
    assert n <= 1.03 * least + 1
    n, least = check(packing.pack(df).collect(), docs)
    assert n <= least + 1
    assert packing.pack(df.limit(0)).collect() == []


def test_marks_capitals_and_control_strings(spark):
    docs = [(i, t) for i, t in enumerate(["<|ENDOFTEXT|> a", "(Éclair) [ÉCLAIR]*** 'tis dogs' don't", None, "<|startoftext|>x", "a\u00a0!\x1cb"] * 40)]
    check(packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect(), docs)


def test_sequences_hold_the_ids(spark):
    df = table(spark, SF_ORACLE, "documents").limit(200)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    packed = packing.pack(df, with_ids=True)
    seqs = packing.sequences(packed).collect()
    want = Counter(e[4] for e in expected(docs))
    got = Counter()
    for r in seqs:
        at = 0
        for n in r.lengths:
            got[zlib.crc32(bytes(r.ids)[4 * at: 4 * (at + n)])] += 1
            at += n
        assert 4 * at == len(r.ids) <= 4 * 2048
    assert got == want


def test_whole_documents(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF_ORACLE, "documents").select("doc_id", "text").collect()]
    got = packing.op12_packing(spark, SF_ORACLE)
    assert got.dtypes == [("doc_id", "bigint"), ("piece", "int"), *[(c, "bigint") for c in ("start", "length", "ids_crc32", "sequence_id", "offset")]]
    n, least = check(got.collect(), docs)
    assert n <= least + 2
