"""BPE by backtracking equals the tiktoken library; decoding restores the bytes."""

import base64

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from candela.llm import bpe


@pytest.fixture(scope="module")
def pair():
    path = bpe.default_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bpe.codec(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(pair, text):
    got = pair[0].encode(text)
    assert np.frombuffer(got, "<u4").tolist() == pair[1].encode_ordinary(text), text
    assert pair[0].decode(got) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(pair, text):
    same(pair, text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abtheinrs 'SDM12.\n\té　\x1c\x85", max_size=80))
def test_dense_text(pair, text):
    same(pair, text)


def test_long_pieces(pair):
    rng = np.random.default_rng(3)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "the", "0123456789", "=-", "éàü"):
        same(pair, "".join(rng.choice(list(alphabet), 3000)))
    for text in ("a" * 5000, " " * 5000, "\n" * 300 + "x", "", " \n \n x  y   ", "tionstiontions" * 200):
        same(pair, text)


def test_query_edges(spark, pair):
    rows = [(1, "the x", 1), (1, "the x", 2), (None, None, 3), (3, "", 4), (4, "word " * 60_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.decode_documents(bpe.encode_documents(df)).collect()
    assert sorted(((r.doc_id or 0, bytes(r.decoded).decode()) for r in out)) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert bpe.encode_documents(df.limit(0)).count() == 0
