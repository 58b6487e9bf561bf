"""Simple-8b round trips; token files equal the tokenizers library's ids."""

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from candela.llm import simple8b, token_files


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_round_trip(values):
    assert simple8b.decode(simple8b.encode(np.array(values, np.uint64))).tolist() == values


def test_blocks_and_density():
    rng = np.random.default_rng(0)
    for top in (1, 2, 300, 50_000, 2**62):
        for n in (0, 1, 1023, 1024, 1025, 100_000):
            v = rng.integers(0, top, n, dtype=np.uint64) if top > 1 else np.zeros(n, np.uint64)
            data = simple8b.encode(v)
            assert (simple8b.decode(data) == v).all()
    assert len(simple8b.encode(np.zeros(102_400, np.uint64))) < 102_400 / 60 * 8 * 1.2


@pytest.mark.parametrize("ordinary", [False, True])
def test_files_equal_library(spark, ordinary):
    t = Tokenizer.from_file(token_files.default_tokenizer())
    if ordinary:
        t.encode_special_tokens = True
    texts = ["İ. İ", "The x. don't THE ÀÉ ΑΣ.", None, "", "a<|endoftext|>b &&&. 12.5 é.́", "<|endoftext|> <|STARTOFTEXT|>x<|startoftext|> é\u0301<|endoftext|>", "\x1c a\x1fb　c\x85", "word, " * 50_000, "x²! ≮ ≮", "İI", "Ⅷ."]
    rows = [(i // 2 if i < 4 else i, x, "clash", 7) for i, x in enumerate(texts)] + [(None, "null id", "", 0), (1, "tie", "", 0), (1, "tie", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file string, block int").repartition(3)
    out = token_files.read_token_files(spark, token_files.write_token_files(df, ordinary=ordinary), with_ids=True).collect()
    assert len(out) == len(rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in out)
    want = sorted((-1 if i is None else i, np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, x, *_ in rows)
    assert got == want
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert token_files.read_token_files(spark, token_files.write_token_files(df.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40), st.text(alphabet="aAzéÉßİıſΣσςﬁǅÅK  .,'1²́ẛ", max_size=30))
def test_any_text_equals_library(a, b):
    words, library = token_files.encoder(token_files.default_tokenizer()), Tokenizer.from_file(token_files.default_tokenizer())
    for text in (a, b, a + b, a + "<|endoftext|>" + b):
        assert np.frombuffer(words.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@lru_cache
def whole_library():
    return Tokenizer.from_file(token_files.default_tokenizer())


def library_ids(texts):
    library = whole_library()
    return [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_control_string_in_capitals_is_text():
    texts = ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "<|endoftext|> <|ENDOFTEXT|>", "<|ENDOFTEXT|>."]
    words = token_files.Words(token_files.default_tokenizer())
    assert [words.encode(t) for t in texts] == library_ids(texts)


def test_words_with_marks_and_capitals_go_to_the_model_at_once(monkeypatch):
    calls, alone = [], []
    letters, library = token_files.Words._letters, token_files.Words._library
    monkeypatch.setattr(token_files.Words, "_letters", lambda self, w: calls.append(list(w)) or letters(self, w))
    monkeypatch.setattr(token_files.Words, "_library", lambda self, s: alone.append(s) or library(self, s))
    words = token_files.Words(token_files.default_tokenizer())
    texts = ["Éclair, (ÉCLAIR) [éclair]*** Word$$$ \"word\"", None, "word. Éclair! over words' word"] * 500
    out = [bytes(x) for x in words.encoded(pa.array(texts))]
    assert out == library_ids(texts)
    assert [sorted(c) for c in calls] == [["over", "word", "words", "éclair"]]
    assert all(not any(map(str.isalpha, s)) for s in alone) and len(alone) <= 12  # each run of marks once


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBJé É×÷ßÿµªKİ̱̌̇.,'(\"-st\\]^ \n\x0b\x85\x1c\xa0я1²", max_size=25),
                          st.sampled_from(["<|endoftext|>", "<|STARTOFTEXT|>", "don't 'tis ('s '' (a) a's' l'É", "ΑΣ. ΑΣ ſ. Ж* Ⅷ. J̌ H̱."])), max_size=12), st.integers(0, 3))
def test_columns_equal_library(texts, skip):
    size, memo = token_files.SLICE, token_files.MEMO
    token_files.SLICE, token_files.MEMO = 30, 3  # many slices; the memo turns over
    try:
        words = token_files.encoder(token_files.default_tokenizer())
        for kind in (pa.string(), pa.large_string()):
            col = pa.array(texts, kind)[skip:]
            assert [bytes(x) for x in words.encoded(col)] == library_ids(texts[skip:])
    finally:
        token_files.SLICE, token_files.MEMO = size, memo
