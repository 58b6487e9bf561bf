"""Byte-level BPE encoding by backtracking, and decoding.

The rank file's tokens go into an Aho-Corasick automaton (bytes mapped to the
Latin-1 characters of the same numbers). A piece is encoded left to right with the
longest token at each place; two neighbours are kept only if BPE, merging their
bytes, would stop at exactly these two (memoised). Where no shorter token fits,
the place is marked dead and the last token is taken back, so each place dies
once and the time is linear in the piece. The result equals the merges' result.

Texts are cut into pieces by the tokenizer's pattern; whole blank-separated
stretches are memoised per worker (the memo is emptied when it holds
``MEMO`` entries, which changes no result).

Defined cases: null text counts as empty (no ids); an empty table gives no rows;
repeated or null doc_ids keep a row each; very long texts are encoded whole, match by match, in linear time; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import table

MEMO = 300_000
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_NO_WS = f"[^{_WS}]"
#: a stretch without white space, with the blank before it; then white space, its last
#: character apart where a stretch follows: the pattern cuts at these places in any case
STRETCH = f" ?{_NO_WS}+|[{_WS}]+(?!{_NO_WS})|[{_WS}]+"


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Bpe(dict):
    """A memo from piece (or stretch) to its ids as little-endian 32-bit words."""

    def __init__(self, ranks_path: str, pattern: str):
        super().__init__()
        with open(ranks_path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.ids = {base64.b64decode(a): int(b) for a, b in rows}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.pattern = regex.compile(pattern)
        self.stretch = re.compile(STRETCH)
        self.trie = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.trie.add_word(t.decode("latin-1"), (len(t), i))
        self.trie.make_automaton()
        self.shorter: dict[int, int | None] = {}
        for t, i in self.ids.items():
            self.shorter[i] = next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), None)
        # halves: the two tokens whose merge makes a token; merged: the other way round
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for i in sorted(self.bytes):
            t, left, found = self.bytes[i], self.shorter[i], None
            while left is not None and found is None:
                right = self.ids.get(t[len(self.bytes[left]):])
                if right is not None and left < i and right < i and self._stay(left, right):
                    found = (left, right)
                left = self.shorter[left]
            self.halves[i] = found
            if found:
                self.merged[found] = i

    def _stay(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between tokens a and b: walking down the merges
        on both sides of the border, latest first, no earlier merge may cross it."""
        before = 1 << 62
        while True:
            over = self.merged.get((a, b))
            if over is not None and over < before:
                return False
            ha, hb = self.halves[a], self.halves[b]
            # undo the later of the two merges that touch the border; equal ranks: the right
            # one, as BPE merges from the left
            if ha is not None and (hb is None or a > b):
                before, a = a, ha[1]
            elif hb is not None:
                before, b = b + 1, hb[0]
            else:
                return True

    def neighbours(self, a: int, b: int) -> bool:
        key = (a, b)
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > 4 * MEMO:
                self.fits.clear()
            ok = self.fits[key] = self._stay(a, b)
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest, reach = [0] * n, [0] * n
        for end, (size, i) in self.trie.iter(piece.decode("latin-1")):
            at = end + 1 - size
            if size > reach[at]:
                longest[at], reach[at] = i, size
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        size_of = self.bytes
        while at < n:
            while token is not None:
                end = at + len(size_of[token])
                if not dead[end] and (not out or self.neighbours(out[-1], token)):
                    break
                token = self.shorter[token]
            if token is None:
                dead[at] = 1
                token = out.pop()
                at -= len(size_of[token])
                token = self.shorter[token]
            else:
                out.append(token)
                at = end
                token = longest[at] if at < n else None
        return out

    def __missing__(self, s: str) -> bytes:
        pieces = self.pattern.findall(s)
        if len(pieces) > 1:
            out = b"".join([self[p] for p in pieces])
        else:
            ids = self.encode_piece(s.encode("utf-8")) if s else []
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(s) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[s] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit words."""
        return b"".join(map(self.__getitem__, self.stretch.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Bpe:
    return Bpe(ranks_path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Rows ``doc_id, ids`` (little-endian unsigned 32-bit ids), one per document; no shuffle."""
    import public_tokenizers
    path, pat = ranks_path or default_ranks(), pattern or public_tokenizers.PATTERN

    def run(batches):
        c = codec(path, pat)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                x = b.slice(at, 256)
                ids = [c.encode(t.as_py() or "") for t in x.column(1)]
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``, the bytes of the ids."""
    import public_tokenizers
    path, pat = ranks_path or default_ranks(), pattern or public_tokenizers.PATTERN

    def run(batches):
        c = codec(path, pat)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                x = b.slice(at, 256)
                out = [c.decode(i.as_py()) for i in x.column(1)]
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode_documents(encode_documents(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

