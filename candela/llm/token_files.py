"""Token-id files: documents encoded, written in doc_id order, and read back.

A file set is a Parquet table of blocks in the shared folder (written with Spark's
commit protocol, so a lost task leaves no half file). A row is one block: ``file``
(range partition, ascending in doc_id), ``block`` (place in the file), ``first``
(ids before it in the file), ``doc_ids`` and ``lengths`` of its documents, and
``payload``, their ids as Simple-8b words (``simple8b``). A block holds whole
documents and closes at ``BLOCK_IDS`` ids or more.

Encoding: the tokenizers library, on blank-separated stretches, which the
tokenizer's own rules treat apart. Texts are split some megabytes at a time (``SLICE``) as Arrow columns and each
distinct stretch of a slice is looked up once, by its letters and by the marks that end it, in a memo per worker (two
generations of ``MEMO`` entries). A text that holds the string of a special token goes to the library whole, which
makes it that token's id, as it does by default; with ``ordinary`` such strings are ordinary text.

Defined cases: null text counts as empty (the end id alone); repeated doc_ids keep a
row each, ordered by text; null doc_ids come first; an empty table gives no files'
rows; a very long text makes one large block; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
import struct
import unicodedata
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candela.llm import simple8b
from candela.llm.common import slices, table, text_bytes
from candela.session import checkpoint_dir

MEMO = 400_000
#: bytes of text whose distinct stretches are looked up at once
SLICE = 4 << 20
#: a run of them is one piece to the tokenizer, apart from letters; only an apostrophe may join letters that follow
MARKS = string.punctuation
_BEFORE = MARKS.replace("'", "")
#: letters that Arrow, Python and the tokenizer treat alike: normal forms, in lower case too; then a simple stretch
_LETTERS = "[a-zA-ZÀ-ÖØ-öø-ÿ]+"
_SIMPLE = f"^[{re.escape(_BEFORE)}]*{_LETTERS}[{re.escape(MARKS)}]*$"
BLOCK_IDS = 1 << 18
END_ID = 1
SCHEMA = "file int, block int, first bigint, doc_ids array<{0}>, lengths array<bigint>, payload binary"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """A memo from a blank-separated stretch to its ids as little-endian 32-bit words.

    Full, it becomes the old generation, from which used entries come back. Words that the
    tokenizer's rules leave as they are, letters alone, go straight to the library's BPE model.
    """

    def __init__(self, path: str, ordinary: bool = False):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # only ``_whole`` looks for special tokens
        self.special = [] if ordinary else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the library's BPE model alone, for words joined by one space
        self.joined = Tokenizer(self.tokenizer.model)
        self.joined.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.old: dict = {}

    @staticmethod
    def _lower(s: str) -> str | None:
        """``s``, letters alone, as the tokenizer's normaliser lower-cases it; None where that may differ from Python's way."""
        if s.isascii():
            return s.lower()
        if "Σ" in s or not unicodedata.is_normalized("NFC", s):  # a last sigma is nothing special to the tokenizer
            return None
        low = s.lower()
        return low if low == s or low.isalpha() and unicodedata.is_normalized("NFC", low) else None

    def _letters(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters alone, as the normaliser leaves them."""
        ids = np.array(self.joined.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        to = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(to) != len(words):  # a tokenizer of another kind
            return list(map(self._library, words))
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *to], to)]

    def _ids(self, s: str) -> bytes:
        body = s.rstrip(MARKS)
        if body.isalpha():
            low = self._lower(body)
            if low is not None:
                if len(body) < len(s):  # letters and marks are never one piece
                    return self[low] + self[s[len(body):]]
                return self._letters([s])[0] if low == s else self[low]
        elif s.isascii() and s.lower() != s:
            return self[s.lower()]
        return self._library(s)

    def _library(self, s: str) -> bytes:
        ids = self.tokenizer.encode(s, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        """The ids of a text in which special tokens count."""
        self.tokenizer.encode_special_tokens = False
        try:
            return self._library(text)
        finally:
            self.tokenizer.encode_special_tokens = True

    def __missing__(self, s: str) -> bytes:
        out = self.old.get(s)
        if out is None:
            out = self._ids(s)
        self._keep(s, out)
        return out

    def _keep(self, s: str, ids: bytes) -> None:
        if len(s) <= 64:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[s] = ids

    def _known_letters(self, words: list[str]) -> list[bytes]:
        """``_letters`` of distinct words through the memo."""
        out = list(map(self.get, words))
        new = [k for k, ids in enumerate(out) if ids is None]
        never = []
        for k in new:
            out[k] = self.old.get(words[k])
            if out[k] is None:
                never.append(k)
        for k, ids in zip(never, self._letters([words[k] for k in never])):
            out[k] = ids
        for k in new:
            self._keep(words[k], out[k])
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        return list(map(self.__getitem__, words))

    @staticmethod
    def _looked_up(words: pa.Array, known) -> pa.Array:
        """The ids of each string, the same string looked up once."""
        keys = words.dictionary_encode()
        return pa.array(known(keys.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(keys.indices)

    def _distinct(self, words: pa.Array) -> pa.Array:
        """The ids of stretches; simple ones are looked up as lower-case letters and the marks around them."""
        simple = pc.match_substring_regex(words, _SIMPLE)
        low = pc.utf8_lower(words.filter(simple))
        letters = pc.ascii_ltrim(pc.ascii_rtrim(low, MARKS), _BEFORE)
        ids = self._looked_up(letters, self._known_letters)
        marked = pc.not_equal(low, letters)
        low, bare = low.filter(marked), pc.invert(marked)
        before = pc.replace_substring_regex(low, f"{_LETTERS}.*", "")
        after = pc.replace_substring_regex(low, f"^[^a-zà-öø-ÿß]*{_LETTERS}", "")
        around = pc.binary_join_element_wise(self._looked_up(before, self._known), ids.filter(marked),
                                             self._looked_up(after, self._known), pa.scalar(b"", pa.large_binary()))
        other = self._looked_up(words.filter(pc.invert(simple)), self._known)
        # back in the order of the words
        place = np.arange(len(words))
        simple, bare = (np.asarray(x.to_numpy(zero_copy_only=False), bool) for x in (simple, bare))
        order = np.concatenate([place[simple][bare], place[simple][~bare], place[~simple]])
        place[order] = np.arange(len(words))
        return pa.concat_arrays([ids.filter(pa.array(bare)), around, other]).take(pa.array(place))

    def encoded(self, texts: pa.Array):
        """The ids of each text of a string column in turn (null: empty), as bytes or views of a slice's bytes."""
        for i, j in slices(text_bytes(texts)[1], SLICE):
            part = texts.slice(i, j - i).fill_null("")
            # these blanks are blanks to the tokenizer; others stay inside a stretch
            words = pc.ascii_split_whitespace(part)
            coded = words.flatten().dictionary_encode()
            ids = self._distinct(coded.dictionary).take(coded.indices)
            _, to, data = ids.buffers()
            to = np.frombuffer(to, np.int64)[words.offsets.to_numpy()].tolist()
            whole = self._special(part)
            data = memoryview(data or b"")
            for k, (a, b) in enumerate(zip(to, to[1:])):
                yield self._whole(part[k].as_py()) if k in whole else data[a:b]

    def _special(self, texts: pa.Array) -> set[int]:
        """The places of texts that hold the string of a special token."""
        return {k for t in self.special for k in np.flatnonzero(pc.match_substring(texts, t).to_numpy(zero_copy_only=False)).tolist()}

    def encode(self, text: str) -> bytes:
        return bytes(next(self.encoded(pa.array([text]))))


@lru_cache(maxsize=2)
def encoder(path: str, ordinary: bool = False) -> Words:
    return Words(path, ordinary)


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, path: str | None = None, ordinary: bool = False) -> str:
    """Write the file set and return its path (a fresh one in the shared folder if not given)."""
    spark, tok = docs.sparkSession, tokenizer or default_tokenizer()
    path = path or f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.format(kind)
    end = struct.pack("<I", end_id)

    def run(batches):
        words, no = encoder(tok, ordinary), TaskContext.get().partitionId()
        ids, parts, block, first = [], [], 0, 0

        def close():
            values = np.frombuffer(end.join(parts) + end, "<u4").astype(np.uint64)
            return pa.RecordBatch.from_pylist([{
                "file": no, "block": block, "first": first, "doc_ids": ids, "lengths": [len(p) // 4 + 1 for p in parts],
                "payload": simple8b.encode(values)}], arrow)

        size = 0
        for b in batches:
            for doc, part in zip(b.column(0).to_pylist(), words.encoded(b.column(1))):
                ids.append(doc)
                parts.append(part)
                size += len(part) // 4 + 1
                if size >= BLOCK_IDS:
                    yield close()
                    ids, parts, block, first, size = [], [], block + 1, first + size, 0
        if ids:
            yield close()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    n = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the text's hash lets a doc_id with very many rows span several files
    df = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(n, "doc_id", "h")
    df.sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text").mapInArrow(run, schema) \
        .write.option("compression", "zstd").parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``), decoded from the files."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    # one row per file: the running sum over files fits one task, the join side is that small
    sums = blocks.groupBy("file").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    base = sums.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    blocks = blocks.join(F.broadcast(base), "file").select((F.col("base") + F.col("first")).alias("start"), "doc_ids", "lengths", "payload")

    def run(batches):
        for b in batches:
            for start, docs, lengths, payload in zip(*(c for c in b.columns)):
                ids = simple8b.decode(payload.as_py()).astype("<u4")
                n = np.asarray(lengths.values, np.int64)
                to = np.cumsum(n)
                view = memoryview(ids.tobytes())
                cut = [view[4 * (e - k): 4 * e] for k, e in zip(n.tolist(), to.tolist())]
                cols = [docs.values, pa.array(to - n + start.as_py()), pa.array(n), pa.array([zlib.crc32(c) for c in cut], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([bytes(c) for c in cut], pa.binary())] * with_ids, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return blocks.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents")))
