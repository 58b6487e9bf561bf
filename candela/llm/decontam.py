"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Texts and benchmark items are normalised alike: lower case, each run of bytes other than
letters, digits and non-ASCII becomes one blank. An item is searched by its passages: at every word start ``WORDS``
words (of these at most ``LONGEST`` bytes, and at least ``MIN_BYTES``, by more words if need be); shorter items whole. So a verbatim
excerpt of ``WORDS`` words is found wherever it lies in the item. A passage of n bytes may
differ by ``k = floor(EDITS * n)`` edits.

* Filter: an occurrence with at most k edits shares n + 1 - q (k + 1) q-grams at least, on
  diagonals (text place less item place) at most k apart. With q = 8 this is 1 or more at every length from ``MIN_BYTES`` on.
  Shared q-grams of text and item are counted in overlapping bands of 2 (K + 1) diagonals, K being the item's largest k; in bands that
  reach its smallest bound the counts inside each passage are taken, and passages that reach their own bound are kept.
* Verification: the passage is aligned in the band, widened by k, free at both ends of the text, and
  the least number of edits decides.

The benchmark is a stated query set: it goes to the tasks in blocks, one pass over the documents per block. A block holds
``BLOCK_BYTES`` of item text on average; its index takes ``INDEX_PER_BYTE`` bytes per byte of text at most, as q-grams are indexed once per place, not
per passage.

Defined cases: null or empty texts match nothing; items that are null or normalise to fewer than
``MIN_BYTES`` bytes match nothing, as they are no passages; repeated items match under each of their ids; repeated rows and
null doc_ids are judged row by row; empty tables give no rows; very long texts are read whole; other
columns are ignored (``find``) or pass through (``drop_contaminated``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import mix, slices, table, text_bytes, unused

Q, WORDS, LONGEST, EDITS, MIN_BYTES = 8, 13, 128, 0.08, 24
BLOCK_BYTES, INDEX_PER_BYTE = 2 << 20, 64
_KEEP = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _KEEP[_a:_b] = np.arange(_a, _b)
_KEEP[65:91] = np.arange(97, 123)
_SLOTS = 22


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes without repeated, leading or trailing blanks, and the new offsets."""
    x = _KEEP[data]
    word = x != 32
    keep = word.copy()
    keep[1:] |= word[:-1]  # of a run of blanks the first one, after a word
    some = np.diff(off) > 0
    edge = off[:-1][some]
    keep[edge] &= word[edge]  # none at a text's start
    x, off = x[keep], np.concatenate([[0], np.cumsum(keep)])[off]
    last = off[1:][np.diff(off) > 0] - 1
    last = last[x[last] == 32]  # nor at its end
    return np.delete(x, last), off - np.searchsorted(last, off)


def _grams(x: np.ndarray) -> np.ndarray:
    """The Q = 8 bytes at each place as one number (the last Q - 1 places have none)."""
    n = len(x) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([x, np.zeros(16, np.uint8)])
    eight = np.empty(n + 8, np.uint64)
    for s in range(8):
        part = eight[s::8]
        part[:] = padded[s: s + 8 * len(part)].view("<u8") if s + 8 * len(part) <= len(padded) else np.concatenate(
            [padded[s:], np.zeros(8 * len(part), np.uint8)])[: 8 * len(part)].view("<u8")
    return eight[:n]


class Passages:
    """The items' texts, their passages, and an index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, texts, head, size, owner = [], [], [], [], []
        for i, text in items:
            x, _ = normalised(*text_bytes(pa.array([(text or "").lower()])))
            if len(x) < MIN_BYTES:
                continue
            start = np.flatnonzero(np.concatenate([[True], x[:-1] == 32]))
            end = np.append(start[1:] - 1, len(x))
            last = np.minimum(np.arange(len(start)) + WORDS - 1, len(start) - 1)
            # a passage of few bytes takes further words
            enough = np.maximum(last, np.searchsorted(end, start + MIN_BYTES))
            whole = (np.arange(len(start)) + WORDS <= len(start)) & (enough < len(start))
            whole[0] |= not whole.any()  # short items whole
            stop = np.minimum(end[np.minimum(enough, len(start) - 1)], start + LONGEST)
            head.append(start[whole])
            size.append((stop - start)[whole])
            owner.append(np.full(int(whole.sum()), len(self.item)))
            self.item.append(i)
            texts.append(x)
        cat = lambda parts, kind=np.int32: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.text, self.base = cat(texts, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.head, self.size, self.owner = cat(head), cat(size), cat(owner)
        self.edits = (EDITS * self.size).astype(np.int32)
        self.bound = self.size + 1 - Q * (self.edits + 1)
        n = len(self.item)
        self.first_passage = np.searchsorted(self.owner, np.arange(n + 1))
        self.step = np.ones(n, np.int64)
        np.maximum.at(self.step, self.owner, self.edits + 1)
        self.least = np.full(n, 1 << 30)
        np.minimum.at(self.least, self.owner, self.bound)
        grams = [_grams(t) for t in texts]
        code = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.of = np.repeat(np.arange(n, dtype=np.int32), [len(g) for g in grams])[order]
        self.place = cat([np.arange(len(g)) for g in grams])[order]
        self.codes, first = np.unique(code[order], return_index=True)
        self.first = np.append(first, len(code)).astype(np.int64)
        slots = np.zeros(1 << _SLOTS, bool)
        slots[(mix(self.codes) >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True
        self.slots = np.packbits(slots)

    def regions(self, x: np.ndarray, off: np.ndarray):
        """(text, passage, lowest diagonal step of the band), in order, where the lemma allows an occurrence."""
        none = (np.zeros(0, np.int64),) * 3
        code = _grams(x)
        slot = mix(code) >> np.uint64(64 - _SLOTS)
        at = np.flatnonzero((self.slots[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7))).astype(np.uint8)) & 1)
        if not len(at) or not len(self.codes):
            return none
        doc = np.searchsorted(off, at, "right") - 1
        spot = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
        ok = (self.codes[spot] == code[at]) & (at + Q <= off[doc + 1])
        at, doc, spot = at[ok], doc[ok], spot[ok]
        if not len(at):
            return none
        n = self.first[spot + 1] - self.first[spot]
        which = np.repeat(self.first[spot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, place, doc = self.of[which].astype(np.int64), self.place[which].astype(np.int64), np.repeat(doc, n)
        at = np.repeat(at, n)
        # a text that shares fewer q-grams with an item than its smallest bound holds none of its passages
        pair = doc * len(self.item) + item
        if pair.max() >= 1 << 25:
            pair = np.unique(pair, return_inverse=True)[1]
        some = np.flatnonzero(np.bincount(pair)[pair] >= self.least[item])
        if not len(some):
            return none
        at, doc, item, place = at[some], doc[some], item[some], place[some]
        # may be negative: the occurrence may begin before its text's first q-gram
        low = (at - place - off[doc]) // self.step[item]
        order = np.lexsort((place, low, item, doc))
        doc, item, low, place = doc[order], item[order], low[order], place[order]
        fresh = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (low[1:] != low[:-1])]))
        group = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(doc))))
        total = np.bincount(group)
        doc, item, low = doc[fresh], item[fresh], low[fresh]
        # band b holds the diagonals of steps b and b + 1; one that starts below the first filled step holds just that
        follows = np.zeros(len(doc), bool)
        follows[:-1] = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (low[1:] == low[:-1] + 1)
        both = total + np.where(follows, np.append(total[1:], 0), 0)
        band = np.flatnonzero(both >= self.least[item])
        # the passages of a band's item, and the shared q-grams inside each
        k = (self.first_passage[1:] - self.first_passage[:-1])[item[band]]
        passage = np.repeat(self.first_passage[item[band]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        band = np.repeat(band, k)
        wide = int(self.base[-1]) + 1
        key = group * wide + place
        a, b = self.head[passage], self.head[passage] + self.size[passage] - Q
        inside = np.zeros(len(passage), np.int64)
        for g, count in ((band, np.ones(len(band), bool)), (np.minimum(band + 1, len(doc) - 1), follows[band])):
            inside += np.where(count, np.searchsorted(key, g * wide + b, "right") - np.searchsorted(key, g * wide + a), 0)
        keep = inside >= self.bound[passage]
        return doc[band[keep]], passage[keep], low[band[keep]]

    def verify(self, x: np.ndarray, off: np.ndarray, doc: np.ndarray, passage: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Least edits of each region (more than the budget: no occurrence)."""
        if not len(doc):
            return np.zeros(0, np.int64)
        k, size = self.edits[passage].astype(np.int64), self.size[passage]
        step = self.step[self.owner[passage]]
        first = self.base[self.owner[passage]] + self.head[passage]
        start = off[doc] + low * step + self.head[passage] - k  # text place of the band's lowest diagonal for the passage's first byte
        width = 2 * int(step.max()) + 2 * int(k.max()) + 2
        # cell j of row i stands for text place start + i + j - 1 being the last one used
        cost = np.zeros((len(doc), width), np.int64)
        column = np.arange(width)
        for i in range(1, int(size.max()) + 1):
            at = start[:, None] + i - 1 + column
            inside = (at >= off[doc][:, None]) & (at < off[doc + 1][:, None])
            same = inside & (x[np.clip(at, 0, len(x) - 1)] == self.text[np.minimum(first + i - 1, len(self.text) - 1)][:, None])
            new = np.where(inside, cost + ~same, cost + 2)  # match or substitution
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # a passage byte left out
            new = np.minimum.accumulate(new - column, axis=1) + column  # a text byte left out
            cost = np.where((size < i)[:, None], cost, new)
        return cost.min(axis=1)

    def search(self, col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, passage, edits) of all verified occurrences in a text column, one per passage and band."""
        data, off = text_bytes(col)
        out = []
        for i, j in slices(off):
            x, o = normalised(data[off[i]: off[j]], off[i: j + 1] - off[i])
            if len(x) < Q:
                continue
            doc, seg, low = self.regions(x, o)
            for a in range(0, len(doc), 2048):
                d, s, b = doc[a: a + 2048], seg[a: a + 2048], low[a: a + 2048]
                edits = self.verify(x, o, d, s, b)
                ok = edits <= self.edits[s]
                out.append((d[ok] + i, s[ok], edits[ok]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _blocks(bench: DataFrame) -> list[list[tuple]]:
    """The items in blocks of bounded size."""
    items = bench.select("item_id", "text").filter("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // BLOCK_BYTES)
    return [[tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect()] for i in range(n)]


def find(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Rows ``doc_id, item_id, passages, edits``: items found, how many of their passages, and the least edits."""
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), bench.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, passages long, edits long"
    out = docs.sparkSession.createDataFrame([], schema)
    text = docs.select("doc_id", F.lower("text").alias("text"))
    for block in _blocks(bench):
        passages = Passages(block)

        def run(batches, passages=passages):
            for b in batches:
                row, seg, edits = passages.search(b.column(1))
                hits: dict = {}
                for r, s, e in zip(row.tolist(), seg.tolist(), edits.tolist()):
                    found = hits.setdefault((r, passages.item[passages.owner[s]]), {})
                    found[s] = min(e, found.get(s, e))
                if hits:
                    ids = b.column(0)
                    yield pa.RecordBatch.from_pylist([{"doc_id": ids[r].as_py(), "item_id": i, "passages": len(f), "edits": min(f.values())}
                                                      for (r, i), f in hits.items()], arrow)

        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(out.schema)
        out = out.union(text.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found; no shuffle."""
    for block in _blocks(bench):
        passages = Passages(block)

        def run(batches, passages=passages):
            for b in batches:
                row, _, _ = passages.search(b.column(b.num_columns - 1))
                clean = np.ones(b.num_rows, bool)
                clean[row] = False
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(clean)) for c in b.columns[:-1]], b.schema.names[:-1])

        docs = docs.withColumn(unused(docs, "_folded"), F.lower("text")).mapInArrow(run, docs.schema)
    return docs


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
