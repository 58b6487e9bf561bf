"""Substring dedup: windows of 13 words that start in a document with a smaller id go.

Super-k-mer partitioning. Each window has a minimiser, the least hash among its
word pairs. Consecutive windows of a document that share it travel as one packed
string (their words, as in the text) to the minimiser's bucket; equal windows have equal
minimisers, so they meet there. In a bucket all windows are sorted by a 128-bit
fingerprint of their words and then by doc_id, which tells each window whether a
smaller document has it. What the map task itself can tell is not sent: of equal
windows in one strip of ``STRIP`` bytes only the smallest document's first goes out, so a passage
with very many copies reaches its bucket once per strip. Strings for one bucket share a
zstd block. Removed windows come back as ranges (doc_id, first window, windows, a check sum), and
one join by doc_id removes the covered words.

Defined cases: null text counts as no words; documents of fewer than 13 words have no
window; rows with the same doc_id are judged as that id (copies within one id remove
nothing) and keep a row each; a null doc_id counts as smaller than all others; an empty table gives no
rows; a very long text is one map slice of its own; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import buckets_for, expanded, gram_hashes, slices, squeezed, table, text_bytes, word_hashes, words

WINDOW, PAIR = 13, 2
#: bytes of text whose windows a map task holds at once
STRIP = 8 << 20
NULL_ID = np.iinfo(np.int64).min
_TWO = 0xD6E8FEB86659FD93


def _windows(h: np.ndarray, off: np.ndarray, size: int) -> np.ndarray:
    """Which of the len(h) - size + 1 windows lie in one document."""
    k = len(h) - size + 1
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return doc[:k] == doc[size - 1:]


def _minimisers(h: np.ndarray, size: int) -> np.ndarray:
    """Least pair hash of each window: sliding minimum over size - PAIR + 1 places."""
    x, span, have = gram_hashes(h, PAIR), size - PAIR + 1, 1
    while have * 2 <= span:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (span - have)], x[span - have:]) if span > have else x


def _runs(keep: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of maximal runs of kept places; same[i]: i may follow i - 1."""
    begin = keep.copy()
    begin[1:] &= ~(keep[:-1] & same[1:])
    at = np.flatnonzero(begin)
    stop = keep.copy()
    stop[:-1] &= ~(keep[1:] & same[1:])
    return at, np.flatnonzero(stop) + 1 - at


def _gone(order: np.ndarray, fp1: np.ndarray, fp2: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which windows a smaller document has; ``order`` sorts by fingerprint, then document."""
    a, b = order[:-1], order[1:]
    fresh = np.concatenate([[True], (fp1[a] != fp1[b]) | (fp2[a] != fp2[b])])
    least = docs[order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]]
    gone = np.zeros(len(order), bool)
    gone[order] = docs[order] > least
    return gone


def _ranges(gone, joins, docs, at_word, fp) -> tuple[np.ndarray, ...]:
    """Runs of removed windows: document, first word, windows, sum of their fingerprints."""
    at, n = _runs(gone, joins)
    total = np.cumsum(fp)
    return docs[at], at_word[at], n, (total[at + n - 1] - total[at] + fp[at]).view(np.int64)


def _packed(ids: np.ndarray, col: pa.Array, size: int, buckets: int):
    """Blobs (bucket, blob) and the ranges removed already of one batch."""
    data, off = text_bytes(col)
    fp1, fp2, docs, rows, at_word, starts, ends, mins, joins = ([] for _ in range(9))
    for i, j in slices(off):
        part, o = data[off[i]: off[j]], off[i: j + 1] - off[i]
        s, e, wo = words(part, o)
        if len(s) < size:
            continue
        h = word_hashes(part, s, e)
        ok = np.flatnonzero(_windows(h, wo, size))
        if not len(ok):
            continue
        doc = np.searchsorted(wo, ok, "right") - 1
        fp1.append(gram_hashes(h, size)[ok])
        fp2.append(gram_hashes(h, size, _TWO)[ok])
        mins.append(_minimisers(h, size)[ok])
        docs.append(ids[i + doc])
        rows.append(i + doc)
        at_word.append(ok - wo[doc])
        starts.append(s[ok] + off[i])
        ends.append(e[ok + size - 1] + off[i])
        follows = np.ones(len(ok), bool)  # the window before it is its neighbour in the same row
        follows[0] = False
        follows[1:] = (np.diff(ok) == 1) & (np.diff(doc) == 0)
        joins.append(follows)
    if not fp1:
        return [], (np.zeros(0, np.int64),) * 4
    fp1, fp2, docs, rows, at_word, starts, ends, mins, joins = map(np.concatenate, (fp1, fp2, docs, rows, at_word, starts, ends, mins, joins))
    order = np.lexsort((rows, docs, fp2, fp1))
    gone = _gone(order, fp1, fp2, docs)
    a, b = order[:-1], order[1:]
    send = ~gone
    send[b[(fp1[a] == fp1[b]) & (fp2[a] == fp2[b]) & (rows[a] == rows[b])]] = False
    local = _ranges(gone, joins, docs, at_word, fp1)
    at, n = _runs(send, joins & np.concatenate([[True], mins[1:] == mins[:-1]]))
    bucket = (mins[at] >> np.uint64(11)) % np.uint64(buckets)
    out, press, view = [], zstandard.ZstdCompressor(level=3), memoryview(data)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for group in np.split(order, cut):
        i, k = at[group], n[group]
        text = b"\n".join([view[s:e] for s, e in zip(starts[i].tolist(), ends[i + k - 1].tolist())])
        head = np.array([len(i)]).tobytes() + b"".join(squeezed(x.astype(np.int64)) for x in (np.diff(docs[i], prepend=0), at_word[i], k))
        out.append((int(bucket[group[0]]), press.compress(head + text)))
    return out, local


def _judge(blobs: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """Ranges of windows that a smaller document has, within one bucket."""
    unpress = zstandard.ZstdDecompressor()
    fp1, fp2, docs, at_word, joins = ([] for _ in range(5))
    for blob in blobs:
        raw = unpress.decompress(blob)
        m = int(np.frombuffer(raw, np.int64, 1)[0])
        doc, first, n = (expanded(raw[8 + 8 * m * c: 8 + 8 * m * (c + 1)], np.int64) for c in range(3))
        doc = np.cumsum(doc)
        data = np.frombuffer(raw, np.uint8, offset=8 + 24 * m)
        s, e, _ = words(data, np.array([0, len(data)]))
        h = word_hashes(data, s, e)
        begin = np.concatenate([[0], np.cumsum(n + size - 1)[:-1]])
        to = np.cumsum(n)
        inner = np.arange(to[-1]) - np.repeat(to - n, n)
        place = np.repeat(begin, n) + inner
        fp1.append(gram_hashes(h, size)[place])
        fp2.append(gram_hashes(h, size, _TWO)[place])
        docs.append(np.repeat(doc, n))
        at_word.append(np.repeat(first, n) + inner)
        joins.append(inner > 0)
    fp1, fp2, docs, at_word, joins = map(np.concatenate, (fp1, fp2, docs, at_word, joins))
    gone = _gone(np.lexsort((docs, fp2, fp1)), fp1, fp2, docs)
    return _ranges(gone, joins, docs, at_word, fp1)


def removed_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows ``doc_id, first, n, mark``: ranges of removed windows by first word, with the sum of their
    fingerprints. Of equal windows in one row at least one is listed."""
    buckets = buckets_for(docs)

    def pack(batches):
        for b in (x.slice(i, j - i) for x in batches for i, j in slices(text_bytes(x.column(1))[1], STRIP)):
            ids = b.column(0).cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
            blobs, local = _packed(ids, b.column(1), size, buckets)
            for at in range(0, len(blobs), 256):
                part = blobs[at: at + 256]
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.binary()),
                                                  none, none, none, none], names)
            # what is known here passes through the buckets, dealt out evenly
            if len(local[0]):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(local[0])) % buckets), pa.nulls(len(local[0]), pa.binary()),
                                                  *map(pa.array, local)], names)

    def judge(t: pa.Table) -> pa.Table:
        known = t.filter(t.column("blob").is_null()).select(names[2:])
        blobs = [x.as_py() for x in t.column("blob") if x.is_valid]
        if not blobs:
            return known
        found = pa.table(dict(zip(names[2:], map(pa.array, _judge(blobs, size)))))
        return pa.concat_tables([known, found])

    names = ["bucket", "blob", "doc_id", "first", "n", "mark"]
    packed = docs.select("doc_id", "text").mapInArrow(pack, "bucket long, blob binary, doc_id long, first long, n long, mark long")
    return packed.groupBy("bucket").applyInArrow(judge, "doc_id long, first long, n long, mark long")


def _kept(text: str, ranges: list, size: int) -> tuple[int, int, str]:
    """Words, removed words and the kept words' text of one document."""
    data, off = text_bytes(pa.array([text or ""]))
    s, e, _ = words(data, off)
    if not ranges:
        cover = np.zeros(len(s), bool)
    else:
        h = word_hashes(data, s, e)
        fp = gram_hashes(h, size)
        total = np.concatenate([[np.uint64(0)], np.cumsum(fp)])
        gone = np.zeros(len(fp) + 1, np.int64)
        first, n, mark = (np.array(x, np.int64) for x in zip(*ranges))
        inside = first + n <= len(fp)  # else of another row with this id, as where the marks differ
        first, n, mark = first[inside], n[inside], mark[inside]
        own = (total[first + n] - total[first]).view(np.int64) == mark
        np.add.at(gone, first[own], 1)
        np.add.at(gone, first[own] + n[own], -1)
        listed = np.cumsum(gone)[:-1] > 0
        fp = fp ^ gram_hashes(h, size, _TWO)
        hit = np.isin(fp, fp[listed])  # a removed window may occur here more than once
        edge = np.zeros(len(s) + 1, np.int64)
        at = np.flatnonzero(hit)
        edge[at] += 1
        np.add.at(edge, at + size, -1)
        cover = np.cumsum(edge)[:-1] > 0
    raw = data.tobytes()
    keep = np.flatnonzero(~cover)
    kept = b" ".join([raw[x:y] for x, y in zip(s[keep].tolist(), e[keep].tolist())])
    return len(s), int(cover.sum()), kept.decode("utf-8")


def dedup_passages(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows ``doc_id, n_words, n_removed, kept``: each document's kept words, joined by a blank."""
    gone = removed_windows(docs, size)
    gone = gone.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("first", "n", "mark")).alias("ranges"))
    both = docs.select("doc_id", "text").join(gone, F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))) == F.col("id"), "left")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                x = b.slice(at, 256)
                rows = [_kept(t.as_py(), [tuple(r.values()) for r in g.as_py() or ()], size) for t, g in zip(x.column(1), x.column(2))]
                yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string())))],
                                                 ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.select("doc_id", "text", "ranges").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM k) WHERE first < doc_id),
r AS (SELECT doc_id, list(i) AS out FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(out), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN out IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(out, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""
