"""Importance resampling towards a target: documents drawn by how much more their n-grams occur in the target.

Features are all runs of 1 to ``orders`` consecutive words (lower-cased A-Z; words are ASCII letters, digits
and everything beyond ASCII), joined by one space, hashed by CRC-32 into ``buckets``. A bucket's gain is the
floored, thousandfold log ratio of its smoothed shares in target and corpus; a document's weight is the sum over its
features. Gumbel noise from a hash of the doc_id makes the draw of the highest scores a weighted draw without
replacement.

CRCs: a slice of documents is normalised (one space before each word) and scanned once; the running CRC
is kept at every byte. With ``P[i]`` the CRC of the first i bytes, the CRC of bytes s to e is
``P[e] XOR shift(P[s], e - s)``: the shift by zero bytes is linear over GF(2), so the prefix cancels. Its tables hold the
images of single register bytes, per length up to ``SHORT`` and per power of two beyond. No n-gram is formed as a string.

Spark: one narrow pass counts buckets per task (at most ``buckets`` rows a task leave it), a second one
sums gains; only the ``buckets`` sums reach the driver. Scores are range-sorted, numbered inside their
partition and offset by the partitions' counts, so no task sees all of them.

Defined cases: null and empty texts have no features (weight 0); a null doc_id has weight but no score and is neither
counted nor drawn; repeated rows count and are drawn one by one, ties by doc_id, then n_features; an
empty corpus gives no rows, an empty target gives gains from smoothing alone; a very long text is a slice of its own
(about 30 bytes of arrays per byte); other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candela.llm.common import slices, table, text_bytes, unused, written

BUCKETS, ORDERS, PERCENT, MIN_WORDS, SEED = 10_000, 3, 5, 20, 42
#: byte lengths whose shift has a table of its own
SHORT = 128
#: bytes of a row of the running scan
ROW = 512
U32 = np.uint32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

# the CRC's step for one byte, from its reflected polynomial
_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _STEP = np.where(_STEP & U32(1), (_STEP >> U32(1)) ^ U32(0xEDB88320), _STEP >> U32(1))


def _apply(images: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map with these images (4 x 256, per register byte) of each x."""
    return images[0][x & U32(255)] ^ images[1][(x >> U32(8)) & U32(255)] ^ images[2][(x >> U32(16)) & U32(255)] ^ images[3][x >> U32(24)]


_ONE = (np.arange(256, dtype=np.uint32)[None] << (U32(8) * np.arange(4, dtype=np.uint32)[:, None]))
_tables: list = []


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Shifts by 0 to SHORT - 1 zero bytes (one array), and by SHORT times 1, 2, 4, ... of them."""
    if not _tables:
        images = [_ONE]
        for _ in range(SHORT):
            x = images[-1]
            images.append(_STEP[x & U32(255)] ^ (x >> U32(8)))
        powers = [images.pop()]
        for _ in range(40):
            powers.append(_apply(powers[-1], powers[-1]))
        _tables.extend([np.stack(images).ravel(), powers])
    return _tables[0], _tables[1]


def shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRCs as they change the CRC of a text with so many bytes more."""
    short, powers = _shift_tables()
    at = (zeros & (SHORT - 1)) << 10
    out = short[at + (crc & U32(255))]
    out ^= short[at + 256 + ((crc >> U32(8)) & U32(255))]
    out ^= short[at + 512 + ((crc >> U32(16)) & U32(255))]
    out ^= short[at + 768 + (crc >> U32(24))]
    rest, k = zeros // SHORT, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _apply(powers[k], out[odd])
        rest, k = rest >> 1, k + 1
    return out


def running_crcs(data: np.ndarray) -> np.ndarray:
    """CRC-32 of each prefix of ``data`` (n + 1 numbers), in one scan of rows side by side."""
    n = len(data)
    rows = -(-n // ROW)
    start, crc, raw = np.zeros(rows, np.uint32), 0, data.tobytes()
    for r in range(rows):
        start[r] = crc
        crc = zlib.crc32(raw[r * ROW: (r + 1) * ROW], crc)
    columns = np.zeros((rows, ROW), np.uint8)
    columns.ravel()[:n] = data
    columns = np.ascontiguousarray(columns.T)
    out = np.empty((ROW, rows), np.uint32)
    reg = ~start
    for k in range(ROW):
        reg = _STEP[(reg ^ columns[k]) & U32(255)] ^ (reg >> U32(8))
        np.invert(reg, out=out[k])
    return np.concatenate([np.zeros(1, np.uint32), out.T.ravel()[:n]])


def features(data: np.ndarray, off: np.ndarray, orders: int = ORDERS) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The n+1 offsets of the documents' words and, per order, the n-grams' CRCs and the number of the n-gram's first word."""
    n = len(off) - 1
    # a blank before each document keeps its words apart from the one before
    place = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(off))
    raw = np.full(len(data) + n, 0x20, np.uint8)
    raw[place] = _LOWER[data]
    word = _WORD[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    owner = np.searchsorted(np.flatnonzero(first), off + np.arange(n + 1))
    keep = word.copy()
    keep[:-1] |= first[1:]
    text = np.where(word, raw, np.uint8(0x20))[keep]
    starts = np.flatnonzero(text == 0x20) + 1
    ends = np.append(starts[1:] - 1, len(text)) if len(starts) else starts
    p = running_crcs(text)
    head, tail = p[starts], p[ends]
    m = len(starts)
    last = np.repeat(owner[1:], np.diff(owner))  # the end of each word's document
    crcs, whose = [], []
    for k in range(orders):
        i = np.arange(m) if not k else np.flatnonzero(np.arange(m) + k < last)
        crcs.append(tail[i + k] ^ shift(head[i], ends[i + k] - starts[i]))
        whose.append(i)
    return owner, crcs, whose


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """Rows ``bucket, n`` over the ``text`` of all rows, for the buckets met."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            data, off = text_bytes(b.column(0))
            for i, j in slices(off):
                _, crcs, _ = features(data[off[i]: off[j]], off[i: j + 1] - off[i], orders)
                for c in crcs:
                    total += np.bincount(c % U32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS) -> np.ndarray:
    """Each bucket's gain; ``buckets`` rows at most of either side are collected."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for side, df in ((s, docs), (t, target)):
        for r in bucket_counts(df, buckets, orders).collect():
            side[r["bucket"]] = r["n"]
    up, down = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * up / ((a + 1) * down))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, orders: int = ORDERS) -> DataFrame:
    """Rows ``doc_id, n_words, n_features, weight``."""
    kind, size = docs.schema["doc_id"].dataType.simpleString(), U32(len(gain))

    def run(batches):
        for b in batches:
            data, off = text_bytes(b.column(1))
            for i, j in slices(off):
                owner, crcs, whose = features(data[off[i]: off[j]], off[i: j + 1] - off[i], orders)
                n, weight = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for c, w in zip(crcs, whose):
                    total = np.concatenate([[0], np.cumsum(gain[c % size])])
                    cut = np.searchsorted(w, owner)
                    n += np.diff(cut)
                    weight += total[cut[1:]] - total[cut[:-1]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(owner)), pa.array(n), pa.array(weight)],
                                                 ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """Rows ``doc_id, n_features, weight, score, rank``, one per row of ``docs``; ``rank`` (1, 2, ...) where drawn."""
    spark = docs.sparkSession
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = weights(docs, gains(docs, target, buckets, orders), orders).withColumn("score", F.col("weight") + noise)
    scored = scored.withColumn("free", (F.col("n_words") >= min_words) & F.col("score").isNotNull())
    # those that may be drawn come first, the highest score first; repeated rows are dealt apart by their place
    salt = F.when(F.col("free"), F.lit(0)).otherwise(F.xxhash64("doc_id", "weight") % 1024)
    order = [F.col("free").desc(), F.col("salt"), F.col("score").desc(), F.col("doc_id"), F.col("n_features")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def number(batches):
        seen, part = 0, TaskContext.get().partitionId()
        for b in batches:
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(k, part, np.int32)), pa.array(np.arange(seen, seen + k))], [*b.schema.names, "part", "place"])
            seen += k

    cols = ["doc_id", "n_features", "weight", "score", "free"]
    rows = written(scored.withColumn("salt", salt).repartitionByRange(n, *order, F.monotonically_increasing_id()).sortWithinPartitions(*order).select(*cols)
                   .mapInArrow(number, f"doc_id {kind}, n_features long, weight long, score long, free boolean, part int, place long"), "scores")
    # a row per partition
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if("free").alias("free_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.floor(F.sum("free_n").over(all_) * percent / 100).alias("drawn"))
    rank = F.col("base") + F.col("place") + 1
    return rows.join(F.broadcast(parts), "part").select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("free") & (rank <= F.col("drawn")), rank).cast("long").alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn, all columns, with the doc_id's best ``rank`` (under a free name)."""
    name = unused(docs, "rank")
    best = resample(docs, target, **settings).filter("rank IS NOT NULL").groupBy("doc_id").agg(F.min("rank").alias(name))
    return docs.join(best.hint("merge"), "doc_id").select(*docs.columns, name)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
