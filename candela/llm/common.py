"""Helpers shared by the operators: tables, word hashing in numpy, components."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.session import checkpoint_dir

U64 = np.uint64
#: bytes of text that the word helpers turn into arrays at once
SLICE_BYTES = 1 << 20
#: bytes of rows that go to a Python worker at once (Spark's own limits are 10,000 rows and 64 MB; sender and worker hold such a
#: batch several times over). Less than a strip of ``jaccard``, so that a batch is one strip
BATCH_BYTES = 3 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back.

    Cuts the lineage; the files survive the loss of executors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's rows go to Python workers ``BATCH_BYTES`` at a time, however long they are."""
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


@contextlib.contextmanager
def in_small_batches(spark: SparkSession):
    """``small_batches`` for the jobs that run inside; the session's setting is put back."""
    before = spark.conf.get(_BATCH_CONF, None)
    small_batches(spark)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_CONF)
        else:
            spark.conf.set(_BATCH_CONF, before)


def buckets_for(df: DataFrame, per_partition: int = 4) -> int:
    """Number of key buckets, in proportion to the input's partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(32, per_partition * max(n, df.rdd.getNumPartitions()))


# --- bytes, words and hashes -------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False) | U64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_MULT = U64(0x9E3779B97F4A7C15)
_MULT_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 2)
        for k, m in ((0, _MULT), (1, _MULT_INV)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the public splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and the n+1 offsets (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset: col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges (i, j) of documents with at most ``limit`` bytes together, one at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the n+1 offsets of
    each document's words. ``off`` are the document offsets into ``data``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word
    last[:-1] &= ~(last[1:]) | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words' bytes (``lower``: A-Z count as a-z)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inv = _powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, n: int, seed: int = 0x632BE59BD9B4E019) -> np.ndarray:
    """Hashes of each n consecutive word hashes (length len(h) - n + 1, 0 if fewer)."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(k, np.uint64)
    m = U64(seed)
    for i in range(n):
        out = out * m + h[i: i + k]
    return mix(out)


def squeezed(x: np.ndarray) -> bytes:
    """The bytes of numbers, those of equal rank together: high ones, mostly 0, then compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def expanded(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).ravel().view(kind)


# --- connected components ----------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """Rows ``(id, component_id)`` for every id in ``edges (a, b)``: the smallest id reachable.

    Alternating large-star and small-star steps; each step is one grouped minimum
    (partial aggregation, so hubs are combined before the shuffle) and one join
    that adaptive execution may split. The state is written to the shared folder
    after each round; only a count and a checksum reach the driver.
    """
    def mark(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    cur = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(cur)
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        cur = written(small, "edges")
        now = mark(cur)
        if now == seen:
            break
        seen = now
    return (cur.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
            .union(cur.select(F.col("b").alias("id"), F.col("b").alias("component_id"))).distinct())
