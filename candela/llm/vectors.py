"""Embedding near-duplicates: rounds of sorted projection passes, then exact counts.

1. Each pass puts every unit vector into the nearest of up to ``CELLS`` cells, whose centres are
   means over one bounded sample of all rows (so dense regions get most cells; passes take other members of it), and
   orders all vectors by cell and by 64 sign bits of random projections of the difference to the
   centre: inside a dense source the signs still tell vectors apart. The order is dealt to
   tasks by key ranges of 16 windows at least; ties of a key are split by id. Each vector is compared, in double precision, with
   its ``window`` successors (or more), and pairs at the threshold or above are
   united. A task sends a spanning forest of its pairs only.
2. A round is ``passes`` passes, written. Rounds are repeated until one joins no two components
   (smallest reachable id) of the rounds before, so their number follows the row count and the density met in the data.
3. Links are then counted inside each component, exactly and without a window. With
   ``a(i)`` the angle to the component's mean direction and ``t`` the
   threshold's angle, every i, j with ``a(i) + a(j) <= t`` is linked (triangle
   inequality), so in a tight component nearly all counts follow from the angles
   alone, however large it is. Only members with ``a(i) + max a > t`` are compared,
   with those j that can fail, in tiles of ``TILE`` x ``TILE`` vectors.

So a group of any size costs the passes a bounded window per vector, and no pair list
is formed. The method stays a random one: if m pairs that a pass meets with probability q are
still missing, a round misses all of them, and ends the search, with probability (1 - q)^(m passes). Measured
recall is in the README.

Defined cases: vectors that are null, zero, or hold a null, NaN or infinite component
link with nothing (n_links 0, their own component); vectors of different
lengths are not compared; equal vectors link; of rows with the same vec_id the least vector (element by element) stands for the
id, and each row is returned; a null vec_id keeps its row, unlinked; an empty table gives
no rows; other columns (labels too) are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import components, table, written

THRESHOLD, PASSES, WINDOW, TILE = 0.95, 8, 256, 2048
CELLS, SAMPLE_ROWS, SAMPLE_VALUES = 256, 4096, 1 << 19
_MARGIN = 1e-7


def _usable(vec: DataFrame, column: str) -> DataFrame:
    """One row ``vec_id, v`` per id with a comparable vector."""
    x = F.col(column)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    ok = (F.size(x) > 0) & ~bad & F.exists(x, lambda e: e != 0)
    rows = vec.filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _unit(col: pa.Array) -> np.ndarray:
    """Unit rows of a list column whose lists have one length; scaled first, so no square overflows."""
    m = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _by_length(col: pa.Array):
    """Row numbers of each vector length."""
    size = np.diff(col.offsets.to_numpy())
    for n in np.unique(size):
        yield int(n), np.flatnonzero(size == n)


def _planes(dim: int, at: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([97, at, dim])).standard_normal((dim, 64))


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (in ids) of a spanning forest of the pairs a[i], b[i]."""
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = root(i), root(j)
        if x != y:
            up[y] = x
            out.append((ids[i], ids[j]))
    return out


def _met(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) with the components of ``hit``, whose columns begin with its rows; few however dense it is."""
    some = np.flatnonzero(hit.any(axis=0))
    first = np.arange(hit.shape[1])
    first[some] = np.minimum(hit[:, some].argmax(axis=0), some)  # each column to its first row
    root = first
    while (root[root] != root).any():
        root = root[root]
    a, b = np.nonzero(hit)
    a, b = np.unique(np.stack([root[a], root[b]])[:, root[a] != root[b]], axis=1)
    joined = np.flatnonzero(first != np.arange(len(first)))
    return np.concatenate([first[joined], a]), np.concatenate([joined, b])


def _centres(sample: pa.Array, rows: int, window: int, at: int) -> dict[int, np.ndarray]:
    """Cell centres of pass ``at`` for each vector length in the sample."""
    out = {}
    for dim, own in _by_length(sample):
        unit = _unit(sample.take(pa.array(own)))
        pivots = unit[np.random.Generator(np.random.PCG64([98, at, dim])).permutation(len(unit))[: max(1, min(CELLS, rows // window))]]
        cell = np.argmax(unit @ pivots.T, axis=1)
        total = np.zeros_like(pivots)
        np.add.at(total, cell, unit)
        out[dim] = total / np.maximum(np.bincount(cell, minlength=len(pivots)), 1)[:, None]
    return out


def _sample(vec: DataFrame) -> tuple[int, pa.Array]:
    """The number of rows, and about SAMPLE_ROWS vectors (fewer if long), dealt by a hash of the id."""
    s = vec.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dim")).first()
    step = max(1, s["n"] // max(64, min(SAMPLE_ROWS, SAMPLE_VALUES // s["dim"])))
    t = vec.filter(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(step)) == 0).select("vec_id", "v").toArrow().sort_by("vec_id")
    return s["n"], pa.concat_arrays(t.column("v").chunks) if t.num_rows else t.column("v").combine_chunks()


def near_pairs(vec: DataFrame, threshold: float, passes: range, window: int, rows: int, sample: pa.Array) -> DataFrame:
    """Rows ``a, b``: per task and pass a spanning forest of the verified pairs found."""
    centres = {p: _centres(sample, rows, window, p) for p in passes}

    def keyed(batches):
        for b in batches:
            for dim, own in _by_length(b.column(1)):
                part = b.take(pa.array(own))
                unit = _unit(part.column(1))
                for p in passes:
                    c = centres[p].get(dim, np.zeros((1, dim)))
                    cell = np.argmax(unit @ c.T - (c * c).sum(axis=1) / 2, axis=1)
                    bits = np.packbits((unit - c[cell]) @ _planes(dim, p) > 0, axis=1).view(">u8").ravel()
                    key = (bits ^ np.uint64(1 << 63)).astype(np.uint64).view(np.int64)  # signed in the same order
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), p, np.int32)), pa.array(np.full(len(own), dim, np.int32)), pa.array(cell.astype(np.int32)),
                                                      pa.array(key), part.column(0), part.column(1)], ["pass", "dim", "cell", "key", "vec_id", "v"])

    def compared(batches):
        tail = None  # the last rows seen, so that a batch's end meets the next one's start
        for b in batches:
            t = pa.Table.from_batches([b] if tail is None else [tail, b]).combine_chunks().to_batches()[0]
            cut = np.flatnonzero(np.diff(t.column(0).to_numpy().astype(np.int64) * (1 << 32) + t.column(1).to_numpy())) + 1
            left, right = [], []
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), t.num_rows]):
                unit = _unit(t.column(5).slice(i, j - i))
                for k in range(0, j - i, window):
                    hit = unit[k: k + window] @ unit[k: k + 2 * window].T >= threshold
                    np.fill_diagonal(hit, False)
                    if hit.any():
                        x, y = _met(hit)
                        left.append(x + i + k)
                        right.append(y + i + k)
            if left:
                edges = _forest(t.column(4).to_numpy(), np.concatenate(left), np.concatenate(right))
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])
            tail = t.slice(max(0, t.num_rows - window))

    n = max(int(vec.sparkSession.conf.get("spark.sql.shuffle.partitions")), vec.rdd.getNumPartitions())
    n = max(1, min(n, rows * len(passes) // (16 * window)))  # shorter ranges would cut the windows
    order = ["pass", "dim", "cell", "key", "vec_id"]
    kind = vec.schema["v"].dataType.simpleString()
    keys = vec.select("vec_id", "v").mapInArrow(keyed, f"pass int, dim int, cell int, key long, vec_id long, v {kind}")
    return keys.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(compared, "a long, b long")


def linked(vec: DataFrame, threshold: float, passes: int, window: int) -> DataFrame:
    """Rows ``id, component_id`` of all vectors with a link: rounds until one joins no two components."""
    rows, sample = _sample(vec)
    comp, at = None, 0
    while True:
        found = written(near_pairs(vec, threshold, range(at, at + passes), window, rows, sample), "pairs")
        at += passes
        if comp is not None:
            a, b = (comp.select(F.col("id").alias(x), F.col("component_id").alias(f"of_{x}")) for x in "ab")
            of_a, of_b = F.coalesce("of_a", "a"), F.coalesce("of_b", "b")
            found = written(found.join(a, "a", "left").join(b, "b", "left").filter(of_a != of_b).select(of_a.alias("a"), of_b.alias("b")).distinct(), "pairs")
            if found.isEmpty():
                return comp
            found = found.union(comp.select("id", "component_id"))
        comp = written(components(found), "components")


def link_counts(vec: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """Rows ``vec_id, component_id, n_links``: exact counts within components."""
    t = float(np.arccos(threshold)) - _MARGIN
    member = vec.join(comp, vec["vec_id"] == comp["id"]).select("component_id", "vec_id", "v")

    def summed(batches):
        # one row per component, length and batch: partial sums before the shuffle
        for b in batches:
            for _, rows in _by_length(b.column(2)):
                part = b.take(pa.array(rows))
                ids, at = np.unique(part.column(0).to_numpy(), return_inverse=True)
                total = np.zeros((len(ids), len(part.column(2)[0])))
                np.add.at(total, at, _unit(part.column(2)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(at)), pa.array(list(total))], ["component_id", "n", "s"])

    sums = member.mapInArrow(summed, "component_id long, n long, s array<double>")
    place = sums.select("component_id", "n", F.posexplode("s")).groupBy("component_id", "pos").agg(F.sum("col").alias("x"), F.sum("n").alias("n"))
    mean = place.groupBy("component_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"), F.max("n").alias("size"))

    def angled(batches):
        for b in batches:
            for dim, rows in _by_length(b.column(2)):
                part = b.take(pa.array(rows))
                unit, mean = _unit(part.column(2)), _unit(part.column(3))
                # half-angle form: accurate for small angles
                a = np.nan_to_num(2 * np.arcsin(np.clip(np.linalg.norm(unit - mean, axis=1) / 2, 0, 1)), nan=np.pi)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * dim, unit.ravel()),
                                                  part.column(4), pa.array(a)], ["component_id", "vec_id", "v", "size", "a"])

    member = written(member.join(mean, "component_id").select("component_id", "vec_id", "v", "mean", "size")
                     .mapInArrow(angled, "component_id long, vec_id long, v array<double>, size long, a double"), "members")
    member = member.join(member.groupBy("component_id").agg(F.max("a").alias("far")), "component_id")
    wide = F.col("a") + F.col("far") > t  # some pair of such a member may fail; of the others none does
    some = member.groupBy("component_id").agg(F.sum(wide.cast("long")).alias("met"))
    member = member.join(some, "component_id")
    # tiles: the wide members dealt to blocks by a hash of the id, as many as their number asks for
    blocks = F.ceil(F.col("met") / TILE)
    dealt = member.filter(wide).withColumn("own", F.pmod(F.xxhash64("vec_id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    both = (dealt.select("component_id", F.col("own").alias("x"), F.col("other").alias("y"), F.lit(True).alias("asks"), "vec_id", "v")
            .union(dealt.select("component_id", "other", "own", F.lit(False), "vec_id", "v")))

    def tile(tab: pa.Table) -> pa.Table:
        asks = tab.column("asks").to_numpy()
        unit = np.array(tab.column("v").to_pylist())  # a component holds vectors of one length
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        n = (unit[q] @ unit[m].T >= threshold).sum(axis=1)
        return pa.table({"vec_id": tab.column("vec_id").take(pa.array(q)), "n": n})

    # dealt anew: the joins above left all tiles of a component in one partition
    tiles = both.repartition("component_id", "x", "y").groupBy("component_id", "x", "y").applyInArrow(tile, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    # a tile's counts hold the vector itself
    links = F.when(wide, F.col("size") - F.col("met") + F.col("n")).otherwise(F.col("size")) - 1
    return member.drop("v").join(tiles, "vec_id", "left").select("vec_id", "component_id", links.alias("n_links"))


def near_duplicates(vec: DataFrame, column: str = "embedding", threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``."""
    usable = written(_usable(vec, column), "vectors")
    comp = linked(usable, threshold, passes, window)
    counts = link_counts(usable, comp, threshold)
    out = vec.select(F.col("vec_id").cast("long").alias("vec_id")).join(counts, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"),
                      F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id)
SELECT vec_id, (SELECT count(*) FROM l WHERE x = vec_id)::BIGINT AS n_links, min(root)::BIGINT AS component_id, min(root) = vec_id AS kept
FROM v JOIN r ON id = vec_id GROUP BY vec_id"""
