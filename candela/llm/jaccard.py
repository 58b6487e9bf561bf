"""N-gram Jaccard join: documents whose sets of word shingles are alike, and their groups.

Sets: distinct 4-word shingles of the lower-cased words (64-bit hashes), shorter texts whole.
Documents link when ``100 * intersection >= 85 * union``; no link is lost.

* Size bands: linked sets have sizes within a factor of 0.85, so a set enters the
  tile of its own band and that of the band below.
* In a tile at most K elements differ between linked sets (K follows from the band's
  largest size). Hash space is cut into K + 1 + c equal segments, and a segment's elements
  are hashed to one key; by the pigeonhole principle linked sets agree on c + 1
  segments at least. Sets with more than c empty segments send these too, the others none, so linked
  sets share a key of a tile. Keys travel to hash buckets in blobs, one per strip
  of ``STRIP`` bytes and bucket; equal sets of a strip send one.
* Sets that share a key are candidates. Bitmap signatures sort most out: a shingle flips one of a
  set's bits (a power of two, eight times K or more), so two sets differ in ``popcount(a XOR b)``
  elements or more, and ``|A| + |B|`` less that bounds twice the intersection from above.
* First only the pairs with a group's first member are looked at, and components are formed
  of those verified: a group of many near copies costs one pair per member.
* Then rounds: in each group that still spans several components, the members outside its largest component (probes) meet
  all members, in tiles of about ``TILE`` probes and ``TILE`` members. A probe gives the candidates of other
  components that its signature finds nearest, ``NEAREST[round]`` a tile at most; these are verified and components joined. Near
  copies that missed the first member so join each other in one or two rounds of few pairs. The last
  round gives all candidates that are left, so no link between components is lost.
* Verification intersects the sorted arrays exactly. They lie in a table bucketed by id, so
  that a join moves the pairs, not the arrays of all candidates.

Defined cases: a text that is null or has no word has the empty set and links with nothing; rows that
share a doc_id are one document, linked with what any of them is linked with (each row is returned);
a null doc_id keeps its row, unlinked; an empty table gives no rows; a very long text is one set; other
columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import components, expanded, gram_hashes, in_small_batches, mix, slices, squeezed, table, text_bytes, word_hashes, words, written
from candela.session import checkpoint_dir

SHINGLE, PERCENT, TILE = 4, 85, 1024
#: candidates of a probe in a tile, by round (None: all)
NEAREST = (1, None)
#: bytes of text per bucket of keys, and the most buckets
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 1 << 14
#: bytes of text whose sets a map task holds at once
STRIP = 4 << 20
#: bytes of text that are made sets at once, and elements that are made keys at once: arrays of many times their size are held meanwhile
PIECE, PIECE_ELEMENTS = 1 << 18, 1 << 16
_TWO = np.uint64(0x8BB84B93962EACC9)


def _spare(n: int, k: int) -> int:
    """How many empty segments to allow for sets of n elements of which k may differ: the fewest that
    all but about one set in a thousand stay within (their number is about Poisson)."""
    def tail(c: int) -> float:
        s = k + 1 + c
        mean = s * math.exp(n * math.log1p(-1 / s))
        term, total = math.exp(-mean), 0.0
        for i in range(c + 1):
            total += term
            term *= mean / (i + 1)
        return 1 - total

    if k <= 300:
        rest = [tail(c) for c in range(1, k + 3)]
        good = [c for c, t in enumerate(rest, 1) if t < 1e-3]
        return good[0] if good else 1 + int(np.argmin(rest))
    c = 0.0
    for _ in range(50):  # mean plus four deviations
        mean = (k + 1 + c) * math.exp(-n / (k + 1 + c))
        c = min(mean + 4 * math.sqrt(mean), float(k))
    return math.ceil(c)


class Bands:
    """Size bands and, per band, the segments of its tile and how many of them may be empty."""

    def __init__(self, percent: int):
        edges = [1]
        while edges[-1] < 1 << 31:
            edges.append(edges[-1] * 100 // percent + 1)
        self.edges = np.array(edges)
        top = self.edges[1:] - 1  # the band's largest size; its partner has 100 / percent times that at most
        differ = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
        self.spare = np.array([_spare(n, k) for n, k in zip(edges, differ.tolist())])
        self.segments = differ + 1 + self.spare
        self.width = 1 << np.maximum(8, np.ceil(np.log2(8 * differ + 1)).astype(int))

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1


def shingle_sets(col, size: int):
    """Per row the sorted distinct shingle hashes."""
    data, off = text_bytes(col)
    for i, j in slices(off, PIECE):
        part, o = data[off[i]: off[j]], off[i: j + 1] - off[i]
        s, e, wo = words(part, o)
        h = word_hashes(part, s, e, lower=True)
        g = gram_hashes(h, size)
        for a, b in zip(wo[:-1].tolist(), wo[1:].tolist()):
            if b - a >= size:
                yield np.unique(g[a: b - size + 1])
            elif b > a:
                yield mix(gram_hashes(h[a:b], b - a) + np.uint64(b - a))
            else:
                yield g[:0]


def _keys(flat: np.ndarray, n: np.ndarray, tile: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Segment keys of all sets (concatenated, sizes n) in the given tiles, and each key's set."""
    off = np.concatenate([[0], np.cumsum(n)])
    found = [(k, w + i) for i, j in slices(off, PIECE_ELEMENTS) for k, w in [_piece_keys(flat[off[i]: off[j]], n[i:j], tile[i:j], bands)]]
    return np.concatenate([k for k, _ in found]), np.concatenate([w for _, w in found])


def _piece_keys(flat: np.ndarray, n: np.ndarray, tile: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    parts, spare = bands.segments[tile], bands.spare[tile]
    base = np.cumsum(parts) - parts
    owner = np.repeat(np.arange(len(n)), n)
    segment = base[owner] + (((flat >> np.uint64(32)) * parts[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    total = np.zeros(int(parts.sum()), np.uint64)
    total[segment[at]] = np.add.reduceat(mix(flat + _TWO), at)
    filled = np.zeros(len(total), bool)
    filled[segment[at]] = True
    whose = np.repeat(np.arange(len(n)), parts)
    empty = parts - np.bincount(whose[filled], minlength=len(n))
    send = filled | (empty > spare)[whose]
    inner = np.arange(len(total)) - base[whose]
    keys = mix(total + mix((tile[whose].astype(np.uint64) << np.uint64(42)) + inner.astype(np.uint64)))
    return keys[send], whose[send]


def signature(s: np.ndarray, width: int) -> bytes:
    """Bits that the elements flip."""
    return np.packbits(np.bincount((mix(s + _TWO) % np.uint64(width)).astype(np.int64), minlength=width) & 1).tobytes()


def _folded(x: bytes, size: int) -> np.ndarray:
    """A signature of ``size`` bytes, as if made with that width: halves flip together."""
    a = np.frombuffer(x, np.uint64)
    while a.nbytes > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2:]
    return a


def _fits(na, nb, differ, percent: int):
    """Whether sets that differ in ``differ`` elements at least can reach the similarity."""
    return (na + nb - differ) * (100 + percent) >= 2 * percent * (na + nb)


def _groups(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Rows of three kinds: ``id, n, bits`` (a document; bits where its set is its strip's first of its kind),
    ``id, same`` (its set equals that of ``same``), ``gid, id, n, first, first_n`` (a member of a group of sets that share a key of a
    tile, and the group's first member). Groups of the same members have one gid."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, bands = min(max(32, math.ceil(total / BUCKET_BYTES)), MOST_BUCKETS), Bands(percent)
    names = ["bucket", "blob", "id", "n", "same", "bits"]

    def batch(ids: np.ndarray, col):
        sets = list(shingle_sets(col, size))
        n = np.array([len(x) for x in sets], np.int64)
        same = np.full(len(ids), -1)
        first: dict = {}
        for i in np.lexsort((ids, n)).tolist():
            if n[i]:
                k = (int(n[i]), int(sets[i].sum()), int(mix(sets[i]).sum()))
                same[i] = first.setdefault(k, i)
        again = np.flatnonzero((same >= 0) & (same != np.arange(len(ids))))
        own = np.flatnonzero(same == np.arange(len(ids)))
        bits: list = [None] * len(ids)
        for i, w in zip(own.tolist(), bands.width[bands.of(n[own])].tolist()):
            bits[i] = signature(sets[i], w)
        dealt = np.arange(len(ids)) % buckets  # these pass through the buckets
        yield pa.RecordBatch.from_arrays([pa.array(dealt), pa.nulls(len(ids), pa.binary()), pa.array(ids), pa.array(n), pa.nulls(len(ids), pa.int64()),
                                          pa.array(bits, pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.array(dealt[again]), pa.nulls(len(again), pa.binary()), pa.array(ids[again]), pa.nulls(len(again), pa.int64()),
                                          pa.array(ids[same[again]]), pa.nulls(len(again), pa.binary())], names)
        if not len(own):
            return
        flat, n, who = np.concatenate([sets[i] for i in own]), n[own], ids[own]
        band = bands.of(n)
        keys, whose = _keys(flat, n, band, bands)
        lower = np.flatnonzero(band > 0)
        k2, w2 = _keys(np.concatenate([sets[own[i]] for i in lower]), n[lower], band[lower] - 1, bands) if len(lower) else (keys[:0], whose[:0])
        code = np.concatenate([whose * 2 + 1, lower[w2] * 2]).astype(np.int64)  # odd: in the tile of its own band
        keys = np.concatenate([keys, k2])
        order = np.argsort(keys)
        keys, code = keys[order], code[order]
        width = np.uint64(-(-(1 << 64) // buckets))
        cuts = np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) * width)
        press = zstandard.ZstdCompressor(level=1)
        rows = []
        for b, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(code, cuts))):
            if len(k):
                there, at = np.unique(c >> 1, return_inverse=True)
                head = np.array([len(k), len(there)], np.int64)
                rows.append((b, press.compress(head.tobytes() + squeezed(np.diff(k, prepend=np.uint64(0))) + squeezed((at * 2 + (c & 1)).astype(np.uint32))
                                               + squeezed(who[there].astype(np.int64)) + squeezed(n[there].astype(np.int64)))))
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), none, none, none, pa.nulls(len(rows), pa.binary())], names)

    def run(batches):
        for b in batches:
            if b.column(0).null_count:  # else spare the copy
                b = b.filter(b.column(0).is_valid())
            for i, j in slices(text_bytes(b.column(1))[1], STRIP):
                part = b.slice(i, j - i)
                yield from batch(part.column(0).cast(pa.int64()).to_numpy(), part.column(1))

    def read(blob: bytes):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        m, d = raw[:16].view(np.int64).tolist()
        cut = np.cumsum([16, 8 * m, 4 * m, 8 * d, 8 * d])
        keys, code, ids, n = (expanded(raw[a:b], k) for a, b, k in zip(cut, cut[1:], (np.uint64, np.uint32, np.int64, np.int64)))
        at = code >> 1
        return np.cumsum(keys), ids[at], n[at], (code & 1).astype(bool)

    kinds = {"id": pa.int64(), "n": pa.int64(), "same": pa.int64(), "bits": pa.binary(), "gid": pa.int64(), "first": pa.int64(), "first_n": pa.int64()}

    def rows(**columns) -> pa.Table:
        size = len(next(iter(columns.values())))
        return pa.table({k: columns[k] if k in columns else pa.nulls(size, t) for k, t in kinds.items()})

    def meet(t: pa.Table) -> pa.Table:
        plain = t.filter(t.column("blob").is_null())
        out = [rows(**{c: plain.column(c) for c in names[2:]})]
        blobs = [read(x.as_py()) for x in t.column("blob") if x.is_valid]
        if blobs:
            keys, ids, n, own = (np.concatenate(x) for x in zip(*blobs))
            del blobs
            order = np.lexsort((n, ids, keys))
            keys, ids, n, own = keys[order], ids[order], n[order], own[order]
            fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]) | (n[1:] != n[:-1])])
            keys, ids, n, own = keys[fresh], ids[fresh], n[fresh], own[fresh]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            count = np.diff(np.concatenate([at, [len(keys)]]))
            good = (np.minimum.reduceat(ids, at) < np.maximum.reduceat(ids, at)) & np.logical_or.reduceat(own, at)
            lists = np.add.reduceat(mix(ids.astype(np.uint64)) * n.astype(np.uint64), at)
            _, once = np.unique(np.where(good, lists, np.uint64(0)), return_index=True)  # equal lists of this bucket count once
            keep = np.zeros(len(at), bool)
            keep[once] = True
            keep &= good
            inside, count = np.repeat(keep, count), count[keep]
            first = np.repeat(at[keep], count)
            out.append(rows(id=ids[inside], n=n[inside], gid=np.repeat(lists[keep], count).view(np.int64), first=ids[first], first_n=n[first]))
        return pa.concat_tables(out)

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "bucket long, blob binary, id long, n long, same long, bits binary")
    return packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(
        meet, "id long, n long, same long, bits binary, gid long, first long, first_n long")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> str:
    """Name of a table ``id, hashes`` (sorted shingles) of the documents in ``ids``, bucketed by id,
    in the shared folder."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                x = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array([s.tobytes() for s in shingle_sets(x.column(1), size)], pa.binary())], ["id", "hashes"])

    # the ids grow with the corpus, so they are joined by a shuffle at every size
    spark = docs.sparkSession
    name = f"sets_{uuid.uuid4().hex}"
    some = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi").mapInArrow(run, "id long, hashes binary")
    some.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").sortBy("id").option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return name


def _possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose signatures allow the similarity."""
    def run(batches):
        for t in batches:
            na, nb = t.column("na").to_numpy(), t.column("nb").to_numpy()
            x, y = t.column("ba").to_pylist(), t.column("bb").to_pylist()
            differ = np.array([int(np.bitwise_count(_folded(u, min(len(u), len(v))) ^ _folded(v, min(len(u), len(v)))).sum()) for u, v in zip(x, y)], np.int64)
            yield t.select(["a", "b"]).filter(pa.array(_fits(na, nb, differ, percent)))

    one, two = (bits.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"b{k}")) for k in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that link, by exact intersection."""
    def run(batches):
        for b in batches:
            keep = []
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                union = len(np.unique(np.concatenate([x, y])))
                if 100 * (len(x) + len(y) - union) >= percent * union:
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    one, two = (sets.select(F.col("id").alias(k), F.col("hashes").alias(f"h{k}")) for k in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _split(members: DataFrame, comp: DataFrame) -> DataFrame:
    """The members ``gid, id, n, comp, major, blocks, hands`` of groups that span several components: the largest one,
    the blocks that all members fill and those that the members outside it fill."""
    member = members.select("gid", "id", "n").join(comp.select(F.col("id"), F.col("component_id").alias("root")), "id", "left")
    member = member.select("gid", "id", "n", F.coalesce("root", "id").alias("comp"))
    per = member.groupBy("gid", "comp").agg(F.count("*").alias("k"))
    split = per.groupBy("gid").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"), F.sum("k").alias("all"), F.max("k").alias("most"), F.count("*").alias("comps"))
    split = split.filter("comps > 1").select("gid", "major", F.ceil(F.col("all") / TILE).alias("blocks"), F.ceil((F.col("all") - F.col("most")) / TILE).alias("hands"))
    return written(member.join(split, "gid"), "split-groups")


def _across(member: DataFrame, bits: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """Pairs of different components that share a key and whose signatures allow the similarity: per probe and
    tile the ``nearest`` ones, or all."""
    member = member.join(bits, ["id", "n"])
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n)
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keep = ["gid", "id", "n", "comp", "bits"]
    targets = member.select(*keep, deal("blocks", 0).alias("x"), up_to("hands").alias("y"), F.lit(False).alias("probe"))
    probes = member.filter("comp <> major").select(*keep, up_to("blocks").alias("x"), deal("hands", 1).alias("y"), F.lit(True).alias("probe"))

    def tile(t: pa.Table) -> pa.Table:
        ids, n, c = (t.column(k).to_numpy() for k in ("id", "n", "comp"))
        probe = t.column("probe").to_numpy(zero_copy_only=False)
        raw = t.column("bits").to_pylist()
        width = np.array([len(r) for r in raw])
        target = np.flatnonzero(~probe)
        folded: dict = {}

        def of(k: int) -> np.ndarray:
            if k not in folded:
                folded[k] = np.array([_folded(raw[i], k) if len(raw[i]) >= k else np.zeros(k // 8, np.uint64) for i in target.tolist()])
            return folded[k]

        a, b = [], []
        for i in np.flatnonzero(probe).tolist():
            to = np.flatnonzero((ids[target] != ids[i]) & (c[target] != c[i]) & (100 * np.minimum(n[target], n[i]) >= percent * np.maximum(n[target], n[i])))
            found, gaps = [], []
            for w in np.unique(width[target[to]]).tolist():  # of two widths the smaller one
                some = to[width[target[to]] == w]
                k = min(w, int(width[i]))
                differ = np.bitwise_count(of(k)[some] ^ _folded(raw[i], k)).sum(axis=1, dtype=np.int64)
                fits = _fits(n[i], n[target[some]], differ, percent)
                found.append(target[some[fits]])
                gaps.append(differ[fits])
            if found:
                some, gap = np.concatenate(found), np.concatenate(gaps)
                if nearest is not None:
                    some = some[np.lexsort((ids[some], gap))[:nearest]]
                a.append(np.minimum(ids[i], ids[some]))
                b.append(np.maximum(ids[i], ids[some]))
        return pa.table({"a": np.concatenate(a) if a else ids[:0], "b": np.concatenate(b) if b else ids[:0]})

    return targets.union(probes).groupBy("gid", "x", "y").applyInArrow(tile, "a long, b long").distinct()


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components after new links between them."""
    root = comp.select("id", "component_id")
    ends = links
    for k in "ab":
        ends = ends.join(root.select(F.col("id").alias(k), F.col("component_id").alias(f"c{k}")), k, "left")
    new = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    both = root.union(new.select("id", F.col("id").alias("component_id"))).distinct()
    to = new.select(F.col("id").alias("component_id"), F.col("component_id").alias("to"))
    return written(both.join(to, "component_id", "left").select("id", F.coalesce("to", "component_id").alias("component_id")).distinct(), "components")


def near_groups(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """``(id, n)`` per row with a doc_id, and ``(id, component_id)`` of all linked documents."""
    with in_small_batches(docs.sparkSession):  # all jobs with Python workers run in here
        found, comp = _linked(docs, percent, size)
    return found.filter("n IS NOT NULL AND gid IS NULL").select("id", "n"), comp


def _linked(docs: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``_groups``, written, and the components."""
    found = written(_groups(docs, percent, size), "shared-keys")
    members = written(found.filter("gid IS NOT NULL").select("gid", "id", "n", "first", "first_n").distinct(), "groups")
    bits = found.filter("bits IS NOT NULL").select("id", "n", "bits")
    name = _sets(docs, members.select("id").distinct(), size)
    try:
        sets = docs.sparkSession.table(name)
        near = F.least("n", "first_n") * 100 >= F.greatest("n", "first_n") * percent
        first = members.filter((F.col("id") != F.col("first")) & near).select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
        same = found.filter("same IS NOT NULL").select(F.col("id").alias("a"), F.col("same").alias("b"))
        comp = components(written(_verified(_possible(first, bits, percent), sets, percent).union(same), "links"))
        for nearest in NEAREST:
            members = _split(members, comp)  # components only grow, so groups that are whole stay so
            links = written(_verified(_across(members, bits, percent, nearest), sets, percent), "links")
            comp = _joined(comp, links)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    return found, comp


def ngram_join(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id``, one per input row."""
    rows, comp = near_groups(docs, percent, size)
    out = rows.join(comp, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    # rows without a doc_id take no part
    none = docs.filter("doc_id IS NULL").select("text")

    def count(batches):
        for b in batches:
            n = [len(s) for s in shingle_sets(b.column(0), size)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return out.unionByName(none.mapInArrow(count, "doc_id long, n_shingles long, component_id long"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root)::BIGINT AS component_id
FROM documents d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""
