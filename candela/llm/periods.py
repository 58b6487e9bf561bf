"""Periodic run detection: maximal stretches of words that repeat with a small period, by recompression.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least ``max(LEAST, TIMES * q)``
words long, that no neighbouring word extends keeping period q.

* Candidates: a run of period q holds ``TIMES - 1`` consecutive multiples p of q at least whose words equal
  those at p + q. For each q the words at multiples of q are compared with their successors, n/q of them, so
  a harmonic sum of comparisons in all; streaks that are long enough are candidates.
* Extensions: of each streak a grid point p asks how far the text agrees with itself q words on, and back. The answer is exact,
  by longest-common-extension queries on a run-length grammar: levels that alternate block compression (a
  maximal block of one symbol becomes a symbol named by symbol and length) and pair compression (symbols are halved into left and
  right by a hash, each left-right pair becomes a symbol). Equal symbols derive equal words, and equal
  stretches are parsed alike but for their rims, so a query climbs from words to large symbols and down again, a few
  steps a level. All queries of a slice take each step together.
* After an answer the streak goes on behind the stretch found, so a streak asks once per stretch.
* Stretches found with several periods count with the smallest; the others are its multiples.

Spark: a narrow pass; slices of about ``common.SLICE_BYTES`` of text (a longer text is a slice of its own) share one grammar of those
documents that have candidates. Words get exact numbers from a dictionary per slice, no hashes decide.

Defined cases: null, empty or blank texts have no words and no runs; nulls in doc_id keep the row; repeated rows are judged
one by one; of runs with equal length the smallest start, then period is the longest; a very long text is handled whole, in
about n log n steps (some 200 bytes of arrays per word); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import mix, slices, table, text_bytes

LEAST, TIMES = 6, 4
#: symbols of the grammar's last level, about
FEW = 16


class Grammar:
    """The levels of a run-length grammar over ``words``: symbols and their starts (the text's length closes these)."""

    def __init__(self, words: np.ndarray):
        words, n = words.astype(np.int64), len(words)
        self.size = n
        at = np.arange(n + 1)
        self.symbols, self.starts = [words], [at]
        fresh, even = int(words.max(initial=0)) + 1, True
        while len(words) > FEW and len(self.symbols) < 200:
            if even:
                first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
                count = np.diff(first, append=len(words))
                many = np.flatnonzero(count > 1)
                _, inverse = np.unique(words[first[many]] * (n + 1) + count[many], return_inverse=True)
                new = words[first]
                new[many] = fresh + inverse
                keep, fresh = first, fresh + int(inverse.max(initial=-1)) + 1
            else:
                left = (mix(words.astype(np.uint64) + np.uint64(len(self.symbols) << 40)) & np.uint64(1)).astype(bool)
                joins = left[:-1] & ~left[1:]
                other = ~left[:-1] & left[1:]
                if other.sum() > joins.sum():  # the other orientation saves more
                    joins = other
                i = np.flatnonzero(joins)
                _, inverse = np.unique(words[i] * fresh + words[i + 1], return_inverse=True)
                new = words.copy()
                new[i] = fresh + inverse
                keep = np.ones(len(words), bool)
                keep[i + 1] = False
                keep = np.flatnonzero(keep)
                new, fresh = new[keep], fresh + int(inverse.max(initial=-1)) + 1
            at = np.append(at[keep], n)
            words, even = new, not even
            self.symbols.append(words)
            self.starts.append(at)

    def _walk(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """How far the words from i and from j on (back: those before them, backwards) are equal."""
        length, top = np.zeros(len(i), np.int64), len(self.symbols) - 1

        def places(q):
            return (i[q] - length[q], j[q] - length[q]) if back else (i[q] + length[q], j[q] + length[q])

        def is_bound(level, x):
            at = self.starts[level]
            return at[np.searchsorted(at, x)] == x

        def room(level, x):
            """Distance from x to the level's next bound (back: the one before)."""
            at = self.starts[level]
            return x - at[np.searchsorted(at, x) - 1] if back else at[np.searchsorted(at, x, "right")] - x

        def match(level, q):
            """Takes the level's next symbols where they are equal (of two blocks what they share); the queries that moved."""
            at, s = self.starts[level], self.symbols[level]
            x, y = places(q)
            inside = np.minimum(x, y) > 0 if back else np.maximum(x, y) < self.size
            q, x, y = q[inside], x[inside], y[inside]
            a, b = np.searchsorted(at, x) - back, np.searchsorted(at, y) - back
            same = s[a] == s[b]
            q, x, y, a = q[same], x[same], y[same], a[same]
            blocks = level % 2 == 0 and level < top  # the next level's symbols are blocks of this one's
            length[q] += np.minimum(room(level + 1, x), room(level + 1, y)) if blocks else at[a + 1] - at[a]
            return q

        # up: match until both places are bounds of the next level; a query that meets a difference stays behind
        going, height = np.arange(len(i)), np.zeros(len(i), np.int64)
        for level in range(top):
            height[going] = level
            up, q = [], going
            while len(q):
                x, y = places(q)
                ready = is_bound(level + 1, x) & is_bound(level + 1, y)
                up.append(q[ready])
                q = match(level, q[~ready])
            going = np.concatenate(up) if up else going[:0]
        height[going] = top
        # down: match what the level allows, then try its parts
        for level in range(top, -1, -1):
            q = np.flatnonzero(height >= level)
            while len(q):
                q = match(level, q)
        return length

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._walk(i, j, False)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._walk(i, j, True)


def grid_streaks(words: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Streaks ``q, first, last`` of multiples of q whose words equal those q further on, as long as any run has."""
    out = []
    for q in range(1, longest // times + 1):
        x = words[::q]
        same = x[1:] == x[:-1]
        need = max(times - 1, (least - q) // q)
        if need > 1 and not (same[1:] & same[:-1]).any():
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).view(np.int8)))
        a, b = edge[::2], edge[1::2]
        good = b - a >= need
        if good.any():
            out.append(np.stack([np.full(int(good.sum()), q), a[good] * q, (b[good] - 1) * q]))
    q, a, b = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return q, a, b


def runs(words: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows ``start, length, period`` of all runs, by start, then period. ``longest`` bounds their length."""
    q, at, last = grid_streaks(words, longest, least, times)
    if not len(q):
        return np.zeros((0, 3), np.int64)
    grammar, found = Grammar(words), []
    while len(q):
        end = at + q + grammar.forward(at, at + q)
        start = at - grammar.backward(at, at + q)
        good = end - start >= np.maximum(least, times * q)
        found.append(np.stack([start[good], end[good], q[good]]))
        # the next multiple whose word differs from the one q on is behind the stretch
        at = np.maximum(at + q, -(-(end - q + 1) // q) * q)
        more = at <= last
        q, at, last = q[more], at[more], last[more]
    start, end, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    least_q = np.ones(len(q), bool)  # of one stretch the smallest period
    least_q[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[least_q], end[least_q], q[least_q]
    order = np.lexsort((q, start))
    return np.stack([start, end - start, q], axis=1)[order]


def document_runs(data: np.ndarray, off: np.ndarray, least: int = LEAST, times: int = TIMES):
    """Per document of a slice its words (bytes) and its runs (rows ``start, length, period``)."""
    raw = data.tobytes()
    split = [raw[a:b].split() for a, b in zip(off.tolist(), off[1:].tolist())]
    number: dict = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)) for ws in split]
    n = np.array([len(x) for x in ids], np.int64)
    none = np.zeros((0, 3), np.int64)
    found = [none] * len(ids)
    # documents of like length together: the grid of a long one would go over all others too
    for group in np.split(by := np.argsort(n, kind="stable"), np.flatnonzero(np.diff(np.floor(np.log2(np.maximum(n[by], 1))))) + 1):
        longest = int(n[group[-1]]) if len(group) else 0
        if longest < least:
            continue
        # each document is followed by a word of its own
        flat = np.concatenate([np.append(ids[d], len(number) + d) for d in group.tolist()])
        base = np.cumsum(n[group] + 1) - n[group] - 1
        _, first, last = grid_streaks(flat, longest, least, times)
        # a streak may reach over several documents
        touched = np.zeros(len(group) + 1, np.int64)
        np.add.at(touched, np.searchsorted(base, first, "right") - 1, 1)
        np.add.at(touched, np.searchsorted(base, last, "right"), -1)
        hit = np.flatnonzero(np.cumsum(touched))
        if not len(hit):
            continue
        some = group[hit]
        flat = np.concatenate([np.append(ids[d], len(number) + d) for d in some.tolist()])
        base = np.cumsum(n[some] + 1) - n[some] - 1
        r = runs(flat, int(n[some].max()), least, times)
        cut = np.searchsorted(r[:, 0], np.append(base, len(flat)))
        for k, d in enumerate(some.tolist()):
            found[d] = r[cut[k]: cut[k + 1]] - np.array([base[k], 0, 0])
    return split, found


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Rows ``doc_id, n_words, runs (start, length, period), collapsed``, one per row of ``docs``: the
    runs by start, then period, and the words that are in no run behind its first period, joined by a space."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    record = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for b in batches:
            data, off = text_bytes(b.column(1))
            for i, j in slices(off):
                split, found = document_runs(data[off[i]: off[j]], off[i: j + 1] - off[i], least, times)
                texts = []
                for words, r in zip(split, found):
                    if len(r):
                        gone = np.zeros(len(words) + 1, np.int64)
                        np.add.at(gone, r[:, 0] + r[:, 2], 1)
                        np.add.at(gone, r[:, 0] + r[:, 1], -1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
                    texts.append(b" ".join(words).decode())
                all_ = np.concatenate(found)
                rows = pa.StructArray.from_arrays([pa.array(all_[:, k]) for k in range(3)], fields=list(record))
                cut = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(w) for w in split], pa.int64()), pa.ListArray.from_arrays(cut, rows),
                                                  pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth document by the CRC of its id repeats a stretch of its words to its end."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                h = 1 if doc is None else zlib.crc32(str(doc).encode())
                g, text = h // 10, text.as_py()
                words = (text or "").encode().split() if h % 10 == 0 else []
                if words:
                    n = len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    text = b" ".join(words[:a] + (words[a: a + p] * ((n - a) // p + 1))[: n - a]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string")


def digest(rows: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the longest run and hashes of runs and collapsed text, from ``periodic_runs``."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    x = rows.select("doc_id", "runs", "collapsed", best.alias("best"))
    return x.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(_planted(table(spark, sf_dir, "documents"))))
