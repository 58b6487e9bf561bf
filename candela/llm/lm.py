"""Language-model scoring: a word bigram model by deleted interpolation.

Tokens: words, A-Z lower-cased, then one end token per text; a text's first token has the
end token as its context. ``P(w | v) = l(b) c(v, w) / c(v) + (1 - l(b)) U(w)`` with
``U`` the unigram estimate with 0.1 added to each count, ``b`` the bucket of the
context's frequency (the bit length of ``c(v)``; 0 for unseen contexts, where l = 0). A bucket that no tuning row falls
into has the weight of the nearest learned bucket below (else above); without tuning documents all weights are 0.
The weights ``l`` come from expectation-maximisation on held-out counts: counts of one
tenth of the documents against estimates from the other training documents; then all training counts enter the model.

How it runs: documents are taken in chunks of consecutive rows. Each chunk sends its distinct
uni- and bigrams (64-bit hashes, sorted, by hash range) with counts to buckets, a
blob per chunk and bucket; a bucket adds them up and answers each blob with the
corpus counts in the same order. The answers are written to the shared folder. A
chunk meets its answers by one cogroup, and scores its texts. So a frequent
word or context is one key per chunk, however often it occurs, and what travels grows with the corpus.
For EM the ratio of both estimates is tallied per bucket in steps of
1/16 of a binary digit: a table bounded by the range of doubles goes to the driver.

``docs`` must yield the same rows in the same partitions at each read, as a file
scan or a written table does; an answer that doesn't fit its chunk raises.

Defined cases: null text counts as empty (one token, the end); a null doc_id counts as an
empty text in the split by crc32 (held out); repeated doc_ids keep a row each; ties of hashed keys are one key; a very long text
lies in one chunk with its neighbours and is counted whole; an
empty table gives no rows; without training documents all counts are 0; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import buckets_for, expanded, mix, slices, squeezed, table, text_bytes, word_hashes, words, written

CHUNK_DOCS = 2048
TEST, TUNE, FIT = 0, 1, 2
ADD = 0.1
STEP = 16
NEVER = -(1 << 20)
END = np.uint64(0x51A5EC0DE0FEED02)
_Q = np.uint64(0xA0761D6478BD642F)
ODD = np.uint64(1)


@dataclass
class Model:
    answers: DataFrame
    buckets: int
    tokens: int  # training tokens
    types: int  # distinct ones
    weights: list[float]  # by context bucket


def _split(docs: DataFrame) -> DataFrame:
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 10
    kind = F.when(part == 0, TEST).when(part == 1, TUNE).otherwise(FIT)
    return docs.select("doc_id", "text").select(
        "doc_id", "text", F.floor(F.monotonically_increasing_id() / CHUNK_DOCS).cast("long").alias("chunk"), kind.alias("kind"))


def _tokens(col) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, ends included, and each text's first place."""
    data, off = text_bytes(col)
    out, first, total = [], [], 0
    for i, j in slices(off):
        part, o = data[off[i]: off[j]], off[i: j + 1] - off[i]
        s, e, wo = words(part, o)
        tok = np.full(len(s) + j - i, END, np.uint64)
        doc = np.repeat(np.arange(j - i), np.diff(wo))
        tok[np.arange(len(s)) + doc] = word_hashes(part, s, e, lower=True) & ~ODD
        out.append(tok)
        first.append(total + wo[:-1] + np.arange(j - i))
        total += len(tok)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(first)


def _pairs(tok: np.ndarray) -> np.ndarray:
    """Bigram hashes (odd; words' are even): each token with the one before it."""
    return mix(np.roll(tok, 1) * _Q + tok) | ODD


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(squeezed(x))


def _expand(b: bytes, kind) -> np.ndarray:
    return expanded(zstandard.ZstdDecompressor().decompress(b), kind)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin among sorted keys: buckets are equal hash ranges."""
    width = np.uint64(-(-(1 << 64) // buckets))
    return np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) * width)


def _ask(docs: DataFrame, buckets: int) -> DataFrame:
    names = ["bucket", "chunk", "kind", "keys", "counts"]

    def blobs(t: pa.Table):
        for kind in (TEST, TUNE, FIT):
            part = t.filter(pa.array(t.column("kind").to_numpy() == kind))
            tok, _ = _tokens(part.column("text"))
            if not len(tok):
                continue
            keys, counts = np.unique(np.concatenate([tok, _pairs(tok)]), return_counts=True)
            cuts = _cuts(keys, buckets)
            rows = [(b, k, c) for b, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(counts.astype(np.uint32), cuts))) if len(k)]
            n = len(rows)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), pa.array([t.column("chunk")[0].as_py()] * n, pa.int64()), pa.array([kind] * n, pa.int32()),
                pa.array([_squeeze(np.diff(r[1], prepend=np.uint64(0))) for r in rows], pa.binary()),
                pa.array([_squeeze(r[2]) if kind != TEST else None for r in rows], pa.binary())], names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            chunk = b.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                part = b.slice(i, j - i)
                if held and part.num_rows and held[0].column(2)[0] != part.column(2)[0]:
                    yield from blobs(pa.Table.from_batches(held))
                    held = []
                if part.num_rows:
                    held.append(part)
        if held:
            yield from blobs(pa.Table.from_batches(held))

    return _split(docs).mapInArrow(run, "bucket int, chunk long, kind int, keys binary, counts binary")


def _answer(asked: DataFrame) -> DataFrame:
    """Per blob the counts in tuning and fitting documents, in its keys' order; per bucket a row of totals."""
    def run(t: pa.Table) -> pa.Table:
        blobs = [np.cumsum(_expand(k.as_py(), np.uint64)) for k in t.column("keys")]
        kinds = t.column("kind").to_numpy()
        keys, place = np.unique(np.concatenate(blobs), return_inverse=True)
        sums = {k: np.zeros(len(keys), np.int64) for k in (TUNE, FIT)}
        at = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
        for i, (kind, c) in enumerate(zip(kinds, t.column("counts"))):
            if kind != TEST:  # keys are distinct within a blob
                sums[kind][place[at[i]: at[i + 1]]] += _expand(c.as_py(), np.uint32)
        word = (keys & ODD) == 0
        total = [int(sums[FIT][word].sum()), int((sums[FIT][word] > 0).sum()), int(sums[TUNE][word].sum()),
                 int(((sums[FIT] + sums[TUNE])[word] > 0).sum())]
        n = t.num_rows
        back = [[_squeeze(sums[k][place[at[i]: at[i + 1]]].astype(np.uint32)) for i in range(n)] + [None] for k in (TUNE, FIT)]
        cols = [t.column("bucket").to_pylist() + [None], t.column("chunk").to_pylist() + [None], kinds.tolist() + [None], *back]
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
                        + [pa.array([None] * n + [x], pa.int64()) for x in total],
                        names=["bucket", "chunk", "kind", "tune", "fit", "n_fit", "v_fit", "n_tune", "v_all"])

    return asked.groupBy("bucket").applyInArrow(
        run, "bucket int, chunk long, kind int, tune binary, fit binary, n_fit long, v_fit long, n_tune long, v_all long")


def _counted(docs: pa.Table, answers: pa.Table, buckets: int):
    """Per token: its counts, its context's and the pair's, each (tune, fit); each text's first place."""
    tok, first = _tokens(docs.column("text"))
    keys, place = np.unique(np.concatenate([tok, _pairs(tok)]), return_inverse=True)
    sizes = np.diff(np.concatenate([[0], _cuts(keys, buckets), [len(keys)]]))
    order = np.argsort(answers.column("bucket").to_numpy())
    got = [np.concatenate([_expand(answers.column(k)[i].as_py(), np.uint32) for i in order]).astype(np.int64) for k in ("tune", "fit")]
    if len(got[0]) != len(keys) or (answers.column("bucket").to_numpy()[order] != np.flatnonzero(sizes)).any():
        raise ValueError("the documents differ between two reads: pass a file scan or a written table")
    n = len(tok)
    own = [g[place[:n]] for g in got]
    return own, [np.roll(x, 1) for x in own], [g[place[n:]] for g in got], first


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.frexp(c.astype(np.float64))[1]


def _tune(docs: DataFrame, answers: DataFrame, buckets: int, n: int, v: int) -> list[float]:
    """Weights per context bucket by EM on the tuning documents' counts."""
    def tally(d: pa.Table, a: pa.Table) -> pa.Table:
        own, ctx, pair, _ = _counted(d, a, buckets)
        unigram = (own[1] + ADD) / (n + ADD * (v + 1))
        seen = ctx[1] > 0
        with np.errstate(divide="ignore"):
            ratio = np.log2(pair[1][seen] / ctx[1][seen] / unigram[seen])
        cell = np.where(np.isfinite(ratio), np.round(np.where(np.isfinite(ratio), ratio, 0) * STEP), NEVER).astype(np.int64)
        code, count = np.unique(_bucket(ctx[1][seen]).astype(np.int64) * (1 << 32) + cell, return_counts=True)
        cell = (code + (1 << 31)) % (1 << 32) - (1 << 31)
        return pa.table({"b": (code - cell) >> 32, "cell": cell, "n": count.astype(np.int64)})

    rows = (_split(docs).filter(F.col("kind") == TUNE).groupBy("chunk").cogroup(answers.filter(F.col("kind") == TUNE).groupBy("chunk"))
            .applyInArrow(tally, "b long, cell long, n long").groupBy("b", "cell").agg(F.sum("n").alias("n")).collect())
    weights = [0.0] * 65
    for b in {r["b"] for r in rows}:
        ratio = np.array([0.0 if r["cell"] == NEVER else 2.0 ** (r["cell"] / STEP) for r in rows if r["b"] == b])
        count = np.array([r["n"] for r in rows if r["b"] == b], float)
        w = 0.5
        for _ in range(500):
            new = float((count * (w * ratio / (w * ratio + 1 - w))).sum() / count.sum())
            done, w = abs(new - w) < 1e-9, min(max(new, 1e-6), 1 - 1e-6)
            if done:
                break
        weights[b] = w
    # a bucket without tuning rows takes the weight of the nearest learned one below, or else above: the
    # scores' counts are larger than the fitting ones, so a context may lie above all learned buckets
    learned = [b for b in range(1, 65) if weights[b]]
    for b in range(1, 65):
        if learned and not weights[b]:
            weights[b] = weights[max([x for x in learned if x < b], default=learned[0])]
    return weights


def fit(docs: DataFrame) -> Model:
    buckets = buckets_for(docs)
    answers = written(_answer(_ask(docs, buckets)), "counts")
    s = answers.filter("chunk IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_fit", "v_fit", "n_tune", "v_all")]).first()
    answers = answers.filter("chunk IS NOT NULL").select("bucket", "chunk", "kind", "tune", "fit")
    weights = _tune(docs, answers, buckets, s["n_fit"], s["v_fit"])
    return Model(answers, buckets, s["n_fit"] + s["n_tune"], s["v_all"], weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for the documents
    that the model was fitted with."""
    n, v, buckets, weights = model.tokens, model.types, model.buckets, np.array(model.weights)

    def run(d: pa.Table, a: pa.Table) -> pa.Table:
        own, ctx, pair, first = _counted(d, a, buckets)
        own, ctx, pair = (x[0] + x[1] for x in (own, ctx, pair))
        unigram = (own + ADD) / (n + ADD * (v + 1))
        w = weights[_bucket(ctx)]
        mixed = w * (pair / np.maximum(ctx, 1)) + (1 - w) * unigram
        size = np.diff(np.concatenate([first, [len(own)]]))
        cols = [d.column("doc_id"), pa.array(d.column("kind").to_numpy() == TEST), pa.array(size), pa.array(np.add.reduceat((own > 0).astype(np.int64), first)),
                pa.array(np.full(len(size), n)), pa.array(np.add.reduceat(np.log10(unigram), first)), pa.array(np.add.reduceat(np.log10(mixed), first))]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _split(docs).groupBy("chunk", "kind").cogroup(model.answers.groupBy("chunk", "kind")).applyInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))
