"""Language identification: a byte convolutional network, trained in numpy.

Model: bytes (A-Z as a-z) -> 8-dimensional embedding -> filters of widths 2, 3 and 4 ->
maximum over a window -> softmax over the languages. Texts are cut into windows of
``WINDOW`` bytes, whole, the last one padded; a text's distribution is the mean of its windows',
weighted by their letters. For prediction the embedding is multiplied into the filters, so
that a convolution is a sum of table rows by byte.

Training: Adam on cross-entropy, on the driver, over a bounded sample of labelled rows with ``SAMPLE_WINDOWS`` windows each: of
every language the same share of ``SAMPLE_DOCS``, ``LEAST_DOCS`` at least (those least by a hash of id and text), so a
rare language is learned however large the others are. The windows of languages with fewer
are repeated up to a quarter of the most frequent one's. Inputs are bytes of the text alone.

``train(..., foreign=True)`` learns one class more, from windows of the sample whose letters are shuffled or
exchanged for each other: text in none of the languages. ``known`` keeps the rows that are not foreign: a text goes
when the probability of that class exceeds a half, and also that of all but a share of ``LOST`` of all labelled rows.

Defined cases: text that is null or has no letter: ``und`` with score 0; no labelled rows: ``und`` for
all; null lang: not learned from; repeated rows are predicted alike; an empty table gives no rows;
very long texts are read whole, slice by slice; other columns pass through (those with the result's names are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candela.llm.common import SLICE_BYTES, table, text_bytes, unused
from candela.operators.quantiles import exact_quantiles

WINDOW, WIDTHS, FILTERS, DIM = 128, (2, 3, 4), 24, 8
SAMPLE_DOCS, LEAST_DOCS, SAMPLE_WINDOWS, EPOCHS, BATCH = 3000, 64, 4, 6, 128
#: the share of the labelled rows that ``known`` may lose
LOST = 0.001
#: the class of text in none of the languages learned
FOREIGN = "zxx"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, np.float32)
_LETTER[97:123] = _LETTER[0x80:] = 1


def held_out() -> Column:
    """Rows never learned from: crc32 of the id's text has remainder 2 by 4 (a null id: as an empty text)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 4 == 2


def _grid(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (rows of folded bytes, 0 beyond the text) of all texts, and each one's text."""
    size = np.diff(off)
    n = np.maximum(1, -(-size // WINDOW))
    owner = np.repeat(np.arange(len(size)), n)
    start = off[:-1][owner] + (np.arange(len(owner)) - (np.cumsum(n) - n)[owner]) * WINDOW
    at = start[:, None] + np.arange(WINDOW)
    x = _FOLD[data[np.minimum(at, len(data) - 1)]] if len(data) else np.zeros(at.shape, np.uint8)
    x[at >= off[1:][owner][:, None]] = 0
    return x, owner


class Cnn:
    def __init__(self, langs: list[str], seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.langs = langs
        self.p = {"e": rng.standard_normal((256, DIM)) * 0.5, "o": np.zeros((FILTERS * len(WIDTHS), len(langs))), "c": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.standard_normal((w * DIM, FILTERS)) / np.sqrt(w * DIM)
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> "Cnn":
        rng = np.random.Generator(np.random.PCG64(5))
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                step += 1
                rate = 0.01 * (1 - epoch / epochs)
                for k, g in self._gradients(x[order[at: at + BATCH]], y[order[at: at + BATCH]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        emb = p["e"][x]
        feats, best = [], []
        for w in WIDTHS:
            k = WINDOW - w + 1
            cols = np.concatenate([emb[:, j: j + k] for j in range(w)], axis=2)
            z = cols.reshape(n * k, -1) @ p[f"w{w}"] + p[f"b{w}"]
            at = z.reshape(n, k, -1).argmax(axis=1)
            best.append(at)
            feats.append(np.take_along_axis(z.reshape(n, k, -1), at[:, None], 1)[:, 0])
        h = np.maximum(np.concatenate(feats, axis=1), 0)
        d = self._softmax(h @ p["o"] + p["c"])
        d[np.arange(n), y] -= 1
        d /= n
        g = {"o": h.T @ d, "c": d.sum(axis=0), "e": np.zeros_like(p["e"])}
        dh = (d @ p["o"].T) * (h > 0)
        for i, w in enumerate(WIDTHS):
            part = dh[:, i * FILTERS: (i + 1) * FILTERS]
            # only the window's best place of each filter has a gradient
            bytes_at = x[np.arange(n)[:, None, None], best[i][:, :, None] + np.arange(w)]
            patch = p["e"][bytes_at].reshape(n, FILTERS, w * DIM)
            g[f"w{w}"] = np.einsum("nfk,nf->kf", patch, part)
            g[f"b{w}"] = part.sum(axis=0)
            back = part[:, :, None] * p[f"w{w}"].T[None]
            np.add.at(g["e"], bytes_at.ravel(), back.reshape(-1, DIM))
        return g

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def tables(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Per offset the byte's contribution to the filters that reach so far, widest first; the biases."""
        wide = WIDTHS[::-1]
        out = [np.concatenate([self.p["e"] @ self.p[f"w{w}"][j * DIM: (j + 1) * DIM] for w in wide if w > j], axis=1) for j in range(wide[0])]
        return [np.ascontiguousarray(t, np.float32) for t in out], np.concatenate([self.p[f"b{w}"] for w in wide])

    def windows(self, x: np.ndarray, tabs) -> np.ndarray:
        """Distributions of a grid of windows."""
        tables, bias = tabs
        wide = WIDTHS[::-1]
        order = np.concatenate([np.arange(FILTERS) + FILTERS * WIDTHS.index(w) for w in wide])
        out = np.empty((len(x), len(bias)), np.float32)
        for a in range(0, len(x), 64):
            part = x[a: a + 64]
            k = WINDOW - WIDTHS[0] + 1
            z = tables[0][part[:, :k]]
            for j in range(1, wide[0]):
                t = tables[j]
                z[:, : WINDOW - j, : t.shape[1]] += t[part[:, j: j + min(k, WINDOW - j)]]
            for i, w in enumerate(wide):  # places where the filter would leave the window don't count
                out[a: a + 64, i * FILTERS: (i + 1) * FILTERS] = z[:, : WINDOW - w + 1, i * FILTERS: (i + 1) * FILTERS].max(axis=1)
        h = np.empty_like(out)
        h[:, order] = np.maximum(out + bias, 0)
        return self._softmax(h @ self.p["o"] + self.p["c"])

    def texts(self, data: np.ndarray, off: np.ndarray, tabs) -> np.ndarray:
        """Distributions of texts, one row each: their windows' means, weighted by letters."""
        total = np.zeros((len(off) - 1, len(self.langs)))
        weight = np.zeros(len(off) - 1)
        for i, j, a, b in _spans(off):
            x, owner = _grid(data[a:b], np.clip(off[i: j + 1], a, b) - a)
            letters = _LETTER[x].sum(axis=1)
            np.add.at(total, owner + i, self.windows(x, tabs) * letters[:, None])
            np.add.at(weight, owner + i, letters)
        return total / np.maximum(weight, 1)[:, None]


def _spans(off: np.ndarray):
    """Texts i..j and their bytes a..b in pieces of about SLICE_BYTES; long texts are cut at whole windows."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, n)
        if j == i + 1:
            for a in range(int(off[i]), max(int(off[j]), int(off[i]) + 1), SLICE_BYTES):
                yield i, j, a, min(a + SLICE_BYTES, int(off[j]))
        else:
            yield i, j, int(off[i]), int(off[j])
        i = j


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))


def _by_hash(rows: DataFrame, count: dict, quota: int, key: Column) -> DataFrame:
    """Of each language the ``quota`` rows least by ``key`` (62 bits)."""
    # first those of small keys only, half as many again as are wanted, so that few rows are sorted
    share = F.create_map(*[F.lit(x) for l, n in count.items() for x in (l, int(min(1.0, 1.5 * quota / n) * (1 << 62)))])
    few = rows.withColumn("k", key).filter(F.col("k") < share[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("k", "cuts")
    return few.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= quota)


def _windows(texts: list[str]) -> np.ndarray:
    raw = [c.encode()[:WINDOW] for c in texts]
    return _grid(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))[0]


def _foreign(x: np.ndarray, rng) -> np.ndarray:
    """Windows in no language: half with their letters shuffled, half with letters exchanged for each other."""
    x = x.copy()
    for i, row in enumerate(x):
        at = np.flatnonzero((row >= 97) & (row < 123))
        if i % 2:
            row[at] = rng.permutation(row[at])
        else:
            row[at] = (rng.permutation(26) + 97)[row[at] - 97]
    return x


def train(docs: DataFrame, sample: int = SAMPLE_DOCS, foreign: bool = False) -> Cnn | None:
    """Fit on the rows of ``docs`` that are not held out and have a language."""
    rows = _labelled(docs)
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not count:
        return None
    langs = sorted(count)
    quota = max(LEAST_DOCS, sample // len(langs))
    # of each row short windows at hashed places
    cuts = [F.substr("text", (F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)) for k in range(SAMPLE_WINDOWS)]
    rows = rows.select("lang", "h", F.array(*cuts).alias("cuts"))
    got = _by_hash(rows, count, quota, F.shiftrightunsigned("h", 2)).select("lang", "cuts").collect()
    pairs = sorted((langs.index(r["lang"]), c) for r in got for c in r["cuts"])
    x, y = _windows([c for _, c in pairs]), np.array([i for i, _ in pairs])
    n = np.bincount(y, minlength=len(langs))
    rng = np.random.Generator(np.random.PCG64(5))
    if foreign:
        some = np.sort(rng.permutation(len(x))[: max(1, len(x) // 2)])
        x, y = np.concatenate([x, _foreign(x[some], rng)]), np.append(y, np.full(len(some), len(langs)))
        n = np.append(n, len(some))
    again = [np.resize(np.flatnonzero(y == c), n.max() // 4 - k) for c, k in enumerate(n.tolist()) if k < n.max() // 4]
    at = np.concatenate([np.arange(len(y)), *again])
    return Cnn(langs + [FOREIGN] * foreign).fit(x[at], y[at])


def level(docs: DataFrame, model: Cnn) -> float:
    """The probability of the foreign class above which a text goes: a half, or what all but ``LOST`` of the labelled rows
    stay below. Every labelled row's whole text counts; the quantile is found where the rows are (``exact_quantiles``)."""
    def run(batches):
        tabs = model.tables()
        for b in batches:
            dist = model.texts(*text_bytes(b.column(0)), tabs)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int32)), pa.array(dist[:, -1].astype(float))], ["all", "p"])

    found = exact_quantiles(_labelled(docs).select("text").mapInArrow(run, "all int, p double"), ["all"], ["p"], [1 - LOST]).first()
    return max(0.5, float(found["p_q0"])) if found else 0.5


def known(docs: DataFrame, model: Cnn | None, most: float) -> DataFrame:
    """The rows of ``docs`` that have a letter and whose text is foreign with probability ``most`` at most."""
    letter = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    docs, schema, at = docs.filter(letter), docs.schema, docs.columns.index("text")
    if model is None:
        return docs

    def run(batches):
        tabs = model.tables()
        for b in batches:
            dist = model.texts(*text_bytes(b.column(at)), tabs)
            yield b.filter(pa.array(dist[:, -1] <= most))

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Cnn | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``lang`` and ``score`` (columns of these names are replaced)."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    letter = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    docs = docs.drop(lang, score)
    if model is None:
        return docs.withColumn(lang, F.lit("und")).withColumn(score, F.lit(0.0))
    schema = StructType(docs.schema.fields).add(lang, StringType()).add(score, DoubleType())
    at = docs.columns.index("text")

    def run(batches):
        tabs = model.tables()
        for b in batches:
            dist = model.texts(*text_bytes(b.column(at)), tabs)
            best = dist.argmax(axis=1)
            known = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            pred = np.where(known, np.array(model.langs, object)[best], "und")
            sure = np.where(known, np.clip(dist[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(sure)], schema.names)

    return docs.withColumn(unused(docs, "_letter"), letter).mapInArrow(run, schema)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    # the prediction sees the text alone; the id is carried along
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
