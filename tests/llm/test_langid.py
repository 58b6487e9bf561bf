"""Language identification: held-out accuracy, equal forms of the network, edge cases."""

import numpy as np
import pyarrow as pa

from candela.llm import langid
from candela.llm.common import table

from conftest import SF_ORACLE


def test_held_out_accuracy(spark):
    docs = table(spark, SF_ORACLE, "documents")
    model = langid.train(docs)
    rows = langid.predict(docs, model).filter(langid.held_out()).collect()
    rows = [r for r in rows if r.lang is not None and r.lang_pred != "und"]
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_tables_equal_convolution():
    rng = np.random.default_rng(1)
    net = langid.Cnn(["a", "b", "c"])
    net.p = {k: rng.standard_normal(v.shape).astype(np.float32) for k, v in net.p.items()}
    x = rng.integers(0, 256, (70, langid.WINDOW)).astype(np.uint8)
    emb, feats = net.p["e"][x], []
    for w in langid.WIDTHS:
        k = langid.WINDOW - w + 1
        z = np.stack([emb[:, i: i + w].reshape(len(x), -1) @ net.p[f"w{w}"] + net.p[f"b{w}"] for i in range(k)], 1)
        feats.append(np.maximum(z.max(axis=1), 0))
    want = net._softmax(np.concatenate(feats, axis=1) @ net.p["o"] + net.p["c"])
    np.testing.assert_allclose(net.windows(x, net.tables()), want, atol=1e-4)


def test_gradients():
    rng = np.random.default_rng(2)
    net = langid.Cnn(["a", "b"])
    net.p = {k: (rng.standard_normal(v.shape) * 0.3).astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0, 1])
    g = net._gradients(x, y)

    def loss():
        return -np.mean(np.log(net.windows(x, net.tables())[np.arange(5), y]))

    for name in ("e", "w3", "b2", "o", "c"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        net.p[name][at] += 1e-2
        up = loss()
        net.p[name][at] -= 2e-2
        down = loss()
        net.p[name][at] += 1e-2
        assert abs((up - down) / 2e-2 - g[name][at]) < 0.05 * abs(g[name][at]) + 1e-3


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !!", "x"), (None, "the cat and the dog of the house", "en"), (4, "der Hund und die Katze " * 60_000, "de"), (5, "é", None),
            (6, "the house and the garden", "en"), (6, "the house and the garden", "en"), (7, "und der Garten ist nicht das Haus", "de")] + [
            (i, ("the and of to in " if i % 2 else "der und die das nicht ") * 8, "en" if i % 2 else "de") for i in range(100, 160)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, _extra int")
    out = langid.predict(df, langid.train(df)).collect()
    assert len(out) == len(rows)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.doc_id in (1, 2, 3))
    assert next(r for r in out if r.doc_id == 4).lang_pred == "de" and next(r for r in out if r.doc_id is None).lang_pred == "en"
    assert langid.train(df.limit(0)) is None and langid.predict(df.limit(0), None).count() == 0
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}


def test_a_rare_language_is_learned(spark):
    rows = [(i, ("the and of to in house " if i % 2 else "der und die das nicht haus ") * 6, "en" if i % 2 else "de") for i in range(20_000)]
    rows += [(50_000 + i, f"az egy hogy nem van ez szoba {i} és meg kell ház " * 4, "hu") for i in range(16)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.langs == ["de", "en", "hu"]
    out = langid.predict(df.filter("doc_id >= 50000 OR doc_id < 200"), model).collect()
    assert all(r.lang == r.lang_pred for r in out)


def test_query_equals_a_plain_pass(spark):
    docs = table(spark, SF_ORACLE, "documents")
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.op4_langid(spark, SF_ORACLE).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        text = (r.text or "").encode()
        low = bytes(b + 32 if 65 <= b < 91 else b for b in text)
        total, weight = np.zeros(len(model.langs)), 0
        for a in range(0, max(len(low), 1), langid.WINDOW):
            x = np.frombuffer(low[a: a + langid.WINDOW].ljust(langid.WINDOW, b"\0"), np.uint8)
            emb, feats = model.p["e"][x], []
            for w in langid.WIDTHS:
                z = sum(emb[j: len(x) - w + 1 + j] @ model.p[f"w{w}"][j * langid.DIM: (j + 1) * langid.DIM] for j in range(w)) + model.p[f"b{w}"]
                feats.append(np.maximum(z.max(axis=0), 0))
            letters = sum(97 <= b < 123 or b >= 128 for b in x.tolist())
            total += model._softmax((np.concatenate(feats) @ model.p["o"] + model.p["c"])[None])[0] * letters
            weight += letters
        dist = total / max(weight, 1)
        have = got[r.doc_id]
        if have.lang_pred != "und":
            assert abs(dist.max() - have.score) < 1e-3
            assert have.lang_pred == model.langs[int(dist.argmax())] or np.sort(dist)[-1] - np.sort(dist)[-2] < 1e-3
        else:
            assert have.score == 0 and not any(c.isalpha() for c in r.text or "")


def test_foreign_texts_go_and_clean_ones_stay(spark):
    docs = table(spark, SF_ORACLE, "documents")
    model = langid.train(docs, foreign=True)
    most = langid.level(docs, model)
    clean = docs.filter("lang IS NOT NULL AND length(text) > 200")
    kept = langid.known(clean, model, most)
    assert kept.columns == docs.columns and kept.count() >= 0.995 * clean.count()
    rng = np.random.default_rng(1)
    noise = ["".join(rng.choice(list("qxzjkvwy bcdfg"), 400)) for _ in range(20)]
    hungarian = "a fiú elment a boltba és vett egy kenyeret, de nem volt nála elég pénz, ezért vissza kellett mennie haza a pénztárcájáért " * 3
    junk = spark.createDataFrame([(i, t) for i, t in enumerate(noise)], "doc_id long, text string")
    assert langid.known(junk, model, most).count() <= 1
    assert langid.known(spark.createDataFrame([(1, None), (2, ""), (3, "12 !")], "doc_id long, text string"), model, most).count() == 0
    print("Hungarian kept:", langid.known(spark.createDataFrame([(1, hungarian)], "doc_id long, text string"), model, most).count())


def test_the_level_counts_every_labelled_row(spark):
    docs = table(spark, SF_ORACLE, "documents").select("doc_id", "lang", "text")
    # beyond the bounded number of rows that set the level before; the text behind the first 20 windows counts too
    docs = docs.union(docs.selectExpr("doc_id + 100000", "lang", "repeat('a b c d ', 400) || reverse(text)")).union(docs.selectExpr("doc_id + 200000", "lang", "text"))
    model = langid.train(docs, foreign=True)
    rows = [r.text for r in langid._labelled(docs).collect()]
    p = model.texts(*langid.text_bytes(pa.array(rows)), model.tables())[:, -1]
    assert abs(langid.level(docs, model) - max(0.5, float(np.quantile(p, 1 - langid.LOST)))) < 1e-9
    assert langid.level(docs.filter("lang IS NULL"), model) == 0.5
