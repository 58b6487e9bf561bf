"""Secret scan against Python's re on hostile texts; planted random tokens; redaction."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from candela.llm import secrets

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    for k, p, least in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[0]) >= least]
    return sorted(out)


def show(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(5)
    bits = ["password", "PassWd", "token", "api_key", "APIKEY", "secret", "=", ":", " ", "'", '"', "abcdefgh", "é😀", "ſecret: abcdefghij",
            "AKIA", "ABCDEF0123456789", "0123456789abcdef", "-_.", "\n", "x", "xyz12345", "deadbeef" * 5]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "a" * 200_000, "password=" + "Ab1" * 50_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, base_ string")
    for r in secrets.decide(secrets.scan(df), {}).collect():
        want = brute(texts[r.doc_id] or "")
        assert [(s.start, s.kind, s.end) for s in r.spans] == want, texts[r.doc_id]


def test_random_tokens_found_words_left(spark):
    rng = random.Random(1)
    b62 = "".join(a for _, a in secrets.ENCODINGS[5:6])
    rows, keys = [], {}
    for i in range(200):
        key = "".join(rng.choice(b62) for _ in range(40))
        key = key if re.search("[0-9]", key) else key[:-1] + "7"
        keys[i] = key
        rows.append((i, f"before {key} after"))
    rows += [(1000 + i, f"the antidisestablishmentarianism{i} route/of/some/long/path/{i} aaaaaaaaaaaaaaaaaaaaaaaaaa1") for i in range(200)]
    out = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in out.collect()}
    assert sum(got[i] == [(7, 47)] for i in range(200)) >= 180
    assert sum(bool(got[1000 + i]) for i in range(200)) == 0
    for r in secrets.redact(out).collect():
        if r.doc_id < 200 and got[r.doc_id]:
            assert r.text == "before [SECRET] after"


def test_redaction_merges_and_digest(spark):
    df = spark.createDataFrame([(1, "password=0123456789abcdef0123456789abcdef end"), (2, None), (3, "plain")], "doc_id long, text string")
    out = secrets.redact(secrets.decide(secrets.scan(df), {}))
    got = {r.doc_id: (r.text, r.s) for r in out.withColumn("s", secrets.shown(F.col("spans"))).collect()}
    assert got[1] == ("[SECRET] end", "assign:0:41,hex:9:41") and got[2] == (None, "") and got[3] == ("plain", "")
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_copies_of_a_token_are_one_test(spark):
    rng = random.Random(8)
    alphabet = secrets.ENCODINGS[5][1]
    rows = [(i, "key " + "".join(rng.choice(alphabet) for _ in range(39)) + "7") for i in range(200)]
    rows += [(200 + i, f"route/of/some/long/path/to/{i}/aaaaaaaaaaaaaaa1") for i in range(50)]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    p = {r.doc_id: r.candidates[0].p for r in found.collect() if r.candidates and r.candidates[0].enc == 5}
    want = secrets.thresholds(found)
    assert want
    for low, high in ((0.2, 0.4), (0.6, 0.8)):
        hot = next(i for i in sorted(p) if low < p[i] < high)
        many = rows + [(1000 + i, rows[hot][1] + "=" * (i % 2)) for i in range(3000)]
        assert secrets.thresholds(secrets.scan(spark.createDataFrame(many, "doc_id long, text string"))) == want


def test_query_counts_spans_by_kind(spark, tmp_path):
    key, access, digest = "password=abcdefgh1", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2
    texts = [None, "", key, access, digest, f"{key} {digest}", f"{access} {access} {key}", f"{digest} {access} {key} {key}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.op2_secrets(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        want = brute(text or "")
        assert got[i] == (*[sum(x[1] == k for x in want) for k in range(3)], hashlib.sha256(show(want).encode()).hexdigest()), text
