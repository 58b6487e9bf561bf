"""The pipeline's stages on a small corpus with planted cases, and on the documents."""

import base64

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from candela.llm import bpe, secrets
from candela.llm.common import BATCH_BYTES, table

from conftest import SF_ORACLE, SF_SMALL


@pytest.fixture(scope="module")
def planted(spark):
    docs = table(spark, SF_ORACLE, "documents").filter("lang IS NOT NULL")
    item = next(r.text for r in table(spark, SF_ORACLE, "benchmark").orderBy("item_id").collect() if len(r.text) > 150)
    base = docs.orderBy("doc_id").limit(300)
    clean = base.orderBy("doc_id").first().text
    rows = [(5001, clean + " extra tail.", "en", "s", 1), (5002, clean, "en", "s", 1), (5003, "Before it " + item.upper() + " after it", "en", "s", 1),
            (5004, "...!!! 123", "en", "s", 1), (5005, None, None, None, None), (5006, "", "en", "s", 0), (5007, "the password=abcdefghij and more words of the text here", "en", "s", 55),
            (5008, "the same row twice in this small table of texts", "en", "s", 1), (5008, "the same row twice in this small table of texts", "en", "s", 1),
            (None, "the row without an id in this small table", "en", "s", 1)]
    return base.unionByName(spark.createDataFrame(rows, base.schema)).selectExpr("*", "1 AS score", "'x' AS base", "'y' AS _folded")


def test_stages_on_planted_cases(spark, planted):
    docs, ids = planted, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = corpus_pipeline.written(stage(spark, docs, SF_ORACLE), name)
        assert new.columns == docs.columns
        ids[name] = {r.doc_id: r for r in new.collect()}
        docs = new
    assert not {5004, 5005, 5006} & ids["language"].keys() and {5001, 5003, 5007, None} <= ids["language"].keys()
    assert not {5001, 5002} & ids["near_copies"].keys() and 5008 in ids["near_copies"]
    assert 5003 in ids["near_copies"] and 5003 not in ids["benchmark"]
    row = ids["secrets"][5007]
    assert row.text == "the [SECRET] and more words of the text here" and row.n_chars == len(row.text) and row.score == 1 and row.base == "x"
    assert ids["benchmark"].keys() == ids["secrets"].keys()
    path = bpe.default_ranks()
    tok = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF_ORACLE).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == tok.encode_ordinary(ids["secrets"][r.doc_id].text) and r.n_tokens == len(r.ids) // 4
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, planted.limit(0), SF_ORACLE).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    docs = {r.doc_id: r.text for r in table(spark, SF_SMALL, "documents").collect()}
    assert 0 < len(out) <= len(docs) and {r.doc_id for r in out} <= docs.keys()
    codec = bpe.codec(bpe.default_ranks(), P.PATTERN)
    same = sum(codec.decode(r.ids).decode() == docs[r.doc_id] for r in out)
    assert same >= 0.8 * len(out) and secrets.KINDS


def test_long_rows_reach_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(2000, numPartitions=1).selectExpr("id AS doc_id", "repeat('some long text ', 600) AS text", "'en' AS lang", "9000L AS n_chars")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    for name, stage in corpus_pipeline.STAGES:
        if name in ("language", "benchmark", "tokens"):  # their results are computed by Python when written
            spark.conf.unset(key)
            stage(spark, docs.limit(40), SF_SMALL)
            assert docs.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] <= BATCH_BYTES + 20_000, name
