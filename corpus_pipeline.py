"""The corpus pipeline: five stages over ``documents``, each an operator of ``candela.llm``.

A stage is ``(name, function(spark, docs, sf_dir))``. It works on all rows that its predecessor
kept; its result is written as Parquet to the shared folder and read back as the next stage's ``docs``. All but the
last return the columns of ``docs``, whatever these are besides ``doc_id``, ``text`` and ``lang``.
A stage's rows go to Python workers in batches of ``common.BATCH_BYTES``: a setting that stays with the session, as the
stage's result is computed when it is written.

1. ``language``: documents without letters (null text too), and those in none of the languages learned, go
   (``langid.known``: a class of its own, its level set on all labelled rows).
2. ``near_copies``: word shingles of five, similarity 0.8; of each group of linked documents the one with the
   smallest id stays. Rows that share a doc_id stay or go together; rows without one stay.
3. ``benchmark``: documents that hold a passage of a benchmark item go.
4. ``secrets``: secrets are replaced by a mark and ``n_chars`` counts anew; no document goes.
5. ``tokens``: byte-level BPE: ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit).

Null ids, repeated rows, very long texts, empty tables and extra columns are treated as the operators say.
SQL can express neither the trained network nor BPE, so there is no ``ORACLE_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import bpe, decontam, jaccard, langid, secrets
from candela.llm.common import small_batches, table, written

SHINGLE, PERCENT = 5, 80
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = langid.train(docs, foreign=True)
    return langid.known(docs, model, langid.level(docs, model) if model else 0.5)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, linked = jaccard.near_groups(docs, PERCENT, SHINGLE)
    gone = linked.filter("id <> component_id").select(F.col("id").alias("doc_id"))
    # these ids grow with the corpus: a shuffle at every size, no broadcast
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = secrets.scan(docs.select("text", F.struct(*docs.columns).alias("row")))
    out = secrets.redact(secrets.decide(rows, secrets.thresholds(secrets.scan(docs.select("text")))))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[(F.when(F.size("spans") > 0, new[c]).otherwise(F.col("row")[c]) if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.encode_documents(docs).select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("secrets", secret_scan), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
