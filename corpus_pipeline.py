"""A corpus pipeline of five stages over ``documents``: quality, near-duplicates, leaks, secrets, mix.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's rows to the
folder all executors share and reads them back as the next one's ``docs``, so a lost executor costs no
earlier stage. All stages but the last return the columns of ``documents``, which has a row per ``doc_id``.

* quality: documents that the ranking puts below its cut go. Learnt from the labels whose id is not held out.
* near_duplicates: of each group of documents that are linked by four fifths of their five-word shingles the smallest id stays.
  Candidates are the fingerprints within four bits of ``simhash``, completed by minimum hashes; the sets themselves decide.
* decontamination: documents with a leaked benchmark passage go.
* secrets: found secrets are replaced by their kind in brackets; ``n_chars`` follows.
* mixing: what each document gives to a mix at the target weights.

Rows: a missing text is an empty document to each stage; a missing id is judged like any other, and of several
rows without id in one group of near-duplicates one stays, as of rows with equal ids. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import copies, leaks, mixing, quality, secret_scan
from shelfwise.llm.common import free_name, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    name = free_name(docs, "score")
    return quality.scored(docs, model, name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return copies.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "leaks")
    items = leaks.prepare(docs, table(spark, sf_dir, "benchmark"))
    return leaks.marked(docs, items, name).where(F.size(name) == 0).drop(name)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: SQL can express neither the learnt score nor the fingerprints; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
