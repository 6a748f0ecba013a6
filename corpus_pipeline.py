"""A corpus pipeline of five stages; each stage's rows are written as Parquet and read again by the next.

Toxic documents go, one document of each group of near copies stays,
documents with benchmark passages go, personal data are replaced by their
kinds, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridewise.llm import decontam, packing, pii, simhash, toxicity
from stridewise.llm.common import materialize, release, table
from stridewise.llm.queries import vocabulary

#: Columns that every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold.

    Null and empty texts stay, and so do rows without an id; without labelled
    rows nothing is toxic. Repeated rows stay repeated. Columns besides
    COLUMNS are dropped here and in the stages behind.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: the one with the smallest id, and of equal ids the one whose text has the smallest key.

    Rows without an id come last; repeated ids are compared by their texts like
    others. Null and empty texts are one class; an empty table stays one.
    """
    table(spark, sf_dir, "documents")
    keyed = simhash.with_set_keys(docs.select(*COLUMNS)).withColumn("row_key", F.xxhash64("doc_id", "text"))
    rows = materialize(keyed.select("doc_id", "node", "row_key"), "pipeline-rows")
    found = simhash.near_copy_components(docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text"))
    placed = rows.join(found, "node", "left")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "node")).alias("first")
    kept = placed.groupBy(F.coalesce("component", "node").alias("class")).agg(first).select("first.node", "first.row_key")
    return keyed.join(kept, ["node", "row_key"], "left_semi").dropDuplicates(["node"]).select(*COLUMNS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts have none and stay; an empty benchmark leaves all.
    """
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them replaced by [KIND]; n_chars is that of the new text.

    Null texts stay null; texts without personal data and their n_chars stay as they are.
    """
    table(spark, sf_dir, "documents")
    found = pii.detect(docs.select(*COLUMNS), pii.learn(docs))
    found = found.withColumn("text", F.col("redacted"))
    changed = F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return found.withColumn("n_chars", changed).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences that the documents are packed into; null and empty texts have their end mark alone."""
    table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("decontamination", without_benchmarks),
    ("pii", redacted),
    ("packing", packed),
]

#: The models cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if number:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
