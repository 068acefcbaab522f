"""Preparing a training corpus: toxicity, near-duplicates, benchmark passages, secrets, and BPE ids.

Every stage takes the documents that the one before has kept and is written once, so that a lost executor costs no more
than the stage at hand. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm import decontaminate, near_copies, secrets, tokenize, toxicity
from cairnflow.llm.common import scratch, table, written
from cairnflow.llm.queries import WORD_BPE


def _sized(before: DataFrame, after: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    if "n_chars" in before.columns:
        after = after.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType))
    return after.select(*before.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; it is fitted on the labels of the documents at hand."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles have a similarity of 0.8 or more, directly or by way of others,
    one row stays: the one with the smallest doc_id, null last; of rows equal in id and text any one. Other columns may be
    of any kind; they are not looked at. Only texts that may go, or come in several rows, are moved."""
    rows = docs.select("doc_id", near_copies.text_digest().alias("digest")).groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    rows = rows.join(near_copies.roots(docs), "digest", "left")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    group = F.coalesce(F.col("group").cast("string").cast("binary"), "digest")
    first = rows.groupBy(group.alias("of")).agg(F.min(place).alias("first"), F.sum("n").alias("members")).where("members > 1")
    rows = rows.withColumn("of", group).join(first, "of").select("doc_id", "digest", "n", (place == F.col("first")).alias("stays"))
    said = written(rows.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "n", "stays"), scratch(spark, "near_copy_groups"))
    return near_copies.decided(docs, said.where("NOT stays OR n > 1"))


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; every document stays."""
    return _sized(docs, decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return _sized(docs, secrets.redact(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids and what they decode to, as digests."""
    return tokenize.round_trip(docs, WORD_BPE).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmarks", cut_benchmarks),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

ORACLE_SQL = None
"""SQL expresses neither the fitted model nor XXH64, so the rows are tested against a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
