"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontamination, ngram_join, packing, pii, toxicity
from textloom.llm.common import discard, save, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, judged by its own text; rows without an id stay.

    Rows that repeat both id and text are copies too: one of them stays.
    """
    keep = ngram_join.representatives(docs).select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    here = f"key_{uuid.uuid4().hex}"
    some = docs.where("doc_id is not null").withColumn(here, F.xxhash64(F.col("text").cast("string")))
    some = some.join(keep, (some["doc_id"].cast("long") == keep["kept_id"]) & (some[here] == keep["kept_key"]), "left_semi")
    return some.dropDuplicates(["doc_id", here]).drop(here).unionByName(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", drop_leaks),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Fitted and iterative stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents, each written as Parquet and read again for the next, then deleted."""
    docs = last = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs, f"stage-{name}")
            discard(last)
            last = docs
    return docs
