"""Embedding job: vectors of texts kept by content, so that a provider sees each text once however often the job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .jobs import Providers

SCHEMA = "content_hash string, vector array<float>, model string, bucket string"
DIGITS = 2


def stored(spark: SparkSession, path: str, model: str) -> DataFrame:
    """content_hash, vector, bucket of a model's table; empty before its first job."""
    try:
        rows = spark.read.schema(SCHEMA).option("basePath", path).parquet(f"{path}/model={model}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMA)
    return rows.select("content_hash", "vector", "bucket")


def wanted(items: DataFrame) -> DataFrame:
    """content_hash, text, bucket: each text of the ingested items (id, content_hash, text) once; empty ones are left out."""
    if "ingest_status" in items.columns:
        items = items.where("ingest_status = 'done'")
    rows = items.where("text <> ''").groupBy("content_hash").agg(F.min("text").alias("text"))
    return rows.withColumn("bucket", F.substring("content_hash", 1, DIGITS))


def run(items: DataFrame, providers: Providers, path: str, model: str, scope: str = "embedding") -> dict[str, int]:
    """Give the provider the texts whose content the table lacks and append their vectors; returns counts of texts: processed,
    skipped (known before) and failed (the provider gave none or an empty one; they are tried again next time).

    The table lies in folders by the hash's first digits, at most 256: only folders of hashes that are asked for are read, and
    of them only the hash. What a job that died has appended is known to the next.
    """
    spark = items.sparkSession
    texts = wanted(items)
    touched = [r.bucket for r in texts.select("bucket").distinct().collect()]
    known = stored(spark, path, model).where(F.col("bucket").isin(touched)).select("content_hash")
    missing = texts.join(known, "content_hash", "left_anti")
    before = stored(spark, path, model).where(F.col("bucket").isin(touched)).count() if touched else 0
    total, todo = texts.count(), missing.count()
    if todo:
        made = providers.apply(missing, scope, "text", "vector", "array<float>").where("size(vector) > 0")
        rows = made.select("content_hash", "vector", F.lit(model).alias("model"), "bucket")
        rows.repartition("bucket").write.mode("append").partitionBy("model", "bucket").parquet(path)
    after = stored(spark, path, model).where(F.col("bucket").isin(touched)).count() if todo else before
    return {"processed": after - before, "skipped": total - todo, "failed": todo - (after - before)}


def vectors(items: DataFrame, path: str, model: str) -> DataFrame:
    """id, vector of the items whose text has been embedded."""
    return items.select("id", "content_hash").join(stored(items.sparkSession, path, model).drop("bucket"), "content_hash").select("id", "vector")
