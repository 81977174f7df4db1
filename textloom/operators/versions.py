"""Immutable dataset versions: snapshots with labels, checksums, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .items import ACTIVE


def snapshot(items: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Active items with hash, decision and their labels (doc_id, category), sorted, none: empty."""
    rows = items.where(F.col("decision").isin(*ACTIVE)).select("id", "dataset_id", "content_hash", "decision")
    if labels is None:
        return rows.withColumn("labels", F.array().cast("array<string>"))
    nested = labels.groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_list("category")).alias("labels"))
    return rows.join(nested, "id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def checksum(snap: DataFrame) -> DataFrame:
    """Per dataset its item count and a checksum: hashes of rows, bucketed and sorted, hashed again.

    The 4096 buckets keep any one aggregate small; the order of rows does not matter.
    """
    line = F.sha2(F.concat_ws("|", F.col("id").cast("string"), "content_hash", "decision"), 256)
    rows = snap.select("dataset_id", line.alias("h")).withColumn("b", F.substring("h", 1, 3))
    buckets = rows.groupBy("dataset_id", "b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("k"))
    return buckets.groupBy("dataset_id").agg(F.sum("k").alias("item_count"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("checksum"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """id and change: added, removed, or modified when the content hash differs."""
    a = old.select("id", F.col("content_hash").alias("was"))
    b = new.select("id", F.col("content_hash").alias("now"))
    rows = a.join(b, "id", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return rows.select("id", change.alias("change")).where("change is not null")


def manifest(items: DataFrame, version: str = "") -> DataFrame:
    """Export rows of the active items."""
    return items.where(F.col("decision").isin(*ACTIVE)).select(
        F.col("id").alias("item_id"), "dataset_id", F.col("content_hash").alias("sha256"), "char_count", "tokens", "language", "decision",
        F.lit(version).alias("dataset_version"), F.lit("local-operator").alias("exported_by"), F.lit("0.1.0").alias("pipeline_version"),
    )


def export_snapshot(items: DataFrame, snap: DataFrame, version: str) -> DataFrame:
    """Export rows of a version: live items that its snapshot has, with the snapshot's decision and labels, in its order."""
    old = snap.select("id", F.col("decision").alias("_then"), F.col("labels").alias("labels"))
    rows = items.join(old, "id").withColumn("decision", F.col("_then")).drop("_then")
    return rows.select(F.col("id").alias("item_id"), "dataset_id", F.col("content_hash").alias("sha256"), "char_count", "tokens", "language", "decision", "labels", F.lit(version).alias("dataset_version")).orderBy("item_id")


def manifest_lines(snap: DataFrame) -> DataFrame:
    """One JSON line per snapshot row, and its hash: the version's manifest file."""
    line = F.to_json(F.struct("id", "content_hash", "decision", "labels"))
    return snap.select("id", line.alias("line"), F.sha2(line, 256).alias("sha256")).orderBy("id")


def chained(versions: DataFrame, new: DataFrame) -> DataFrame:
    """versions (version_id, dataset_id, created_at, parent_id) with new ones, whose parent is their dataset's latest."""
    last = versions.groupBy("dataset_id").agg(F.max_by("version_id", F.struct("created_at", "version_id")).alias("parent_id"))
    return versions.unionByName(new.drop("parent_id").join(last, "dataset_id", "left").select(*versions.columns))


def strict_licenses(items: DataFrame) -> None:
    """An error if an active item's license is unknown."""
    bad = items.where(F.col("decision").isin(*ACTIVE) & F.coalesce("license", F.lit("unknown")).isin("", "unknown")).limit(1).count()
    if bad:
        raise ValueError("strict license policy: an active item has no known license")


def retained(exports: DataFrame, keep: int = 5) -> DataFrame:
    """The newest ``keep`` exports of each dataset and format."""
    from pyspark.sql import Window

    w = Window.partitionBy("dataset_id", "fmt").orderBy(F.desc("created_at"), F.desc("id"))
    return exports.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")
