"""Review of issues and labels: states, supersession, lists and shares. Changes come as frames, so one call does many."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import save


def _changed(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns that ``changes`` (one row a key) has set; null leaves the old value."""
    new = changes.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns))
    out = rows.join(new, key, "left")
    for c in columns:
        old = F.col(c) if c in rows.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(f"_{c}", old))
    return out.drop(*(f"_{c}" for c in columns))


def add_labels(labels: DataFrame, new: DataFrame, at) -> DataFrame:
    """labels with new ones (id, doc_id, category, source_type, confidence, supersedes_id) appended: a human's are approved,
    others pending; each label that one of them names is superseded at the time ``at``."""
    gone = new.where("supersedes_id is not null").select(F.col("supersedes_id").alias("id")).distinct().withColumn("_at", at)
    old = labels.join(gone, "id", "left").withColumn("superseded_at", F.coalesce("superseded_at", "_at")).drop("_at")
    status = F.when(F.col("source_type") == "human", "approved").otherwise("pending")
    fresh = new.withColumn("status", status).withColumn("superseded_at", F.lit(None).cast(labels.schema["superseded_at"].dataType))
    return old.unionByName(fresh.select(*old.columns))


def rename_labels(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """Labels under new categories (id, category), trimmed; an empty category is an error."""
    name = F.trim("category")
    checked = changes.select("id", F.when(name == "", F.raise_error(F.lit("category cannot be empty"))).otherwise(name).alias("category"))
    return _changed(labels, checked, "id", ["category"])


def review_labels(labels: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels with their new status (id, status, reviewer, comment), and the audit rows; other states are an error."""
    state = F.when(F.col("status").isin("approved", "rejected"), F.col("status")).otherwise(F.raise_error(F.lit("status must be approved|rejected")))
    checked = reviews.withColumn("status", state)
    audit = checked.select(F.lit("label").alias("target_type"), F.col("id").alias("target_id"), F.coalesce("reviewer", F.lit("local")).alias("reviewer_id"), F.col("status").alias("decision"), F.coalesce("comment", F.lit("")).alias("comment"))
    return _changed(labels, checked.select("id", "status"), "id", ["status"]), audit


def acknowledge(issues: DataFrame, acks: DataFrame) -> DataFrame:
    """Issues with status, reviewed_by and reviewed_at of ``acks`` (id, status, reviewed_by, reviewed_at)."""
    return _changed(issues, acks, "id", ["status", "reviewed_by", "reviewed_at"])


def set_tags(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items with the tags of ``changes`` (id, tags), each once, in order."""
    return _changed(items, changes.select("id", F.array_sort(F.array_distinct("tags")).alias("tags")), "id", ["tags"])


def set_license(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items with the license of ``changes`` (id, license)."""
    return _changed(items, changes, "id", ["license"])


def set_captions(captions: DataFrame, new: DataFrame, at) -> DataFrame:
    """captions (id, text_id, text, status, superseded_at) with new ones (id, text_id, text) appended as pending; an
    item's earlier caption is superseded."""
    mine = new.select("text_id").distinct().withColumn("_at", at)
    old = captions.join(mine, "text_id", "left").withColumn("superseded_at", F.coalesce("superseded_at", "_at")).drop("_at")
    fresh = new.withColumn("status", F.lit("pending")).withColumn("superseded_at", F.lit(None).cast(captions.schema["superseded_at"].dataType))
    return old.unionByName(fresh.select(*old.columns))


def listed(issues: DataFrame, issue_type: str | None = None, status: str | None = None, dataset: str | None = None) -> DataFrame:
    for column, value in (("issue_type", issue_type), ("status", status), ("dataset_id", dataset)):
        if value:
            issues = issues.where(F.col(column) == value)
    return issues


def worst(issues: DataFrame, limit: int) -> DataFrame:
    """The issues of highest score, ties by text and type."""
    return issues.orderBy(F.desc("score"), "text_id", "issue_type").limit(limit)


def ranked(issues: DataFrame, most: int) -> DataFrame:
    """Each type's ``most`` issues of highest score with their place and the type's count of issues.

    The count is an aggregate and the window's filter bounds what a task keeps of a type, so no type is gathered whole. Issues
    are written once, for what makes them is dear and both read them.
    """
    issues = save(issues, "issues")
    place = Window.partitionBy("issue_type").orderBy(F.desc("score"), "text_id")
    count = issues.groupBy("issue_type").agg(F.count("*").alias("of_type"))
    top = issues.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)
    return top.join(F.broadcast(count), "issue_type")


def exports_by_date(exports: DataFrame, fmt: str | None = None) -> DataFrame:
    return (exports.where(F.col("fmt") == fmt) if fmt else exports).orderBy(F.desc("created_at"), F.desc("id"))


def shares(items: DataFrame, members: DataFrame) -> DataFrame:
    """Per dataset the total, kept share, pending items (all without a known decision) and the share of items that are
    duplicates other than the canonical one; shares in percent, one place."""
    extra = members.where("not is_canonical").select(F.col("text_id").alias("id")).distinct().withColumn("_extra", F.lit(1))
    known = F.count_if(F.col("decision").isin("keep", "review", "quarantine", "reject", "restore"))
    out = items.join(extra, "id", "left").groupBy("dataset_id").agg(F.count("*").alias("total"), known.alias("known"), F.count_if(F.col("decision") == "keep").alias("kept"), F.count("_extra").alias("duplicates"))
    share = lambda c: F.round(100 * F.col(c) / F.col("total"), 1)
    return out.select("dataset_id", "total", (F.col("total") - F.col("known")).alias("pending"), share("kept").alias("keep_pct"), share("duplicates").alias("savings_pct"))
