"""Items: documents as dataset rows with decisions, filters, orders, pages, counts and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import save
from .ranking import numbered

ACTIVE = ("keep", "restore")
FEW_CATEGORIES = 100_000
DECISIONS = ("keep", "review", "quarantine", "reject", "restore", "pending")


def from_documents(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Item rows: id, dataset_id (the source), text, hash, counts and decision; labels decide as their worst row says.

    toxic: quarantine; low quality: review; good: keep; no label: pending. Null texts are empty.
    """
    t = T.text_of("text")
    items = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("dataset_id"), t.alias("text"), F.sha2(t, 256).alias("content_hash"), F.length(t).cast("long").alias("char_count"), T.tokens_estimate(t).alias("tokens"), F.coalesce(F.col("lang"), F.lit("unknown")).alias("language"))
    if labels is None:
        return items.withColumn("decision", F.lit("pending"))
    worst = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    decision = F.when(F.col("toxic") == 1, "quarantine").when(F.col("quality") == 0, "review").when(F.col("quality") == 1, "keep").otherwise("pending")
    return items.join(worst, "id", "left").withColumn("decision", decision).drop("toxic", "quality")


def filtered(items: DataFrame, issues: DataFrame | None = None, *, status=None, min_length=None, dataset=None, language=None, q=None, tag=None, license=None, queue=False, issue=None) -> DataFrame:  # noqa: A002
    """All given filters together; ``issue`` keeps items that have one of that type (a semi join)."""
    if status is not None:
        items = items.where(F.col("decision") == status)
    if min_length is not None:
        items = items.where(F.col("char_count") >= int(min_length))
    if dataset is not None:
        items = items.where(F.col("dataset_id") == dataset)
    if language is not None:
        items = items.where(F.col("language") == language)
    if q is not None:
        items = items.where(F.col("original_filename").contains(q) | F.col("relative_path").contains(q))
    if tag is not None:
        items = items.where(F.array_contains("tags", tag))
    if license is not None:
        items = items.where(F.coalesce("license", F.lit("unknown")) == license)
    if queue:
        failed = F.col("ingest_status") == "error" if "ingest_status" in items.columns else F.lit(False)
        items = items.where((F.col("decision") != "keep") | failed)
    if issue is not None:
        items = items.join(issues.where(F.col("issue_type") == issue).select(F.col("text_id").alias("id")), "id", "left_semi")
    return items


def pending_first(items: DataFrame) -> list:
    """Undecided items first, then by decision; where the items say how their ingest went, failed before sound ones of the same
    decision; then by id."""
    rank = F.lit(4)
    for i, d in reversed(list(enumerate(("pending", "review", "quarantine", "reject")))):
        rank = F.when(F.col("decision") == d, i).otherwise(rank)
    failed = [F.when(F.col("ingest_status") == "error", 0).otherwise(1)] if "ingest_status" in items.columns else []
    return [rank, *failed, "id"]


def page(items: DataFrame, offset: int, limit: int, order=None) -> DataFrame:
    """One page, 1 to 5000 rows."""
    return items.orderBy(*(order or pending_first(items))).offset(max(0, offset)).limit(max(1, min(5000, limit)))


def corpus_stats(items: DataFrame) -> DataFrame:
    """One row of totals, averages (one place) and extremes; an empty table gives zeros."""
    words = F.size(T.words(F.col("text"))).cast("long")
    rows = items.select("tokens", "char_count", "dataset_id", words.alias("words"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    cols = [F.count("*").alias("items"), F.count_distinct("dataset_id").alias("sources")]
    for c, name in (("tokens", "tokens"), ("char_count", "chars"), ("words", "words")):
        cols += [zero(F.sum(c)).alias(f"total_{name}"), zero(F.round(F.avg(c), 1)).alias(f"avg_{name}"), zero(F.min(c)).alias(f"min_{name}"), zero(F.max(c)).alias(f"max_{name}")]
    return rows.agg(*cols)


def top_values(items: DataFrame, column: str) -> DataFrame:
    """Rows by value, most first; null and empty are "unknown"."""
    value = F.when(F.coalesce(F.col(column), F.lit("")) == "", "unknown").otherwise(F.col(column))
    return items.groupBy(value.alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def decision_counts(items: DataFrame) -> DataFrame:
    """Per dataset one column for each decision, zero-filled, and the total."""
    return items.groupBy("dataset_id").agg(*(F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS), F.count("*").alias("total"))


def triage(items: DataFrame, issues: DataFrame) -> DataFrame:
    """Per dataset its open issues and status: flagged (over 3), review (some), new (pending items), clean."""
    opened = issues.where("status = 'open'").groupBy("text_id").agg(F.count("*").alias("k"))
    per = items.join(opened, items.id == opened.text_id, "left").groupBy("dataset_id").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("open_issues"), F.count_if(F.col("decision") == "pending").alias("pending"))
    return per.withColumn("triage", F.when(F.col("open_issues") > 3, "flagged").when(F.col("open_issues") > 0, "review").when(F.col("pending") > 0, "new").otherwise("clean"))


def decide(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items with the latest decision of an append-only log (text_id, decision, reason, decided_at); ties by decision."""
    last = log.groupBy("text_id").agg(F.max_by(F.struct("decision", "reason"), F.struct("decided_at", "decision")).alias("d"))
    rows = items.join(last.select(F.col("text_id").alias("id"), F.col("d.decision").alias("_new"), F.col("d.reason").alias("reason")), "id", "left")
    return rows.withColumn("decision", F.coalesce("_new", "decision")).drop("_new")


def restore(items: DataFrame, snapshot: DataFrame) -> DataFrame:
    """keep what the snapshot (id) has, quarantine what it lacks; undecided and rejected rows stay as they are."""
    rows = items.join(snapshot.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left")
    new = F.when(F.col("decision").isin("keep", "restore", "quarantine"), F.when(F.col("_in"), "keep").otherwise("quarantine")).otherwise(F.col("decision"))
    return rows.withColumn("decision", new).drop("_in")


def latest(rows: DataFrame, key: str, at: str = "created_at", unless: str = "superseded_at") -> DataFrame:
    """The newest row of each key that nothing has superseded."""
    live = rows.where(F.col(unless).isNull())
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc("id"))
    return live.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def labelled(items: DataFrame, labels: DataFrame, kind: str | None = None) -> DataFrame:
    """Distinct (category, id) of labels (doc_id, category) on these items: approved ones where labels have a status, not
    superseded ones, and of one label_type if ``kind`` is given."""
    rows = labels.where(F.col("category").isNotNull())
    if "status" in labels.columns:
        rows = rows.where("status = 'approved'")
    if "superseded_at" in labels.columns:
        rows = rows.where("superseded_at is null")
    if kind is not None:
        rows = rows.where(F.col("label_type") == kind)
    rows = rows.select("category", F.col("doc_id").alias("id")).join(items.select("id"), "id", "left_semi")
    return rows.select("category", "id").distinct()


def postings(items: DataFrame, labels: DataFrame, kind: str | None = None, size: int = 10_000) -> DataFrame:
    """category, chunk, first_id, n, ids: each category's sorted item ids in chunks of ``size`` (the last may be shorter),
    numbered from 0, so that a category of any size is no group. Labels as labelled() takes them.

    Rows are numbered over the ranges of (category, id); a category's least number, one row a category, turns numbers into places.
    """
    rows = numbered(labelled(items, labels, kind), "category", "id", name="_at", start=0)
    begins = save(rows.groupBy("category").agg(F.min("_at").alias("_from")), "begins")
    rows = rows.join(F.broadcast(begins) if begins.count() <= FEW_CATEGORIES else begins, "category").withColumn("chunk", F.floor((F.col("_at") - F.col("_from")) / size))
    return rows.groupBy("category", "chunk").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))


def by_label(items: DataFrame, labels: DataFrame, kind: str | None = None) -> DataFrame:
    """category, ids, n: category to sorted item ids in one row, as a page shows them; postings() is the form for large
    categories. Labels as labelled() takes them."""
    return labelled(items, labels, kind).groupBy("category").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))


def prefer(pairs: DataFrame, choice) -> DataFrame:
    """Preference pairs after a reviewer's choice column: a approves, b swaps and approves, tie rejects, skip waits."""
    c = choice if not isinstance(choice, str) else F.col(choice)
    return pairs.select(
        *(x for x in pairs.columns if x not in ("chosen", "rejected", "status", "strategy")),
        F.when(c == "b", F.col("rejected")).otherwise(F.col("chosen")).alias("chosen"),
        F.when(c == "b", F.col("chosen")).otherwise(F.col("rejected")).alias("rejected"),
        F.when(c == "tie", "manual_tie").otherwise(F.col("strategy")).alias("strategy"),
        F.when(c.isin("a", "b"), "approved").when(c == "tie", "rejected").otherwise("pending").alias("status"),
    )


def pair_decision(status):
    """approved: keep, rejected: reject, pending: review."""
    return F.when(status == "approved", "keep").when(status == "rejected", "reject").otherwise("review")


def add_label(label_source, confidence, least: float = 1.0):
    """Status of a new label: a human's is approved, a model's too from ``least`` confidence on, else it is pending."""
    return F.when((label_source == "human") | (confidence >= least), "approved").otherwise("pending")
