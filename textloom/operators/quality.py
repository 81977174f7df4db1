"""Quality rules and the issues they raise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import text as T

MAX_TOKENS = 4000


def scores(items: DataFrame) -> DataFrame:
    """id, dataset_id and the seven scores, six places."""
    t = F.col("text")
    named = {"repetition": T.repetition(t), "spam_score": T.spam(t), "code_ratio": T.code_ratio(t), "toxicity": T.toxicity(t), "pii_score": T.pii(t)}
    length = F.length(t).cast("double")
    return items.select("id", "dataset_id", length.alias("length"), *(F.round(c, 6).alias(n) for n, c in named.items()))


def issues(items: DataFrame, thresholds: Thresholds = Thresholds(), datasets: DataFrame | None = None) -> DataFrame:
    """One row per rule that a text breaks, strictly; evaluated in one pass over the text.

    ``datasets`` (dataset_id, thresholds: map of a rule's name to its value) overrides ``thresholds`` for items of a dataset;
    names it lacks, null values and datasets it lacks keep the default. Zero counts.
    """
    th = thresholds
    rules = [("too_short", "length", "min_length"), ("too_long", "length", "max_length"), *((c, c, c.split("_")[0]) for c in ("repetition", "spam_score", "code_ratio", "toxicity", "pii_score"))]
    rows, own = scores(items), lambda name: F.lit(None).cast("double")
    if datasets is not None:
        rows = rows.join(datasets.select("dataset_id", F.col("thresholds").alias("_own")), "dataset_id", "left")
        own = lambda name: F.coalesce(F.try_element_at("_own", F.lit(name)), F.try_element_at("_own", F.lit(f"{name}_threshold"))).cast("double")
    found = F.array(*(F.struct(F.lit(name).alias("issue_type"), F.col(c).alias("score"), F.coalesce(own(key), F.lit(float(getattr(th, key)))).alias("threshold")) for name, c, key in rules))
    broken = F.filter(found, lambda r: F.when(r["issue_type"] == "too_short", r["score"] < r["threshold"]).otherwise(r["score"] > r["threshold"]))
    out = rows.select(F.col("id").alias("text_id"), "dataset_id", F.explode(broken).alias("i"))
    return out.select("text_id", "dataset_id", "i.issue_type", "i.score", "i.threshold", F.lit("open").alias("status"))


def ingest_issues(items: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """too_short below the least length, too_long above 4000 estimated tokens, with score 1."""
    rows = F.array(
        F.when(F.col("char_count") < thresholds.min_length, F.struct(F.lit("too_short").alias("issue_type"), F.lit(float(thresholds.min_length)).alias("threshold"))),
        F.when(F.col("tokens") > MAX_TOKENS, F.struct(F.lit("too_long").alias("issue_type"), F.lit(float(MAX_TOKENS)).alias("threshold"))),
    )
    out = items.select(F.col("id").alias("text_id"), F.explode(F.array_compact(rows)).alias("i"))
    return out.select("text_id", "i.issue_type", F.lit(1.0).alias("score"), "i.threshold")


def replace_open(old: DataFrame, new: DataFrame) -> DataFrame:
    """A detector's fresh issues in place of its open ones; acknowledged and dismissed ones stay, unless they recur as open."""
    closed = old.where("status <> 'open'")
    return closed.unionByName(new.join(closed.select("text_id", "issue_type"), ["text_id", "issue_type"], "left_anti"))


def enriched(issues_: DataFrame, items: DataFrame) -> DataFrame:
    """Issues with their item's decision and size, null where the item is gone."""
    return issues_.join(items.select(F.col("id").alias("text_id"), "decision", "char_count"), "text_id", "left")


def by_type(issues_: DataFrame) -> DataFrame:
    return issues_.groupBy("issue_type").agg(F.count("*").alias("n"))


def bulk_reject(items: DataFrame, issues_: DataFrame, types=("pii", "possible_pii", "secrets", "pii_score")) -> DataFrame:
    """Items with an open issue of these types are rejected."""
    hit = issues_.where((F.col("status") == "open") & F.col("issue_type").isin(*types)).select(F.col("text_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return items.join(hit, "id", "left").withColumn("decision", F.when(F.col("_hit"), "reject").otherwise(F.col("decision"))).drop("_hit")
