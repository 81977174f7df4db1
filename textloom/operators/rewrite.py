"""Jobs that rewrite texts: normalise and redact, with hashes, counts and flags taken anew, and counters of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import text as T
from .items import ACTIVE

COUNTED = ("char_count", "word_count", "line_count", "max_line_length", "min_line_length")


def _with_text(items: DataFrame, text) -> DataFrame:
    """Items with a new text; hash, sizes, counts and flags follow where it differs, other rows stay as they are."""
    out = items.withColumn("_new", text).withColumn("changed", F.col("_new") != F.col("text"))
    stats = T.stats(F.col("_new"))
    taken = {"content_hash": F.sha2("_new", 256), "byte_size": F.octet_length("_new").cast("long"), **{c: stats[c] for c in COUNTED}, "tokens": stats["tokens"], "has_html": F.lit(False), "has_unicode_issues": F.lit(False), "has_whitespace_issues": F.lit(False)}
    for name, value in taken.items():
        if name in items.columns:
            out = out.withColumn(name, F.when(F.col("changed"), value).otherwise(F.col(name)))
    return out.withColumn("text", F.col("_new")).drop("_new")


def normalized(items: DataFrame) -> DataFrame:
    """Ingested items with normalised text, and the columns changed and one for each step that changed it."""
    if "ingest_status" in items.columns:
        items = items.where("ingest_status = 'done'")
    work = items.withColumn("_n", N.normalize(F.col("text")))
    steps = [F.col(f"_n.{s}").alias(f"step_{s}") for s in N.STEPS]
    return _with_text(work.select(*items.columns, *steps, F.col("_n.text").alias("_t")), F.col("_t")).drop("_t")


def counters(done: DataFrame) -> DataFrame:
    """One row: items, changed_items and how many each step changed."""
    steps = [c for c in done.columns if c.startswith("step_")]
    return done.agg(F.count("*").alias("items"), F.count_if("changed").alias("changed_items"), *(F.count_if(F.col(c) & F.col("changed")).alias(c.removeprefix("step_")) for c in steps))


def redacted(items: DataFrame) -> DataFrame:
    """The active items with masked text, substitutions (how many masks) and changed; a new version takes them."""
    text, count = T.redact(F.col("text"))
    active = items.where(F.col("decision").isin(*ACTIVE)).withColumn("substitutions", count)
    return _with_text(active, text)
