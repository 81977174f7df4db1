"""New datasets from old ones: derive, merge, split, sample, mix. New ids are hashes of dataset and old id."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import save
from .items import ACTIVE, filtered
from .ranking import first

POOL = 1_000


def new_id(dataset: str):
    return F.sha2(F.concat(F.lit(dataset + "/"), F.col("id").cast("string")), 256)


def order_hash(seed: int):
    """Order of an item under a seed."""
    return F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(seed))), 256)


def derive(items: DataFrame, dataset: str, ids: DataFrame | None = None) -> DataFrame:
    """Items, all or those of ``ids`` (id), under new ids; keep decisions only where ids are given."""
    if ids is not None:
        items = items.join(ids.select("id").distinct(), "id", "left_semi").where("decision = 'keep'")
    return items.withColumn("new_id", new_id(dataset))


def derive_filtered(items: DataFrame, labels: DataFrame, dataset: str, issues: DataFrame | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """A new dataset in one call: ingested items that pass the filters of items.filtered(), under new ids, and their labels
    (doc_id, ...) with new ids as doc_id."""
    if "ingest_status" in items.columns:
        items = items.where("ingest_status = 'done'")
    rows = derive(filtered(items, issues, **filters), dataset)
    copied = copy_labels(labels, rows).withColumn("doc_id", F.col("new_id")).drop("new_id")
    rows = rows.withColumn("id", F.col("new_id")).drop("new_id")
    return (rows.withColumn("dataset_id", F.lit(dataset)) if "dataset_id" in rows.columns else rows), copied


def copy_labels(labels: DataFrame, derived: DataFrame) -> DataFrame:
    return labels.join(derived.select(F.col("id").alias("doc_id"), "new_id"), "doc_id")


def merge(items: DataFrame, order: list[str]) -> DataFrame:
    """First item of each content hash over datasets in ``order``; an empty or null hash never merges."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("dataset_id"))
    rows = items.where(F.col("dataset_id").isin(*order)).withColumn("_rank", rank)
    blank = F.coalesce(F.col("content_hash"), F.lit("")) == ""
    first = rows.where(~blank).groupBy("content_hash").agg(F.min_by("id", F.struct("_rank", "id")).alias("id"))
    return rows.where(~blank).join(first, ["content_hash", "id"], "left_semi").unionByName(rows.where(blank)).drop("_rank")


def split(items: DataFrame, ratios: list[float], seed: int = 0) -> DataFrame:
    """Active items with ``part``, by the unit fraction of sha256(id + seed) and cumulative ratios."""
    total, bounds = sum(ratios) or 1.0, []
    for r in ratios:
        bounds.append((bounds[-1] if bounds else 0.0) + r / total)
    h = F.conv(F.substring(order_hash(seed), 1, 13), 16, 10).cast("double") / float(16**13)
    part = F.lit(len(ratios) - 1)
    for i in range(len(ratios) - 2, -1, -1):
        part = F.when(h <= bounds[i], i).otherwise(part)
    return items.where(F.col("decision").isin(*ACTIVE)).withColumn("part", part)


def first_by_hash(items: DataFrame, size: int, seed: int) -> DataFrame:
    """The ``size`` items that are first in the order of their seeded hash and id, without gathering them in one task.

    Counts by the hash's first four digits tell which digits are wholly in; only rows of the digits at the boundary are sorted.
    """
    if size <= 0:
        return items.limit(0)
    head = F.substring(order_hash(seed), 1, 4)
    counts = sorted(items.groupBy(head.alias("b")).agg(F.count("*").alias("n")).collect())
    taken = 0
    for b, n in counts:
        if taken + n > size:
            return items.where(head < b).unionByName(items.where(head == b).orderBy(order_hash(seed), "id").limit(size - taken))
        taken += n
    return items


def sample_random(items: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``size`` items, the first in the order of their seeded hash."""
    return first_by_hash(items, size, seed)


def sample_important(items: DataFrame, issues: DataFrame, size: int) -> DataFrame:
    """Items with most open issues, then those under review, then the longest, then of the smallest id.

    Histograms find the last item's key and a filter takes what comes before it, so no task sorts or holds the share.
    """
    k = issues.where("status = 'open'").groupBy("text_id").agg(F.count("*").alias("open_issues"))
    k = save(k, "open-issues")
    rows = items.join(k, items.id == k.text_id, "left").withColumn("open_issues", F.coalesce("open_issues", F.lit(0)))
    rows = rows.withColumn("_review", F.coalesce(F.col("decision") == "review", F.lit(False)))
    return first(rows, size, [("open_issues", True), ("_review", True), ("tokens", True), ("id", False)]).drop("_review")


def sample_diverse(signatures: DataFrame, size: int) -> DataFrame:
    """``size`` ids chosen farthest first by MinHash distance, beginning with the longest text (id, tokens, sig).

    Each pass takes every signature's distance to the chosen ones on the executors and brings the POOL farthest to the
    driver; equals go by a hash of the id. Distances only fall, so the pool's first is the first of all as long as it
    comes before the pool's last at the time of the pass.
    """
    spark = signatures.sparkSession
    rows = save(signatures.select(F.col("id").cast("long").alias("id"), "tokens", "sig", F.xxhash64("id").alias("h")), "signatures").where(F.size("sig") > 0)
    first = rows.orderBy(F.desc("tokens"), "id").limit(1).collect() if size > 0 else []
    ids, sigs = [r.id for r in first], [np.array(r.sig, np.int64) for r in first]

    def distances(batches):
        for batch in batches:
            sig = batch.column("sig").flatten().to_numpy().reshape(batch.num_rows, -1)
            far = np.full(batch.num_rows, np.inf)
            for s in sigs:
                far = np.minimum(far, 1 - (sig == s).mean(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(far), *(batch.column(c) for c in ("h", "id", "sig"))], ["far", "h", "id", "sig"])

    while ids and len(ids) < size:
        some = rows.where(~F.col("id").isin(ids)).select("id", "h", "sig").mapInArrow(distances, "far double, h long, id long, sig array<long>")
        pool = some.orderBy(F.desc("far"), "h", "id").limit(POOL).collect()
        if not pool:
            break
        far, sig = np.array([r.far for r in pool]), np.array([r.sig for r in pool], np.int64)
        last = (-pool[-1].far, pool[-1].h, pool[-1].id) if len(pool) == POOL else (np.inf,)
        left = set(range(len(pool)))
        while left and len(ids) < size:
            at = min(left, key=lambda i: (-far[i], pool[i].h, pool[i].id))
            if (-far[at], pool[at].h, pool[at].id) > last:
                break
            left.remove(at)
            ids.append(pool[at].id)
            sigs.append(sig[at])
            far = np.minimum(far, 1 - (sig == sig[at]).mean(axis=1))
    return spark.createDataFrame([(x, k) for k, x in enumerate(ids)], "id long, place int")


def quotas(sizes: dict[str, int], weights: dict[str, float], size: int = 0) -> dict[str, int]:
    """Rows to take of each source; the last takes the rest, none more than it has."""
    total = sum(weights.values()) or 1.0
    if size <= 0:
        size = sum(min(sizes[s], round(w / total * sum(sizes.values()))) for s, w in weights.items())
    out, used, names = {}, 0, list(weights)
    for s in names:
        q = size - used if s == names[-1] else math.floor(size * weights[s] / total)
        used += q
        out[s] = max(0, min(q, sizes[s]))
    return out


def mix(items: DataFrame, weights: dict[str, float], size: int = 0, seed: int = 0) -> DataFrame:
    """Weighted quotas per source in seeded order; an equal text enters once, by the order of sources."""
    names = list(weights)
    rows = items.where(F.col("dataset_id").isin(*names))
    have = {r[0]: r[1] for r in rows.groupBy("dataset_id").count().collect()}
    if missing := [s for s in names if not have.get(s)]:
        raise ValueError(f"no items in {missing}")
    parts = [first_by_hash(rows.where(F.col("dataset_id") == s), q, seed) for s, q in quotas(have, weights, size).items() if q]
    taken = parts[0]
    for p in parts[1:]:
        taken = taken.unionByName(p)
    return merge(taken, names)


def first_of_each(items: DataFrame, key: str, *order) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return items.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
