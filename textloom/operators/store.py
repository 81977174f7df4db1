"""Datasets and their records as append-only tables: the latest row of an id counts, a deleted dataset takes its rows along."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("permissive", "strict")
CHILDREN = {"issues": "text_id", "labels": "doc_id", "captions": "text_id", "decisions": "target_id"}


def current(log: DataFrame, key: str = "id", at: str = "updated_at") -> DataFrame:
    """The latest state of each key; a row whose ``deleted`` is set ends it. Ties go to the row with the greatest hash."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*log.columns), F.struct(at, F.xxhash64(*log.columns))).alias("r")).select("r.*")
    return last.where(~F.coalesce(F.col("deleted"), F.lit(False))).drop("deleted") if "deleted" in log.columns else last


def patched(datasets: DataFrame, changes: DataFrame) -> DataFrame:
    """Datasets with what ``changes`` (id and any columns, null: as before) sets; an unknown license policy is an error."""
    columns = [c for c in changes.columns if c != "id"]
    out = datasets.join(changes.select("id", *(F.col(c).alias(f"_{c}") for c in columns)), "id", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", F.col(c))).drop(f"_{c}")
    if "license_policy" in columns:
        known = F.col("license_policy").isin(*POLICIES)
        out = out.withColumn("license_policy", F.when(known, F.col("license_policy")).otherwise(F.raise_error(F.lit("license_policy must be permissive|strict"))))
    return out


def without_dataset(tables: dict[str, DataFrame], dataset: str) -> dict[str, DataFrame]:
    """All tables without a dataset's rows: children of its items and groups first, then what names the dataset itself."""
    items = tables["items"].where(F.col("dataset_id") == dataset).select("id")
    out = {}
    for name, rows in tables.items():
        if name in CHILDREN:
            out[name] = rows.join(items.select(F.col("id").alias(CHILDREN[name])).distinct(), CHILDREN[name], "left_anti")
        elif name == "members":
            groups = tables["groups"].where(F.col("dataset_id") == dataset).select("group_id").distinct()
            out[name] = rows.join(groups, "group_id", "left_anti")
        else:
            out[name] = rows.where(F.coalesce(F.col("id" if name == "datasets" else "dataset_id") != dataset, F.lit(True)))
    return out


def append_turns(turns: DataFrame, new: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with new rows (conv_id, seq, role, text) numbered on from each conversation's count."""
    have = turns.groupBy("conv_id").agg(F.count("*").alias("have"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq")) - 1
    fresh = new.withColumn("nth", nth).join(have, "conv_id", "left")
    kind = turns.schema["turn"].dataType
    numbered = fresh.select("conv_id", (F.coalesce("have", F.lit(0)) + F.col("nth")).cast(kind).alias("turn"), "role", "text")
    return turns.select("conv_id", "turn", "role", "text").unionByName(numbered)


def append(records: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """Records with new ones under ids of their content, in a fresh record's state; what is there already is not added again."""
    content = [c for c in new.columns if c not in ("id", "status")]
    rows = new.withColumn("id", F.sha2(F.concat(F.lit(f"{kind}/"), F.to_json(F.struct(*content))), 256)).withColumn("status", F.lit("pending"))
    rows = rows.dropDuplicates(["id"]).join(records.select("id"), "id", "left_anti")
    return records.unionByName(rows, allowMissingColumns=True)
