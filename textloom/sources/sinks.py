"""Sinks: manifests, training records, dataset folders and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, fmt: str) -> None:
    """jsonl, csv (arrays as JSON) or parquet (native types)."""
    if fmt == "jsonl":
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def training_records(frames: dict[str, DataFrame], path: str, fmt: str = "jsonl") -> None:
    """sft, dpo and traces: approved records of the first two, all traces."""
    for name, df in frames.items():
        write(df.where("status = 'approved'") if name in ("sft", "dpo") else df, f"{path}/{name}", fmt)


def dataset_folder(frames: dict[str, DataFrame], path: str, name: str) -> dict:
    """Parquet data of each configuration with dataset_info.json and README.md as text files; returns the info.

    Rows are counted on what was written, not by running the frames again.
    """
    configs = {}
    for config, df in frames.items():
        write(df, f"{path}/{config}", "parquet")
        n = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{config}").count()
        configs[config] = {"num_examples": n, "features": [f.name for f in df.schema]}
    total = sum(c["num_examples"] for c in configs.values())
    info = {"dataset_name": name, "configs": configs, "size_category": "n<1K" if total < 1000 else "1K<n<10K" if total < 10_000 else "n>10K"}
    lines = [f"# {name}", "", *(f"- {c}: {x['num_examples']} rows ({', '.join(x['features'])})" for c, x in configs.items())]
    spark = next(iter(frames.values())).sparkSession
    for file, text in (("dataset_info.json", json.dumps(info)), ("README.md", "\n".join(lines))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{file}")
    return info


def report(items: DataFrame, issues: DataFrame, records: dict[str, DataFrame] | None = None) -> dict[str, dict]:
    """Decision counts (all six), issues by type and the count of each kind of training record."""
    from ..operators.items import DECISIONS

    counts = {r[0]: r[1] for r in items.groupBy("decision").count().collect()}
    types = {r[0]: r[1] for r in issues.groupBy("issue_type").count().collect()}
    kinds = {k: df.count() for k, df in (records or {}).items()}
    return {"decisions": {d: counts.get(d, 0) for d in DECISIONS}, "issues_by_type": types, "training_records": kinds}
