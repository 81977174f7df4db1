"""Named jobs over a session: run, progress, cancel; and a registry of Python providers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


class Jobs:
    """Runs functions under a Spark job group, so that cancel() stops their stages."""

    def __init__(self, spark: SparkSession):
        self.spark, self.status = spark, {}

    def run(self, kind: str, fn: Callable[[], object]):
        job = uuid.uuid4().hex
        self.spark.sparkContext.setJobGroup(job, kind, interruptOnCancel=True)
        self.status[job] = "running"
        try:
            out = fn()
        except Exception:
            self.status[job] = "failed"
            raise
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        self.status[job] = "completed"
        return job, out

    def cancel(self, job: str) -> None:
        self.spark.sparkContext.cancelJobGroup(job)
        self.status[job] = "cancelled"


class Providers:
    """Providers by scope; each makes, once a task, a function from a list of texts to a list of results.

    The active one is that chosen, else that set as default, else the first registered.
    """

    def __init__(self):
        self.known: dict[str, dict[str, Callable]] = {}
        self.chosen: dict[str, str] = {}
        self.default: dict[str, str] = {}

    def register(self, scope: str, name: str, make: Callable[[], Callable[[list[str]], list]]) -> None:
        self.known.setdefault(scope, {})[name] = make

    def active(self, scope: str) -> Callable:
        names = self.known.get(scope)
        if not names:
            raise LookupError(f"no provider for {scope}")
        for name in (self.chosen.get(scope), self.default.get(scope)):
            if name in names:
                return names[name]
        return next(iter(names.values()))

    def apply(self, df: DataFrame, scope: str, text: str, out: str, kind: str) -> DataFrame:
        make = self.active(scope)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {out} {kind}"

        def run(batches: Iterator[pd.DataFrame]):
            call = make()
            for pdf in batches:
                yield pdf.assign(**{out: call([t or "" for t in pdf[text]])})

        return df.mapInPandas(run, schema)


def hash_embedding(dim: int = 64) -> Callable:
    """A deterministic local embedding: signed counts of hashed words, of unit length."""

    def call(texts: list[str]) -> list:
        import math
        import zlib

        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h >> 31 else -1
            n = math.sqrt(sum(x * x for x in v)) + 1e-9
            out.append([x / n for x in v])
        return out

    return lambda: call
