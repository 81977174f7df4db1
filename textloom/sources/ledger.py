"""Exports that are either whole or not there: written aside, moved into place, then entered in a ledger of small files."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..lineage import remove
from .sinks import write

KEEP = 5


class Ledger:
    """Exports below one folder, which may lie in any store that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _entry_text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def entries(self, dataset: str | None = None, fmt: str | None = None) -> list[dict]:
        """Entries, newest first: export_id, dataset_id, fmt, version, path, rows, created_at."""
        folder = self._path(f"{self.root}/ledger")
        if not self._fs.exists(folder):
            return []
        names = sorted((s.getPath().getName() for s in self._fs.listStatus(folder)), reverse=True)
        found = [json.loads(self._entry_text(self._path(f"{self.root}/ledger/{n}"))) for n in names if n.endswith(".json")]
        return [e for e in found if dataset in (None, e["dataset_id"]) and fmt in (None, e["fmt"])]

    def frame(self) -> DataFrame:
        """The ledger as rows."""
        kind = "export_id string, dataset_id string, fmt string, version string, path string, rows long, created_at double"
        return self.spark.createDataFrame([tuple(e[c.split()[0]] for c in kind.split(", ")) for e in self.entries()], kind)

    def export(self, manifest: DataFrame, dataset: str, fmt: str, version: str = "") -> dict:
        """Write ``manifest`` and return its entry; the dataset's KEEP newest of the format stay, older ones go.

        Rows go to a staging folder, which is moved into place once it is whole; the entry, moved into the ledger after that, makes
        it an export. Whatever fails before leaves earlier exports as they were, and the staging folder is removed.
        """
        export_id = uuid.uuid4().hex
        staging, place = f"{self.root}/staging/{export_id}", f"{self.root}/{dataset}/{fmt}-{export_id}"
        try:
            write(manifest, staging, fmt)
            got = {"jsonl": self.spark.read.json, "parquet": self.spark.read.parquet}.get(fmt)
            rows = got(staging).count() if got else self.spark.read.option("header", "true").option("multiLine", "true").csv(staging).count()
            self._fs.mkdirs(self._path(f"{self.root}/{dataset}"))
            if not self._fs.rename(self._path(staging), self._path(place)):
                raise OSError(f"{place}: cannot be moved into place")
        except Exception:
            remove(self.spark, staging)
            raise
        now = time.time_ns()
        entry = {"export_id": export_id, "dataset_id": dataset, "fmt": fmt, "version": version, "path": place, "rows": rows, "created_at": now / 1e9}
        self._commit(f"{now:020d}-{export_id}.json", json.dumps(entry))
        self._prune(dataset, fmt)
        return entry

    def _commit(self, name: str, text: str) -> None:
        """A file whole or not at all: written under another name, then renamed."""
        aside = self._path(f"{self.root}/staging/{name}")
        stream = self._fs.create(aside, False)
        stream.write(text.encode())
        stream.close()
        self._fs.mkdirs(self._path(f"{self.root}/ledger"))
        if not self._fs.rename(aside, self._path(f"{self.root}/ledger/{name}")):
            raise OSError(f"{name}: cannot be entered")

    def _prune(self, dataset: str, fmt: str) -> None:
        """Entries go before their folders, so that none names a folder that is gone; then folders without an entry."""
        old = {e["export_id"] for e in self.entries(dataset, fmt)[KEEP:]}
        for status in self._fs.listStatus(self._path(f"{self.root}/ledger")):
            if status.getPath().getName().removesuffix(".json").rpartition("-")[2] in old:
                self._fs.delete(status.getPath(), False)
        for e in old:
            remove(self.spark, f"{self.root}/{dataset}/{fmt}-{e}")

    def latest(self, dataset: str, fmt: str) -> dict | None:
        """The newest export's entry, or None."""
        return next(iter(self.entries(dataset, fmt)), None)
