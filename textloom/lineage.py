"""Tables written to the shared folder so that a plan need not be run again when an executor is lost."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SAVED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where the master is local."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        where = sc.getCheckpointDir()
    return where


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when Python ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _SAVED[path] = spark
    return path


def save(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back; discard() or the end of Python removes it."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store its path names; a missing one is no error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*saved: DataFrame) -> None:
    """Delete what save() wrote for frames that nothing reads any more; other frames are left alone."""
    for df in saved:
        path = getattr(df, "_saved_at", None)
        if path in _SAVED:
            remove(_SAVED.pop(path), path)


@atexit.register
def _at_exit() -> None:
    """The session may have ended before; what is left is then the cluster's to clean."""
    with contextlib.suppress(Exception):
        for path, spark in list(_SAVED.items()):
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
