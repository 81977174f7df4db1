"""Versions on disk, in folders by a hash of the id, with digests that tell where two of them differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import diff

FOLDERS = 64
PARTS = 64


def _placed(snap: DataFrame) -> DataFrame:
    h = F.xxhash64("id")
    return snap.withColumn("folder", F.pmod(h, F.lit(FOLDERS))).withColumn("part", F.pmod(F.shiftright(h, 16), F.lit(PARTS)))


def write(snap: DataFrame, path: str) -> None:
    """A snapshot (id, content_hash, and other columns) in FOLDERS folders, rows sorted by part, and its digests: of each folder
    and part the number of rows and two sums of hashes of id and content, whatever the order of rows."""
    rows = _placed(snap)
    rows.repartition("folder", "part").sortWithinPartitions("folder", "part", "id").write.partitionBy("folder").parquet(f"{path}/rows")
    kept = snap.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    one, two = F.xxhash64("id", "content_hash"), F.xxhash64("content_hash", "id", F.lit(7))
    digests = kept.groupBy("folder", "part").agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("one"), F.bit_xor(two).alias("two"))
    digests.coalesce(1).write.parquet(f"{path}/digests")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot's rows."""
    return spark.read.parquet(f"{path}/rows").drop("folder", "part")


def differing(spark: SparkSession, old: str, new: str) -> DataFrame:
    """folder, part in which the two versions differ: at most FOLDERS times PARTS rows, from the digests alone."""
    a, b = spark.read.parquet(f"{old}/digests"), spark.read.parquet(f"{new}/digests")
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("folder", "part").distinct()


def changed(spark: SparkSession, old: str, new: str) -> DataFrame:
    """id, change as versions.diff() gives them, reading only folders, and of those only parts, whose digests differ."""
    places = [(r.folder, r.part) for r in differing(spark, old, new).collect()]
    folders = sorted({f for f, _ in places})

    def some(path):
        rows = spark.read.parquet(f"{path}/rows").where(F.col("folder").isin(folders))
        here = spark.createDataFrame(places, "folder long, part long")
        parts = sorted({p for _, p in places})
        return rows.where(F.col("part").isin(parts)).join(F.broadcast(here), ["folder", "part"], "left_semi")

    return diff(some(old), some(new))
