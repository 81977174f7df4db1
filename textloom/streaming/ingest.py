"""Incremental ingest: new lines or files of a folder, each text once, by a stateful stream.

The stream's state holds the content hash of every text that has been taken, 32 bytes each in RocksDB, dealt by the hash: a batch
looks up its own hashes only, and neither the target nor earlier input is read again. State, offsets and the list of written files are
committed together in the checkpoint, so a batch that is repeated after a failure or a restart writes its rows once.
"""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.normalize import trimmed
from ..sources.readers import EXTENSIONS, decode

#: State in RocksDB; a commit uploads what the batch changed, and no store reserves disk that it does not fill, of which a
#: stream over many partitions would have one share a partition.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
HELD = 1_000_000
BINARY = "path string, modificationTime timestamp, length long, content binary"


def line_stream(spark: SparkSession, source: str, files: int = 1000, glob: str | None = None) -> DataFrame:
    """source_uri, text of the lines of new text files below ``source``, at most ``files`` a batch; white space around a
    line goes, lines of nothing else are left out."""
    reader = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).text(source)
    return rows.select(F.col("_metadata.file_path").alias("source_uri"), trimmed(F.col("value")).alias("text")).where("text <> ''")


def file_stream(spark: SparkSession, source: str, files: int = 1000, glob: str | None = None) -> DataFrame:
    """source_uri, text of new files with a known extension, each whole; files with a zero byte are no text and left out."""
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(source)
    known = F.lit(False)
    for e in EXTENSIONS:
        known = known | F.lower("path").endswith(e)
    rows = rows.where(known).select(F.col("path").alias("source_uri"), decode(F.col("content")).alias("text"))
    return rows.where((F.col("text") != "") & ~F.contains("text", F.lit("\0")))


def _seeds(spark: SparkSession, checkpoint: str, known: DataFrame | None) -> tuple[DataFrame, bool]:
    """A stream of the hashes that count as taken before the first batch, and whether they are new. They are written beside
    the checkpoint once; later runs read none of them again."""
    folder = f"{checkpoint}-known"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fresh = not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if fresh:
        hashes = known.select("content_hash").distinct() if known is not None else spark.createDataFrame([], "content_hash string")
        hashes.write.parquet(folder)
    return spark.readStream.schema("content_hash string").parquet(folder), fresh and known is not None


@contextmanager
def _rocks(spark: SparkSession):
    """New streams keep their state as _STORE says; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _first_here(batches):
    """Rows of a task less those whose hash it has passed on before; it remembers HELD hashes at most, then begins anew."""
    seen: set = set()
    for batch in batches:
        keep = []
        for i, h in enumerate(batch.column("key").to_pylist()):
            if h not in seen:
                seen.add(h)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep, pa.int64()))
        if len(seen) > HELD:
            seen.clear()


def once_each(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """content_hash, text, source_uri, char_count, tokens of a stream's rows (source_uri, text): the first of each hash that
    neither an earlier batch nor ``seeds`` (a stream of content_hash) had. Of equal texts in one batch any one is taken.

    One shuffle by hash; each task first drops what repeats within it, so that a text that makes up a third of a batch
    does not meet in one task.
    """
    t = F.col("text")
    taken = rows.select(F.unhex(F.sha2(t, 256)).alias("key"), "text", "source_uri").mapInArrow(_first_here, "key binary, text string, source_uri string")
    none = seeds.select(F.unhex("content_hash").alias("key"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source_uri"))
    first = taken.unionByName(none).dropDuplicates(["key"]).where("text is not null")
    return first.select(F.lower(F.hex("key")).alias("content_hash"), "text", "source_uri", F.length(t).cast("long").alias("char_count"), T.tokens_estimate(t).alias("tokens"))


def ingest(spark: SparkSession, make, target: str, checkpoint: str, known: DataFrame | None = None):
    """Start a query that appends to Parquet ``target`` what is new in a stream, and ends when all there is has been read.

    ``make(glob)`` gives the stream (source_uri, text) of the files that match; ``known`` (content_hash) are taken already,
    as at the first run with this checkpoint: a run over no file brings them into the state before any line is looked at.
    Read ``target`` with Spark, which takes only files of batches that were committed.
    """
    seeds, fresh = _seeds(spark, checkpoint, known)

    def start(glob):
        out = once_each(make(glob), seeds).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        with _rocks(spark):
            return out.trigger(availableNow=True).start(target)

    if fresh:
        start("no file has this name").awaitTermination()
    return start(None)


def stream_lines(spark: SparkSession, source: str, target: str, checkpoint: str, known: DataFrame | None = None, files: int = 1000):
    """ingest() of the lines of text files below ``source``."""
    return ingest(spark, lambda glob: line_stream(spark, source, files, glob), target, checkpoint, known)


def stream_files(spark: SparkSession, source: str, target: str, checkpoint: str, known: DataFrame | None = None, files: int = 1000):
    """ingest() of whole files below ``source``."""
    return ingest(spark, lambda glob: file_stream(spark, source, files, glob), target, checkpoint, known)
