"""Readers: whole files, lines, JSON lines, delimited text, Parquet, archives; records to items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.normalize import trimmed
from ..lineage import save

# Extensions taken and fields that may hold the text, in order.
EXTENSIONS = (".txt", ".jsonl", ".json", ".csv", ".tsv", ".md", ".jsonl.gz", ".parquet")
TEXT_FIELDS = ("text", "content", "message", "prompt", "completion", "response", "answer", "output")
HEAD = 1024
FEW_BLOCKS = 100_000


def decode(content: Column, limit: int | None = None) -> Column:
    """Bytes as UTF-8 without a byte order mark, or as Latin-1 where that fails; whole, or the first ``limit`` bytes."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(b):
            b = (b or b"")[:limit]
            try:
                return b.decode("utf-8-sig")
            except UnicodeDecodeError:
                return b.decode("latin-1")

        return s.map(one)

    return run(content)


def text_field(record: Column) -> Column:
    """First non-blank string of the known fields of a JSON record, else of any field; null if none."""
    known = [F.nullif(F.trim(F.get_json_object(record, f"$.{f}")), F.lit("")) for f in TEXT_FIELDS]
    other = F.filter(F.map_values(F.from_json(record, "map<string,string>")), lambda v: F.trim(v) != "")
    return F.coalesce(*known, F.get(other, 0))


def whole_files(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """source_uri, relative_path, text, ingest_status of every file under a folder with a known extension, less those already
    in ``known``. A file with a zero byte is no text: its status is error and its text null; others are done. Files without
    any byte are no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    keep = F.lit(False)
    for e in EXTENSIONS:
        keep = keep | F.lower("path").endswith(e)
    below = F.regexp_replace(F.substring_index("path", path.rstrip("/").rpartition("/")[2] + "/", -1), "^/+", "")
    text = decode(F.col("content"))
    rows = files.where(keep).select(F.col("path").alias("source_uri"), below.alias("relative_path"), text.alias("_text"))
    sound = ~F.contains("_text", F.lit("\0"))
    rows = rows.select("source_uri", "relative_path", F.when(sound, F.col("_text")).alias("text"), F.when(sound, "done").otherwise("error").alias("ingest_status"))
    return rows if known is None else rows.join(known.select("source_uri"), "source_uri", "left_anti")


def retried(spark: SparkSession, path: str, items: DataFrame) -> DataFrame:
    """items with those of status error read again from their files under ``path``; what fails again keeps the status."""
    failed = items.where("ingest_status = 'error'").select("source_uri")
    again = whole_files(spark, path).join(failed, "source_uri", "left_semi").where("ingest_status = 'done'").select("source_uri", F.col("text").alias("_text"))
    out = items.join(again, "source_uri", "left")
    return out.withColumn("text", F.coalesce("_text", "text")).withColumn("ingest_status", F.when(F.col("_text").isNotNull(), "done").otherwise(F.col("ingest_status"))).drop("_text")


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """source_uri and form, training or text, of each file of lines, by its first line that is not blank."""
    from ..operators.records import kind

    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("source_uri"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
    first = rows.where(F.col("value").rlike(f"[^{T.SPACE}]")).groupBy("source_uri").agg(F.min_by("value", F.struct("at", "n")).alias("line"))
    return first.select("source_uri", F.when(kind(F.col("line")).isNotNull(), "training").otherwise("text").alias("form"))


def numbered(rows: DataFrame, text: Column) -> DataFrame:
    """Items of row-wise files (source_uri, at: bytes where the row's block begins, n: growing in the block, and its columns):
    text, the row's number in its file, relative_path ``stem_number`` and the other columns as JSON metadata.

    A first pass counts each block's rows, sums over a file's blocks give where each block begins, and a second pass numbers
    rows within their block. Only blocks, one row for 128 MB or a file, are gathered by file; rows stay where they are
    read as long as the blocks are few enough to be sent to all tasks, else they meet their block in a shuffle. ``n`` must count
    the block's rows without gaps, as line_rows() does.
    """
    name = F.regexp_replace(F.element_at(F.split("source_uri", "/"), -1), r"\.[^.]*$", "")
    rest = [c for c in rows.columns if c not in ("source_uri", "at", "n")]
    blocks = save(rows.groupBy("source_uri", "at").agg(F.count("*").alias("_k"), F.min("n").alias("_n")), "blocks")
    before = Window.partitionBy("source_uri").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    begins = blocks.select("source_uri", "at", "_n", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_from"))
    if blocks.count() <= FEW_BLOCKS:
        begins = F.broadcast(begins)
    out = rows.join(begins, ["source_uri", "at"]).withColumn("row", F.col("_from") + F.col("n") - F.col("_n")).withColumn("text", text)
    return out.select("source_uri", "row", F.concat_ws("_", name, F.col("row").cast("string")).alias("relative_path"), "text", F.to_json(F.struct(*rest)).alias("metadata"))


def line_rows(spark: SparkSession, path: str) -> DataFrame:
    """source_uri, at, n, value of all lines that are not blank, for numbered(); n counts a task's lines after the filter."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("source_uri"), F.col("_metadata.file_block_start").alias("at"), "value")
    return rows.where(F.col("value").rlike(f"[^{T.SPACE}]")).select("source_uri", "at", F.monotonically_increasing_id().alias("n"), "value")


def json_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """source_uri, value of the lines that are JSON objects; blank and malformed ones are left out. gz is read too.
    ``limit`` counts raw lines."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("source_uri"), "value")
    return (rows if limit is None else rows.limit(limit)).where(F.json_object_keys("value").isNotNull())


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("source_uri"), trimmed(F.col("value")).alias("text"))
    return rows.where("text <> ''")


def delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """CSV with a header; without ``sep`` each file is read by the delimiter of , ; tab and | that is most frequent in its
    first KiB (of equals the first named), and files of different delimiters are joined by the names of their columns."""

    def read(where, by):
        return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("recursiveFileLookup", "true").csv(where, sep=by)

    if sep is not None:
        return read(path, sep)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    head = F.decode(F.substring("content", 1, HEAD), "ISO-8859-1")
    counts = F.array(*(F.struct(F.regexp_count(head, F.lit(f"[{c}]")).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("sep")) for i, c in enumerate(",;\t|")))
    by = {r.sep: r.paths for r in files.select("path", F.array_max(counts)["sep"].alias("sep")).groupBy("sep").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()}
    if not by:
        return read(path, ",")
    parts = [read(by[c], c) for c in ",;\t|" if c in by]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def parquet(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if limit is None else df.limit(limit)


def snapshot(spark: SparkSession, path: str, split: str = "train", text_column: str = "text", max_samples: int | None = None) -> DataFrame:
    """A downloaded dataset folder with one Parquet folder per split."""
    rows = parquet(spark, f"{path}/{split}", max_samples)
    return rows.select(F.col(text_column).cast("string").alias("text"), F.to_json(F.struct("*")).alias("metadata"))


def items(rows: DataFrame, dataset: str) -> DataFrame:
    """Registered items of (source_uri, text) rows: hashes, counts, language, flags; null texts are empty."""
    from ..functions.normalize import not_nfc

    t = T.text_of("text")
    cols = {k: v for k, v in T.stats(t).items()}
    kept = [c for c in ("relative_path", "row", "metadata", "ingest_status") if c in rows.columns]
    out = rows.select("source_uri", *kept, t.alias("text"), F.lit(dataset).alias("dataset_id"), F.sha2(t, 256).alias("content_hash"), *(c.alias(k) for k, c in cols.items()), not_nfc(t).alias("has_unicode_issues"), T.has_whitespace_issue(t).alias("has_whitespace_issues"))
    own = ["dataset_id", "source_uri", *(["row"] if "row" in kept else []), "content_hash"]
    out = out.withColumn("id", F.sha2(F.concat_ws("/", *(F.col(c).cast("string") for c in own)), 256)).withColumn("decision", F.lit("pending"))
    return out if "ingest_status" in kept else out.withColumn("ingest_status", F.lit("done"))


def benchmark(spark: SparkSession, source) -> DataFrame:
    """(item_id, text) from a list of strings or a .jsonl, .json, .parquet or text file; an empty source is an error."""
    from ..operators.contamination import benchmark_text

    if isinstance(source, (list, tuple)):
        rows = spark.createDataFrame([(str(x),) for x in source], "text string")
    elif source.endswith((".jsonl", ".jsonl.gz")):
        rows = json_lines(spark, source).select(benchmark_text(F.col("value")).alias("text"))
    elif source.endswith(".json"):
        rows = spark.read.option("multiLine", "true").json(source).select(F.to_json(F.struct("*")).alias("v")).select(benchmark_text(F.col("v")).alias("text"))
    elif source.endswith(".parquet"):
        rows = spark.read.parquet(source).select(F.to_json(F.struct("*")).alias("v")).select(benchmark_text(F.col("v")).alias("text"))
    else:
        rows = text_lines(spark, source).select("text")
    if rows.isEmpty():
        raise ValueError("the benchmark is empty")
    return rows.select(F.xxhash64("text").alias("item_id"), "text").dropDuplicates(["item_id"])
