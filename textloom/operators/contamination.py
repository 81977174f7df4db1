"""Share of a text's word n-grams that a benchmark has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FIELDS = ("text", "content", "response", "answer", "chosen", "prompt", "question", "input")


def benchmark_text(record):
    """The first non-blank of the known fields of a JSON record, else the record."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(record, f"$.{f}")), F.lit("")) for f in FIELDS), record)


def _tokens(text: str):
    return F.regexp_extract_all(F.lower(T.text_of(text)), F.lit(T.WORD), F.lit(0))


def grams(df: DataFrame, text: str, n: int) -> DataFrame:
    """Distinct (h, gram): lower-case word n-grams of whole texts under their 64-bit hashes."""
    both = F.arrays_zip(T.run_hashes(_tokens(text), n).alias("h"), T.ngrams(_tokens(text), n).alias("gram"))
    rows = df.select(F.explode(both).alias("z")).select("z.h", "z.gram")
    return rows.groupBy("h").agg(F.min("gram").alias("gram"))


def overlap(items: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """text_id, overlap_ngrams, total_ngrams, overlap, samples of items that share a gram.

    Only hashes of grams travel; the benchmark's are distinct, so the join gives a row per gram at most and adaptive
    execution splits a hot gram on the items' side. A benchmark without grams is an error.
    """
    bench = grams(benchmark, "text", n)
    if bench.isEmpty():
        raise ValueError(f"the benchmark has no {n}-grams")
    rows = items.select(F.col("id").alias("text_id"), F.array_distinct(T.run_hashes(_tokens("text"), n)).alias("g"))
    hits = rows.select("text_id", F.size("g").alias("total_ngrams"), F.explode("g").alias("h")).join(bench, "h")
    return hits.groupBy("text_id", "total_ngrams").agg(F.count("*").alias("overlap_ngrams"), F.slice(F.sort_array(F.collect_set("gram")), 1, 3).alias("samples")).withColumn("overlap", F.round(F.col("overlap_ngrams") / F.col("total_ngrams"), 6))


def issues(items: DataFrame, benchmark: DataFrame, n: int | None = None, threshold: float | None = None) -> DataFrame:
    n = 10 if n is None else n
    threshold = 0.05 if threshold is None else threshold
    hit = overlap(items, benchmark, n).where(F.col("overlap") >= threshold)
    return hit.select("text_id", F.lit("contamination").alias("issue_type"), F.col("overlap").alias("score"), F.lit(threshold).alias("threshold"), F.col("overlap_ngrams").cast("long").alias("overlap_ngrams"), F.col("total_ngrams").cast("long").alias("total_ngrams"))
