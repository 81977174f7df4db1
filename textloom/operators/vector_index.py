"""Nearest vectors of many queries: exact over a grid of bounded blocks, or by an inverted index of cells with exact scores.

Vectors and queries of a cell (the exact search has one) are dealt by hashes into blocks of about ROWS, and each pair of blocks
meets in one task as two matrices, so neither a hot cell nor the set of queries is ever one group. Of a pair of
blocks only each query's k best leave the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import save
from .ranking import first

ROWS = 8192
CELLS = 256
SAMPLE = 50_000
STEPS = 20
MICRO = 1_000_000
#: Parts in which a query's candidates are reduced before they meet.
PARTS = 64


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.sqrt((m * m).sum(axis=1, keepdims=True)) + 1e-9)


def _best(k: int):
    """A function of a task: each query's k best of the vectors of its block, by the score rounded to six places, then the id."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = pa.table({"query_id": pa.array([], queries.schema.field("query_id").type), "id": pa.array([], vectors.schema.field("id").type), "micro": pa.array([], pa.int64()), "part": pa.array([], pa.int64())})
        if not vectors.num_rows or not queries.num_rows:
            return out
        vectors = vectors.sort_by("id")
        units, names, n = _unit(_matrix(vectors["vector"])), vectors["id"], vectors.num_rows
        parts = [out]
        for lo in range(0, queries.num_rows, 512):
            some = queries.slice(lo, 512)
            micro = np.rint(_unit(_matrix(some["vector"])) @ units.T * MICRO).astype(np.int64)
            key = -micro * n + np.arange(n)
            top = np.argpartition(key, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), key.shape)
            rows = np.repeat(np.arange(len(top)), top.shape[1])
            at = top.ravel()
            part = np.full(len(at), vectors["sub"][0].as_py() % PARTS, np.int64)
            parts.append(pa.table({"query_id": some["query_id"].take(pa.array(rows)), "id": names.take(pa.array(at)), "micro": pa.array(micro[rows, at]), "part": pa.array(part)}))
        return pa.concat_tables(parts)

    return run


def _met(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score of each query's k best among the vectors of its cells; vectors (cell, id, vector), queries (cell,
    query_id, vector), of the lengths of which only equal ones meet."""
    sized = F.size("vector").alias("dim")
    v, q = vectors.select("cell", sized, "id", "vector"), queries.select("cell", sized, "query_id", "vector")
    both = v.groupBy("cell", "dim").agg(F.count("*").alias("nv")).join(q.groupBy("cell", "dim").agg(F.count("*").alias("nq")), ["cell", "dim"])
    grid = save(both.select("cell", "dim", F.ceil(F.col("nv") / ROWS).alias("a"), F.ceil(F.col("nq") / ROWS).alias("b")), "grid")
    sub, qsub = F.pmod(F.xxhash64("id"), "a"), F.pmod(F.xxhash64("query_id"), "b")
    v = v.join(grid, ["cell", "dim"]).select("cell", "dim", sub.alias("sub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("qsub"), "id", "vector")
    q = q.join(grid, ["cell", "dim"]).select("cell", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("a") - 1)).alias("sub"), qsub.alias("qsub"), "query_id", "vector")
    q = q.select(*(F.col(c).alias(c) for c in q.columns))  # columns of its own, where queries are rows of the vectors' table
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("query_id", queries), ("id", vectors)))
    by = ["cell", "dim", "sub", "qsub"]
    found = v.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(_best(k), f"{kinds}, micro long, part long")

    def reduced(rows, *key):
        """The k first of each key; a vector that two of a query's cells would give is in one of them only."""
        kept = rows.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("micro")).alias("less"), "id"))), 1, k).alias("top"))
        return kept.select(*key, F.inline("top")).withColumn("micro", -F.col("less")).drop("less")

    top = reduced(reduced(found, "query_id", "part"), "query_id")
    return top.select("query_id", "id", (F.col("micro") / MICRO).alias("score"))


def exact(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, score (cosine, six places) of each query's (query_id, vector) k nearest of ``vectors`` (id, vector); ties go
    to the smaller id, so results are those of a sort. Vectors and queries of unequal length do not match; null ones neither.

    For filters pass the vectors that are left, as with joined(); a query that is itself a row finds itself.
    """
    if k < 1:
        return _met(vectors.limit(0).withColumn("cell", F.lit(0)), queries.limit(0).withColumn("cell", F.lit(0)), 1)
    return _met(vectors.where("vector is not null").withColumn("cell", F.lit(0)), queries.where("vector is not null").withColumn("cell", F.lit(0)), k)


def centers(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE, seed: int = 0) -> np.ndarray:
    """Unit vectors of the cells: k-means on at most ``sample`` rows, the first by a hash of the id; all lengths must be equal."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where("vector is not null").select("id", "vector", F.xxhash64("id", F.lit(seed)).alias("h"))
    rows = save(first(rows, sample, [("h", False), ("id", False)]), "sample")
    cells = min(cells, rows.count())
    if cells < 2:
        return _unit(np.array(rows.select("vector").first()[0], float)[None, :]) if cells else np.zeros((0, 0))
    model = KMeans(k=cells, seed=seed, maxIter=STEPS, distanceMeasure="cosine", initMode="random").fit(rows.select(array_to_vector("vector").alias("features")))
    return _unit(np.array(model.clusterCenters()))


def _cells(rows: DataFrame, at: np.ndarray, n: int) -> DataFrame:
    """rows, once for each of the ``n`` cells nearest to their vector, the nearest first, with ``cell``."""
    at = rows.sparkSession.sparkContext.broadcast(at)
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cell int"

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = -(_unit(_matrix(batch.column("vector"))) @ at.value.T)
                take = min(n, near.shape[1])
                some = np.argsort(near, axis=1, kind="stable")[:, :take]
                rows_ = pa.array(np.repeat(np.arange(batch.num_rows), take))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows_) for c in names), pa.array(some.ravel(), pa.int32())], [*names, "cell"])

    return rows.mapInArrow(run, schema)


def build(vectors: DataFrame, path: str, cells: int = CELLS, sample: int = SAMPLE, seed: int = 0) -> None:
    """Write an index of all vectors (id, vector, and columns to filter by) to ``path``: a folder for each cell, and the centers."""
    at = centers(vectors, cells, sample, seed)
    if not len(at):
        raise ValueError("no vectors to index")
    _cells(vectors.where("vector is not null"), at, 1).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("cell").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(at)], "cell int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")


def search(spark, path: str, queries: DataFrame, k: int = 10, probes: int = 16, where=None) -> DataFrame:
    """query_id, id, score as exact() gives them, of the vectors in the ``probes`` cells nearest to each query.

    ``where`` is a condition on the index's columns. Scores are exact; what may be missing is a neighbour in another cell.
    Cells that no query asks for are not read.
    """
    rows = spark.read.parquet(f"{path}/centers").orderBy("cell").limit(1 << 16).collect()
    at = np.array([r.center for r in rows])
    asked = save(_cells(queries.where("vector is not null").select("query_id", "vector"), at, probes), "asked")
    index = spark.read.parquet(f"{path}/vectors")
    wanted = [r.cell for r in asked.select("cell").distinct().collect()]  # at most as many as there are centers
    index = index.where(F.col("cell").isin(wanted))
    return _met(index if where is None else index.where(where), asked, k)


def of_items(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Queries (query_id, vector) that are items' own vectors; items without one give none."""
    return vectors.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), "vector")


def joined(vectors: DataFrame, items: DataFrame) -> DataFrame:
    """The vectors of the items that are left after filters, such as items.filtered() gives."""
    return vectors.join(items.select("id"), "id", "left_semi")
