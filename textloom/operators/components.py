"""Connected components of pairs by large and small stars, each task first contracting its own edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import discard, save

#: Nodes that a task holds before it gives its stars and begins anew.
HELD = 1_000_000


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v < u, that connect what each task's edges (u, v) connect: a star around the smallest node of each of
    the task's components."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches):
        over: dict = {}
        arrow = None

        def top(x):
            root = x
            while (y := over.get(root, root)) != root:
                root = y
            while (y := over.get(x, x)) != root:  # halve the way for the next
                over[x] = root
                x = y
            return root

        def stars():
            rows = [(x, top(x)) for x in list(over)]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], arrow), pa.array([y for _, y in rows], arrow)], ["u", "v"])

        for batch in batches:
            arrow = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = top(a), top(b)
                if a != b:
                    over[max(a, b)] = min(a, b)
            if len(over) > HELD:
                yield stars()
                over.clear()
        if over:
            yield stars()

    return edges.mapInArrow(run, f"u {kind}, v {kind}")


def components(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(text_id, group_id) of every node of ``pairs``: the group is named by its smallest node. Nulls and loops are left out.

    Rounds go on until the edges are stars; each is written to the shared folder and the one before deleted, so one
    table is kept and a lost executor costs one round. Of a round's rows none reach the driver but the answer whether to go on.
    """
    edges = pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = save(_contracted(edges).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        last, now = now, save(_contracted(small.distinct()).distinct(), "edges")
        discard(last)
    return now.select(F.col("u").alias("text_id"), F.col("v").alias("group_id")).unionByName(now.select(F.col("v").alias("text_id"), F.col("v").alias("group_id")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most and none with an edge down has one up."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1").isEmpty()
