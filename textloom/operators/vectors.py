"""Vector search and clusters over (id, vector) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Dot of the two over their norms plus 1e-9, as exact sums of doubles."""
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))


def top_k(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k nearest by cosine; a query of another length than a row's vector does not match it."""
    q = F.array(*map(F.lit, map(float, query)))
    rows = vectors.where(F.size("vector") == len(query))
    return rows.select("id", F.round(cosine(F.col("vector"), q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def near_item(vectors: DataFrame, item, k: int = 10) -> DataFrame:
    """The k nearest to an item's own vector, without it; an unknown item is an error."""
    row = vectors.where(F.col("id") == item).select("vector").first()
    if row is None:
        raise ValueError(f"no vector of {item}")
    return top_k(vectors.where(F.col("id") != item), row[0], k)


def clusters(vectors: DataFrame, k: int = 8, seed: int = 0) -> DataFrame:
    """id, cluster, distance by k-means with cosine distance, 25 rounds at most."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("id", "vector", array_to_vector("vector").alias("features"))
    k = min(k, rows.count())
    if k < 2:
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance"))
    model = KMeans(k=k, seed=seed, maxIter=25, distanceMeasure="cosine", initMode="random").fit(rows)
    centers = F.array(*(F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()))
    out = model.transform(rows)
    return out.select("id", F.col("prediction").alias("cluster"), F.round(1 - cosine(F.col("vector"), F.element_at(centers, F.col("prediction") + 1)), 6).alias("distance"))


def representatives(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.min_by("id", F.struct("distance", "id")).alias("representative"), F.count("*").alias("n"))


def outliers(clustered: DataFrame) -> DataFrame:
    """The most distant rows: a fiftieth of all, ten at least."""
    return clustered.orderBy(F.desc("distance"), "id").limit(max(10, clustered.count() // 50))
