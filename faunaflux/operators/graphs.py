"""Graphs over points: nearest neighbours, radius, hybrid, patches, user edges; edge tables (keys, src, dst).

Nearest neighbours are exact, by a k-d partition of each group (see neighbours).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import chord, d, unit_sphere
from . import near, neighbours
from .recipe import standard_scale

K, ALPHA = 8, 0.5


def knn_edges(df: DataFrame, keys: list[str], node: str, axes: list[str], k: int = K) -> DataFrame:
    """The k nearest others of each node in its group, by Euclidean distance, ties to the lesser node: keys, src, dst, dist, rank. Nodes with a null among axes take no part."""
    df = df.na.drop(subset=axes)
    if keys:
        return neighbours.between(df, keys, node, axes, k)
    return neighbours.between(df.withColumn("__all", F.lit(0)), ["__all"], node, axes, k).drop("__all")


def symmetrise(edges: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Both directions, without loops, once each."""
    e = edges.select(*keys, "src", "dst")
    return e.unionByName(e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()


def geographic_knn(df: DataFrame, keys: list[str], node: str, k: int = K, geographic: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    if geographic:
        a, b, c = unit_sphere(x, y)
        df = df.withColumn("__a", a).withColumn("__b", b).withColumn("__c", c)
        return symmetrise(knn_edges(df, keys, node, ["__a", "__b", "__c"], k), keys)
    return symmetrise(knn_edges(df, keys, node, [x, y], k), keys)


def _scaled(df: DataFrame, keys: list[str], columns: list[str], weight: float = 1.0) -> tuple[DataFrame, list[str]]:
    z = [f"__z_{c}" for c in columns]
    t = df.withColumns({n: F.col(c).cast("double") for n, c in zip(z, columns, strict=True)})
    t = standard_scale(t, keys, z)
    return t.withColumns({n: F.coalesce(F.col(n), d(0)) * d(weight) for n in z}), z


def environmental_knn(df: DataFrame, keys: list[str], node: str, features: list[str], k: int = K) -> DataFrame:
    t, z = _scaled(df, keys, features)
    return symmetrise(knn_edges(t, keys, node, z, k), keys)


def hybrid_knn(df: DataFrame, keys: list[str], node: str, features: list[str], k: int = K, alpha: float = ALPHA, x: str = "x", y: str = "y") -> DataFrame:
    """Nearest in space and environment together, weighed by the roots of alpha and 1 - alpha."""
    t, z = _scaled(df, keys, [x, y], alpha**0.5)
    t, ze = _scaled(t, keys, features, (1 - alpha) ** 0.5)
    return symmetrise(knn_edges(t, keys, node, z + ze, k), keys)


def _plane(x: str, y: str, radius: float) -> list:
    if radius <= 0:
        raise ValueError("the radius must be positive")
    return [F.col(x).cast("double"), F.col(y).cast("double")]


def radius_edges(df: DataFrame, keys: list[str], node: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """All pairs within the radius."""
    return near.pairs(df, keys, node, _plane(x, y, radius), radius)


def radius_degrees(df: DataFrame, keys: list[str], node: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """degree_stats() of radius_edges(), without the edges."""
    return near.degrees(df, keys, node, _plane(x, y, radius), radius)


def radius_smoothed(df: DataFrame, keys: list[str], node: str, features: list[str], radius: float, hops: int = 2, x: str = "x", y: str = "y") -> DataFrame:
    """learners.graph_smoothed() of radius_edges(), without the edges."""
    return near.smoothed(df, keys, node, features, _plane(x, y, radius), radius, hops)


def geographic_radius(df: DataFrame, keys: list[str], node: str, metres: float, x: str = "x", y: str = "y") -> DataFrame:
    """All pairs within so many metres on the sphere, by the chord in three dimensions, so no seam and no poles."""
    if metres <= 0:
        raise ValueError("the radius must be positive")
    return near.pairs(df, keys, node, list(unit_sphere(x, y)), chord(metres))


def user_graph(edges: DataFrame, n_nodes: int) -> DataFrame:
    """Given edges (src, dst), checked against the number of nodes, in both directions."""
    if edges.where((F.col("src") < 0) | (F.col("dst") < 0) | (F.col("src") >= n_nodes) | (F.col("dst") >= n_nodes)).limit(1).count():
        raise ValueError("an edge leaves the range of nodes")
    return symmetrise(edges)


def degree_stats(edges: DataFrame, nodes: DataFrame, keys: list[str], node: str) -> DataFrame:
    """n_nodes, n_edges, mean_degree and isolated_nodes of each group."""
    deg = edges.groupBy(*keys, F.col("src").alias(node)).agg(F.count("*").alias("deg"))
    t = nodes.select(*keys, node).join(deg, [*keys, node], "left").na.fill(0, ["deg"])
    return t.groupBy(*keys).agg(F.count("*").alias("n_nodes"), F.sum("deg").alias("n_edges"), (F.sum("deg") / F.count("*")).alias("mean_degree"), F.count_if(F.col("deg") == 0).alias("isolated_nodes"))


def patch_adjacency(df: DataFrame, node: str, features: list[str], n_patches: int | None = None, k: int = 4, seed: int = 32639) -> tuple[DataFrame, DataFrame]:
    """(node to patch, patch edges): k-means in blended space, then nearest centroids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    t, z = _scaled(df, [], features)
    n = n_patches or max(2, df.count() // 20)
    t = VectorAssembler(inputCols=z, outputCol="__v").transform(t)
    model = KMeans(k=n, seed=seed, featuresCol="__v", predictionCol="patch").fit(t)
    centres = df.sparkSession.createDataFrame([(i, *map(float, c)) for i, c in enumerate(model.clusterCenters())], ["patch", *z])
    return model.transform(t).select(node, "patch"), symmetrise(knn_edges(centres, [], "patch", z, k))
