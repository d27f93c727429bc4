"""Clusters of points (proper motions, positions) on the graph of their neighbours, by power iteration.

Neighbours come from a grid of cells, so the graph has as many edges as there are near pairs; power iteration gives the leading
structure that spectral clustering looks for without an eigenproblem on the driver."""

from __future__ import annotations

from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoloom.operators.spatial import pixel_pairs


def neighbour_clusters(points: DataFrame, radius: float, k: int, *, key: str = "id", x: str = "x", y: str = "y", rounds: int = 15) -> DataFrame:
    """``key``, cluster (0 to k - 1). Points without a neighbour within ``radius`` have no row."""
    p = points.select(F.col(key).cast("long").alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    edges = pixel_pairs(p, p, radius).where("l.id < r.id").select(F.col("l.id").alias("src"), F.col("r.id").alias("dst"), F.exp(-F.pow(F.col("dist") / (radius / 2), F.lit(2))).alias("weight"))
    return PowerIterationClustering(k=k, maxIter=rounds, initMode="degree", weightCol="weight").assignClusters(edges).select(F.col("id").alias(key), "cluster")
