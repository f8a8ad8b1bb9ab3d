"""Cluster artifacts: Parquet tables of centroids and assignments under one root, with a line of metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .writers import exists


@dataclass
class ClusterModel:
    """Centroids (cluster, centroid), and for two stages the coarse cluster of each fine one (fine, coarse)."""

    centroids: DataFrame
    mapping: DataFrame | None = None
    metadata: DataFrame | None = None

    @property
    def stages(self) -> int:
        return 1 if self.mapping is None else 2


def cluster_metadata(assignments: DataFrame, centroids: DataFrame, method: str, limit: int) -> DataFrame:
    """One row: counts, width, iteration limit, sizes by cluster, method and distance."""
    sizes = centroids.select("cluster", F.size("centroid").alias("dim")).join(assignments.groupBy("cluster").count(), "cluster", "left")
    item = F.struct("cluster", F.coalesce("count", F.lit(0).cast("long")).alias("n"))
    row = sizes.agg(F.count("*").cast("int").alias("n_clusters"), F.max("dim").alias("feature_dim"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["n"]).alias("cluster_sizes"))
    total = F.aggregate("cluster_sizes", F.lit(0).cast("long"), lambda s, x: s + x)
    return row.select("n_clusters", total.alias("n_samples"), "feature_dim", F.lit(limit).alias("iter_limit"), "cluster_sizes", F.lit(method).alias("clustering_method"), F.lit("cosine").alias("distance_metric"))


def save_model(root: str, centroids: DataFrame, assignments: DataFrame, mapping: DataFrame | None = None, method: str = "balanced_kmeans", limit: int = 100) -> None:
    stage = "fine_" if mapping is not None else ""
    centroids.write.mode("overwrite").parquet(f"{root}/{stage}centroids")
    assignments.write.mode("overwrite").parquet(f"{root}/{stage}assignments")
    if mapping is not None:
        mapping.write.mode("overwrite").parquet(f"{root}/fine_to_coarse")
    cluster_metadata(assignments, centroids, method, limit).coalesce(1).write.mode("overwrite").json(f"{root}/metadata")


def load_model(spark: SparkSession, root: str, prefer_single: bool = False) -> ClusterModel:
    """A two-stage model if all its tables are there, else a single-stage one; ``prefer_single`` looks in the other order."""
    two = all(exists(spark, f"{root}/{t}") for t in ("fine_centroids", "fine_assignments", "fine_to_coarse"))
    one = exists(spark, f"{root}/centroids")
    metadata = spark.read.json(f"{root}/metadata") if exists(spark, f"{root}/metadata") else None
    if two and not (prefer_single and one):
        return ClusterModel(spark.read.parquet(f"{root}/fine_centroids"), spark.read.parquet(f"{root}/fine_to_coarse"), metadata)
    if one:
        return ClusterModel(spark.read.parquet(f"{root}/centroids"), None, metadata)
    raise FileNotFoundError(f"no cluster model under {root}")
