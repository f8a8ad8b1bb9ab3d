"""Routing of rows to the cluster of their nearest centroid, and partitions by cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.artifacts import ClusterModel, load_model
from ..sources.writers import write_partitions
from .joins import path_cascade, settled

#: Values of a tile of centroids that a task holds at once, and how far below the best a similarity is looked at again.
TILE_VALUES, NEAR = 8_000_000, 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-8)


def tiles(centroids: DataFrame, values: int = TILE_VALUES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of ``centroids``, by cluster, in parts of ``values`` values at most. One part is on the driver at a time."""
    size = centroids.agg(F.count("*"), F.max(F.size("centroid"))).first()
    parts = max(1, -(-(size[0] or 0) * (size[1] or 0) // values))
    if parts > 1:
        bounds = centroids.selectExpr(f"percentile(cluster, array({', '.join(str(i / parts) for i in range(1, parts))})) AS p").first().p
        cuts = [float("-inf"), *bounds, float("inf")]
    else:
        cuts = [float("-inf"), float("inf")]
    for low, high in zip(cuts, cuts[1:]):
        part = centroids.where((F.col("cluster") > low) & (F.col("cluster") <= high)) if parts > 1 else centroids
        rows = sorted((r.cluster, r.centroid) for r in part.select("cluster", "centroid").collect())
        if rows or parts == 1:
            yield np.array([c for c, _ in rows], np.int32), unit(np.array([v for _, v in rows], np.float64)) if rows else np.zeros((0, 0))


def vectors_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ``width`` values and no null among them, and their vectors."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    right = pc.fill_null(pc.equal(pc.list_value_length(lists), width), False)
    at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(lists.filter(right)).cast(pa.float64())
    values = np.array(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(at), width)
    sound = np.ones(len(at), bool)
    if flat.null_count:
        sound = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), width).any(axis=1)
    return at[sound], values[sound]


def in_order(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of rows of ``x`` with rows of ``c`` one by one, summed from the first value to the last."""
    return np.cumsum(x * c, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def best_of_tile(x: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place and cosine of the nearest row of ``matrix``, the first of several, for unit vectors.

    A matrix product finds what comes near the best; these are then compared by sums in a fixed order, so that the result
    doesn't depend on how rows and centroids are divided.
    """
    rough = x @ matrix.T
    row, place = np.nonzero(rough >= rough.max(axis=1, keepdims=True) - NEAR)
    exact = np.zeros(len(row))
    for a in range(0, len(row), 4096):
        exact[a : a + 4096] = in_order(x[row[a : a + 4096]], matrix[place[a : a + 4096]])
    order = np.lexsort((place, -exact, row))
    first = order[np.r_[True, row[order][1:] != row[order][:-1]]] if len(order) else order
    return place[first], exact[first]


def _with_tile(rows: DataFrame, ids: np.ndarray, matrix: np.ndarray, vector: str, cluster: str, sim: str, found: bool) -> DataFrame:
    """``rows`` with the best cluster of this tile, or of those before (``found``) where that one is at least as near."""
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    kept = [f for f in rows.schema.fields if not (found and f.name in (cluster, sim))]
    sent = rows.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        for batch in batches:
            best, sims = np.full(len(batch), -1, np.int64), np.full(len(batch), -np.inf)
            at, x = vectors_of(batch.column(batch.schema.get_field_index(vector)), matrix.shape[1])
            x, at = x[own := (x * x).sum(axis=1) > 0], at[own]
            for a in range(0, len(at), 1024) if len(ids) else ():
                place, value = best_of_tile(unit(x[a : a + 1024]), matrix)
                best[at[a : a + 1024]], sims[at[a : a + 1024]] = ids[place], value
            if found:
                before = pc.fill_null(batch.column(batch.schema.get_field_index(sim)), -np.inf).to_numpy(zero_copy_only=False)
                held = pc.fill_null(batch.column(batch.schema.get_field_index(cluster)), -1).to_numpy(zero_copy_only=False)
                stays = before >= sims
                best, sims = np.where(stays, held, best), np.where(stays, before, sims)
            none = np.isneginf(sims)
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(best.astype(np.int32), mask=none), pa.array(sims, mask=none)], [*(f.name for f in kept), cluster, sim])

    return rows.mapInArrow(run, StructType([*kept, StructField(cluster, IntegerType()), StructField(sim, DoubleType())]))


def nearest(rows: DataFrame, centroids: DataFrame, vector: str = "embedding", cluster: str = "cluster", compat: bool = False, similarity: str | None = None, values: int = TILE_VALUES) -> DataFrame:
    """``rows`` with the cluster of the most similar centroid, the lowest of several; null (compat: 0) for a zero vector, one
    with nulls or one of another width. ``similarity`` names a column for the cosine.

    Any number of centroids: rows meet them in tiles of bounded size, one after the other, and carry the best so far. Between
    tiles the rows are written, so that a task holds one tile only; where one tile holds all, nothing is written.
    """
    out, sim, found = rows, similarity or "q_similarity", False
    for ids, matrix in tiles(centroids, values):
        out = _with_tile(settled(out) if found and not rows.isStreaming else out, ids, matrix, vector, cluster, sim, found)
        found = True
    out = out if similarity else out.drop(sim)
    return out.withColumn(cluster, F.coalesce(F.col(cluster), F.lit(0))) if compat else out


def nearest_two_stage(rows: DataFrame, centroids: DataFrame, mapping: DataFrame, vector: str = "embedding", cluster: str = "cluster", compat: bool = False) -> DataFrame:
    """The nearest fine centroid's coarse cluster; both are kept (fine and ``cluster``)."""
    fine = nearest(rows, centroids, vector, "fine", compat)
    return fine.join(mapping.select("fine", F.col("coarse").alias(cluster)), "fine", "left").select(*rows.columns, "fine", cluster)


def default_route(rows: DataFrame, routes: DataFrame, key: str, experts: int, cluster: str = "cluster") -> DataFrame:
    """Rows with the cluster of their key: 0 where there is none, modulo the number of experts."""
    out = rows.join(routes.select(key, F.col(cluster).alias("q_cluster")), key, "left")
    return out.withColumn(cluster, F.pmod(F.coalesce("q_cluster", F.lit(0)), F.lit(experts)).cast("int")).drop("q_cluster")


def assigner(model: ClusterModel, compat: bool = False):
    """The transform that a model stands for: a function from rows with an embedding to rows with a cluster."""

    def assign(rows: DataFrame, vector: str = "embedding") -> DataFrame:
        if model.mapping is None:
            return nearest(rows, model.centroids, vector, compat=compat)
        return nearest_two_stage(rows, model.centroids, model.mapping, vector, compat=compat).drop("fine")

    return assign


def cluster_sizes(assignments: DataFrame, k: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Rows and percentage per cluster (and dataset), empty clusters too."""
    by = by or []
    counts = assignments.groupBy(*by, "cluster").agg(F.count("*").alias("n"))
    if k is not None:
        every = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cluster")
        grid = assignments.select(*by).distinct().select(*by, every) if by else assignments.sparkSession.range(1).select(every)
        counts = grid.join(counts, [*by, "cluster"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.select(*by, "cluster", "n", F.coalesce(F.try_divide(100.0 * F.col("n"), total), F.lit(0.0)).alias("percent"))


def partition_datasets(rows: DataFrame, features: DataFrame, model: ClusterModel, image: str = "image", drop_prefix: bool | None = None) -> DataFrame:
    """Dataset rows (dataset, line_no, image, line) with the cluster of their image; rows without one go.

    Images are assigned once, then rows find theirs by path. ``features`` has path, embedding and line_no.
    """
    assigned = assigner(model)(features).select("path", "line_no", "cluster").where("cluster is not null")
    prefix = model.stages == 2 if drop_prefix is None else drop_prefix
    return path_cascade(rows, assigned, "cluster", image, drop_prefix=prefix).where("cluster is not null")


def skipped_counts(rows: DataFrame, routed: DataFrame) -> DataFrame:
    """Rows per dataset, those that found a cluster, and those that were skipped for want of one."""
    found = routed.groupBy("dataset").agg(F.count("*").alias("routed"))
    out = rows.groupBy("dataset").agg(F.count("*").alias("n")).join(found, "dataset", "left")
    out = out.withColumn("routed", F.coalesce("routed", F.lit(0).cast("long")))
    return out.withColumn("skipped", F.col("n") - F.col("routed"))


def route_and_write(spark: SparkSession, rows: DataFrame, root: str, out: str, line: str = "line") -> DataFrame:
    """Rows with an embedding go to the partition of their cluster under ``out``; returns the sizes."""
    routed = assigner(load_model(spark, root))(rows)
    write_partitions(routed, out, ["cluster", "dataset"], line)
    return cluster_sizes(routed.select("cluster", "dataset"), by=["dataset"])


def split_tasks(tasks: DataFrame, features: DataFrame, model: ClusterModel, experts: int) -> DataFrame:
    """Task lines (task, line_no, image, ...) with the expert of their image; all lines of an image stay together."""
    images = tasks.select("image").distinct()
    routes = path_cascade(images, assigner(model)(features).select("path", "line_no", "cluster"), "cluster")
    return default_route(tasks, routes, "image", experts)


def cluster_where(column: Column, k: int) -> Column:
    return F.pmod(column, F.lit(k)).cast("int")
