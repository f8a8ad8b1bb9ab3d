"""k-means on embedding tables: spherical, balanced, and both in two stages.

Assignment and update are DataFrame jobs; only centroids (k times the width) and counts reach the driver. Each round's
assignment is recomputed from the written vectors, so lineage does not grow and lost executors cost a task, not a run.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..sources.writers import shared_folder
from . import auction
from .joins import settled
from .routing import NEAR, TILE_VALUES, best_of_tile, in_order, nearest, unit, vectors_of

#: Parts of a cosine of 1 in which balanced assignment counts.
UNIT = 1_000_000

#: Values of all centroids up to which the driver adds the sums of tasks itself, without a shuffle.
SMALL_SUMS = 1 << 14


@dataclass
class Clusters:
    """``skipped``: the share of rows whose nearest centroid was known without looking at the others, over all rounds."""

    centroids: DataFrame
    assignments: DataFrame
    similarity: float
    skipped: float = 0.0
    rounds: int = 0


def _frame(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster int, centroid array<double>")


def update_centroids(assigned: DataFrame, key: str = "cluster", vector: str = "embedding") -> DataFrame:
    """The mean of each cluster's vectors, scaled to length 1: cluster, centroid. Sums combine before the shuffle."""
    parts = assigned.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    means = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("p")).select(key, F.transform("p", lambda x: x["mean"]).alias("m"))
    return means.select(F.col(key).alias("cluster"), F.transform("m", lambda x: x / F.greatest(norm("m"), F.lit(1e-8))).alias("centroid"))


def first_centroids(rows: DataFrame, k: int, seed: int, key: str, vector: str) -> np.ndarray:
    """k rows by a seeded hash of their key, as unit vectors."""
    picked = rows.where(F.col(vector).isNotNull() & (norm(vector) > 0)).orderBy(F.xxhash64(F.lit(seed), key), key).limit(k).select(vector).collect()
    if not picked:
        raise ValueError("no vectors to cluster")
    v = np.array([r[0] for r in picked], np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)


class Rounds:
    """Rounds of assignment that know, for each row, its cluster and how near and how far others were at an earlier round.

    By the triangle inequality a row stays where it is while the bound of the distance to its own centroid lies below the
    bound of the distance to any other; since that round, both have changed by what centroids moved at most. Unit vectors,
    clusters and bounds are written as a table, vectors as bytes; a round computes with the rows whose gap between both bounds
    the centroids may have crossed, and changes the table's sums by those that go elsewhere. The table is written anew, with
    the bounds of that round, when as many rows were in doubt as it has, then twice as many and so on: a few times in all.
    """

    def __init__(self, rows: DataFrame, vector: str, key: str | None = None):
        self.spark = rows.sparkSession
        spread = rows.repartition(F.xxhash64(key)) if key else rows
        self.source = spread.select(F.col(vector).cast("array<double>").alias("q_v"))
        self.root, self.tables = shared_folder(self.spark, f"rounds-{uuid.uuid4().hex[:12]}"), 0
        self.table: DataFrame | None = None
        self.looked = self.seen = self.doubted = self.size = 0

    def assign(self, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of unit vectors and numbers of rows by cluster, with every row at its nearest centroid of ``now``."""
        if self.table is None or self.doubted >= self.size << (self.tables - 1):
            self._write(now)
            return self.sums, self.n
        sums, n, looked, read = self._moved(now)
        self.looked += looked
        self.doubted += read
        self.seen += self.size
        return self.sums + sums, self.n + n

    def _write(self, now: np.ndarray) -> None:
        first, width = self.table is None, now.shape[1]
        sent = self.spark.sparkContext.broadcast((now, np.zeros(len(now)) if first else self._shift(now)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, moved = sent.value
            for batch in batches:
                if first:
                    _, x = vectors_of(batch.column(0), width)
                    x = unit(x[(x * x).sum(axis=1) > 0])
                    c, up, low = np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x))
                else:
                    x, c, up, low = _bounds_of(batch, width)
                (c, looked), up, low = bounded_step(x, c, up, low, now, moved)
                yield pa.RecordBatch.from_arrays([_packed(x), pa.array(c.astype(np.int32)), pa.array(up), pa.array(low), pa.array(looked)], ["q_v", "q_c", "q_up", "q_low", "q_looked"])

        rows = self.source if first else self.table.select("q_v", "q_c", "q_up", "q_low")
        placed = rows.mapInArrow(run, "q_v binary, q_c int, q_up double, q_low double, q_looked boolean")
        path = f"{self.root}/{self.tables}"
        placed.write.parquet(path)
        self.table, self.tables = self.spark.read.schema(placed.schema).parquet(path), self.tables + 1

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, looked = np.zeros(sent.value[0].shape), 0
            n = np.zeros(len(sums), np.int64)
            for batch in batches:
                c = batch.column(1).to_numpy(zero_copy_only=False)
                _add(sums, c, _unpacked(batch.column(0), width))
                n += np.bincount(c, minlength=len(n))
                looked += int(batch.column(2).to_numpy(zero_copy_only=False).sum())
            yield _sums_batch(sums, n, looked, int(n.sum()))

        self.sums, self.n, looked, self.size = self._total(self.table.select("q_v", "q_c", "q_looked").mapInArrow(partial, _SUMS), now)
        self.epoch, self.doubted = now, 0
        self.looked += looked
        self.seen += self.size

    def _shift(self, now: np.ndarray) -> np.ndarray:
        """How far each centroid is from where it was when the table was written."""
        return np.sqrt(((now - self.epoch) ** 2).sum(axis=1))

    def _moved(self, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        """What sums and numbers gain since the table was written, the rows that were compared with all centroids, and those read."""
        moved = self._shift(now)
        most = np.sort(moved)[::-1]
        # A row's own centroid and the farthest moved of the others.
        crossed = float(most[:2].sum()) + 2 * NEAR
        sent, width = self.spark.sparkContext.broadcast((now, moved)), now.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, moved = sent.value
            sums, n, looked, read = np.zeros(now.shape), np.zeros(len(now), np.int64), 0, 0
            for batch in batches:
                x, was, up, low = _bounds_of(batch, width)
                near = np.flatnonzero(low - up <= crossed)
                x, was, up, low = x[near], was[near], up[near], low[near]
                (c, doubt), _, _ = bounded_step(x, was.copy(), up, low, now, moved)
                looked, read = looked + int(doubt.sum()), read + len(x)
                went = np.flatnonzero(c != was)
                _add(sums, c[went], x[went])
                _add(sums, was[went], -x[went])
                n += np.bincount(c[went], minlength=len(n)) - np.bincount(was[went], minlength=len(n))
            yield _sums_batch(sums, n, looked, read)

        # Tested in the function: a threshold in the plan would be compiled anew each round.
        return self._total(self.table.select("q_v", "q_c", "q_up", "q_low").mapInArrow(run, _SUMS), now)

    def _total(self, parts: DataFrame, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Partial sums of tasks together. Clusters that no row of a task came to or left are not sent; the driver adds small ones."""
        sums, rows = np.zeros(now.shape), np.zeros(len(now), np.int64)
        if now.size <= SMALL_SUMS:
            found = parts.toArrow()
            c, n, looked, read = (found.column(v).to_numpy() for v in ("c", "n", "looked", "read"))
            real = c >= 0
            np.add.at(rows, c[real], n[real])
            if real.any():
                _add(sums, c[real], pc.list_flatten(found.column("s")).to_numpy().reshape(-1, now.shape[1]))
            return sums, rows, int(looked.sum()), int(read.sum())
        found = parts.select("c", "n", "looked", "read", F.posexplode_outer("s").alias("pos", "x")).groupBy("c", "pos").agg(*(F.sum(v).alias(v) for v in ("x", "n", "looked", "read"))).toArrow()
        c, pos, x, n, looked, read = (found.column(v).to_numpy() for v in ("c", "pos", "x", "n", "looked", "read"))
        real = c >= 0
        c = c[real]
        sums[c, pos[real].astype(np.int64)], rows[c] = x[real], n[real]
        return sums, rows, int(looked[~real].sum()), int(read[~real].sum())


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of ``x`` as bytes, which pass between Spark and Python whole, not value by value."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * (8 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width))
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.float64).reshape(len(column), width)


def _bounds_of(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    c, up, low = (np.array(batch.column(i).to_numpy(zero_copy_only=False)) for i in (1, 2, 3))
    return _unpacked(batch.column(0), width), c.astype(np.int64), up, low


_SUMS = "c long, s array<double>, n long, looked long, read long"


def _add(sums: np.ndarray, c: np.ndarray, x: np.ndarray) -> None:
    """Adds each row of ``x`` to the row of ``sums`` that ``c`` names."""
    order = np.argsort(c, kind="stable")
    if len(order):
        first = np.flatnonzero(np.r_[True, c[order][1:] != c[order][:-1]])
        sums[c[order][first]] += np.add.reduceat(x[order], first, axis=0)


def _sums_batch(sums: np.ndarray, n: np.ndarray, looked: int, read: int) -> pa.RecordBatch:
    """A row for each cluster with a sum or a number, and one of cluster -1 with what was looked at and read."""
    full = np.flatnonzero((n != 0) | (sums != 0).any(axis=1))
    zeros = [0] * len(full)
    s = pa.array([*sums[full], None], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([*full.tolist(), -1], pa.int64()), s, pa.array([*n[full].tolist(), 0], pa.int64()), pa.array([*zeros, looked], pa.int64()), pa.array([*zeros, read], pa.int64())], ["c", "s", "n", "looked", "read"])


def bounded_step(x: np.ndarray, c: np.ndarray, up: np.ndarray, low: np.ndarray, now: np.ndarray, moved: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """One round for unit vectors ``x``: ((cluster, whether all centroids were looked at), upper bound, lower bound)."""
    looked = np.ones(len(x), bool)
    known = np.flatnonzero(c >= 0)
    if len(known):
        own, most = c[known], np.sort(moved)[-2:]
        others = np.where(moved[own] == moved.max(), most[0], moved.max())  # the farthest that another centroid moved
        up[known] += moved[own]
        low[known] -= others
        doubt = known[up[known] + NEAR >= low[known]]
        up[doubt] = np.sqrt(np.maximum(0, 2 - 2 * in_order(x[doubt], now[c[doubt]])))
        looked[known] = up[known] + NEAR >= low[known]
    at = np.flatnonzero(looked)
    for a in range(0, len(at), 1024):
        part = at[a : a + 1024]
        place, cosine = best_of_tile(x[part], now)
        rest = x[part] @ now.T
        rest[np.arange(len(part)), place] = -1
        second = rest.max(axis=1)
        c[part], up[part], low[part] = place, np.sqrt(np.maximum(0, 2 - 2 * cosine)), np.sqrt(np.maximum(0, 2 - 2 * second))
    return (c, looked), up, low


def spherical_kmeans(rows: DataFrame, k: int, iterations: int = 100, runs: int = 1, seed: int = 42, key: str = "vec_id", vector: str = "embedding") -> Clusters:
    """The best of ``runs`` runs by total similarity. A run ends early when no centroid moves.

    Rows without a vector, with nulls in it or of length zero belong to no cluster. Centroids lie on the driver (k times the
    width); where a task should not hold them all, ``nearest`` assigns tile by tile, without bounds.
    """
    spark = rows.sparkSession
    rows = rows.select(key, vector)
    best: Clusters | None = None
    for run in range(runs):
        now, done = first_centroids(rows, k, seed + run, key, vector), 0
        bounds = Rounds(rows, vector, key) if now.size <= TILE_VALUES else None
        for _ in range(iterations):
            done += 1
            if bounds:
                sums, n = bounds.assign(now)
                means = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-8)
                new = np.where((n > 0)[:, None], means, now)
            else:
                found = {r.cluster: r.centroid for r in update_centroids(nearest(rows, _frame(spark, now), vector).where("cluster is not null"), vector=vector).collect()}
                new = np.array([found.get(i, now[i]) for i in range(len(now))])
            moved = float(np.abs(new - now).max())
            now = new
            if moved < 1e-9:
                break
        assigned = nearest(rows, _frame(spark, now), vector, similarity="q_s")
        total = assigned.agg(F.coalesce(F.sum("q_s"), F.lit(0.0))).first()[0]
        if best is None or total > best.similarity:
            best = Clusters(_frame(spark, now), assigned.select(key, "cluster"), total, 1 - bounds.looked / max(1, bounds.seen) if bounds else 0.0, done)
    return best


def similarity(assigned: DataFrame, centroids: DataFrame, vector: str) -> float:
    """Sum of cosines between vectors and their centroids."""
    from ..functions.vectors import dot

    both = assigned.join(centroids, "cluster")
    return both.agg(F.coalesce(F.sum(F.try_divide(dot(vector, "centroid"), norm(vector))), F.lit(0.0))).first()[0]


def similarities(rows: DataFrame, centroids: np.ndarray, key: str, vector: str) -> DataFrame:
    """(q_row, tie, sims) of ``rows`` (q_row, key, vector): cosines to all centroids in whole parts of UNIT, and a number that
    decides between equal bids. Rows without a sound vector are equally near to all."""
    sent = rows.sparkSession.sparkContext.broadcast(unit(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            out = np.zeros((len(batch), len(c)), np.int64)
            at, x = vectors_of(batch.column(2), c.shape[1])
            if len(at):  # value by value, so that the order of sums is fixed
                x = unit(x)
                out[at] = np.rint(sum(x[:, j, None] * c[None, :, j] for j in range(c.shape[1])) * UNIT)
            sims = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(c)), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sims], ["q_row", "tie", "sims"])

    return rows.select("q_row", F.xxhash64(key).alias("tie"), vector).mapInArrow(run, "q_row long, tie long, sims array<bigint>")


def balanced_kmeans(rows: DataFrame, k: int, iterations: int = 100, seed: int = 42, key: str = "vec_id", vector: str = "embedding", epsilon: float = 1e-4) -> Clusters:
    """Clusters whose sizes differ by one at most, each assignment within ``epsilon`` a row of the best total cosine.

    Ends when no centroid moves, or when a round gains less than ``epsilon`` a row; the best round counts.
    """
    spark = rows.sparkSession
    rows = settled(rows.select(F.monotonically_increasing_id().alias("q_row"), key, vector))
    now = first_centroids(rows, k, seed, key, vector)
    n, prices, best = rows.count(), None, None
    for done in range(1, iterations + 1):
        placed, prices, total = auction.balanced(similarities(rows, now, key, vector), len(now), int(epsilon * UNIT), prices)
        both = rows.join(placed, "q_row")
        assigned = both.select(key, "cluster")
        if best is not None and total / UNIT < best.similarity + epsilon * n:
            if total / UNIT > best.similarity:
                best = Clusters(_frame(spark, now), assigned, total / UNIT, 0.0, done)
            break
        best = Clusters(_frame(spark, now), assigned, total / UNIT, 0.0, done)
        found = {r.cluster: r.centroid for r in update_centroids(both, vector=vector).collect()}
        new = np.array([found.get(i, now[i]) for i in range(len(now))])
        moved = float(np.abs(new - now).max())
        now = new
        if moved < 1e-9:
            break
    return best


def two_stage(rows: DataFrame, fine: int = 1024, coarse: int = 2, iterations: int = 100, runs: int = 1, seed: int = 42, key: str = "vec_id", vector: str = "embedding") -> tuple[Clusters, DataFrame]:
    """Spherical k-means, then balanced k-means on its centroids: the fine clusters, and the mapping fine to coarse."""
    first = spherical_kmeans(rows, fine, iterations, runs, seed, key, vector)
    points = first.centroids.select(F.col("cluster").cast("long").alias("fine"), F.col("centroid").alias("embedding"))
    second = balanced_kmeans(points, coarse, iterations, seed, "fine", "embedding")
    return first, second.assignments.select(F.col("fine").cast("int").alias("fine"), F.col("cluster").alias("coarse"))
