"""Nearest centroids in tiles, bounds between rounds, and the auction against an exact solver."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import auction, clustering, routing


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(300, 6)) + 4 * np.eye(6)[np.arange(300) % 6]
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, [0.0] * 6), (301, None), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [1.0]), (7, x[7].tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).cache()


def test_tiles_give_what_one_matrix_gives(spark, table):
    draw = np.random.default_rng(2)
    c = draw.normal(size=(40, 6))
    c[31] = c[3] * 2  # a tie: the lower id counts
    centroids = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(c)], "cluster int, centroid array<double>")
    whole = {(r.vec_id, r.cluster) for r in routing.nearest(table, centroids).collect()}
    unit = c / np.linalg.norm(c, axis=1, keepdims=True)
    for vec_id, cluster in whole:
        if vec_id < 300:
            v = np.array(table.where(F.col("vec_id") == vec_id).first().embedding) if vec_id % 60 == 0 else None
            assert v is None or cluster == 3 * int(np.argmax(np.round(unit @ v, 12)))
        else:
            assert cluster is None
    assert {(r.vec_id, r.cluster) for r in routing.nearest(table, centroids, values=6 * 7).collect()} == whole
    none = centroids.limit(0)
    assert {r.cluster for r in routing.nearest(table, none).collect()} == {None}


def test_bounds_change_nothing_and_skip_rows(spark, table):
    c = clustering.spherical_kmeans(table, 6, iterations=12)
    now = clustering.first_centroids(table, 6, 42, "vec_id", "embedding")
    for _ in range(c.rounds):
        found = {r.cluster: r.centroid for r in clustering.update_centroids(routing.nearest(table, clustering._frame(spark, now)).where("cluster is not null")).collect()}
        unit_means = now
        sums = routing.nearest(table, clustering._frame(spark, now)).where("cluster is not null").collect()
        unit_means = np.array([routing.unit(np.array([r.embedding for r in sums if r.cluster == i])).sum(axis=0) if i in found else now[i] for i in range(6)])
        now = routing.unit(unit_means)
    got = np.array([r.centroid for r in c.centroids.orderBy("cluster").collect()])
    assert np.abs(got - now).max() < 1e-9
    assert c.skipped > 0.2 and c.assignments.count() == 305
    assert c.assignments.where("cluster is null").count() == 4


def exact(sims, room):
    """The best total by trying every way to fill the clusters."""
    n = len(sims)
    slots = [c for c, r in enumerate(room) for _ in range(r)]
    return max(sum(sims[i][c] for i, c in enumerate(p)) for p in set(itertools.permutations(slots, n)))


def test_auction_is_within_epsilon_of_the_best():
    draw = np.random.default_rng(3)
    for n, k in ((6, 2), (7, 3), (8, 4), (5, 5), (4, 1)):
        for spread in (1000, 5, 1):
            sims = draw.integers(-spread, spread, (n, k))
            room, prices = auction.rooms(n, k), np.zeros(k, np.int64)
            for e in auction.steps(1, 100):
                held, prices = auction.local(sims, room, e, prices)
            assert np.bincount(held, minlength=k).tolist() == room.tolist()
            assert sims[np.arange(n), held].sum() >= exact(sims.tolist(), room) - n


def test_auction_in_spark_takes_the_same_rounds(spark):
    draw = np.random.default_rng(4)
    sims = draw.integers(0, 1000, (40, 2))
    sims[10:30] = sims[10]
    rows = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sims)], "q_row long, sims array<bigint>").select("q_row", F.xxhash64("q_row").alias("tie"), "sims")
    one, prices, total = auction.balanced(rows, 2, 400)
    many, other, also = auction.balanced(rows, 2, 400, local_values=0)
    assert total == also and prices.tolist() == other.tolist()
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_balanced_clusters(spark, table):
    b = clustering.balanced_kmeans(table, 4)
    sizes = sorted(r["count"] for r in b.assignments.groupBy("cluster").count().collect())
    assert sum(sizes) == 305 and sizes[-1] - sizes[0] <= 1
    first = clustering.balanced_kmeans(table, 4, iterations=1)
    assert b.similarity >= first.similarity
