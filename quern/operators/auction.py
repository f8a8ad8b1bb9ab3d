"""Balanced assignment by an auction.

Every row bids for the cluster that gives it most (similarity less price): up to where the second best would give it as much,
and epsilon more. A cluster keeps as many bids as it has room for, the highest ones; its price is the lowest of these once
it is full. Rows that are put out bid again. When all rows have a place, each has a cluster within epsilon of its best at these
prices, so the total is within epsilon a row of the best total. Steps of epsilon that get smaller, each from the prices of the
one before, keep the rounds few. Everything is counted in whole numbers, so a result does not depend on how rows are divided.

A round is a pass over the written rows: prices are k numbers; bids are counted by cluster and value, which gives each
cluster's price without sorting rows; among equal bids at the price a hash decides, counted by parts of the hash first, so that
many copies of a row are no single task's work. A table of at most LOCAL_VALUES similarities takes the same rounds in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import settled

#: Similarities (rows times clusters) that one task may hold.
LOCAL_VALUES = 1_000_000
#: Parts of hashes that equal bids are counted by, and by how much epsilon shrinks from step to step.
PARTS, SHRINK = 4096, 10


def rooms(n: int, k: int) -> np.ndarray:
    return np.array([n // k + (i < n % k) for i in range(k)], np.int64)


def steps(epsilon: int, widest: int) -> list[int]:
    """Falling values of epsilon, from about ``widest`` down to ``epsilon``."""
    out = [max(1, epsilon)]
    while out[-1] * SHRINK <= widest:
        out.append(out[-1] * SHRINK)
    return out[::-1]


def bids_of(sims: np.ndarray, prices: np.ndarray, epsilon: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's cluster and bid."""
    value, row = sims - prices, np.arange(len(sims))
    best = value.argmax(axis=1)
    top = value[row, best]
    if sims.shape[1] > 1:
        value[row, best] = np.iinfo(np.int64).min
        second = value.max(axis=1)
    else:
        second = top
    return best, prices[best] + top - second + epsilon


def local(sims: np.ndarray, room: np.ndarray, epsilon: int, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clusters of rows, which stand in the order that decides between equal bids, and prices."""
    held, bid, prices = np.full(len(sims), -1), np.zeros(len(sims), np.int64), prices.copy()
    while len(free := np.flatnonzero(held < 0)):
        held[free], bid[free] = bids_of(sims[free], prices, epsilon)
        for c in np.unique(held[free]):
            asked = np.flatnonzero(held == c)
            if len(asked) >= room[c]:
                order = asked[np.argsort(-bid[asked], kind="stable")]
                held[order[room[c] :]] = -1
                if room[c]:
                    prices[c] = bid[order[room[c] - 1]]
    return held, prices


def _pick(values: list | np.ndarray, at: str, kind: str = "long") -> Column:
    return F.get(F.array(*(F.lit(None if v is None else int(v)).cast(kind) for v in values)), F.col(at))


def offers(state: DataFrame, prices: np.ndarray, epsilon: int) -> DataFrame:
    """``state`` with a cluster and a bid for every row that has none."""
    value = F.transform("sims", lambda s, i: s - F.get(F.array(*(F.lit(int(p)) for p in prices)), i))
    free = state.withColumn("q_value", F.when(F.col("held").isNull(), value)).withColumn("q_top", F.array_max("q_value"))
    free = free.withColumn("q_best", (F.array_position("q_value", F.col("q_top")) - 1).cast("int"))
    second = F.array_max(F.filter("q_value", lambda v, i: i != F.col("q_best"))) if len(prices) > 1 else F.col("q_top")
    bid = _pick(prices, "q_best") + F.col("q_top") - second + epsilon
    return free.select("q_row", "tie", "sims", F.coalesce("held", "q_best").alias("held"), F.coalesce("bid", bid).alias("bid"))


def cuts(offered: DataFrame, room: np.ndarray) -> dict[int, tuple]:
    """For each cluster with as many bids as room, or more: its price, and of the rows that bid it the last to stay, as the
    part of its hash, the hash and the row number (nulls where all stay). Bids are counted, not sorted."""
    ahead = F.coalesce(F.sum("q_n").over(Window.partitionBy("held").orderBy(F.desc("bid")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_bid = offered.groupBy("held", "bid").agg(F.count("*").alias("q_n")).withColumn("q_ahead", ahead).withColumn("q_left", _pick(room, "held") - F.col("q_ahead"))
    full = {r.held: r for r in by_bid.where("q_left > 0 and q_n >= q_left").collect()}
    out: dict[int, tuple] = {c: (r.bid, None, None, None) for c, r in full.items()}
    tied = {c: r for c, r in full.items() if r.q_n > r.q_left}
    if not tied:
        return out
    k = len(room)
    price, left = [tied[c].bid if c in tied else None for c in range(k)], [tied[c].q_left if c in tied else None for c in range(k)]
    equal = offered.where(F.col("bid") == _pick(price, "held")).select("held", "tie", "q_row", F.pmod("tie", F.lit(PARTS)).alias("q_part"))
    before = F.coalesce(F.sum("q_n").over(Window.partitionBy("held").orderBy("q_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = equal.groupBy("held", "q_part").agg(F.count("*").alias("q_n")).withColumn("q_take", _pick(left, "held") - before)
    edge = {r.held: r for r in parts.where("q_take > 0 and q_n >= q_take").collect()}
    at, take = [edge[c].q_part if c in edge else None for c in range(k)], [edge[c].q_take if c in edge else None for c in range(k)]
    rank = F.row_number().over(Window.partitionBy("held").orderBy("tie", "q_row"))
    last = equal.where(F.col("q_part") == _pick(at, "held")).withColumn("q_rank", rank).where(F.col("q_rank") == _pick(take, "held"))
    return out | {r.held: (full[r.held].bid, r.q_part, r.tie, r.q_row) for r in last.collect()}


def put_out(offered: DataFrame, cut: dict[int, tuple], k: int) -> DataFrame:
    """``offered`` without the places of rows behind the last that their cluster keeps."""
    price, part, tie, row = ([cut[c][i] if c in cut else None for c in range(k)] for i in range(4))
    mine, last = F.struct(F.pmod("tie", F.lit(PARTS)).alias("a"), F.col("tie").alias("b"), F.col("q_row").alias("c")), F.struct(_pick(part, "held").alias("a"), _pick(tie, "held").alias("b"), _pick(row, "held").alias("c"))
    low = (F.col("bid") < _pick(price, "held")) | ((F.col("bid") == _pick(price, "held")) & _pick(part, "held").isNotNull() & (mine > last))
    keeps = ~F.coalesce(low, F.lit(False))
    return offered.withColumns({"held": F.when(keeps, F.col("held")), "bid": F.when(keeps, F.col("bid"))})


def balanced(table: DataFrame, k: int, epsilon: int, prices: np.ndarray | None = None, local_values: int = LOCAL_VALUES) -> tuple[DataFrame, np.ndarray, int]:
    """(q_row, cluster) for rows of ``table`` (q_row, tie, sims), with sizes that differ by one at most; prices; and the total
    similarity. ``prices`` of an auction over nearly the same similarities make this one short."""
    spark = table.sparkSession
    table = settled(table)
    n = table.count()
    room = rooms(n, k)
    widest = max(epsilon, 100_000 if prices is None else 1000)
    prices = np.zeros(k, np.int64) if prices is None else prices.copy()
    if n * k <= local_values:
        rows = table.orderBy(F.pmod("tie", F.lit(PARTS)), "tie", "q_row").collect()
        sims, held = np.array([r.sims for r in rows], np.int64).reshape(n, k), np.zeros(n, np.int64)
        for e in steps(epsilon, widest):
            held, prices = local(sims, room, e, prices)
        placed = spark.createDataFrame([(r.q_row, int(c)) for r, c in zip(rows, held, strict=True)], "q_row long, cluster int")
        return placed, prices, int(sims[np.arange(n), held].sum())
    for e in steps(epsilon, widest):
        state = table.select("q_row", "tie", "sims", F.lit(None).cast("int").alias("held"), F.lit(None).cast("long").alias("bid"))
        placed = 0
        while placed < n:
            state = settled(offers(state, prices, e))
            cut = cuts(state, room)
            for c, found in cut.items():
                prices[c] = found[0]
            state = put_out(state, cut, k)
            placed = state.where("held is not null").count()
    state = settled(state)
    return state.select("q_row", F.col("held").alias("cluster")), prices, int(state.agg(F.sum(F.get("sims", F.col("held")))).first()[0] or 0)
