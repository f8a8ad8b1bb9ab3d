"""Exact top-k by inner product with an M-tree over pages of vectors.

The tree lives in the Euclidean metric, and a ball bounds the inner product: for x within r of c, <q, x> <= <q, c> + |q| * r.
Vectors are ranged by their two nearest pivots (of a bounded sample), so that neighbours lie in the same part, at most
``PART_ROWS`` of them. Each part is loaded by itself, ``CHUNK_ROWS`` vectors at a time: a node is split between two members
that lie far apart, again and again, until pages of ``PAGE_ROWS`` are left. More data makes more parts, each with a ball of
its own, not deeper trees. A node keeps its centre, its covering radius, its smallest id and its distance to the centre above; a page also keeps
its members' distances to the centre, in order.

A query first meets its own neighbours, where its part is loaded, and takes the k-th best score there along. It then goes to
the parts whose ball may hold a better one, and to no others. There it takes nodes in the order of their bound, best first,
and stops at the first that cannot reach the k-th score at hand. Through the triangle inequality, the distance to the centre
above bounds a node before its own product is computed, and a member's distance to the page's centre bounds the member. How
much that saves depends on the vectors: see ``visited``.

Pivots only shape the tree, and any choice gives the same, exact result.

Defined results: rows without an id, and vectors that are null or hold a null or non-finite component, take no part; all
others do. A row is no candidate of a query with its own id. Each row is a candidate, also where ids repeat; a query's rows
of equal vectors are one query, others are queries of their own. Vectors of different lengths do not meet. Fewer than k
candidates give as many rows. Products that double precision cannot hold exactly are computed in whole numbers; a score
beyond a long counts as the largest or smallest long, and 1024 times a component beyond a double as the largest double.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, slices, tidy

SCALE, K = 1024, 10
#: Pivots, and rows that they are chosen from; vectors of a page, of a subtree built at once, and of a part.
PIVOTS, SAMPLE, PAGE_ROWS, CHUNK_ROWS, PART_ROWS = 128, 4096, 256, 4096, 65_536
#: Values of all parts' balls that each task may hold (64 MB); beyond it, queries go to every part.
BALL_VALUES = 8_000_000
#: Room for rounding in double precision when a bound is compared with a score.
ROUNDING = 1e-6
_LONG = 2**63


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dim and x (array of doubles) of the rows that take part."""
    sound = F.coalesce(F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    return table.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), x.alias("x"))


def _scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) in double precision, where it is exact."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * x), -np.finfo(np.float64).max, np.finfo(np.float64).max)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return _scaled(np.asarray(column.flatten(), np.float64).reshape(len(column), dim))


def _small(v: np.ndarray) -> bool:
    """Whether products of such vectors are exact in double precision, in any order of summation."""
    return not v.size or float(np.abs(v).max()) ** 2 * v.shape[-1] < 2.0**52


def _distance(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances to ``c``; infinite where double precision cannot hold them."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(np.sqrt(((v - c) ** 2).sum(axis=-1)), nan=np.inf, posinf=np.inf)


def pivots_of(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension, up to PIVOTS vectors spread far apart, out of SAMPLE rows with the smallest hash."""
    rows = vectors.where("dim > 0").orderBy(F.xxhash64("id", "x"), "id").limit(SAMPLE).select("dim", "x").collect()
    out = {}
    for dim in {r.dim for r in rows}:
        sample = _scaled(np.array([r.x for r in rows if r.dim == dim], np.float64))
        chosen, far = [0], _distance(sample, sample[0])
        while len(chosen) < min(PIVOTS, len(sample)) and 0 < far.max() < np.inf:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _distance(sample, sample[chosen[-1]]))
        out[dim] = sample[chosen]
    return out


def ranged(vectors: DataFrame, pivots: dict[int, np.ndarray], parts: int) -> DataFrame:
    """``vectors`` (id, dim, x) in parts of neighbours: by dimension, nearest pivot, second nearest and distance."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            dims = np.asarray(batch.column(1))
            first, second, away = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in set(dims.tolist()) & set(pivots):
                at = np.flatnonzero(dims == dim)
                v = _matrix(batch.column(2).take(pa.array(at)), dim)
                d = np.stack([_distance(v, p) for p in pivots[dim]])
                order = np.argsort(d, axis=0, kind="stable")[:2]
                first[at], second[at], away[at] = order[0], order[-1], d[order[0], np.arange(len(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), pa.array(second), pa.array(away)], ["id", "dim", "x", "first", "second", "away"])

    routed = vectors.select("id", "dim", "x").mapInArrow(run, "id long, dim int, x array<double>, first int, second int, away double")
    by = ["dim", "first", "second", "away", "id"]
    return routed.repartitionByRange(parts, *by).sortWithinPartitions(*by)


#: Three sorts of rows. A subtree: ids, members and the distances own, and per node centre, reach, up (the node above), apart
#: (the distance to it), begin and stop (its members) and low. A query: q_id, key (of its vector), vector and floor. The ball of a
#: part: centre, reach and low.
TREE = "part int, dim int, q_id long, key long, floor double, ids binary, members binary, own binary, centre binary, reach binary, up binary, apart binary, begin binary, stop binary, low binary"
_NAMES = [c.split()[0] for c in TREE.split(", ")]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), *[pa.binary()] * 10]


def _table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(_NAMES, _KINDS, strict=True)], _NAMES)


def subtree(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes over the vectors: each is split between far members until a page is left. A node stands before those below it."""
    nodes: list[tuple] = []
    order, own = np.arange(len(ids)), np.zeros(len(ids))
    stack = [(0, len(ids), -1)]
    while stack:
        begin, stop, up = stack.pop()
        here = order[begin:stop]
        rows = v[here]
        centre = rows.mean(axis=0)
        away = _distance(rows, centre)
        apart = float(_distance(centre, nodes[up][0])) if up >= 0 else 0.0
        if stop - begin <= PAGE_ROWS:
            sort = np.lexsort((ids[here], away))
            order[begin:stop], own[begin:stop] = here[sort], away[sort]
        else:
            a = rows[int(away.argmax())]
            b = rows[int(_distance(rows, a).argmax())]
            with np.errstate(over="ignore", invalid="ignore"):
                side = np.nan_to_num(rows @ (b - a))
            order[begin:stop] = here[np.argsort(side, kind="stable")]
            half = (begin + stop) // 2
            stack += [(half, stop, len(nodes)), (begin, half, len(nodes))]
        nodes.append((centre, float(away.max()), up, apart, begin, stop, int(ids[here].min())))
    centre, reach, up, apart, begin, stop, low = zip(*nodes, strict=True)
    return {
        "ids": ids[order], "members": v[order], "own": own, "centre": np.array(centre), "reach": np.array(reach), "up": np.array(up, np.int32), "apart": np.array(apart),
        "begin": np.array(begin, np.int32), "stop": np.array(stop, np.int32), "low": np.array(low, np.int64),
    }


def build(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """Subtrees, queries and balls (see TREE) of ``vectors`` in the parts that they lie in. A query's floor is the k-th best
    score among those built with it, null where there are fewer."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        roots: dict[int, list[tuple]] = {}

        def load(dim: int, ids: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            t = subtree(ids, v)
            roots.setdefault(dim, []).append((t["centre"][0], t["reach"][0], t["low"][0]))
            yield _table([{"part": part, "dim": dim} | {n: x.tobytes() for n, x in t.items()}])
            asked = []
            for i in np.flatnonzero(ids % every == 0).tolist():
                others, floor = ids != ids[i], None
                if others.sum() >= k and _small(v):
                    floor = float(np.partition(v[others] @ v[i], -k)[-k])
                asked.append({"part": part, "dim": dim, "q_id": int(ids[i]), "key": np.int64(np.uint64(xxhash.xxh64_intdigest(v[i].tobytes())).view(np.int64)), "floor": floor, "members": v[i].tobytes()})
            if asked:
                yield _table(asked)

        held: list[pa.RecordBatch] = []
        size, now = 0, None
        for batch in slices(batches, CHUNK_ROWS):
            dims = np.asarray(batch.column(1))
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and (dims[a] != now or size + b - a > CHUNK_ROWS):
                    yield from load(now, *_joined(held, now))
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size, now = size + b - a, int(dims[a])
        if held:
            yield from load(now, *_joined(held, now))
        for dim, found in roots.items():
            centre = np.mean([c for c, _, _ in found], axis=0)
            reach = max(float(_distance(c, centre)) + r for c, r, _ in found)
            yield _table([{"part": part, "dim": dim, "centre": centre.tobytes(), "reach": np.array([reach]).tobytes(), "low": np.array([min(x for _, _, x in found)]).tobytes()}])

    return vectors.select("id", "dim", "x").mapInArrow(run, TREE)


def _joined(held: list[pa.RecordBatch], dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.asarray(b.column(0)) for b in held]), np.concatenate([_matrix(b.column(2), dim) for b in held])


def _bound(product: np.ndarray | float, norm: float, reach: np.ndarray | float) -> np.ndarray:
    """No inner product with what lies within ``reach`` of a centre is above this; infinite where that cannot be told."""
    with np.errstate(over="ignore", invalid="ignore"):
        slack = norm * reach
        return np.nan_to_num(product + slack + ROUNDING * (1 + np.abs(product) + slack), nan=np.inf, posinf=np.inf, neginf=np.inf)


def _highest(product: float, norm: float, reach: float) -> float:
    """``_bound`` of one ball."""
    slack = norm * reach
    bound = product + slack + ROUNDING * (1 + abs(product) + slack)
    return bound if bound == bound else math.inf


def sent(queries: DataFrame, balls: list | None, parts: int) -> DataFrame:
    """Queries (q_id, key, dim, floor, members) by the part that they go to: those whose ball may hold a score of the floor."""
    held = None
    if balls is not None:
        by: dict[int, list] = {}
        for r in balls:
            by.setdefault(r.dim, []).append((r.part, np.frombuffer(r.centre), np.frombuffer(r.reach)[0]))
        held = {d: (np.array([p for p, _, _ in x], np.int32), np.array([c for _, c, _ in x]).reshape(len(x), d), np.array([r for _, _, r in x])) for d, x in by.items()}
        held = queries.sparkSession.sparkContext.broadcast(held)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows, to = [], []
            for i, (dim, floor, members) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if held is None:
                    mine = np.arange(parts)
                else:
                    mine, centres, reach = held.value[dim]
                    if floor is not None:
                        q = np.frombuffer(members)
                        with np.errstate(over="ignore", invalid="ignore"):
                            mine = mine[_bound(centres @ q, float(np.sqrt(q @ q)), reach) >= floor]
                rows.append(np.full(len(mine), i))
                to.append(mine)
            at = np.concatenate(rows) if rows else np.empty(0, int)
            out = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(to).astype(np.int32))], ["dim", "floor", "members", "q_id", "key", "part"])

    typed = queries.select("dim", "floor", "members", "q_id", "key")
    return typed.mapInArrow(run, "dim int, floor double, members binary, q_id long, key long, part int")


class Part:
    """The subtrees of one part that a task holds, of one dimension."""

    def __init__(self, rows: list[dict], dim: int):
        self.trees = []
        for r in rows:
            number = lambda n, t=np.float64, r=r: np.frombuffer(r[n], t)
            t = {n: number(n) for n in ("own", "reach", "apart")} | {n: number(n, np.int32) for n in ("up", "begin", "stop")} | {n: number(n, np.int64) for n in ("ids", "low")}
            t |= {"members": number("members").reshape(len(t["ids"]), dim), "centre": number("centre").reshape(len(t["reach"]), dim)}
            below: list[list[int]] = [[] for _ in t["up"]]
            for i, u in enumerate(t["up"].tolist()):
                if u >= 0:
                    below[u].append(i)
            t |= {n: t[n].tolist() for n in ("reach", "apart", "begin", "stop", "low")}
            self.trees.append(t | {"below": below, "small": _small(t["members"])})
        self.pages = sum(not b for t in self.trees for b in t["below"])
        #: Pages whose members were multiplied, over all searches.
        self.visited = 0

    def search(self, q: np.ndarray, own_id: int, k: int, floor: float | None = None) -> list[tuple[int, int]]:
        """The k best (score, -id), or those of them that reach ``floor``."""
        with np.errstate(over="ignore", invalid="ignore"):
            norm = float(np.sqrt(q @ q))
        small = _small(q)
        best: list[tuple[int, int]] = []
        queue: list[tuple] = []
        count = 0

        def hopeless(bound: float, low: int) -> bool:
            """Whether nothing under this bound, with ids of at least ``low``, can enter the k best."""
            if len(best) < k:
                return floor is not None and bound < floor
            return bound < best[0][0] or (bound < best[0][0] + 1 and -low < best[0][1])

        def offer(t: dict, at: int, product: float) -> None:
            nonlocal count
            bound = _highest(product, norm, t["reach"][at])
            if not hopeless(bound, t["low"][at]):
                heapq.heappush(queue, (-bound, count, t, at, product))
                count += 1

        with np.errstate(over="ignore", invalid="ignore"):
            for t in self.trees:
                offer(t, 0, float(t["centre"][0] @ q))
            while queue:
                bound, _, t, at, product = heapq.heappop(queue)
                if hopeless(-bound, t["low"][at]):
                    if len(best) == k and -bound < best[0][0] - 1:
                        break  # bounds only fall from here
                    continue
                if t["below"][at]:
                    for child in t["below"][at]:
                        # What the node above knows of the child, before its own product is computed.
                        if not hopeless(_highest(product, norm, t["apart"][child] + t["reach"][child]), t["low"][child]):
                            offer(t, child, float(t["centre"][child] @ q))
                    continue
                self._page(t, at, q, product, norm, own_id, k, floor, small, best)
        return best

    def _page(self, t: dict, at: int, q: np.ndarray, product: float, norm: float, own_id: int, k: int, floor: float | None, small: bool, best: list) -> None:
        self.visited += 1
        begin, stop = t["begin"][at], t["stop"][at]
        least = best[0][0] if len(best) == k else floor
        if least is not None and norm:
            # Members lie in the order of their distance to the centre; the near ones cannot reach far above its product.
            away = (least - product - ROUNDING * (1 + abs(product))) / (norm * (1 + ROUNDING))
            if away > 0:
                begin += int(np.searchsorted(t["own"][begin:stop], away * (1 - ROUNDING)))
        rows, ids = t["members"][begin:stop], t["ids"][begin:stop]
        stay = ids != own_id
        rows, ids = rows[stay], ids[stay]
        if small and t["small"]:
            scores = rows @ q
            if least is not None:
                stay = scores >= least
                scores, ids = scores[stay], ids[stay]
            top = np.lexsort((ids, -scores))[:k]
            found = [(int(scores[i]), -int(ids[i])) for i in top]
        else:
            whole = [int(x) for x in q]
            exact = (sum(int(a) * b for a, b in zip(r, whole, strict=True)) for r in rows)
            found = [(min(max(score, -_LONG), _LONG - 1), -int(i)) for score, i in zip(exact, ids, strict=True)]
        for item in found:
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)


def answers(trees: DataFrame, queries: DataFrame, parts: int, k: int = K) -> DataFrame:
    """The k best of every part for the queries that came to it: query_id, key, vec_id, score."""
    given = trees.where("ids is not null").select("part", "dim", *_NAMES[5:], *(F.lit(None).cast(t).alias(c) for c, t in (("q_id", "long"), ("key", "long"), ("floor", "double"))))
    empty = {c: F.lit(None).cast("binary").alias(c) for c in _NAMES[5:]}
    asked = queries.select("part", "dim", *(F.col("members") if c == "members" else empty[c] for c in _NAMES[5:]), "q_id", "key", "floor")
    dealt = given.unionByName(asked).repartitionByRange(parts, "part").sortWithinPartitions("part", "dim", F.col("q_id").isNotNull())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for batch in slices(batches, 64):
            out: list[tuple] = []
            for r in batch.to_pylist():
                if (r["part"], r["dim"]) != now:
                    now, held, tree = (r["part"], r["dim"]), [], None
                if r["q_id"] is None:
                    held.append(r)
                    continue
                if tree is None:
                    tree, held = Part(held, r["dim"]), []
                for score, negative in tree.search(np.frombuffer(r["members"]), r["q_id"], k, r["floor"]):
                    out.append((r["q_id"], r["key"], -negative, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "key", "vec_id", "score"])

    return dealt.mapInArrow(run, "query_id long, key long, vec_id long, score long")


def _built(table: DataFrame, every: int, id_col: str, vector_col: str, k: int) -> tuple[DataFrame, int]:
    """The written tree (see TREE) of a table, and its number of parts."""
    scratch = Scratch(table.sparkSession, "search")
    vectors = scratch.put(usable(table, id_col, vector_col), "vectors")
    parts = max(partitions(table.sparkSession), -(-vectors.count() // PART_ROWS))
    return scratch.put(build(ranged(vectors, pivots_of(vectors), parts), every, k), "tree"), parts


def _sent_queries(tree: DataFrame, parts: int) -> DataFrame:
    ball = tree.where("ids is null and q_id is null")
    values = ball.agg(F.coalesce(F.sum(F.col("dim") + 2), F.lit(0)).alias("n")).first().n
    queries = tree.where("q_id is not null").dropDuplicates(["q_id", "dim", "key"])
    return sent(queries, ball.select("part", "dim", "centre", "reach").collect() if values <= BALL_VALUES else None, parts)


def search(table: DataFrame, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """For each row whose id is divisible by ``every``: its k best other rows. query_id, rank, vec_id, score."""
    tree, parts = _built(table, every, id_col, vector_col, k)
    found = answers(tree, _sent_queries(tree, parts), parts, k)
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def visited(table: DataFrame, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> tuple[float, float]:
    """What the tree saves on a table that fits one machine: the share of (query, part) pairs that are sent, and of pages
    whose members a query is multiplied with."""
    tree, parts = _built(table, every, id_col, vector_col, k)
    queries = tree.where("q_id is not null").count()
    rows = [r.asDict() for r in tree.where("ids is not null").collect()]
    held = {key: Part([r for r in rows if (r["part"], r["dim"]) == key], key[1]) for key in {(r["part"], r["dim"]) for r in rows}}
    come = _sent_queries(tree, parts).collect()
    for r in come:
        if (r.part, r.dim) in held:
            held[r.part, r.dim].search(np.frombuffer(r.members), r.q_id, k, r.floor)
    pages = sum(p.pages for p in held.values())
    return len(come) / max(1, queries * len(held)), sum(p.visited for p in held.values()) / max(1, queries * pages)
