"""Counting, manifests, shards, sampling and mixtures of datasets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import repeat_factors, settled, with_counts


def row_number(order: str | list[str], by: list[str] | None = None) -> Column:
    """Number of a row from 0 in its group."""
    order = [order] if isinstance(order, str) else order
    return (F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)) - 1).cast("long")


def numbered(rows: DataFrame, order: Column | str, name: str = "rn", by: Sequence[str] = (), ties: Sequence[Column | str] = ()) -> DataFrame:
    """``rows`` with their rank from 0 over the whole table, or in each group of ``by``, in the order of ``order`` and then
    ``ties``; together they should be unique.

    Spark divides the rows into sorted ranges, as many as their size asks for, also inside a group or a value that many rows
    share. The rows are written once with their place in their range; a rank is that place, plus the rows of the ranges
    before, less those before the group.
    """
    keys = [*by, order, *ties]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("q_at", F.monotonically_increasing_id())
    placed = settled(placed.withColumn("q_range", F.shiftright("q_at", 33)).withColumn("q_place", F.col("q_at").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("q_range").agg(F.count("*").alias("q_n"))
    earlier = Window.orderBy("q_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = sizes.select("q_range", F.coalesce(F.sum("q_n").over(earlier), F.lit(0)).alias("q_before"))
    ranked = placed.join(F.broadcast(before), "q_range").withColumn(name, F.col("q_before") + F.col("q_place"))
    if by:
        key = F.struct(*by)
        first = ranked.groupBy(key.alias("q_key")).agg(F.min(name).alias("q_first"))
        ranked = ranked.join(first, key == F.col("q_key")).withColumn(name, F.col(name) - F.col("q_first"))
    return ranked.select(*(c for c in rows.columns if c != name), name)


def _hash_ranked(rows: DataFrame, order: str, by: list[str], seed: int) -> DataFrame:
    """``rows`` with q_rn, their rank in their group by a seeded hash."""
    hashed = rows.withColumn("q_h", F.xxhash64(F.lit(seed), *by, order))
    return numbered(hashed, "q_h", name="q_rn", by=by, ties=[order]).drop("q_h")


def shard_balanced(rn: Column, total: Column, n: int) -> Column:
    """Contiguous shards; the first ones have one row more."""
    size, left = F.floor(total / n), total % n
    wide = left * (size + 1)
    return F.when(rn < wide, F.floor(F.try_divide(rn, size + 1))).otherwise(left + F.floor(F.try_divide(rn - wide, size))).cast("int")


def shard_truncated(rn: Column, total: Column, n: int) -> Column:
    """Contiguous shards of total // n rows; null for the rows of the tail."""
    size = F.floor(total / n)
    return F.when((size > 0) & (rn < size * n), F.floor(F.try_divide(rn, size))).cast("int")


def shard_stride(rn: Column, n: int) -> Column:
    return F.pmod(rn, F.lit(n)).cast("int")


def stride_sample(rn: Column, total: Column, most: int, start: int = 0) -> Column:
    """Every (total // most)-th row from ``start``, ``most`` at most."""
    step = F.greatest(F.floor(total / most), F.lit(1))
    return (rn >= start) & (F.pmod(rn - start, step) == 0) & (F.floor((rn - start) / step) < most)


def repeat_rows(rows: DataFrame, factor: Column | float, order: str, by: list[str], shuffle_seed: int | None = None) -> DataFrame:
    """Rows of each group as often as the factor says: below 1 a prefix (or, with a seed, a hash-ordered part), above 1
    whole copies. The factor may be a column that is constant in a group."""
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    ranked = numbered(rows, order, name="q_rn", by=by) if shuffle_seed is None else _hash_ranked(rows, order, by, shuffle_seed)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("q_n"))
    marked = ranked.join(sizes, by).withColumn("q_f", factor)
    copies = F.when(F.col("q_f") < 1, (F.col("q_rn") < F.floor(F.col("q_n") * F.col("q_f"))).cast("int")).otherwise(F.floor("q_f").cast("int"))
    kept = marked.withColumn("q_c", copies).where("q_c > 0")
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("q_c") - 1))).select(*rows.columns, "copy")


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key)


def mixture_weights(sizes: DataFrame, size: str = "length", root: bool = True) -> DataFrame:
    """Weights by size or its root, with sum 1. One row per dataset."""
    w = F.sqrt(F.col(size)) if root else F.col(size).cast("double")
    return sizes.withColumn("weight", w / F.sum(w).over(Window.partitionBy()))


def weighted_quota(weights: DataFrame, total: int) -> DataFrame:
    """Rows to draw from each dataset."""
    return weights.withColumn("quota", F.rint(F.col("weight") * total).cast("long"))


#: Draws that one row stands for before they are made.
DRAWS = 1 << 16


def draw_with_replacement(rows: DataFrame, quotas: DataFrame, order: str, seed: int = 42) -> DataFrame:
    """Each dataset's quota of draws: a seeded hash of the draw's number picks a row, each as likely at every draw, so some
    rows come several times and some not at all. ``order`` is a unique integer column; a dataset without rows gives none."""
    ranked = numbered(rows, order, name="q_rn", by=["dataset"])
    sizes = rows.groupBy(F.col("dataset").alias("q_d")).agg(F.count("*").alias("q_n"))
    met = quotas.select("dataset", F.col("quota").cast("long").alias("quota")).join(sizes, F.col("dataset").eqNullSafe(F.col("q_d"))).where("quota > 0")
    # In blocks, so that no array is as long as a quota.
    blocks = met.withColumn("q_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1, F.lit(DRAWS).cast("long"))))
    draws = blocks.withColumn("draw", F.explode(F.sequence("q_from", F.least(F.col("q_from") + DRAWS, F.col("quota")) - 1)))
    picked = draws.select("q_d", F.pmod(F.xxhash64(F.lit(seed), "dataset", "draw"), F.col("q_n")).alias("q_at"), "draw")
    return ranked.join(picked, F.col("dataset").eqNullSafe(F.col("q_d")) & (F.col("q_rn") == F.col("q_at"))).select(*rows.columns, "draw")


def sample_rows(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, in hash order."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def few_shot(rows: DataFrame, pool: DataFrame, k: int, key: str, pool_key: str, text: str, seed: int = 42) -> DataFrame:
    """``rows`` (of a unique ``key``) with k examples of ``pool``, or all of a smaller one: neighbours in the pool's hash order,
    from a place that a hash of the row's key picks. ``pool_key`` is an integer column."""
    hashed = pool.select(F.col(pool_key).alias("q_key"), F.col(text).alias("q_text")).withColumn("q_h", F.xxhash64(F.lit(seed), "q_key"))
    ranked = numbered(hashed, "q_h", name="q_at", ties=["q_key"]).select("q_at", "q_text")
    total = pool.count()
    wanted = rows.withColumn("q_i", F.explode(F.sequence(F.lit(0), F.lit(min(k, total) - 1)))) if min(k, total) else rows.withColumn("q_i", F.lit(None).cast("int"))
    placed = wanted.withColumn("q_at", F.pmod(F.xxhash64(F.lit(seed + 1), key) + F.col("q_i"), F.lit(max(total, 1))))
    found = placed.join(ranked, "q_at", "left").groupBy(F.col(key).alias("q_row")).agg(F.array_sort(F.collect_list(F.when(F.col("q_i").isNotNull(), F.struct("q_i", "q_text")))).alias("q_list"))
    return rows.join(found, F.col(key).eqNullSafe(F.col("q_row")), "left").select(*rows.columns, F.transform("q_list", lambda x: x["q_text"]).alias("examples"))


def take_from_cursors(rows: DataFrame, cursors: DataFrame, line: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """The next rows of each dataset from where it stopped, beginning anew at its end: ``rows`` (dataset, numbered from 0)
    with turn (how often the dataset was begun anew before), and the cursors to go on from.

    ``cursors`` has dataset, position (null: 0) and quota. A dataset without rows gives none and keeps its cursor.
    """
    sizes = rows.groupBy("dataset").agg(F.count("*").alias("q_n"))
    plan = cursors.select("dataset", F.coalesce("position", F.lit(0)).cast("long").alias("q_p"), F.col("quota").cast("long").alias("q_q")).join(sizes, "dataset", "left")
    met = rows.join(plan, "dataset")
    first = F.ceil((F.col("q_p") - F.col(line)) / F.col("q_n"))
    last = F.floor((F.col("q_p") + F.col("q_q") - 1 - F.col(line)) / F.col("q_n"))
    taken = met.where(last >= first).withColumn("turn", F.explode(F.sequence(first.cast("long"), last.cast("long")))).select(*rows.columns, "turn")
    after = F.coalesce(F.try_mod(F.col("q_p") + F.col("q_q"), F.col("q_n")), F.col("q_p"))
    return taken, plan.select("dataset", after.alias("position"), F.col("q_q").alias("quota"))


def sorted_rows(rows: DataFrame, *keys: str | Column, descending: bool = False) -> DataFrame:
    """Rows in the order of the keys, as a total order over range partitions."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return rows.orderBy(*(c.desc() if descending else c for c in cols))


def first_lines(rows: DataFrame, n: int, line: str = "line_no") -> DataFrame:
    """The first ``n`` lines of each file, by their number."""
    return rows.where(F.col(line) < n)


def entry_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset").count()


def mixture_manifest(rows: DataFrame, manifest: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """A manifest entry for each dataset that has rows, with its length."""
    defaults = defaults or {"root": "", "annotation": "", "data_augment": False, "max_dynamic_patch": 12, "repeat_time": 1.0}
    return with_counts(manifest, entry_counts(rows), defaults)


def token_counts(rows: DataFrame, tokens: Column) -> DataFrame:
    """Entries and tokens by (cluster, dataset), with subtotals: level 0 pair, 1 cluster, 3 everything."""
    return rows.withColumn("q_t", tokens).rollup("cluster", "dataset").agg(F.count("*").alias("entries"), F.sum("q_t").alias("tokens"), F.grouping_id().alias("level"))


def adjusted_tokens(counts: DataFrame, manifest: DataFrame, cluster_manifests: DataFrame) -> DataFrame:
    """Tokens times repeat factor by (cluster, dataset), with each cluster's share of its dataset."""
    repeats = repeat_factors(counts.select("dataset").distinct(), manifest, cluster_manifests)
    out = counts.join(repeats, "dataset").withColumn("adjusted", F.col("tokens") * F.col("repeat_time"))
    return out.withColumn("share", F.try_divide(F.col("adjusted"), F.sum("adjusted").over(Window.partitionBy("dataset"))))


def build_mixture(read: Callable[[str], DataFrame], manifest: DataFrame, order: str = "line_no") -> DataFrame:
    """All datasets of a manifest (a row each), repeated by their factor, as one table with dataset."""
    out = None
    for entry in manifest.select("dataset", "annotation", "repeat_time").orderBy("dataset").collect():
        part = repeat_rows(read(entry.annotation).withColumn("dataset", F.lit(entry.dataset)), float(entry.repeat_time), order, ["dataset"])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
