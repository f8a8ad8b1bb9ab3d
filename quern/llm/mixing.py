"""Mixing sources to target weights with nested hash thresholds.

Sizes are summed per source, targets follow from the weights by water filling, and each source takes its documents whole
so many times, plus once more those whose hash lies under a threshold. The threshold comes from histograms: sizes summed
by source and hash bucket give the bucket in which the budget is met; only that bucket is refined by the next bits. No
documents are sorted, and no group of documents meets in one task: a plan of few sources is broadcast, after a count of
them, and sums combine before they move.

Defined results: a null text has size 0. Sources are ordered by code point with null last. Documents that repeat both id
and text have one hash, so they are taken together. A source of size 0 has target 0. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, broadcast_small, fresh, text_or_empty

#: Levels of the histograms and bits refined at each: 48 bits of hash in all.
LEVELS, BITS = 4, 12
#: A source's target is at most so many times its size.
MOST = 3


def word_count(text: Column) -> Column:
    """Number of runs of characters outside [\\x20\\x09-\\x0D]."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def doc_hash(doc_id: Column, text: Column) -> Column:
    """48 bits that depend on the document alone, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text))), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """``sizes`` (source, source_size) with weight, target, copies (whole) and budget (words beyond the whole copies).

    The total is shared by weight; a target stops at MOST times its source and the excess is shared again. In order of
    MOST * size / weight, the sources that stop are a prefix, so one pass of running sums finds the level. The table has a
    row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))).cast("int") + 1).cast("long")
    t = sizes.select("source", "source_size", weight.alias("weight"), (MOST * F.col("source_size")).alias("most"))
    by_ratio = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = t.withColumns({"left": F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)), "weights": F.sum("weight").over(after)})
    free = F.col("left") * F.col("weight") <= F.col("most") * F.col("weights")
    level = F.min(F.when(free, F.struct((F.col("most") / F.col("weight")).alias("ratio"), F.col("left"), F.col("weights")))).over(everything)
    t = t.withColumn("level", level)
    # Sources before the level stop at their most; from it on, each takes its weight's share of what is left.
    share = F.col("weight") * F.col("level.left") / F.col("level.weights")
    stops = F.col("weight") * F.col("level.left") >= F.col("most") * F.col("level.weights")
    target = F.when(F.col("level").isNull() | stops, F.col("most").cast("double")).otherwise(share)
    t = t.withColumn("target", target)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return t.select("source", "source_size", "target", copies.alias("copies"), (F.col("target") - copies * F.col("source_size")).alias("budget"))


def thresholds(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``until``: documents whose hash is below it are taken once more.

    ``docs`` has source, size, hash. Each level sums sizes within the bucket that the level before has found.
    """
    few = targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    open_ = targets.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = docs.join(F.broadcast(open_) if few else open_, docs["source"].eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + BITS) == F.col("prefix")))
        cells = inside.groupBy("source", F.shiftright("hash", shift).alias("cell")).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
        met = cells.withColumn("sum", run).where(F.col("sum") > F.col("left"))
        met = met.groupBy(F.col("source").alias("s")).agg(F.min_by(F.struct("cell", "words", "sum", "left"), "cell").alias("m"))
        last = level == LEVELS
        # In the last cell, take it whole if that comes nearer to the budget.
        cell = F.col("m.cell") + (F.when(F.col("m.sum") - F.col("m.left") < F.col("m.left") - F.col("m.sum") + F.col("m.words"), 1).otherwise(0) if last else 0)
        open_ = met.select("s", cell.cast("long").alias("prefix"), (F.col("m.left") - F.col("m.sum") + F.col("m.words")).alias("left"))
    until = F.coalesce(F.col("prefix"), F.lit(1 << (BITS * LEVELS)).cast("long"))
    return targets.join(open_, targets["source"].eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "copies", F.when(F.col("budget") > 0, until).otherwise(0).alias("until"))


def plan_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per source: source, source_size, target, copies, until (a table with a row per source, written once)."""
    scratch = Scratch(docs.sparkSession, "mix")
    text = text_or_empty(text_col)
    small = scratch.put(docs.select(F.col(source_col).alias("source"), word_count(text).alias("size"), doc_hash(F.col(id_col), text).alias("hash")), "sizes")
    sizes = small.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = scratch.put(source_targets(sizes, weights), "targets")
    plan = scratch.put(thresholds(small, targets), "plan")
    scratch.drop(small, targets)
    return plan


def _mixed(docs: DataFrame, weights: Sequence[int], id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, str]:
    """``docs`` with size, source_size, target and times under a prefix that no column has; and the prefix."""
    plan = plan_mix(docs, weights, id_col, text_col, source_col)
    p = fresh(docs)
    plan = broadcast_small(plan.select(*(F.col(c).alias(p + c) for c in plan.columns)))
    text = text_or_empty(text_col)
    out = docs.join(plan, F.col(source_col).eqNullSafe(F.col(p + "source")), "left")
    times = F.col(p + "copies") + (doc_hash(F.col(id_col), text) < F.col(p + "until")).cast("long")
    return out.withColumns({p + "size": word_count(text), p + "times": times}).drop(p + "source", p + "copies", p + "until"), p


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and times (how often the mix takes the document); columns of these names in
    ``docs`` are replaced."""
    out, p = _mixed(docs, weights, id_col, text_col, source_col)
    new = ["size", "source_size", "target", "times"]
    keep = [c for c in docs.columns if c not in new or c in (id_col, text_col, source_col)]
    return out.select(*keep, *(F.col(p + c).alias(c) for c in new))


def take_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1)) -> DataFrame:
    """The mixed documents with all their columns as they are: each row as often as the mix takes it."""
    out, p = _mixed(docs, weights, "doc_id", "text", "source")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col(p + "times"))).alias(p + "copy")
    return out.where(F.col(p + "times") > 0).select(*docs.columns, copies).drop(p + "copy")
