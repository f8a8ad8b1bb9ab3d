"""Pairs of chosen and rejected responses of each key, without their product.

Whether a rejected answer contains a chosen one is read from an index: the parts of rejected answers, of the lengths that
chosen answers of the key have, meet the chosen answers by key and part. Rejected answers of a key lie in buckets by hash. From
counts per bucket follows which buckets hold, for a chosen answer, rejected answers that don't contain it; only the first
of these are opened, until there are enough partners. So a key costs its rows, the parts of its answers and k pairs, however
many responses it has; its rows are never one task's work, as all steps go by answer, part or bucket.

Keys are compared as a whole, and null parts of a key are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import settled

#: Most buckets of a key, as a power of two.
BUCKET_BITS = 12


def first_of(rows: DataFrame, by: list[str], k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows of each group. Spark cuts groups to k rows before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("q_rank", rank).where(F.col("q_rank") <= k).drop("q_rank")


def by_answer(rows: DataFrame, answer: str, k: int, seed: int, meta: list[str]) -> DataFrame:
    """Distinct answers of each key (q_key, q_a), with ``k`` of their responses at most as q_items."""
    few = first_of(rows.dropDuplicates(["q_key", answer, "response"]), ["q_key", answer], k, F.xxhash64(F.lit(seed), "response"), "response")
    return few.groupBy("q_key", answer).agg(F.sort_array(F.collect_list(F.struct("response", *meta))).alias("q_items"))


def entailed(chosen: DataFrame, rejected: DataFrame, a: str = "q_a", b: str = "q_b") -> DataFrame:
    """(q_key, a, b) where the rejected answer ``b`` contains the chosen answer ``a``; both tables have distinct answers.

    A rejected answer of n characters has at most n parts of each length that chosen answers of its key have.
    """
    sizes = chosen.select("q_key", F.char_length(a).alias("q_n")).distinct()
    sized = rejected.select("q_key", b).join(sizes, "q_key").where(F.char_length(b) >= F.col("q_n"))
    placed = sized.select("q_key", b, "q_n", F.explode(F.sequence(F.lit(1), F.when(F.col("q_n") == 0, 1).otherwise(F.char_length(b) - F.col("q_n") + 1))).alias("q_at"))
    parts = placed.select("q_key", b, F.substring(F.col(b), F.col("q_at"), F.col("q_n")).alias(a)).distinct()
    return parts.join(chosen.select("q_key", a), ["q_key", a])


def partners(chosen: DataFrame, rejected: DataFrame, entails: DataFrame | None, k: int, seed: int) -> DataFrame:
    """Of the first ``k`` chosen answers of each key that have any partner, the first ``k`` partners each: rejected answers
    that ``entails`` doesn't hold. (q_key, q_a, q_b, q_turn), with q_turn from 1.

    k chosen answers with a partner each are k pairs, so no more of them are needed.
    """
    sizes = rejected.groupBy("q_key").agg(F.count("*").alias("q_all"))
    bits = F.greatest(F.lit(0), F.least(F.lit(BUCKET_BITS), F.ceil(F.log2(F.col("q_all") / k)).cast("int")))
    h = lambda c: F.xxhash64(F.lit(seed), c)
    placed = rejected.select("q_key", "q_b").join(sizes, "q_key").withColumn("q_bucket", F.pmod(h("q_b"), F.pow(F.lit(2), bits).cast("long")).cast("int")).select("q_key", "q_b", "q_bucket")
    open_ = chosen.select("q_key", "q_a").join(sizes, "q_key")
    if entails is not None:
        taken = entails.groupBy("q_key", "q_a").agg(F.count("*").alias("q_taken"))
        open_ = open_.join(taken, ["q_key", "q_a"], "left").where(F.col("q_all") > F.coalesce("q_taken", F.lit(0)))
    open_ = settled(first_of(open_.select("q_key", "q_a"), ["q_key"], k, h("q_a"), "q_a"))
    held = placed.groupBy("q_key", "q_bucket").agg(F.count("*").alias("q_free"))
    free = open_.join(held, "q_key")
    if entails is not None:
        own = entails.join(open_, ["q_key", "q_a"]).join(placed, ["q_key", "q_b"]).groupBy("q_key", "q_a", "q_bucket").agg(F.count("*").alias("q_not"))
        free = free.join(own, ["q_key", "q_a", "q_bucket"], "left").withColumn("q_free", F.col("q_free") - F.coalesce("q_not", F.lit(0))).where("q_free > 0")
    before = F.sum("q_free").over(Window.partitionBy("q_key", "q_a").orderBy("q_bucket").rowsBetween(Window.unboundedPreceding, -1))
    opened = free.withColumn("q_before", F.coalesce(before, F.lit(0))).where(F.col("q_before") < k).select("q_key", "q_a", "q_bucket")
    found = opened.join(placed, ["q_key", "q_bucket"])
    if entails is not None:
        found = found.join(entails, ["q_key", "q_a", "q_b"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("q_key", "q_a").orderBy("q_bucket", h("q_b"), "q_b"))
    return found.withColumn("q_turn", turn).where(F.col("q_turn") <= k).select("q_key", "q_a", "q_b", "q_turn")


def pair_up(pos: DataFrame, neg: DataFrame, keys: list[str], k: int, seed: int, entailment: bool, meta: list[str]) -> DataFrame:
    """At most ``k`` pairs (keys, chosen, rejected, their meta) of rows (keys, q_a or q_b, response, meta) per key.

    Partners come in turns: every chosen answer's first, then every second one, so that a few answers don't take all pairs.
    Of a pair of answers, k pairs of responses can be taken.
    """
    key = F.struct(*keys).alias("q_key")
    chosen = settled(by_answer(pos.select(key, "q_a", "response", *meta), "q_a", k, seed, meta))
    rejected = settled(by_answer(neg.select(key, "q_b", "response", *meta), "q_b", k, seed, meta))
    entails = None if entailment else settled(entailed(chosen, rejected))
    found = partners(chosen, rejected, entails, k, seed)
    sized = found.join(chosen.select("q_key", "q_a", F.size("q_items").alias("q_m")), ["q_key", "q_a"]).join(rejected.select("q_key", "q_b", F.size("q_items").alias("q_n")), ["q_key", "q_b"])
    order = [F.col("q_turn"), F.xxhash64(F.lit(seed), "q_a"), F.col("q_a")]
    ahead = F.sum(F.col("q_m") * F.col("q_n")).over(Window.partitionBy("q_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    few = sized.withColumn("q_ahead", F.coalesce(ahead, F.lit(0))).where(F.col("q_ahead") < k)
    both = few.join(chosen.withColumnRenamed("q_items", "q_c"), ["q_key", "q_a"]).join(rejected.withColumnRenamed("q_items", "q_r"), ["q_key", "q_b"])
    crossed = F.flatten(F.transform("q_c", lambda c: F.transform("q_r", lambda r: F.struct(c.alias("c"), r.alias("r")))))
    pairs = both.select("q_key", F.explode(F.slice(crossed, F.lit(1), F.lit(k) - F.col("q_ahead").cast("int"))).alias("q_pair"))
    sides = [F.col(f"q_pair.{x}.{c}").alias(name if c == "response" else f"{name}_{c}") for x, name in (("c", "chosen"), ("r", "rejected")) for c in ("response", *meta)]
    return pairs.select(*(F.col(f"q_key.{c}").alias(c) for c in keys), *sides)
