"""Packing, padding and batches over document lengths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import packing
from .registry import query

_LIMITS = packing.Limits(tokens=4096, images=6, buffers=20, overflow=True)
#: Documents that a shard packs, about; small tables still have eight shards.
_SHARD_ROWS = 4096


def _samples(t):
    return t("documents").select(F.col("doc_id").alias("sample"), ((F.col("n_chars") / 4).cast("int") + 1).alias("tokens"), (F.col("doc_id") % 3).cast("int").alias("images"))


def _pieces(t):
    """All tokens of all documents in pieces of at most the limit; long documents go on in the next piece."""
    shards = max(8, -(-t("documents").count() // _SHARD_ROWS))
    return packing.cut_packs(packing.pack_samples(_samples(t), _LIMITS, shards), _LIMITS.tokens)


@query()
def pack_sequences(t):
    return _pieces(t)


@query()
def pack_report(t):
    return packing.pack_stats(_pieces(t), _LIMITS)


@query("""WITH p AS (SELECT source AS pack, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, doc_id, (n_chars % 7)::INTEGER AS tokens FROM documents)
SELECT doc_id, coalesce(sum(tokens) OVER (PARTITION BY pack ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS offset FROM p""".replace(" AS offset", ' AS "offset"'))
def pack_offsets(t):
    place = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("place")
    packs = t("documents").select(F.col("source").alias("pack"), place, "doc_id", (F.col("n_chars") % 7).cast("int").alias("tokens"))
    return packing.pack_offsets(packs, ["pack"]).select("doc_id", "offset")


@query("""WITH p AS (SELECT conv_id, turn, (length(text) % 9 + 1)::INTEGER AS tokens, (length(text) % 4)::INTEGER AS learned FROM conversations)
SELECT conv_id, sum(tokens)::INTEGER AS tokens, round(sum(tokens * CASE WHEN learned > 0 THEN 1 / sqrt(learned) ELSE 0 END), 6) AS weight, count(*)::INTEGER + 1 AS ends FROM p GROUP BY conv_id""")
def cu_seqlens(t):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    packs = t("conversations").select(F.col("conv_id").alias("pack"), F.lit(0).alias("shard"), place.alias("place"), (F.char_length("text") % 9 + 1).cast("int").alias("tokens"), (F.char_length("text") % 4).cast("int").alias("learned"), F.lit(0).alias("images"))
    out = packing.packed_rows(packs)
    return out.select(F.col("pack").alias("conv_id"), "tokens", F.round(F.aggregate("loss_weight", F.lit(0.0), lambda s, x: s + x), 6).alias("weight"), F.size("cu_seqlens").alias("ends"))


@query("""WITH r AS (SELECT conv_id, turn, (length(text) % 9 + 1)::INTEGER AS n FROM conversations)
SELECT conv_id, turn, (max(n) OVER (PARTITION BY conv_id))::INTEGER AS size, (n * (n + 1) // 2)::BIGINT AS ids, n::BIGINT AS mask, ((max(n) OVER (PARTITION BY conv_id)) - n)::INTEGER AS ignored FROM r""")
def pad_batch(t):
    ids = F.sequence(F.lit(1), (F.char_length("text") % 9 + 1).cast("int"))
    rows = t("conversations").select("conv_id", "turn", ids.alias("input_ids"), ids.alias("labels"))
    out = packing.pad_batch(rows, "conv_id")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("conv_id", "turn", F.size("input_ids").alias("size"), total("input_ids").alias("ids"), total("attention_mask").alias("mask"), F.size(F.filter("labels", lambda x: x == -100)).alias("ignored"))


@query()
def length_batches(t):
    rows = t("documents").select("doc_id", F.col("n_chars").alias("length"))
    return packing.length_batches(rows, 4, 8, "doc_id").select("doc_id", "mega", "place", "shard")
