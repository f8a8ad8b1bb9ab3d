"""Packing of samples into bounded sequences by first fit, batches of near lengths, and padding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chat import length_weight
from .joins import settled

IGNORE = -100


@dataclass
class Limits:
    """Bounds of a pack, and of the open buffers that a shard keeps."""

    tokens: int = 32768
    images: int = 6
    buffers: int = 100
    overflow: bool = True


@dataclass
class Buffers:
    """Open packs of one shard, kept by falling image count. A pack is (tokens, images, sample ids)."""

    limits: Limits
    open: list[tuple[int, int, list]] = field(default_factory=list)

    def _choice(self, tokens: int, images: int) -> int | None:
        """The first pack with room for both; where there is none and half of the buffers are open, overflow takes the last
        with room for the images."""
        room = [i for i, (_, m, _) in enumerate(self.open) if m + images <= self.limits.images]
        whole = [i for i in room if self.open[i][0] + tokens <= self.limits.tokens]
        crowded = self.limits.overflow and len(self.open) >= self.limits.buffers // 2
        return min(whole, default=max(room, default=None) if crowded else None)

    def add(self, sample, tokens: int, images: int) -> list[tuple[int, int, list]]:
        """Packs that are ready once a sample has come in. A pack over the token limit is ready too; cut it later. A sample
        with more images than a pack may have is a pack of its own."""
        if images > self.limits.images:
            return [(tokens, images, [sample])]
        i = self._choice(tokens, images)
        t, m, ids = self.open.pop(i) if i is not None else (0, 0, [])
        pack = (t + tokens, m + images, [*ids, sample])
        if pack[0] >= self.limits.tokens or pack[1] == self.limits.images:
            return [pack]
        place = next((j for j, p in enumerate(self.open) if p[1] < pack[1]), len(self.open))
        self.open.insert(place, pack)
        ready = []
        while len(self.open) > self.limits.buffers:
            ready.append(self.open.pop(0))
        return ready

    def flush(self) -> list[tuple[int, int, list]]:
        ready, self.open = self.open, []
        return ready


PACK_SCHEMA = "shard int, pack long, place int, sample long, tokens int, images int, offset int"
#: Shards whose open packs meet in one, and where the numbers of packs of the next meeting begin.
MEET, LEVEL = 16, 1 << 40


def over_limit(samples: DataFrame, limits: Limits) -> DataFrame:
    """Samples with more images than a pack may have: each is a pack of its own."""
    return samples.where(F.col("images") > limits.images)


def _pass(dealt: DataFrame, limits: Limits, shards: int, first: int) -> DataFrame:
    """Packs of ``dealt`` (sample, tokens, images, shard), numbered from ``first`` in each shard; open says that a pack was
    still open when its shard ended. Shard i is partition i."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, buffers, count, held = None, Buffers(limits), first, {}

        def rows(packs: list[tuple[int, int, list]], open_: bool) -> list[tuple]:
            nonlocal count
            out = []
            for _, _, ids in packs:
                offset = 0
                for place, i in enumerate(ids):
                    sample, tokens, images = held.pop(i)
                    out.append((shard, count, place, sample, tokens, images, offset, open_))
                    offset += tokens
                count += 1
            return out

        names, at = [*(f.split()[0] for f in PACK_SCHEMA.split(", ")), "open"], 0
        for frame in frames:
            out: list[tuple] = []
            for i, tokens, images, s in frame[["sample", "tokens", "images", "shard"]].itertuples(index=False):
                if s != shard:
                    out += rows(buffers.flush(), True)
                    shard, buffers, count = s, Buffers(limits), first
                held[at] = (i, tokens, images)  # rows may repeat a sample
                out += rows(buffers.add(at, tokens, images), False)
                at += 1
            if out:
                yield pd.DataFrame(out, columns=names)
        if out := rows(buffers.flush(), True):
            yield pd.DataFrame(out, columns=names)

    return dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "sample").mapInPandas(run, PACK_SCHEMA + ", open boolean")


def pack_samples(samples: DataFrame, limits: Limits, shards: int, order: str = "sample") -> DataFrame:
    """Samples (sample, tokens, images) dealt to shards, and packed in order within each: the pack, place in it and offset.

    A shard is a stream: its samples pass one by one, and only its open buffers are held. Shards pack in parallel. Packs that
    are open at the end of MEET neighbouring shards are packed together, whole, and so on up to one shard, so that more shards
    do not mean more padding; what meets there is open buffers, never samples. Every sample is in a pack: one with more images
    than a pack may have is alone in its pack. With overflow, packs above the token limit come out; ``cut_packs`` cuts them.
    """
    dealt = samples.select(F.col(order).cast("long").alias("sample"), F.col("tokens").cast("int"), F.col("images").cast("int"), F.pmod(F.xxhash64(order), F.lit(shards)).cast("int").alias("shard"))
    now, done, level = _pass(dealt, limits, shards, 0), [], 0
    while shards > 1:
        now = settled(now)
        done.append(now.where("not open").drop("open"))
        left, shards, level = now.where("open"), -(-shards // MEET), level + 1
        whole = left.groupBy("shard", "pack").agg(F.sum("tokens").cast("int").alias("tokens"), F.sum("images").cast("int").alias("images"))
        # An open pack of a shard is an item of the next one: shard and number make its name.
        item = (F.col("shard").cast("long") * (1 << 20) + F.col("pack") % (1 << 20)).alias("sample")
        met = _pass(whole.select(item, "tokens", "images", F.floor(F.col("shard") / MEET).cast("int").alias("shard")), replace(limits, overflow=False), shards, level * LEVEL)
        moved = met.select(F.col("sample").alias("q_item"), F.col("shard").alias("q_shard"), F.col("pack").alias("q_pack"), F.col("place").alias("q_place"), F.col("offset").alias("q_offset"), "open")
        parts = left.drop("open").withColumn("q_item", item).join(moved, "q_item")
        place = (F.row_number().over(Window.partitionBy("q_shard", "q_pack").orderBy("q_place", "place")) - 1).cast("int")
        now = parts.withColumn("place", place).select(F.col("q_shard").alias("shard"), F.col("q_pack").alias("pack"), "place", "sample", "tokens", "images", (F.col("offset") + F.col("q_offset")).cast("int").alias("offset"), "open")
    out = now.drop("open")
    for part in done:
        out = out.unionByName(part)
    return out


def cut_packs(packs: DataFrame, limit: int) -> DataFrame:
    """Packs above the limit in pieces of at most ``limit`` tokens, cut between samples where that fits, else inside one.

    ``skipped`` is how many tokens of the sample lie in earlier pieces; its images stay with the first.
    """
    at = F.col("offset")
    end = at + F.col("tokens")
    piece = F.explode(F.sequence(F.floor(at / limit), F.floor((F.greatest(end, at + 1) - 1) / limit)))
    cut = packs.withColumn("piece", piece)
    start, stop = F.greatest(at, F.col("piece") * limit), F.least(end, (F.col("piece") + 1) * limit)
    images = F.when(start == at, F.col("images")).otherwise(F.lit(0)).cast("int")
    return cut.withColumns({"tokens": (stop - start).cast("int"), "images": images, "offset": (start - F.col("piece") * limit).cast("int"), "skipped": (start - at).cast("int")})


def split_packed(ids: Column, images_at: Column, limit: int) -> Column:
    """Where to cut a pack of ``ids``: ends of pieces of at most ``limit`` ids, never inside an image; ``images_at`` holds
    (start, stop) of the images in order. An image longer than the limit is cut at the limit."""

    def step(ends: Column, _: Column) -> Column:
        here = F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0))
        wish = F.least(here + limit, F.size(ids))
        inside = F.get(F.filter(images_at, lambda m: (m["start"] < wish) & (m["stop"] > wish)), F.lit(0))
        end = F.when(inside.isNotNull() & (inside["start"] > here), inside["start"]).otherwise(wish)
        return F.when(here < F.size(ids), F.concat(ends, F.array(end.cast("int")))).otherwise(ends)

    rounds = F.sequence(F.lit(0), F.ceil(F.size(ids) / F.lit(max(1, limit // 2))).cast("int"))
    return F.aggregate(rounds, F.array().cast("array<int>"), step)


def supervised(labels: Column, least: float = 1 / 256) -> Column:
    """Whether a piece has more than the least share of learned labels."""
    return F.size(F.filter(labels, lambda x: x != IGNORE)) > F.size(labels) * F.lit(least)


def pack_offsets(packs: DataFrame, by: list[str]) -> DataFrame:
    """Running token offsets of samples in their pack."""
    before = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return packs.withColumn("offset", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("int"))


def packed_rows(packs: DataFrame, learned: str = "learned", mode: str = "square") -> DataFrame:
    """A row per pack: cu_seqlens, position ids, sample index per token and loss weight per token."""
    sorted_ = packs.groupBy("shard", "pack").agg(F.array_sort(F.collect_list(F.struct("place", "tokens", learned, "images"))).alias("s"), F.sum("tokens").cast("int").alias("tokens"), F.sum("images").cast("int").alias("images"))
    ends = F.aggregate("s", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["tokens"])))
    spread = lambda f: F.flatten(F.transform("s", f))
    return sorted_.select(
        "shard", "pack", "tokens", "images", ends.alias("cu_seqlens"),
        spread(lambda x: F.when(x["tokens"] > 0, F.sequence(F.lit(0), F.greatest(x["tokens"] - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))).alias("position_ids"),
        spread(lambda x: F.array_repeat(x["place"], x["tokens"])).alias("data_index"),
        spread(lambda x: F.array_repeat(length_weight(x[learned], mode), x["tokens"])).alias("loss_weight"),
    )


def pack_stats(packs: DataFrame, limits: Limits) -> DataFrame:
    """Samples, packs, and the tokens and images that padding to the limits would add. Of ``cut_packs``, each piece is a pack
    and a sample counts once."""
    cut = "piece" in packs.columns
    first = F.col("skipped") == 0 if cut else F.lit(True)
    each = packs.groupBy("shard", "pack", *(["piece"] if cut else [])).agg(F.count_if(first).alias("n"), F.sum("tokens").alias("t"), F.sum("images").alias("m"))
    return each.agg(F.sum("n").alias("samples"), F.count("*").alias("packs"), F.sum(F.greatest(F.lit(limits.tokens) - F.col("t"), F.lit(0))).alias("padding_tokens"), F.sum(F.greatest(F.lit(limits.images) - F.col("m"), F.lit(0))).alias("padding_images"))


def pad_to(values: Column, size: Column, pad: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(pad), F.greatest(size - F.size(values), F.lit(0)).cast("int")))


def pad_batch(rows: DataFrame, batch: str = "batch", pad_id: int = 0) -> DataFrame:
    """input_ids and labels padded to the batch's longest, with the attention mask (id is not the pad)."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    out = rows.withColumn("q_n", longest).withColumns({"input_ids": pad_to(F.col("input_ids"), F.col("q_n"), pad_id), "labels": pad_to(F.col("labels"), F.col("q_n"), IGNORE)})
    return out.withColumn("attention_mask", F.transform("input_ids", lambda x: (x != pad_id).cast("int"))).drop("q_n")


def pad_preference(rows: DataFrame, batch: str = "batch", pad_id: int = 0) -> DataFrame:
    """Chosen and rejected arrays padded to the longest of both in their batch."""
    both = F.greatest(F.size("chosen_ids"), F.size("rejected_ids"))
    out = rows.withColumn("q_n", F.max(both).over(Window.partitionBy(batch)))
    padded = {f"{s}_{k}": pad_to(F.col(f"{s}_{k}"), F.col("q_n"), p) for s in ("chosen", "rejected") for k, p in (("ids", pad_id), ("labels", IGNORE))}
    return out.withColumns(padded).drop("q_n")


def length_batches(rows: DataFrame, world: int, batch: int, key: str, length: str = "length", seed: int = 42) -> DataFrame:
    """Rows in mega-batches of world * batch, each sorted by falling length and dealt to the shards in turn.

    Mega-batches come from a hash of the key: ``rn`` ranks rows by it over the table.
    """
    from .mixture import numbered

    hashed = rows.withColumn("q_h", F.xxhash64(F.lit(seed), key))
    ranked = numbered(hashed, "q_h", name="rn")
    mega = ranked.withColumn("mega", F.floor(F.col("rn") / (world * batch)).cast("long"))
    place = F.row_number().over(Window.partitionBy("mega").orderBy(F.desc(length), key)) - 1
    return mega.withColumn("place", place.cast("int")).withColumn("shard", F.pmod("place", F.lit(world)).cast("int")).drop("q_h")


def even_split(rows: DataFrame, shards: int, group: str = "mega", length: str = "length", key: str = "id") -> DataFrame:
    """Rows of each group dealt so that the shards' total lengths stay near: the longest first, each to the shard with the
    least so far that still has room; in turn where the rows do not divide evenly. A group has a stated bound of rows."""

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([length, key], ascending=[False, True], kind="stable").reset_index(drop=True)
        n = len(frame)
        if n % shards:
            return frame.assign(shard=[i % shards for i in range(n)])
        totals, counts, out = [0] * shards, [0] * shards, []
        for value in frame[length]:
            s = min((s for s in range(shards) if counts[s] < n // shards), key=lambda s: (totals[s], s))
            totals[s] += value
            counts[s] += 1
            out.append(s)
        return frame.assign(shard=out)

    from pyspark.sql.types import LongType, StructField, StructType

    return rows.groupBy(group).applyInPandas(deal, StructType([*rows.schema.fields, StructField("shard", LongType())]))


def estimated_lengths(rows: DataFrame, text: str, tokens: Column, by_chars: bool = False) -> DataFrame:
    """Token lengths; ``by_chars`` takes that of the first row (by line_no) with as many characters."""
    rows = rows.withColumns({"chars": F.char_length(text), "length": tokens})
    if not by_chars:
        return rows
    first = rows.groupBy("chars").agg(F.min_by("length", "line_no").alias("length"))
    return rows.drop("length").join(first, "chars")
