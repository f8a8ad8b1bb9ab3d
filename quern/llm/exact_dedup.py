"""Exact deduplication by deterministic block naming, with DataFrame functions only.

A text is cut into blocks of a fixed number of characters. The distinct blocks of each hash bucket are sorted, and a
block's name is the bucket's number followed by its rank there: an integer that depends on nothing but the blocks
themselves, so a recomputed task gives the same name. Then the names of adjacent blocks are paired, and the pairs named
in the same way, until every document has one name. Equal names at a level mean equal texts, with no collision: hashes
choose the bucket and find a block's name again, and where two blocks share even their 128-bit hash, the join compares
their text.

A block or text may have copies in a third of all rows. Names of blocks come from a join of written tables, whose large
partitions adaptive execution splits; groups of many copies are joined by broadcast, and there are fewer than HOT of them.

Defined results: null counts as the empty text, which is one empty block. Rows with a null doc_id take part; a group's
largest doc_id is null only if all its rows have none. Of rows that repeat both doc_id and text, one is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, spread_join, text_or_empty

BLOCK_CHARS = 8192
#: Low bits of a name that hold the rank within its bucket; the other 44 bits are the bucket.
RANK_BITS = 20


def _named(keys: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Names of distinct ``key`` values: columns ``by``, name, and key where ``by`` alone does not tell it.

    ``by`` are hash columns (the first of which gives the bucket). Distinct values combine before the one shuffle.
    """
    bucket = F.expr(f"shiftright({by[0]}, {RANK_BITS})")
    item = F.struct(F.col(key).alias("key"), *by)
    groups = keys.groupBy(bucket.alias("bucket")).agg(F.array_sort(F.collect_set(item)).alias("items"))
    ranked = groups.select("bucket", "items", F.posexplode("items").alias("rank", "item"))
    same = F.size(F.filter("items", lambda x: (x[by[0]] == F.col(f"item.{by[0]}")) & (x[by[1]] == F.col(f"item.{by[1]}"))))
    full = F.raise_error(F.lit("a naming bucket is full")).cast("long")
    name = F.when(F.col("rank") < (1 << RANK_BITS), F.expr(f"shiftleft(bucket, {RANK_BITS}) + rank")).otherwise(full)
    return ranked.select(*(F.col(f"item.{c}").alias(c) for c in by), name.alias("name"), F.when(same > 1, F.col("item.key")).alias("twin"))


def _blocks(docs: DataFrame, id_col: str, text_col: str, chars: int) -> DataFrame:
    text = text_or_empty(text_col)
    cut = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0)))
    base = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.unhex(F.sha2(text, 256)).alias("sha"), cut.alias("cut"))
    exploded = base.select("doc", "t1", "t2", "sha", F.size("cut").alias("n"), F.posexplode("cut").alias("idx", "block"))
    return exploded.select("doc", "t1", "t2", F.when(F.col("idx") == 0, F.col("sha")).alias("sha"), "n", "idx", "block", F.xxhash64("block").alias("h1"), F.xxhash64(F.lit(1), "block").alias("h2"))


def _lookup(rows: DataFrame, names: DataFrame, key: str, has_twins: bool) -> DataFrame:
    """``rows`` with the name of their ``key``."""
    plain = rows.join(names.where(F.col("twin").isNull()).drop("twin"), ["h1", "h2"]).drop("h1", "h2", key)
    if not has_twins:
        return plain
    twins = names.where(F.col("twin").isNotNull())
    return plain.unionByName(rows.join(twins, (rows["h1"] == twins["h1"]) & (rows["h2"] == twins["h2"]) & (rows[key] == twins["twin"])).select(*(rows[c] for c in rows.columns if c not in ("h1", "h2", key)), twins["name"]))


def text_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per distinct (doc, text): doc, t1, t2, copies (rows), sha, level, name; (level, name) is the text's identity."""
    scratch = Scratch(docs.sparkSession, "naming")
    blocks = _blocks(docs, id_col, text_col, chars)
    names = scratch.put(_named(blocks, "block", ["h1", "h2"]), "names")
    twins = not names.where(F.col("twin").isNotNull()).isEmpty()
    rows = scratch.put(_lookup(blocks, names, "block", twins), "level")
    one = rows.where("n = 1").groupBy("doc", "t1", "t2", F.col("sha")).agg(F.count("*").alias("copies"), F.lit(0).alias("level"), F.first("name").alias("name"))
    done = [one]
    level, open_rows = 0, rows.where("n > 1").withColumn("copies", F.lit(1).cast("long"))
    while not open_rows.isEmpty():
        level += 1
        # At level 1, rows that repeat a document's id and text meet here; copies counts them.
        pairs = open_rows.groupBy("doc", "t1", "t2", "n", F.expr("idx div 2").cast("int").alias("idx")).agg(
            F.max("sha").alias("sha"),
            (F.count(F.when(F.expr("idx % 2 = 0"), 1)) if level == 1 else F.max("copies")).alias("copies"),
            F.max(F.when(F.expr("idx % 2 = 0"), F.col("name"))).alias("a"),
            F.max(F.when(F.expr("idx % 2 = 1"), F.col("name"))).alias("b"),
        )
        pairs = pairs.select("doc", "t1", "t2", "sha", "copies", F.expr("cast((n + 1) div 2 as int)").alias("n"), "idx", F.struct("a", "b").alias("pair"), F.xxhash64("a", "b").alias("h1"), F.xxhash64(F.lit(1), "a", "b").alias("h2"))
        pairs = scratch.put(pairs, "pairs")
        names = scratch.put(_named(pairs, "pair", ["h1", "h2"]), "names")
        twins = not names.where(F.col("twin").isNotNull()).isEmpty()
        rows = scratch.put(_lookup(pairs, names, "pair", twins), "level")
        done.append(rows.where("n = 1").select("doc", "t1", "t2", "sha", "copies", F.lit(level).alias("level"), "name"))
        open_rows = rows.where("n > 1")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of ``docs``: its id, keep_id, group_size, kept and text_sha256. Of equal texts, the largest id stays."""
    scratch = Scratch(docs.sparkSession, "groups")
    ids = scratch.put(text_identities(docs, id_col, text_col, chars), "ids")
    groups = scratch.put(ids.groupBy("level", "name").agg(F.max("doc").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("rows")), "groups")
    each = spread_join(ids, groups, ["level", "name"], "rows", ids.count()).select("doc", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return each.select(
        F.col("doc").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text a row with a larger id repeats; repeated rows stay once."""
    p = fresh(docs)
    kept = dedup_exact(docs, id_col, text_col).where("kept").select(F.col(id_col).alias(p + "keep"), F.unhex("text_sha256").alias(p + "sha"))
    hashed = docs.withColumn(p + "hash", F.unhex(F.sha2(text_or_empty(text_col), 256)))
    once = hashed.dropDuplicates([id_col, p + "hash"])
    return once.join(kept, F.col(id_col).eqNullSafe(F.col(p + "keep")) & (F.col(p + "hash") == F.col(p + "sha")), "left_semi").drop(p + "hash")
