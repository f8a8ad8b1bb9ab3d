"""Line deduplication with DataFrame functions only.

Keys of lines are hashed to 128 bits, range-partitioned by hash and sorted within a hash by document and position; a
streaming window takes the first document of each hash. What goes back to the documents is a compressed bitmap of the
dropped lines, not text. A hash that holds a large share of all lines is dealt over many partitions by document and
position instead; its first document comes from a map-side aggregate.

Defined results: a null or empty text is one empty line. A null doc_id counts as one document that precedes all others.
Rows that repeat a doc_id are the same document, so their lines do not drop each other. Extra columns are kept as they
are. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Scratch, ascii_lower, fresh, partitions, text_or_empty

WORD = 64


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at either end and with A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per line whose key is long enough: doc, row (a hash of the text), pos, h1, h2."""
    text = text_or_empty(text_col)
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(lines_of(text)).alias("pos", "line"))
    key = lines.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return key.select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def hot_owners(hashes: DataFrame, n_parts: int) -> DataFrame:
    """First documents of hashes that hold more than one in K lines; fewer than K rows, so they may be broadcast.

    A histogram over hash buckets finds the few buckets that can hold such a hash; only those are counted by hash.
    """
    k = max(512, 2 * n_parts)
    total = hashes.count()
    bucket = F.pmod("h1", F.lit(16 * k))
    full = hashes.groupBy(bucket.alias("bucket")).count().where(F.col("count") * k > total).select("bucket")
    inside = hashes.withColumn("bucket", bucket).join(F.broadcast(full), "bucket")
    counted = inside.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc")).alias("owner"))
    return counted.where(F.col("n") * k > total).select("h1", "h2", F.col("owner").alias("hot"))


def drop_bitmaps(hashes: DataFrame, n_parts: int) -> DataFrame:
    """Per document the lines to drop, as sorted (word, bits) pairs of 64-bit words; words without a drop are left out."""
    hot = hot_owners(hashes, n_parts)
    dealt = hashes.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("part", F.when(F.col("hot").isNull(), F.col("h1")).otherwise(F.xxhash64("h1", "doc", "row", "pos")))
    ordered = Window.partitionBy("part", "h1", "h2").orderBy(F.col("doc").asc_nulls_first(), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.coalesce(F.col("hot"), F.first(F.struct("doc")).over(ordered))
    seen = dealt.repartitionByRange("part").select("doc", "row", "pos", first.alias("owner"))
    dropped = seen.where(~F.col("owner.doc").eqNullSafe(F.col("doc"))).repartition("doc", "row")
    word = F.floor(F.col("pos") / WORD).cast("int")
    words = dropped.groupBy("doc", "row", word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pos, {WORD}) as int))")).alias("bits"))
    return words.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def _dense(drops: str) -> Column:
    """Sparse (word, bits) pairs as an array with one element per word, up to the last word with a drop."""
    fill = F.transform(F.col(drops), lambda x, i: F.concat(
        F.array_repeat(F.lit(0).cast("long"), x["word"] - F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col(drops), i - 1)["word"]) - 1),
        F.array(x["bits"]),
    ))
    return F.flatten(fill)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, counts: bool = True) -> DataFrame:
    """``docs`` with each repeated line kept only in the smallest document that holds it, and with ``counts`` also n_lines and
    n_dropped, which replace columns of these names.

    A key of at least ``min_chars`` code points that two or more documents hold loses all its lines elsewhere.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    hashes = scratch.put(line_hashes(docs, id_col, text_col, min_chars), "hashes")
    maps = drop_bitmaps(hashes, partitions(spark))
    p = fresh(docs)
    count = F.aggregate("drops", F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x["bits"]))
    right = maps.select(F.col("doc").alias(p + "doc"), F.col("row").alias(p + "row"), count.alias(p + "n"), _dense("drops").alias(p + "bits"))
    left = docs.withColumn(p + "hash", F.xxhash64(text_or_empty(text_col)))
    joined = left.join(right, (F.col(p + "hash") == F.col(p + "row")) & F.col(id_col).eqNullSafe(F.col(p + "doc")), "left")
    text, bits = text_or_empty(text_col), F.col(p + "bits")
    lines = lines_of(text)
    stays = F.filter(lines, lambda x, i: F.coalesce(F.getbit(F.get(bits, F.floor(i / WORD).cast("int")), F.pmod(i, F.lit(WORD))), F.lit(0)) == 0)
    out = joined.withColumn(p + "text", F.when(bits.isNull(), text).otherwise(F.array_join(stays, "\n")))
    out = out.withColumns({p + "lines": F.size(lines).cast("long"), p + "n": F.coalesce(F.col(p + "n"), F.lit(0).cast("long"))})
    new = [F.col(p + "lines").alias("n_lines"), F.col(p + "n").alias("n_dropped")] if counts else []
    keep = [F.col(p + "text").alias(c) if c == text_col else F.col(c) for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    return out.select(*keep, *new)
