"""How far the sources of a language differ in their terms.

Terms are runs of letters and of characters beyond ASCII, with A-Z lower-cased. Arrow functions split texts, encode terms as
a dictionary and count them per language and source inside each task, together with the number of rows that hold them. Spark
sums these partial counts. Terms in enough rows of their language are kept, each with its counts by source as one row. Kept
terms are dealt to shards by hash, and each shard also gets the totals of all sources. A shard is a matrix of counts, sources
by terms, from which the divergences of all pairs of sources and the highest terms of each source are computed column-wise.
Sums over shards give the pairs, and the highest of the shards' highest give the terms. No term, source or language has all
of its rows in one task: counts are pre-aggregated, and a shard holds a bounded number of terms.

All arithmetic is exact, in 64-bit integers: a share of a thousand million is divided digit by digit.

Defined results: null texts, languages and sources count as ''. A source without terms takes part by its smoothing alone.
Pairs of a language that keeps no term have value 0. Rows that repeat a document count as documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_slices, tidy

#: Characters between terms, and the whole of a share.
BETWEEN, WHOLE = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", 1_000_000_000
#: Bytes of texts that are counted at once, and partial counts that a task holds before it passes them on.
SLICE_BYTES, HELD = 4 << 20, 400_000
#: Counts that a shard holds of one language, about, and numbers of a matrix that are worked on at once.
SHARD_ROWS, AT_ONCE = 200_000, 1 << 20
_KEYS = ["lang", "source", "term"]


def partial_counts(batch: pa.RecordBatch) -> pa.Table:
    """Of rows (lang, source, text): lang, source, term, n (occurrences) and docs (rows that hold the term).

    Each (lang, source) also has a row with the empty term and no counts.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), BETWEEN)
    # (lang, source) as one number, and so each term; a term's occurrences in a row meet first.
    group = pa.table([batch.column("lang").dictionary_encode().indices, batch.column("source").dictionary_encode().indices], ["l", "s"])
    places = group.append_column("row", pa.array(np.arange(len(batch)))).group_by(["l", "s"], use_threads=False).aggregate([("row", "min")])
    pair = np.zeros(len(batch), np.int64)
    number = {k: i for i, k in enumerate(zip(places["l"].to_pylist(), places["s"].to_pylist(), strict=True))}
    pair[:] = [number[k] for k in zip(group["l"].to_pylist(), group["s"].to_pylist(), strict=True)]
    terms = pc.list_flatten(lists)
    coded = (terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms).dictionary_encode()
    by_row = pa.table([pc.list_parent_indices(lists), coded.indices], ["row", "code"]).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    rows, codes = by_row["row"].to_numpy(), by_row["code"]
    by_pair = pa.table([pa.array(pair[rows]), codes, by_row["count_all"]], ["pair", "code", "n"]).group_by(["pair", "code"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    term = coded.dictionary.take(by_pair["code"].combine_chunks())
    real = pc.not_equal(term, "")
    first = places["row_min"].combine_chunks()

    def of(column: str) -> pa.Array:
        values = batch.column(column)
        return pa.concat_arrays([values.take(first.take(by_pair["pair"].combine_chunks().filter(real))), values.take(first)])

    none, zeros = pa.array([""] * len(places), pa.string()), pa.array(np.zeros(len(places), np.int64))
    counts = [pa.concat_arrays([by_pair[c].combine_chunks().filter(real).cast(pa.int64()), zeros]) for c in ("n_sum", "count_all")]
    return pa.table([of("lang"), of("source"), pa.concat_arrays([term.filter(real), none]), *counts], [*_KEYS, "n", "docs"])


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n and docs over all rows; the empty term marks each (lang, source) that occurs."""

    def merged(tables: list[pa.Table]) -> pa.Table:
        held = pa.concat_tables(tables).group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return held.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns([*_KEYS, "n", "docs"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in bounded_slices(batches, "text", SLICE_BYTES):
            held.append(partial_counts(batch))
            if sum(map(len, held)) > HELD:
                held = [merged(held)]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().to_batches(max_chunksize=1 << 16)
        if held:
            yield from merged(held).to_batches(max_chunksize=1 << 16)

    typed = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    partial = typed.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(WHOLE * (counts + 1) / totals) in 64 bits, three decimal digits at a time. Totals are below 2 ** 53."""
    whole, rest = np.divmod(counts + 1, totals)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + digits
    return whole + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def shard_divergences(shard: pa.Table, top: int) -> pa.Table:
    """Partial sums of all ordered pairs of sources of one language, and the ``top`` highest terms of each source.

    Rows of ``shard``: (source, term, n) of kept terms, the language itself as source null; and with term null the totals of
    each source: n and v, the number of kept terms.
    """
    lang, is_total = shard["lang"][0].as_py(), pc.is_null(shard["term"])
    totals, counts = shard.filter(is_total), shard.filter(pc.invert(is_total))
    whole = pc.is_null(totals["source"])
    names = totals.filter(pc.invert(whole))["source"].combine_chunks()
    n = totals.filter(pc.invert(whole))["n"].to_numpy().astype(np.int64)
    n_all, v = int(totals.filter(whole)["n"][0].as_py()), int(totals["v"][0].as_py())
    sources = len(names)
    sums, best = np.zeros((sources, sources), np.int64), []
    coded = counts["term"].combine_chunks().dictionary_encode()
    number, terms = coded.indices.to_numpy(), coded.dictionary
    row = pc.index_in(counts["source"].combine_chunks(), names)
    row = pc.fill_null(row, sources).to_numpy()
    order = np.argsort(number, kind="stable")
    number, row, count = number[order], row[order], counts["n"].to_numpy()[order]
    step = max(1, AT_ONCE // (sources + 1))
    for at in range(0, len(terms), step):
        width = min(step, len(terms) - at)
        a, b = np.searchsorted(number, [at, at + width])
        table = np.zeros((sources + 1, width), np.int64)
        table[row[a:b], number[a:b] - at] = count[a:b]
        p, q = shares(table[:-1], n[:, None] + v), shares(table[-1], np.int64(n_all + v))
        for i in range(sources):
            sums[i] += distance(p[i], p).sum(axis=1)
        over = distance(p, q)
        over[(table[:-1] == 0) | (p <= q)] = -1
        for i in range(sources):
            own = np.flatnonzero(over[i] >= 0)
            if len(own) > top:  # all that tie with the last stay
                own = own[over[i][own] >= np.partition(over[i][own], len(own) - top)[len(own) - top]]
            best.append((np.full(len(own), i), own + at, p[i][own], q[own], over[i][own]))
    one, other = np.nonzero(~np.eye(sources, dtype=bool))
    source, term, share, whole_share, value = (np.concatenate([x[k] for x in best]) if best else np.zeros(0, np.int64) for k in range(5))
    parts = [("pair", one, names.take(pa.array(other)), np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), sums[one, other]), ("term", source, terms.take(pa.array(term)), share, whole_share, value)]
    tables = [pa.table([pa.array([lang] * len(s), pa.string()), names.take(pa.array(s)), pa.array([part] * len(s), pa.string()), item, pa.array(p), pa.array(q), pa.array(x)], ["lang", "source", "part", "item", "p", "q", "value"]) for part, s, item, p, q, x in parts]
    return pa.concat_tables(tables)


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, shard_rows: int = SHARD_ROWS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, p, q, value, rank: each source against every other of its language over all kept terms
    (part 'pair'; no p and q), and its ``top`` terms that it uses more than the language does (part 'term')."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    counts = term_counts(docs, lang_col, source_col, text_col)
    # A term in too few rows of a source may still be kept, so all counts of a term meet, as one row of an array.
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    kept = scratch.put(by_term.where((F.col("docs") >= least_docs) | (F.col("term") == "")).select("lang", "term", "by_source"), "kept")
    flat = kept.select("lang", "term", F.explode("by_source").alias("x")).select("lang", "term", F.col("x.source").alias("source"), F.col("x.n").alias("n"))
    by_source = flat.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = kept.groupBy("lang").agg(F.sum(F.when(F.col("term") != "", 1).otherwise(0)).alias("v"), F.sum(F.aggregate("by_source", F.lit(0).cast("long"), lambda s, x: s + x["n"])).alias("n"))
    totals = by_source.join(by_lang.select("lang", "v"), "lang").unionByName(by_lang.select("lang", F.lit(None).cast("string").alias("source"), "n", "v"))
    totals = scratch.put(totals.select("lang", "source", F.lit(None).cast("string").alias("term"), "n", "v"), "totals")
    shards = int(-(-kept.agg(F.coalesce(F.sum(F.size("by_source")), F.lit(0))).first()[0] // shard_rows)) or 1
    # Every shard has the totals of its language, and each term whole: its counts by source and that of the language.
    whole = kept.where("term <> ''").select("lang", F.lit(None).cast("string").alias("source"), "term", F.aggregate("by_source", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n"))
    rows = flat.where("term <> ''").select("lang", "source", "term", "n").unionByName(whole).select("*", F.lit(None).cast("long").alias("v"), F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"))
    everywhere = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def one(shard: pa.Table) -> pa.Table:
        return shard_divergences(shard, top)

    found = rows.unionByName(everywhere).groupBy("lang", "shard").applyInArrow(one, "lang string, source string, part string, item string, p long, q long, value long")
    keys = ["lang", "source", "part", "item"]
    merged = scratch.put(found.groupBy(*keys).agg(F.max("p").alias("p"), F.max("q").alias("q"), F.sum("value").alias("value")), "merged")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = merged.where("part = 'pair'").withColumns({"rank": rank, "p": F.lit(None).cast("long"), "q": F.lit(None).cast("long")})
    terms = merged.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)  # cut before the shuffle too
    return pairs.unionByName(terms).select(*keys, "p", "q", "value", "rank")
