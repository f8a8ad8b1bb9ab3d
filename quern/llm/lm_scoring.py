"""Stupid-backoff scores of whole documents from bigram and unigram counts of a whole corpus.

A word scores c(before, word) / c(before) where the corpus holds the bigram, else 0.4 * c(word) / N; a document's first word
scores c(word) / N, and c(word) counts as one where the corpus lacks the word. The document's score is the sum of the
logarithms, kept in whole millionths so that sums do not depend on their order.

The work is relational. A document is exploded into its distinct n-grams, each with how often it occurs and with a weight:
the logarithm of its count enters the document's score so many times. A bigram weighs as often as it occurs; a word weighs
minus one for each time it comes before another, and one as a first word. The exploded n-grams are dealt by hash, once. In
its hash partition, each n-gram's occurrences are summed over the corpus and joined to its rows by a window, which is a
count table and its join in one shuffle; the products are then summed by document. Words of a bounded table of frequent
ones have their counts in every task and never travel. Heavy bigrams would send a large share of all documents to one
partition: those above a 1 / K share of a task's bigrams, summed over tasks, include every bigram above 2 / K of the corpus,
and fewer than K pass the same share of the corpus. K is HEAVY or four times the number of partitions, whichever is more, so
that no bigram is more than half a partition's share at any size. They are dealt by document instead, and their counts are
summed at the end and joined to the documents by broadcast (fewer than K rows).

Scored by its own corpus, a document holds no bigram that the corpus lacks, and nothing backs off. By another corpus it
may: its n-grams are joined to that corpus's count table, and what the join does not find is scored by its word's count.

Words are runs of characters outside [\\x20\\x09-\\x0D], A-Z in lower case. N-grams are told apart by a 64-bit hash. Defined
results: null and empty texts have no words and score 0. Rows that repeat a document each count and each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, Memo, Scratch, most_frequent, partitions, slices, tidy

#: Bits of the table of frequent words, and the backoff factor.
FREQUENT_BITS, BACKOFF = 18, 0.4
#: Bigrams above a share of the corpus, 1 / HEAVY or less (see ``heavy_share``), are dealt by document.
HEAVY = HOT
#: Words and rows a task gathers before it passes them on; distinct words it remembers.
GATHERED, ROWS_SENT, WORDS_HELD = 800_000, 100_000, 150_000

_U = np.uint64
_P, _Q = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def micro(count: np.ndarray | float) -> np.ndarray:
    """Millionths of the natural logarithm."""
    return np.rint(1e6 * np.log(count)).astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes() -> Memo:
    import xxhash

    return Memo(xxhash.xxh64_intdigest, WORDS_HELD)


def bigram_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(_mix(before) * _P + word * _Q)


def heavy_share(n_parts: int) -> int:
    """A bigram that is more than one in so many goes by document."""
    return max(HEAVY, 4 * n_parts)


def word_counts(docs: DataFrame, text_col: str, share: int = HEAVY) -> DataFrame:
    """Counts of the corpus: h, n and heavy. Rows with heavy false count words; the others count, in part, bigrams that are
    more than one in ``share`` in a task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()

        def counted(held: list[np.ndarray]) -> pa.RecordBatch:
            h = np.concatenate(held)
            ends = np.cumsum([len(x) for x in held])[:-1]
            word, place, n = np.unique(h, return_inverse=True, return_counts=True)
            # A bigram can be heavy only if both of its words are.
            often = (n * share > len(h))[place]
            both = often[:-1] & often[1:]
            both[ends[ends > 0] - 1] = False
            g, m = np.unique(bigram_keys(h[:-1][both], h[1:][both]), return_counts=True)
            g, m = g[m * share > len(h)], m[m * share > len(h)]
            columns = [np.concatenate([word, g]).view(np.int64), np.concatenate([n, m]), np.arange(len(word) + len(g)) >= len(word)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "n", "heavy"])

        held, size = [], 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if words := words_of(text):
                    held.append(np.fromiter(map(hashes.__getitem__, words), _U, len(words)))
                    size += len(words)
                if size >= GATHERED:
                    yield counted(held)
                    held, size = [], 0
            hashes.bound()
        if held:
            yield counted(held)

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "h long, n long, heavy boolean")
    return found.groupBy("h", "heavy").agg(F.sum("n").alias("n"))


class Model:
    """What every task knows of the corpus: its size, counts of frequent words, and which bigrams are heavy; bounded at any
    size."""

    def __init__(self, h: np.ndarray, n: np.ndarray, heavy: np.ndarray, total: int):
        order = np.argsort(h.view(_U))
        self.h, self.n, self.total = h.view(_U)[order], n[order], max(1, total)
        self.heavy = np.sort(heavy.view(_U))


def places(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted table, -1 where it is none of it."""
    if not len(table):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def model_of(words: DataFrame, frequent_bits: int = FREQUENT_BITS, share: int | None = HEAVY) -> Model:
    """``words`` is the written table of ``word_counts``; without a ``share``, no bigram is heavy."""
    singles = words.where(~F.col("heavy"))
    total = singles.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    top = most_frequent(singles, "n", 1 << min(frequent_bits, FREQUENT_BITS)).select("h", "n").toArrow()
    # Every bigram occurrence counts once at most here, so fewer than ``share`` pass.
    heavy = words.where(F.col("heavy") & (F.col("n") * share > total)).select("h").collect() if share else []
    column = lambda name: np.asarray(top.column(name).combine_chunks(), np.int64)
    return Model(column("h"), column("n"), np.array([r.h for r in heavy], np.int64), total)


#: Rows of two sorts. An n-gram of a document: key, row (the document), times, weight, for a heavy bigram its place (its key is
#: its row then), and if asked for its words (before and word; before is null for a single word). And a document: doc, its
#: number of words in times, and in base the part of its score that needs no other count; its weight is null, its key its row.
EXPLODED = "key long, row long, times long, weight int, heavy int, doc long, base long"
WITH_WORDS = EXPLODED + ", before long, word long"


def explode_ngrams(docs: DataFrame, model: Model, id_col: str, text_col: str, with_words: bool = False) -> DataFrame:
    """Documents and their distinct n-grams (see EXPLODED). Words of the model's table are in the documents' base instead."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = WITH_WORDS if with_words else EXPLODED
    names = [c.split()[0] for c in schema.split(", ")]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, hashes = held.value, word_hashes()
        log_n, log_total = micro(m.n), int(micro(m.total))
        row = TaskContext.get().partitionId() << 36
        parts: list[list[np.ndarray]] = [[] for _ in range(7)]
        documents: list[tuple] = []

        def send(key: np.ndarray, times: np.ndarray, weight: np.ndarray, before: np.ndarray, word: np.ndarray, heavy: np.ndarray | None = None) -> None:
            if heavy is None:
                heavy = np.full(len(key), -1)
            for part, x in zip(parts, (key.view(np.int64), np.full(len(key), row), times, weight, before, word, heavy), strict=True):
                part.append(x)

        def batch_of() -> pa.RecordBatch:
            key, rows, times, weight, before, word, heavy = (np.concatenate(p) if p else np.empty(0, np.int64) for p in parts)
            n, k, doc = len(key), len(documents), [x[1] for x in documents]
            join = lambda a, b, kind: pa.concat_arrays([pa.array(a, kind), pa.array(b, kind)])
            null = lambda size, kind: pa.nulls(size, kind)
            own = np.array([x[0] for x in documents], np.int64)
            columns = [join(key, own, pa.int64()), join(rows, own, pa.int64()), join(times, [x[2] for x in documents], pa.int64()), pa.concat_arrays([pa.array(weight, pa.int32()), null(k, pa.int32())]), pa.concat_arrays([pa.array(heavy, pa.int32(), mask=heavy < 0), null(k, pa.int32())])]
            columns += [pa.concat_arrays([null(n, pa.int64()), pa.array(x, pa.int64())]) for x in (doc, [x[3] for x in documents])]
            if with_words:
                columns += [pa.concat_arrays([pa.array(x.view(np.int64), pa.int64(), mask=x == 0), null(k, pa.int64())]) for x in (before.astype(_U), word.astype(_U))]
            for p in parts:
                p.clear()
            documents.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        sent = 0
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                base = 0
                if words:
                    h = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
                    place = places(m.h, h)
                    # The first word weighs one, every word that comes before another minus one.
                    base = -log_total + (int(log_n[place[0]]) if place[0] >= 0 else 0) - int(log_n[place[:-1][place[:-1] >= 0]].sum())
                    rare, at, n = np.unique(h[place < 0], return_inverse=True, return_counts=True)
                    weight = -n
                    if place[-1] < 0:
                        weight[at[-1]] += 1
                    if place[0] < 0:
                        weight[at[0]] += 1
                    send(rare, n, weight, np.zeros(len(rare), _U), rare)
                    key, first, n = np.unique(bigram_keys(h[:-1], h[1:]), return_index=True, return_counts=True)
                    heavy = places(m.heavy, key) if len(m.heavy) else None
                    if heavy is not None:
                        key = np.where(heavy >= 0, _U(row), key)
                    send(key, n, n, h[:-1][first], h[1:][first], heavy)
                    sent += len(rare) + len(key)
                documents.append((row, doc, len(words), base))
                row += 1
                if sent + len(documents) >= ROWS_SENT:
                    yield batch_of()
                    sent = 0
            hashes.bound()
        yield batch_of()

    typed = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return typed.mapInArrow(run, schema)


def _micro(n: Column) -> Column:
    return F.round(F.ln(n) * 1e6).cast("long")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent_bits: int = FREQUENT_BITS, corpus: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: its id, n_words, log_score and mean_log_score (by word; null without words).

    Counts come from ``corpus`` (its ``text_col``), or from ``docs`` themselves.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    source = docs if corpus is None else corpus
    share = heavy_share(partitions(docs.sparkSession))
    words = scratch.put(word_counts(source, text_col, share), "words")
    # The joins with another corpus are split by adaptive execution where a bigram is heavy.
    model = model_of(words, frequent_bits, share if corpus is None else None)
    if corpus is None:
        dealt = explode_ngrams(docs, model, id_col, text_col).repartition(partitions(docs.sparkSession), "key")
        count = F.sum("times").over(Window.partitionBy("key"))
        # A document's own row is no n-gram: what it brings is its base. A heavy bigram's count is not known yet.
        part = F.when(F.col("heavy").isNull(), F.coalesce("base", F.col("weight") * _micro(F.col("count"))))
        rows = dealt.withColumn("count", count).withColumn("part", part)
    else:
        exploded = scratch.put(explode_ngrams(docs, model, id_col, text_col, with_words=True), "exploded")
        rows = _by_other(exploded, explode_ngrams(corpus.withColumn(id_col, F.lit(None).cast("long")), model, id_col, text_col), words, model)
    times = F.sum(F.when(F.col("heavy").isNotNull(), F.col("times"))).alias("times")
    total = rows.groupBy("row", "heavy").agg(F.max("doc").alias("doc"), F.max(F.when(F.col("weight").isNull(), F.col("times"))).alias("n_words"), F.sum("part").alias("score"), times)
    if len(model.heavy):
        total = scratch.put(total, "totals")
        log_n = total.where("heavy is not null").groupBy("heavy").agg(_micro(F.sum("times")).alias("log_n"))
        total = total.join(F.broadcast(log_n), "heavy", "left").withColumn("score", F.coalesce("score", F.col("times") * F.col("log_n")))
        total = total.groupBy("row").agg(F.max("doc").alias("doc"), F.max("n_words").alias("n_words"), F.sum("score").alias("score"))
    score = F.col("score") / 1e6
    return total.select(F.col("doc").alias(id_col), "n_words", score.alias("log_score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_log_score"))


def _by_other(exploded: DataFrame, corpus: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """``exploded`` with each row's part of the score by the count table of another corpus."""
    table = corpus.where("weight is not null").groupBy("key").agg(_micro(F.sum("times")).alias("log_n"))
    singles = words.where(~F.col("heavy"))
    log_of = lambda name: singles.select(F.col("h").alias(name), _micro(F.col("n")).alias(f"log_{name}"))
    found = exploded.join(table, "key", "left")
    # What is no bigram, or is one that the corpus holds; a word that it lacks counts as one, and its logarithm is 0.
    plain = found.where(F.col("before").isNull() | F.col("log_n").isNotNull()).withColumn("part", F.coalesce("base", F.col("weight") * F.coalesce("log_n", F.lit(0))))
    # A bigram that it lacks gives back what the word before has taken off, and its word's share comes in.
    lost = found.where(F.col("before").isNotNull() & F.col("log_n").isNull()).join(log_of("before"), "before", "left").join(log_of("word"), "word", "left")
    share = F.coalesce("log_before", F.lit(0)) + F.coalesce("log_word", F.lit(0)) + F.lit(int(micro(BACKOFF)) - int(micro(model.total)))
    columns = ["row", "heavy", "doc", "weight", "times", "part"]
    return plain.select(*columns).unionByName(lost.withColumn("part", F.col("weight") * share).select(*columns))
