"""Token counts of whole texts without materialising ids.

A piece model whose pieces hold the space mark only at their front never merges across a space, so a text's count is the
sum over its pre-tokens (a run of spaces and the characters up to the next space). Pieces are counted once per distinct
pre-token of the corpus. The counts then meet the per-document frequencies: those of the most frequent pre-tokens (a table
of bounded size) inside the tasks, those of all others in a join. Frequent pre-tokens never enter the join, so no key of it
holds many rows.

Defined results: null counts as the empty text, which has no tokens. Rows that repeat a document get a row each.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, most_frequent, slices, tidy

#: The most entries, and the longest entry, of the table of frequent pre-tokens that each task holds.
FREQUENT, FREQUENT_CHARS = 200_000, 64
#: Distinct pre-tokens that a task counts before it passes them on.
HELD = 300_000
_MARK = "▁"

_SPLIT = re.compile("[ ▁]+[^ ▁]*")


@functools.lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if spanning := [p for p in map(model.id_to_piece, range(model.get_piece_size())) if _MARK in p.lstrip(_MARK)]:
        raise ValueError(f"{path} has pieces that cross a space, such as {spanning[0]!r}; texts cannot be counted by pre-token")
    return model


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text; the library puts a space before a text that isn't empty."""
    return _SPLIT.findall(" " + text) if text else []


def piece_counts(tokens: list[str], model: str) -> list[int]:
    """Pieces of each pre-token; the leading space is the one that the library adds itself, but to no empty text: a lone
    space (at a text's end) is one piece."""
    return [len(x) if len(t) > 1 else 1 for t, x in zip(tokens, _model(model).encode([t[1:] for t in tokens], num_threads=1), strict=True)]


def corpus_pretokens(docs: DataFrame, text_col: str) -> DataFrame:
    """Distinct pre-tokens of all texts with their frequency: token, freq."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["token", "n"])
            held.clear()
            return out

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.update(pretokens(text))
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    counted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "token string, n long")
    return counted.groupBy("token").agg(F.sum("n").alias("freq"))


def count_pieces(tokens: DataFrame, model: str) -> DataFrame:
    """``tokens`` (token, freq) with pieces, counted once for each."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pieces = piece_counts(batch.column(0).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int32())], ["token", "freq", "pieces"])

    return tokens.select("token", "freq").mapInArrow(run, "token string, freq long, pieces int")


def frequent_table(counted: DataFrame, most: int = FREQUENT) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens of bounded length, ``most`` at most; a few MB at any size of the corpus."""
    top = most_frequent(counted.where(F.char_length("token") <= FREQUENT_CHARS), "freq", most).select("token", "pieces")
    return {r.token: r.pieces for r in top.collect()}


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Per row of ``docs``: its id, n_bytes, n_tokens and over_limit."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    tokens = scratch.put(corpus_pretokens(docs, text_col), "pretokens")
    counted = scratch.put(count_pieces(tokens, model), "pieces")
    scratch.drop(tokens)
    table = spark.sparkContext.broadcast(frequent_table(counted, frequent))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, row = table.value, TaskContext.get().partitionId() << 36
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row += 1
                found = list(map(known.get, toks := pretokens(text)))
                n = sum(filter(None, found))
                rows.append((row, doc, len(text.encode()), n, None, None))
                if None in found:
                    rare = Counter(t for t, k in zip(toks, found, strict=True) if k is None)
                    rows += [(row, None, None, None, t, m) for t, m in rare.items()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "doc", "n_bytes", "n", "token", "times"])

    typed = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = scratch.put(typed.mapInArrow(run, "row long, doc long, n_bytes long, n long, token string, times long"), "frequencies")
    rare = found.where("token is not null").join(counted.select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    each = found.where("token is null").select("row", "doc", "n_bytes", "n").join(rare, "row", "left")
    total = F.col("n") + F.coalesce(F.col("more"), F.lit(0))
    return each.select(F.col("doc").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
