"""Python extension points: tokenizers, embedders and the step expander for SQL."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The default tokenizer: words and single other marks.
TOKEN = re.compile(r"\w+|[^\w\s]")


def tokenizer(encode: Callable[[str], list[int]] | None = None):
    """An Arrow function from text to ids. Without ``encode``, ids are hashes of words and marks. One text at a time is a
    Python string; ids are kept in four bytes each."""

    @F.arrow_udf("array<int>")
    def tokenize(texts: pa.Array) -> pa.Array:
        import zlib

        of = encode or (lambda t: (zlib.crc32(w[0].encode()) & 0x7FFFFFFF for w in TOKEN.finditer(t)))
        ids, ends = array("i"), array("i", [0])
        for text in texts:
            if text.is_valid:
                ids.extend(of(text.as_py()))
            ends.append(len(ids))
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(ids, np.int32)) if ids else pa.array([], pa.int32()))

    return tokenize


def token_count(text: Column | str) -> Column:
    """Tokens of the default tokenizer, counted without leaving the JVM."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")).cast("long")


def embed(rows: DataFrame, encode: Callable[[pd.Series], list[list[float]]], path: str = "path", column: str = "embedding") -> DataFrame:
    """``rows`` with an embedding from a function over batches of paths."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{column: encode(frame[path])})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(column, ArrayType(FloatType()))]))


def register_step_expander(spark: SparkSession, name: str = "split_steps") -> None:
    """A table function for SQL: split_steps(text, most) gives (step_idx, step)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="step_idx: int, step: string")
    class Steps:
        def eval(self, text: str, most: int):
            parts = (text or "").split("\n\n")
            each = -(-len(parts) // most) if most and len(parts) > most else 1
            for i in range(0, len(parts), each):
                yield i // each, "\n\n".join(parts[i : i + each])

    spark.udtf.register(name, Steps)
