"""The corpus pipeline: five stages over ``documents``, each written and read again by whoever runs them.

Toxic documents go, repeated lines go, one document of each group of near copies stays, the sources are mixed to target
weights, and the rest is packed into sequences. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import line_dedup, mixing, near_dedup, packing, toxicity
from quern.llm.common import Scratch
from quern.llm.queries import tokenizer_path


#: Similarity from which the near_dedup stage takes documents for copies; op9 takes 85.
NEAR_PERCENT = 80


def _with_chars(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the text, where the table has it."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long"))
    return docs.select(*columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, scores below 0.5."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds."""
    return _with_chars(line_dedup.dedup_lines(docs, counts=False), docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies, alike in 0.8 or more of their shingles of five words."""
    return near_dedup.drop_near_copies(docs, percent=NEAR_PERCENT).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A trained network and a tokenizer library have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.put(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
