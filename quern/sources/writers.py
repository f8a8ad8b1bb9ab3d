"""Writers of partitions, results, artifacts and score tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import append_once


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; a local session that names none gets a
    temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_partitions(rows: DataFrame, path: str, keys: list[str], line: str = "line", mode: str = "errorifexists") -> None:
    """The lines as they were, in a folder per key. Adaptive execution splits the partition of a large key, which gets
    several files, and lets small keys share a task."""
    rows.select(*keys, line).hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).text(path)


def write_results(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Nothing happens where the output exists."""
    rows.write.mode("ignore").parquet(path)


def append_missing(rows: DataFrame, path: str, keys: list[str], batch: str | None = None) -> None:
    """Rows whose key the table at ``path`` does not hold yet are added to it, all of them or none (see ``commits``); a batch
    that has a name is added once."""
    append_once(rows, path, keys, batch)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system it belongs to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p))


def write_manifest(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A mixture manifest as one JSON object. It has a row per dataset, so its size does not follow the data."""
    fields = [c for c in entries.columns if c != "dataset"]
    pair = F.struct("dataset", F.struct(*fields))
    entries.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(pair)))).alias("value")).write.mode(mode).text(path)


SCORE_KEY = ["dataset", "split", "label", "metric"]


def upsert_scores(scores: DataFrame, new: DataFrame, keys: list[str] = SCORE_KEY) -> DataFrame:
    """``scores`` with the rows of ``new`` in place of those with the same key."""
    return scores.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def format_report(counts: DataFrame, by: str = "cluster") -> DataFrame:
    """Token counts as a row per dataset and a column per cluster."""
    return counts.groupBy("dataset").pivot(by).agg(F.sum("tokens")).na.fill(0)
