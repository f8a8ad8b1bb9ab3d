"""Rows taken from datasets in turns, with cursors that a later run goes on from.

A run takes the next rows of each dataset, beginning anew at its end, and writes them and the cursors behind them under the
same version number; one record, put in place by a rename, makes both count (see ``sources.commits``). A run that a crash ends
before its record has taken nothing, and one after it has taken its rows once. Two runs that start from the same version
cannot both put their record.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mixture import take_from_cursors
from ..sources import commits

CURSORS = "dataset string, position long"


def cursors(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The next version, and where each dataset's cursor stands."""
    version = len(commits.records(commits.Folder(spark, path)))
    if not version:
        return 0, spark.createDataFrame([], CURSORS)
    return version, spark.read.schema(CURSORS).parquet(f"{path.rstrip('/')}/_cursors/{version - 1:09d}")


def take_next(rows: DataFrame, quotas: DataFrame, path: str) -> int:
    """Adds the next rows of ``rows`` (dataset, line_no from 0 without gaps, ...) to the table at ``path``, as many of each
    dataset as ``quotas`` (dataset, quota) says, with ``turn`` (how often the dataset had ended); returns the version."""
    spark, path = rows.sparkSession, path.rstrip("/")
    folder = commits.Folder(spark, path)
    commits.recover(spark, path)
    version, at = cursors(spark, path)
    name = f"{version:09d}"
    wanted = quotas.join(at, "dataset", "left").select("dataset", F.coalesce("position", F.lit(0)).cast("long").alias("position"), "quota")
    taken, after = take_from_cursors(rows, wanted)
    # Datasets that this run does not ask keep their cursors.
    rest = at.join(quotas.select("dataset"), "dataset", "left_anti")
    taken.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/_staging/{name}")
    after.select("dataset", F.col("position").cast("long")).unionByName(rest).write.mode("overwrite").parquet(f"{path}/_cursors/{name}")
    if name in folder.names("_commits"):
        raise FileExistsError(f"another run has taken version {version}")
    staged = [n for n in folder.names(f"_staging/{name}") if n.endswith(".parquet")]
    record = {"files": {n: f"{name}-{i:05d}.parquet" for i, n in enumerate(staged)}}
    folder.put(f"_commits/{name}", json.dumps(record))
    commits.publish(folder, name, record)
    return version
