"""Joins between dataset rows, features, predictions and ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import basename, normalize_path
from ..sources.writers import shared_folder


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` as a checkpoint in the shared folder of ``spark.checkpoint.dir``: costly columns are computed once, lineage
    ends, and lost executors lose nothing. A local session that names no folder gets a temporary one."""
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))
    return rows.checkpoint()


def last_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one that comes last."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def feature_keys(features: DataFrame, value: str, feature_path: str = "path", order: str = "line_no", drop_prefix: bool = False) -> DataFrame:
    """(q_kind, q_key, q_value): what each kind of key of a feature's path stands for. 0 is the path as it is, 1 the path once
    normalised (the last feature counts), 2 the base name (the first one does). One aggregate for all kinds."""
    path, at = F.col(feature_path), F.col(order)
    each = [F.struct(F.lit(i).alias("kind"), k.alias("key")) for i, k in enumerate((path, normalize_path(path, drop_prefix), basename(path)))]
    flat = features.select(at.alias("q_order"), F.col(value).alias("q_value"), F.explode(F.array(*each)).alias("k")).where("k.key is not null")
    picked = flat.groupBy(F.col("k.kind").alias("q_kind"), F.col("k.key").alias("q_key")).agg(F.max_by(F.struct("q_value"), "q_order").alias("last"), F.min_by(F.struct("q_value"), "q_order").alias("first"))
    return picked.select("q_kind", "q_key", F.when(F.col("q_kind") == 2, F.col("first.q_value")).otherwise(F.col("last.q_value")).alias("q_value"))


def path_cascade(rows: DataFrame, features: DataFrame, value: str, path: str = "image", feature_path: str = "path", order: str = "line_no", drop_prefix: bool = False) -> DataFrame:
    """``rows`` with ``value`` of the feature whose path is equal, else equal once normalised, else of the same base name.

    Equal paths: the last feature counts; base names: the first. Rows without a match have null; empty paths match nothing.
    Distinct paths, not rows, meet the features, in one join by kind and key; the least kind that matches counts. Rows then
    find their path's value, which is a join by the path alone.
    """
    keys = feature_keys(features, value, feature_path, order, drop_prefix)
    asked = rows.select(F.col(path).alias("q_path")).where("q_path <> ''").distinct()
    p = F.col("q_path")
    each = [F.struct(F.lit(i).alias("kind"), k.alias("key")) for i, k in enumerate((p, normalize_path(p, drop_prefix), basename(p)))]
    flat = asked.select("q_path", F.explode(F.array(*each)).alias("k")).select("q_path", F.col("k.kind").alias("q_kind"), F.col("k.key").alias("q_key"))
    # A feature whose value is null still ends the search of its kind only, as the next kind may have one.
    met = flat.join(keys.where("q_value is not null"), ["q_kind", "q_key"])
    found = met.groupBy("q_path").agg(F.min_by("q_value", "q_kind").alias("q_value"))
    out = rows.join(found, F.col(path) == found["q_path"], "left")
    return out.select(*(rows[c] for c in rows.columns if c != value), F.col("q_value").alias(value))


def by_position(left: DataFrame, right: DataFrame, line: str = "line_no") -> DataFrame:
    """Rows at the same place; the longer side's tail goes."""
    return left.join(right, line)


def with_truth(predictions: DataFrame, truth: DataFrame, key: str = "question_id", strict: bool = False) -> DataFrame:
    """Predictions with their annotation; those without one go, or fail in strict mode."""
    if strict:
        missing = predictions.join(truth, key, "left_anti").limit(1).count()
        if missing:
            raise ValueError(f"predictions without an annotation by {key}")
    return predictions.join(truth, key)


def only_known(rows: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    return rows.join(truth.select(key).distinct(), key, "left_semi")


def integrity(truth: DataFrame, predictions: DataFrame, key: str, answer: str) -> DataFrame:
    """Problems of a prediction file by key: missing, unknown, duplicate, or an empty answer."""
    t = truth.select(F.col(key)).distinct().withColumn("in_truth", F.lit(True))
    p = predictions.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(answer).isNull()).alias("empty"))
    both = t.join(p, key, "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("in_truth").isNull(), "unknown").when(F.col("n") > 1, "duplicate").when(F.col("empty") > 0, "empty")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def label_join(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Answers (image, text, ...) with label by image and the text's first line, else by image and the whole text."""
    l1 = labels.select("image", F.col("text").alias("q_line"), F.col("label").alias("q_first"))
    l2 = labels.select("image", F.col("text").alias("q_whole"), F.col("label").alias("q_second"))
    first = F.substring_index("text", "\n", 1)
    out = answers.withColumn("q_line", first).join(l1, ["image", "q_line"], "left").withColumn("q_whole", F.col("text")).join(l2, ["image", "q_whole"], "left")
    return out.withColumn("label", F.coalesce("q_first", "q_second")).where("label is not null").select(*answers.columns, "label")


def deficit(wanted: DataFrame, done: DataFrame, keys: list[str], count: Column | int) -> DataFrame:
    """Keys for which fewer rows are done than wanted, with what is missing."""
    n = done.groupBy(*keys).agg(F.count("*").alias("q_done"))
    missing = (F.lit(count) if isinstance(count, int) else count) - F.coalesce("q_done", F.lit(0))
    return wanted.join(n, keys, "left").withColumn("missing", missing.cast("long")).where("missing > 0").drop("q_done")


def zip_lookup(first: DataFrame, second: DataFrame, third: DataFrame, lookup: DataFrame, key: str = "image") -> DataFrame:
    """Three files side by side by line_no, then a lookup by ``key``."""
    return first.join(second, "line_no").join(third, "line_no").join(lookup, key)


def with_counts(manifest: DataFrame, counts: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Datasets that have rows, with their manifest entry or the defaults, and length from the counts."""
    out = counts.join(manifest.drop("length"), "dataset", "left")
    return out.select("dataset", *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()), F.col("count").alias("length"))


def repeat_factors(datasets: DataFrame, manifest: DataFrame, cluster_manifests: DataFrame) -> DataFrame:
    """Datasets with repeat_time: of the manifest, else of the first cluster's that has it, else 1."""
    first = cluster_manifests.groupBy("dataset").agg(F.min_by("repeat_time", "cluster").alias("q_cluster"))
    own = manifest.select("dataset", F.col("repeat_time").alias("q_own"))
    return datasets.join(own, "dataset", "left").join(first, "dataset", "left").withColumn("repeat_time", F.coalesce("q_own", "q_cluster", F.lit(1.0))).drop("q_own", "q_cluster")


def dimension(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Rows with the columns of a dimension table that has one row per key."""
    return rows.join(table.dropDuplicates(keys), keys, how)


def attach_predictions(table: DataFrame, predictions: DataFrame, key: str = "index", drop: tuple[str, ...] = ("image",)) -> DataFrame:
    return table.drop(*drop).join(predictions, key, "left")


def gains(scores: DataFrame, baseline: DataFrame, keys: list[str], value: str = "accuracy") -> DataFrame:
    """Scores that the baseline also has, with the difference to two places."""
    b = baseline.select(*keys, F.col(value).alias("q_base"))
    return scores.join(b, keys).withColumn("gain", F.round(F.col(value) - F.col("q_base"), 2)).drop("q_base")


def extra_positives(positives: DataFrame, references: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Positives with reference answers for keys that have none, or for all with ``force``."""
    added = references if force else references.join(positives.select(*keys).distinct(), keys, "left_anti")
    return positives.unionByName(added, allowMissingColumns=True)


def line_window(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("line_no")
