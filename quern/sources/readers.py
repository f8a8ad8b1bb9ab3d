"""Readers of line files, JSON documents, manifests and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def numbered_lines(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """Lines of text files: file, line_no (from 0 within its file, in order) and line.

    Spark numbers rows by partition, and a file's splits are in order. A line's number is its rank in its split plus the
    lines of the splits before, so that no task sees a whole file.
    """
    lines = spark.read.options(**options).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    return _numbered_in_splits(lines, ["file"], "at", "id", "line_no").select("file", "line_no", "line")


def _numbered_in_splits(rows: DataFrame, by: list[str], split: str, order: str, name: str) -> DataFrame:
    """``rows`` with their rank from 0 in their group, by the split and the order in it."""
    sizes = rows.groupBy(*by, split).agg(F.count("*").alias("q_n"))
    before = F.coalesce(F.sum("q_n").over(Window.partitionBy(*by).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = rows.withColumn("q_r", F.row_number().over(Window.partitionBy(*by, split).orderBy(order)))
    joined = inside.join(sizes.select(*by, split, before.alias("q_before")), [*by, split])
    return joined.withColumn(name, (F.col("q_before") + F.col("q_r") - 1).cast("long")).drop("q_r", "q_before")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str, keep_raw: bool = False) -> DataFrame:
    """Rows of JSON lines with file and line_no; blank and malformed lines are left out, and keep their number."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    marked = StructType([*schema.fields, *StructType.fromDDL("_corrupt_record string").fields])
    parsed = lines.withColumn("row", F.from_json("line", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    rows = parsed.where(F.col("row").isNotNull() & F.col("row._corrupt_record").isNull())
    return rows.select("file", "line_no", *(F.col(f"row.`{f.name}`").alias(f.name) for f in schema.fields), *(["line"] if keep_raw else []))


def read_json(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None) -> DataFrame:
    """Rows of JSON arrays or objects that span lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_results(spark: SparkSession, path: str | list[str], form: str, schema: StructType | str) -> DataFrame:
    """A prediction file in the form json or jsonl."""
    if form == "jsonl":
        return read_jsonl(spark, path, schema).drop("file", "line_no")
    if form == "json":
        return read_json(spark, path, schema)
    raise ValueError(f"unknown form {form}: json or jsonl")


def read_nested(spark: SparkSession, path: str, root: str, element: str) -> DataFrame:
    """Elements of an array under ``root`` of a JSON object, or the values of a keyed object with their key.

    ``element`` is the DDL of an element. A ``root`` of "*" means that the file itself is the keyed object.
    """
    if root == "*":
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<{element}>>").alias("m"))
        return whole.select(F.explode("m").alias("key", "value")).select("key", "value.*")
    return spark.read.option("multiLine", True).schema(f"{root} array<struct<{element}>>").json(path).select(F.inline(root))


def read_features(spark: SparkSession, path: str, name: str = "features", unique: bool | None = None) -> DataFrame:
    """All Parquet feature files below ``path`` whose name holds ``name``.

    ``unique`` True prefers files with "unique" in their name and falls back to the others, False leaves those out.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(path).withColumn("file", F.col("_metadata.file_path"))
    rows = rows.where(F.contains(F.substring_index("file", "/", -1), F.lit(name)))
    is_unique = F.contains(F.substring_index("file", "/", -1), F.lit("unique"))
    if unique is None:
        return rows
    chosen = rows.where(is_unique if unique else ~is_unique)
    return rows.where(~is_unique) if unique and chosen.isEmpty() else chosen


PATH_COLUMNS = ["image_paths", "paths", "image_path", "path", "image"]
VECTOR_COLUMNS = ["features", "embedding", "embeddings", "feature"]


def feature_rows(table: DataFrame, path_columns: list[str] = PATH_COLUMNS, vector_columns: list[str] = VECTOR_COLUMNS) -> DataFrame:
    """path and embedding from whichever of the known columns there are; parallel arrays become rows."""
    types = dict(table.dtypes)
    path = next((c for c in path_columns if c in types), None)
    vector = next((c for c in vector_columns if c in types), None)
    if vector is None:
        raise ValueError(f"no vector column among {table.columns}")
    if types[vector].startswith("array<array"):
        zipped = F.arrays_zip(F.col(path).alias("path"), F.col(vector).alias("embedding")) if path else F.transform(F.col(vector), lambda v: F.struct(F.lit(None).cast("string").alias("path"), v.alias("embedding")))
        return table.select(F.inline(zipped))
    return table.select((F.col(path) if path else F.lit(None).cast("string")).alias("path"), F.col(vector).alias("embedding"))


def resolve_names(names: DataFrame, aliases: dict[str, str], column: str = "dataset") -> DataFrame:
    """``names`` with file: the alias of the dataset name, or the name itself."""
    known: Column = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)) if aliases else F.create_map().cast("map<string,string>")
    return names.withColumn("file", F.coalesce(F.element_at(known, F.col(column)), F.col(column)))


def read_task_lines(spark: SparkSession, path: str, fields: int, names: list[str]) -> DataFrame:
    """Tab-separated lines of a folder of task files: task (the file's name), line_no and the named fields; only lines with
    exactly so many fields."""
    lines = numbered_lines(spark, path).withColumn("parts", F.split(F.rtrim("line"), "\t", -1)).where(F.size("parts") == fields)
    task = F.regexp_replace(F.substring_index("file", "/", -1), r"\.txt$", "")
    return lines.select(F.url_decode(task).alias("task"), "line_no", *(F.get("parts", F.lit(i)).alias(n) for i, n in enumerate(names)))


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def option_columns(table: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """``table`` with options: a map of the option columns that are filled."""
    have = [x for x in letters if x in table.columns]
    pairs = F.create_map(*(c for x in have for c in (F.lit(x), F.col(x))))
    return table.withColumn("options", F.map_filter(pairs, lambda k, v: v.isNotNull()))


#: Neighbouring lines that one task numbers.
NUMBERED_TOGETHER = 1 << 20

MANIFEST_ENTRY = "root string, annotation string, data_augment boolean, max_dynamic_patch int, repeat_time double, length bigint"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A mixture manifest as a row per dataset."""
    return read_nested(spark, path, "*", MANIFEST_ENTRY).withColumnRenamed("key", "dataset")


def drop_system_turn(rows: DataFrame) -> DataFrame:
    """Conversation rows without a leading system turn, renumbered from 0 within their file, in order of line_no."""
    c = F.col("conversations")
    cut = F.when(F.get(c, F.lit(0))["from"] == "system", F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))).otherwise(c)
    by = ["file"] if "file" in rows.columns else []
    parts = rows.withColumns({"conversations": cut, "q_split": F.floor(F.col("line_no") / NUMBERED_TOGETHER), "q_all": F.lit(0)})
    return _numbered_in_splits(parts, [*by, "q_all"], "q_split", "line_no", "id").drop("q_split", "q_all")
