"""Readers and writers over whole tables: written to the shared folder, read back, and compared with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import routing
from ..plans import registry
from ..sources import artifacts, readers, writers
from .registry import query
from .routing import _centroids, _routed


def _name_parts(spark, folder: str, suffix: str) -> None:
    """Part files below ``folder`` take the name of their key's folder."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for d in fs.listStatus(root):
        if d.isDirectory():
            parts = [f.getPath() for f in fs.listStatus(d.getPath()) if f.getPath().getName().startswith("part-")]
            for i, part in enumerate(parts):
                fs.rename(part, jvm.org.apache.hadoop.fs.Path(root, f"{d.getPath().getName().split('=', 1)[1]}{f'-{i}' if i else ''}{suffix}"))


def _folder(df: DataFrame, name: str) -> str:
    return writers.shared_folder(df.sparkSession, name)


@query("SELECT doc_id, source, sha256(text) AS digest FROM documents")
def jsonl_scan(t):
    docs = t("documents").select("doc_id", "source", "text")
    out = _folder(docs, "jsonl")
    writers.write_results(docs, out)
    return readers.read_jsonl(docs.sparkSession, out, "doc_id long, source string, text string").select("doc_id", "source", F.sha2("text", 256).alias("digest"))


@query("SELECT count(*)::BIGINT AS lines, count(*)::BIGINT AS numbers, count(*)::BIGINT AS ends, 0::BIGINT AS least FROM orders")
def line_numbers(t):
    """Lines of several files, of which each is numbered from 0 without a gap."""
    orders = t("orders").select("o_orderkey", "o_comment") if "o_comment" in t("orders").columns else t("orders").select("o_orderkey")
    out = _folder(orders, "lines")
    writers.write_results(orders.repartition(3, "o_orderkey"), out)
    lines = readers.numbered_lines(orders.sparkSession, out)
    each = lines.groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("line_no").alias("d"), (F.max("line_no") + 1).alias("e"), F.min("line_no").alias("l"))
    return each.agg(F.sum("n").alias("lines"), F.sum("d").alias("numbers"), F.sum("e").alias("ends"), F.max("l").alias("least"))


@query("SELECT s_suppkey, s_name FROM supplier")
def json_scan(t):
    rows = t("supplier").select("s_suppkey", "s_name", F.floor(F.col("s_suppkey") / 100).alias("g"))
    out = _folder(rows, "json")
    rows.groupBy("g").agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("value")).write.partitionBy("g").text(out)
    return readers.read_results(rows.sparkSession, out, "json", "s_suppkey long, s_name string").select("s_suppkey", "s_name")


@query("SELECT s_suppkey, s_name AS answer, 'k' || s_suppkey AS key FROM supplier")
def nested_scan(t):
    """Arrays under a root, and a keyed object, of a hundred rows a file."""
    rows = t("supplier").select("s_suppkey", F.col("s_name").alias("answer"), F.floor(F.col("s_suppkey") / 100).alias("g"))
    spark, arrays, keyed = rows.sparkSession, _folder(rows, "arrays"), _folder(rows, "keyed")
    item = F.struct("s_suppkey", "answer")
    rows.groupBy("g").agg(F.to_json(F.struct(F.collect_list(item).alias("annotations"))).alias("value")).write.partitionBy("g").text(arrays)
    rows.groupBy("g").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("k"), "s_suppkey"), F.struct("answer").alias("v"))))).alias("value")).write.partitionBy("g").text(keyed)
    first = readers.read_nested(spark, arrays, "annotations", "s_suppkey: bigint, answer: string").select("s_suppkey", "answer")
    second = readers.read_nested(spark, keyed, "*", "answer: string").select("key", F.col("answer").alias("q_answer"))
    return first.join(second, F.col("key") == F.concat(F.lit("k"), "s_suppkey")).where("answer = q_answer").select("s_suppkey", "answer", "key")


@query("SELECT source AS dataset, 'root/' || source AS root, 'a/' || source || '.jsonl' AS annotation, false AS data_augment, 12 AS max_dynamic_patch, 0.5::DOUBLE AS repeat_time, count(*)::BIGINT AS length FROM documents WHERE source IS NOT NULL GROUP BY source")
def manifest_roundtrip(t):
    entries = t("documents").where("source is not null").groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("length"))
    entries = entries.select("dataset", F.concat(F.lit("root/"), "dataset").alias("root"), F.concat(F.lit("a/"), "dataset", F.lit(".jsonl")).alias("annotation"), F.lit(False).alias("data_augment"), F.lit(12).alias("max_dynamic_patch"), F.lit(0.5).alias("repeat_time"), "length")
    out = _folder(entries, "manifest")
    writers.write_manifest(entries, out)
    return readers.read_manifest(entries.sparkSession, out).select(*entries.columns)


@query("""SELECT 'all' AS kind, 2 * count(*)::BIGINT AS n, round(2 * sum(embedding[1]::DOUBLE), 4) AS total FROM embeddings
UNION ALL SELECT 'unique', count(*)::BIGINT, round(sum(embedding[1]::DOUBLE), 4) FROM embeddings UNION ALL SELECT 'others', count(*)::BIGINT, round(sum(embedding[1]::DOUBLE), 4) FROM embeddings""")
def feature_union(t):
    """One feature table with a row per path, and one of parallel arrays; read as one, and by their names."""
    rows = t("embeddings").select(F.concat(F.lit("v/"), "vec_id").alias("path"), "embedding", F.floor(F.col("vec_id") / 50).alias("g"))
    spark, out = rows.sparkSession, _folder(rows, "features")
    rows.select("path", "embedding").withColumn("k", F.lit("features_plain")).write.partitionBy("k").parquet(f"{out}/a")
    arrays = rows.groupBy("g").agg(F.collect_list("path").alias("image_paths"), F.collect_list("embedding").alias("features"))
    arrays.select("image_paths", "features").withColumn("k", F.lit("features_unique")).write.partitionBy("k").parquet(f"{out}/b")
    for d in ("a", "b"):
        _name_parts(spark, f"{out}/{d}", ".parquet")

    def total(kind: str, unique: bool | None) -> DataFrame:
        table = readers.read_features(spark, out, "features", unique)
        parts = [p for p in (readers.feature_rows(table.where("path is not null").select("path", "embedding")), readers.feature_rows(table.where("image_paths is not null").select("image_paths", "features")))]
        return parts[0].unionByName(parts[1]).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 4).alias("total"))

    return total("all", None).unionByName(total("unique", True)).unionByName(total("others", False))


@query("SELECT n_name AS dataset, CASE n_name WHEN 'FRANCE' THEN 'fr_v2' WHEN 'NATION_1' THEN 'first' WHEN 'CANADA' THEN 'ca' ELSE n_name END AS file FROM nation")
def dataset_names(t):
    return readers.resolve_names(t("nation").select(F.col("n_name").alias("dataset")), {"FRANCE": "fr_v2", "NATION_1": "first", "CANADA": "ca"})


@query("SELECT r_name AS task, n_name AS image, n_nationkey::VARCHAR AS answer FROM nation JOIN region ON n_regionkey = r_regionkey")
def task_lines(t):
    """A file of tab-separated lines for each region, with lines of other widths between them that are left out."""
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    good = rows.select(F.col("r_name").alias("k"), F.concat_ws("\t", "n_name", F.col("n_nationkey").cast("string")).alias("value"))
    out = _folder(rows, "tasks")
    good.unionByName(rows.select(F.col("r_name").alias("k"), F.concat(F.lit("short "), "n_name").alias("value"))).write.partitionBy("k").text(out)
    _name_parts(rows.sparkSession, out, ".txt")
    lines = readers.read_task_lines(rows.sparkSession, out, 2, ["image", "answer"])
    return lines.select(F.regexp_replace("task", r"-\d+$", "").alias("task"), "image", "answer")


@query("""SELECT p_partkey, p_name AS question, 1 + (p_size % 2 = 0)::INTEGER AS options, p_brand AS first, CASE WHEN p_size % 2 = 0 THEN p_type END AS second FROM part""")
def tsv_scan(t):
    parts = t("part").select("p_partkey", F.col("p_name").alias("question"), F.col("p_brand").alias("A"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("B"))
    out = _folder(parts, "tsv")
    parts.write.option("sep", "\t").option("header", True).option("escape", '"').csv(out)
    table = readers.option_columns(readers.read_tsv(parts.sparkSession, out, "p_partkey long, question string, A string, B string"))
    return table.select("p_partkey", "question", F.size("options").alias("options"), F.element_at("options", F.lit("A")).alias("first"), F.try_element_at("options", F.lit("B")).alias("second"))


_PLACED = f"""{_routed(4)}, d AS (SELECT doc_id, source AS dataset, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id END AS image FROM documents WHERE source IS NOT NULL)"""


def _partitioned(t):
    docs = t("documents").where("source is not null")
    image = F.when(F.col("doc_id") % 5 == 0, "nowhere").otherwise(F.concat(F.lit("i/"), "doc_id", F.lit(".jpg")))
    rows = docs.select(F.col("source").alias("dataset"), F.col("doc_id").alias("line_no"), image.alias("image"), F.concat(F.lit('{"id": '), "doc_id", F.lit("}")).alias("line"))
    features = t("embeddings").select(F.concat(F.lit("i/"), "vec_id", F.lit(".jpg")).alias("path"), "embedding", F.col("vec_id").alias("line_no"))
    return rows, routing.partition_datasets(rows, features, artifacts.ClusterModel(_centroids(t, 4)))


@query(f"""WITH {_PLACED} SELECT r.cluster, d.dataset, count(*)::BIGINT AS n, sum(d.doc_id)::BIGINT AS ids FROM d JOIN routed r ON d.image = r.vec_id GROUP BY ALL""")
def partition_sink(t):
    """Lines by the cluster of their image, in a folder per cluster and dataset, read back from there."""
    rows, routed = _partitioned(t)
    out = _folder(rows, "partitions")
    writers.write_partitions(routed, out, ["cluster", "dataset"])
    back = rows.sparkSession.read.text(out).select("cluster", "dataset", F.get_json_object("value", "$.id").cast("long").alias("id"))
    return back.groupBy("cluster", "dataset").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"""WITH {_PLACED} SELECT d.dataset, count(*)::BIGINT AS n, count(r.cluster)::BIGINT AS routed, (count(*) - count(r.cluster))::BIGINT AS skipped FROM d LEFT JOIN routed r ON d.image = r.vec_id GROUP BY d.dataset""")
def skipped_rows(t):
    return routing.skipped_counts(*_partitioned(t))


@query(f"""WITH {_routed(16)}, s AS (SELECT 'set' || (vec_id % 3)::VARCHAR AS dataset, cluster % 2 AS cluster, count(*)::BIGINT AS n FROM routed GROUP BY ALL)
SELECT dataset, cluster, n, round(100.0 * n / sum(n) OVER (PARTITION BY dataset), 6) AS percent FROM s""")
def route_job(t):
    """A saved two-stage model, loaded again, routes rows to partitions."""
    rows = t("embeddings").select("vec_id", "embedding", F.concat(F.lit("set"), F.col("vec_id") % 3).alias("dataset"), F.col("vec_id").cast("string").alias("line"))
    spark, root, centroids = rows.sparkSession, _folder(rows, "model"), _centroids(t, 16)
    mapping = centroids.select(F.col("cluster").alias("fine"), (F.col("cluster") % 2).alias("coarse"))
    artifacts.save_model(root, centroids, routing.nearest(t("embeddings"), centroids).select("vec_id", "cluster"), mapping, "two_stage")
    return routing.route_and_write(spark, rows, root, f"{root}/routed").withColumn("percent", F.round("percent", 6))


@query(f"""WITH {_routed(4)} SELECT 4 AS n_clusters, count(*)::BIGINT AS n_samples, (SELECT len(v) FROM v LIMIT 1)::INTEGER AS feature_dim, 100 AS iter_limit,
  (SELECT string_agg(n, ',' ORDER BY cluster) FROM (SELECT cluster, count(*)::VARCHAR AS n FROM routed GROUP BY cluster)) AS sizes, 'balanced_kmeans' AS clustering_method FROM routed""")
def model_metadata(t):
    centroids = _centroids(t, 4)
    root = _folder(centroids, "single")
    artifacts.save_model(root, centroids, routing.nearest(t("embeddings"), centroids).select("vec_id", "cluster"))
    meta = artifacts.load_model(centroids.sparkSession, root).metadata
    return meta.select(F.col("n_clusters").cast("int"), "n_samples", F.col("feature_dim").cast("int"), F.col("iter_limit").cast("int"), F.array_join(F.transform("cluster_sizes", lambda x: x.cast("string")), ",").alias("sizes"), "clustering_method")


@query("SELECT doc_id, 1::BIGINT AS n FROM documents GROUP BY doc_id")
def append_resume(t):
    """Rows appended in three runs that overlap, and a write that finds its output there."""
    docs = t("documents").select("doc_id", "source").dropDuplicates(["doc_id"])
    out = _folder(docs, "append")
    writers.append_missing(docs.where("doc_id % 3 = 0"), out, ["doc_id"])
    writers.append_missing(docs.where("doc_id % 2 = 0"), out, ["doc_id"])
    writers.append_missing(docs, out, ["doc_id"])
    writers.write_once(docs.limit(1), out)
    return docs.sparkSession.read.parquet(out).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""SELECT source AS dataset, sum(CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE 0 END)::BIGINT AS "0", sum(CASE WHEN doc_id % 3 = 1 THEN n_chars ELSE 0 END)::BIGINT AS "1", sum(CASE WHEN doc_id % 3 = 2 THEN n_chars ELSE 0 END)::BIGINT AS "2" FROM documents GROUP BY source""")
def report_layout(t):
    counts = t("documents").groupBy(F.col("source").alias("dataset"), (F.col("doc_id") % 3).alias("cluster")).agg(F.sum("n_chars").alias("tokens"))
    return writers.format_report(counts)


@query("""WITH c AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS r FROM conversations GROUP BY conv_id), n AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS id FROM c)
SELECT conv_id, id, (len(r) - (r[1] = 'system')::INTEGER)::INTEGER AS turns FROM n""")
def system_turns(t):
    from .texts import _conversations

    rows = _conversations(t).withColumn("line_no", F.col("conv_id"))
    return readers.drop_system_turn(rows).select("conv_id", "id", F.size("conversations").alias("turns"))


@query("""SELECT 'vqav2' AS name, 'q' || doc_id AS question, doc_id AS question_id, NULL::BIGINT AS "questionId", NULL::BIGINT AS image, lang AS answer, NULL::VARCHAR AS annotation FROM documents
UNION ALL SELECT 'docvqa', 'q' || doc_id, NULL, doc_id, NULL, lang, source FROM documents UNION ALL SELECT 'ai2d', 'q' || doc_id, NULL, NULL, doc_id, lang, source FROM documents UNION ALL SELECT 'docvqa_test', NULL, NULL, doc_id, NULL, lang, NULL FROM documents""")
def prediction_rows(t):
    rows = t("documents").select(F.concat(F.lit("q"), "doc_id").alias("question"), F.col("doc_id").alias("question_id"), F.col("lang").alias("answer"), F.col("source").alias("annotation"), "n_chars")
    parts = [registry.project_predictions(n, rows).withColumn("name", F.lit(n)) for n in ("vqav2", "docvqa", "ai2d", "docvqa_test")]
    return registry.combine(parts)
