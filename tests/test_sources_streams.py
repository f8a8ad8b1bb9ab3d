"""Files in and out, and streams that equal their batch forms."""

import json

from pyspark.sql import functions as F

from quern.operators.packing import Limits, pack_samples
from quern.sources import readers, writers
from quern.streaming import jobs


def test_json_lines_keep_their_numbers(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "image": "x"}\n\nnot json\n{"id": 2}\n')
    rows = readers.read_jsonl(spark, str(p), "id long, image string", keep_raw=True).orderBy("line_no").collect()
    assert [(r.line_no, r.id, r.image) for r in rows] == [(0, 1, "x"), (3, 2, None)] and rows[0].line.startswith("{")


def test_nested_manifest_tasks_and_options(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"annotations": [{"question_id": "1", "answers": [{"answer": "a"}]}]}))
    got = readers.read_nested(spark, str(tmp_path / "t.json"), "annotations", "question_id: string, answers: array<struct<answer: string>>".replace(": ", " ").replace("struct<answer ", "struct<answer: ")).first()
    assert got.question_id == "1" and got.answers[0].answer == "a"
    entries = spark.createDataFrame([("d", "r", "a", True, 6, 1.0, 5)], "dataset string, " + readers.MANIFEST_ENTRY)
    writers.write_manifest(entries, str(tmp_path / "m"))
    back = readers.read_manifest(spark, str(tmp_path / "m")).first()
    assert (back.dataset, back.repeat_time, back.length) == ("d", 1.0, 5)
    d = tmp_path / "tasks"
    d.mkdir()
    (d / "count.txt").write_text("i.jpg\tq?\tYes\nbad line\n")
    assert [tuple(r) for r in readers.read_task_lines(spark, str(d), 3, ["image", "question", "gt"]).collect()] == [("count", 0, "i.jpg", "q?", "Yes")]
    (tmp_path / "o.tsv").write_text("index\tA\tB\n1\tred\t\n")
    table = readers.option_columns(readers.read_tsv(spark, str(tmp_path / "o.tsv"), "index long, A string, B string"))
    assert table.first().options == {"A": "red"}


def test_features_partitions_and_appends(spark, tmp_path):
    parts = spark.createDataFrame([("a", "l1"), ("b", "l2")], "cluster string, line string").withColumn("dataset", F.lit("d"))
    writers.write_partitions(parts, str(tmp_path / "p"), ["cluster", "dataset"])
    assert {(r.cluster, r.value) for r in spark.read.text(str(tmp_path / "p")).collect()} == {("a", "l1"), ("b", "l2")}
    table = spark.createDataFrame([(["x", "y"], [[1.0], [2.0]])], "paths array<string>, features array<array<double>>")
    assert [(r.path, r.embedding) for r in readers.feature_rows(table).collect()] == [("x", [1.0]), ("y", [2.0])]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    writers.append_missing(rows.limit(1), str(tmp_path / "t"), ["k"])
    writers.append_missing(rows, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    rows.write.parquet(str(tmp_path / "f/x_unique_features"))
    assert readers.read_features(spark, str(tmp_path / "f"), "part", unique=False).count() == 2


def stream(spark, tmp_path, rows, name):
    rows.repartition(3).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def test_running_scores_equal_the_batch(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 3).alias("b"), (F.col("id") % 2 == 0).alias("correct"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    q = jobs.running_scores(stream(spark, tmp_path, rows, "s"), ["b"]).writeStream.outputMode("complete").format("memory").queryName("q_scores").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("q_scores").collect())) == [(0, 20, 10), (1, 20, 10), (2, 20, 10)]
    days = jobs.running_scores(rows, ["b"], time="ts").count()
    assert days == 9


def test_packing_stream_loses_no_sample(spark, tmp_path):
    rows = spark.range(90).select(F.col("id").alias("sample"), (F.col("id") % 5 + 1).cast("int").alias("tokens"), F.lit(1).alias("images"))
    limits = Limits(tokens=8, images=3, buffers=2, overflow=False)
    q = jobs.pack_stream(stream(spark, tmp_path, rows, "p"), limits, 2, None).writeStream.outputMode("append").format("memory").queryName("q_packs").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("q_packs")
    assert got.select("sample").distinct().count() == got.count() >= 90 - 2 * 2 * 3
    assert got.groupBy("shard", "pack").agg(F.sum("tokens").alias("t")).where("t > 8").count() == 0
    assert pack_samples(rows, limits, 2).count() == 90


def test_routed_and_resumed_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, embedding array<double>")
    centroids = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster int, centroid array<double>")
    q = jobs.write_routed(jobs.route_stream(stream(spark, tmp_path, rows, "r"), centroids), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination()
    assert {(r.id, r.cluster) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 0), (2, 1)}
    for n in ("a", "b"):
        jobs.append_stream(stream(spark, tmp_path, rows.drop("embedding"), n), str(tmp_path / "t"), ["id"], str(tmp_path / f"k{n}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
