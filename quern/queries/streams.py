"""Streams over whole tables, which arrive in files; what has run is read back as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import settled
from ..operators.mixture import numbered
from ..operators.packing import Limits
from ..sources import writers
from ..streaming import cursors, jobs
from .registry import query
from .routing import _centroids, _routed

_FILES = 3


def _arriving(table: DataFrame, name: str) -> DataFrame:
    """``table`` as a stream of files, one at a time."""
    out = writers.shared_folder(table.sparkSession, name)
    table.repartition(_FILES).write.parquet(out)
    return table.sparkSession.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(out)


def _in_turn(tables: list[DataFrame], name: str) -> DataFrame:
    """A stream whose batches are ``tables``, one after the other, each in one file."""
    spark, out = tables[0].sparkSession, writers.shared_folder(tables[0].sparkSession, name)
    for i, table in enumerate(tables):
        table.coalesce(1).write.mode("append").parquet(out)
    return spark.readStream.schema(tables[0].schema).option("maxFilesPerTrigger", 1).parquet(out)


def _run(stream: DataFrame, mode: str, name: str, mark: str | None = None) -> DataFrame:
    """The stream's result once all has arrived: rows of all batches, or (complete) the last batch."""
    spark, out, mark = stream.sparkSession, writers.shared_folder(stream.sparkSession, name), mark or writers.shared_folder(stream.sparkSession, "marks")
    write = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(f"WITH {_routed(4)} SELECT vec_id, cluster FROM routed")
def route_arriving(t):
    rows = _arriving(t("embeddings").select("vec_id", "embedding"), "vectors")
    return _run(jobs.route_stream(rows, _centroids(t, 4)).select("vec_id", "cluster"), "append", "routed")


@query("SELECT event_type, count(*)::BIGINT AS n, (count(*) FILTER (value > 120))::BIGINT AS \"right\" FROM events GROUP BY event_type")
def scores_so_far(t):
    rows = _arriving(t("events").select("event_type", (F.col("value") > 120).alias("correct")), "answers")
    return _run(jobs.running_scores(rows, ["event_type"]), "complete", "scores")


@query("SELECT doc_id, 1::BIGINT AS n FROM documents GROUP BY doc_id")
def append_arriving(t):
    """A stream appended to a table that already holds some of its rows, and once more from its start."""
    docs = t("documents").select("doc_id", "source").dropDuplicates(["doc_id"])
    spark, out = docs.sparkSession, writers.shared_folder(docs.sparkSession, "appended")
    docs.where("doc_id % 5 = 0").write.parquet(out)
    for _ in range(2):
        jobs.append_stream(_arriving(docs, "documents"), out, ["doc_id"], writers.shared_folder(spark, "marks")).awaitTermination()
    return spark.read.schema(docs.schema).parquet(out).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""SELECT doc_id AS sample, (n_chars % 900 + 1)::BIGINT AS tokens, 1::BIGINT AS times, doc_id % 97 = 0 AS alone FROM documents""")
def pack_arriving(t):
    """Every sample once, in a pack that is out or, by the stream's own state, in one that is open. Those with more images than
    a pack may have are alone in theirs."""
    limits = Limits(tokens=1000, images=3, buffers=4, overflow=False)
    images = F.when(F.col("doc_id") % 97 == 0, 4).otherwise(1)
    docs = t("documents").select(F.col("doc_id").alias("sample"), (F.col("n_chars") % 900 + 1).cast("int").alias("tokens"), images.alias("images"))
    mark = writers.shared_folder(docs.sparkSession, "marks")
    packs = _run(jobs.pack_stream(_arriving(docs, "samples"), limits, 2, None), "append", "packs", mark)
    sizes = packs.groupBy("shard", "pack").agg(F.count("*").alias("k"), F.sum("images").alias("m"))
    out = packs.join(sizes, ["shard", "pack"]).select("sample", "tokens", ((F.col("k") == 1) & (F.col("m") > limits.images)).alias("alone"))
    both = out.unionByName(jobs.waiting(docs.sparkSession, mark).select("sample", "tokens", F.lit(False).alias("alone")))
    return both.groupBy("sample").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("times"), F.bool_or("alone").alias("alone"))


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*)::BIGINT AS n, (count(*) FILTER (value > 120))::BIGINT AS "right" FROM events
WHERE ts < (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) FROM events) GROUP BY ALL""")
def scores_by_day(t):
    """Days that the watermark has closed, each once; a last file repeats early rows, which come too late to count."""
    # Event times without a zone, as instants, so that days don't follow the session's zone.
    at = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz)))")
    events = t("events").select(at.alias("ts"), "event_type", (F.col("value") > 120).alias("correct"))
    cut = F.timestamp_micros(F.lit(events.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0]))
    late = events.where(F.unix_micros("ts") < F.floor((F.unix_micros(cut) - 3_600_000_000) / 86_400_000_000) * 86_400_000_000)
    rows = _in_turn([events.where(F.col("ts") <= cut), events.where(F.col("ts") > cut), late], "answers")
    found = _run(jobs.running_scores(rows, ["event_type"], time="ts"), "append", "days")
    day = F.expr("timestampadd(MICROSECOND, unix_micros(window_start), TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return found.select(day.alias("day"), "event_type", "n", "right")


@query("""WITH r AS (SELECT coalesce(source, '') AS dataset, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) - 1 AS line_no, count(*) OVER (PARTITION BY coalesce(source, '')) AS n FROM documents),
x AS (SELECT dataset, line_no, unnest(range(0, 40)) * n + line_no AS place FROM r)
SELECT dataset, line_no::BIGINT AS line_no, count(*)::BIGINT AS times FROM x WHERE place < 40 GROUP BY ALL""")
def cursors_resumed(t):
    """Forty rows of each source in two runs, the second of which goes on where the first one stopped."""
    docs = t("documents").select(F.coalesce("source", F.lit("")).alias("dataset"), "doc_id")
    rows, out = settled(numbered(docs, "doc_id", name="line_no", by=["dataset"]).select("dataset", "line_no")), writers.shared_folder(docs.sparkSession, "turns")
    for quota in (25, 15):
        cursors.take_next(rows, rows.select("dataset").distinct().withColumn("quota", F.lit(quota)), out)
    taken = docs.sparkSession.read.schema("dataset string, line_no long").parquet(out)
    return taken.groupBy("dataset", "line_no").agg(F.count("*").alias("times"))
