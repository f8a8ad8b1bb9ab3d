"""Parsing of options, boxes and judge replies, label joins, and scores through the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.boxes import iou, parse_box
from ..operators import joins, metrics, mixture
from ..plans.registry import combine_and_score
from .registry import query


@query("""SELECT p_partkey, p_name || chr(10) || '(A) ' || p_brand || chr(10) || '(B) ' || p_type AS prompt FROM part""")
def option_prompt(t):
    return t("part").select("p_partkey", A.option_prompt("p_name", F.array("p_brand", "p_type"), "bracket").alias("prompt"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 400 AS x, l_suppkey % 300 AS y, l_quantity::BIGINT * 9 AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, round(x / 1000.0::DOUBLE * 640, 6) AS x1, round(y / 1000.0::DOUBLE * 480, 6) AS y1, round((x + q) / 1000.0::DOUBLE * 640, 6) AS x2, round((y + q) / 1000.0::DOUBLE * 480, 6) AS y2 FROM b""")
def parse_boxes(t):
    x, y, q = F.col("l_partkey") % 400, F.col("l_suppkey") % 300, F.col("l_quantity").cast("long") * 9
    said = F.format_string("the box is [[%d, %d, %d, %d]].", x, y, x + q, y + q)
    box = parse_box(said, F.lit(640.0), F.lit(480.0))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", box.alias("b"))
    return rows.select("l_orderkey", "l_linenumber", *(F.round(F.get("b", F.lit(i)), 6).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 10)::DOUBLE WHEN 1 THEN -1.0 ELSE 8.5 END AS first, CASE event_id % 3 WHEN 0 THEN 7.5 WHEN 1 THEN -1.0 ELSE 9.0 END AS second,
  CASE WHEN event_id % 3 = 2 THEN 0 WHEN event_id % 9 <= 6 THEN (event_id % 9)::INTEGER ELSE 0 END AS rating FROM events""")
def judge_parse(t):
    e = F.col("event_id")
    scores = F.when(e % 3 == 0, F.concat((e % 10).cast("string"), F.lit(" 7.5\nbecause"))).when(e % 3 == 1, "no scores here").otherwise("8.5, 9\n")
    rating = F.when(e % 3 == 2, "rating: 2 or rating: 3").otherwise(F.concat(F.lit("I say Rating: "), (e % 9).cast("string")))
    rows = t("events").select("event_id", A.judge_scores(scores).alias("s"), A.judge_rating(rating).alias("rating"))
    return rows.select("event_id", F.get("s", F.lit(0)).alias("first"), F.get("s", F.lit(1)).alias("second"), "rating")


@query("""WITH a AS (SELECT doc_id, source, string_split(text, chr(10))[1] AS line FROM documents),
l AS (SELECT source, line, min(doc_id) AS label FROM a WHERE doc_id % 2 = 0 GROUP BY ALL)
SELECT a.doc_id, l.label FROM a JOIN l USING (source, line)""")
def label_join(t):
    docs = t("documents").select("doc_id", F.col("source").alias("image"), "text")
    line = F.substring_index("text", "\n", 1)
    labels = docs.where("doc_id % 2 = 0").groupBy("image", line.alias("text")).agg(F.min("doc_id").alias("label"))
    return joins.label_join(docs, labels).select("doc_id", "label")


_AREA = "SELECT l_linenumber, (l_quantity::BIGINT * (l_linenumber * l_linenumber)) AS gt, (l_quantity::BIGINT * (l_linenumber * l_linenumber)) + l_suppkey % 50 AS pred FROM lineitem"


@query(f"""WITH r AS ({_AREA}), s AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'count' WHEN 1 THEN 'area' ELSE 'presence' END AS type,
  CASE WHEN l_linenumber % 3 = 2 THEN (pred = gt)::INTEGER ELSE ((CASE WHEN pred <= 0 THEN 0 WHEN pred <= 100 THEN 1 WHEN pred <= 1000 THEN 2 ELSE 3 END) = (CASE WHEN gt <= 0 THEN 0 WHEN gt <= 100 THEN 1 WHEN gt <= 1000 THEN 2 ELSE 3 END))::INTEGER END AS ok FROM r),
l AS (SELECT type, ok FROM s UNION ALL SELECT 'total', ok FROM s UNION ALL SELECT 'useful', ok FROM s WHERE type = 'presence')
SELECT type, round(avg(ok), 4) AS score, count(*)::BIGINT AS n FROM l GROUP BY type""")
def useful_scores(t):
    n = F.col("l_linenumber")
    gt = F.col("l_quantity").cast("long") * n * n
    pred = gt + F.col("l_suppkey") % 50
    kind = F.when(n % 3 == 0, "count").when(n % 3 == 1, "area").otherwise("presence")
    unit = F.when(n % 3 == 1, "m2").otherwise("")
    rows = t("lineitem").select(kind.alias("type"), F.concat(pred.cast("string"), unit).alias("pred"), F.concat(gt.cast("string"), unit).alias("gt"))
    return metrics.useful_scores(rows)


@query("""WITH p AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS gt, CASE WHEN doc_id % 4 = 0 THEN ' EN ' ELSE lang END AS pred FROM documents)
SELECT 'ai2d' AS dataset, 'accuracy' AS label, round(avg((lower(trim(pred)) = gt OR lower(trim(pred)) = 'xx')::INTEGER), 6) AS metric_value, count(*)::BIGINT AS n FROM p""")
def registry_scores(t):
    rows = t("documents").select(F.when(F.col("doc_id") % 4 == 0, " EN ").otherwise(F.col("lang")).alias("answer"), F.array(F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang")), F.lit("xx")).alias("annotation"), "doc_id")
    parts = [rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1").drop("doc_id")]
    return combine_and_score("ai2d", parts).withColumn("metric_value", F.round("metric_value", 6))


@query("""WITH d AS (SELECT source AS dataset, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT dataset, count(*)::BIGINT AS rows, 100::BIGINT AS drawn FROM d GROUP BY dataset""")
def draw_with_replacement(t):
    """How many rows each source has, and how many draws of 100 it gives."""
    rows = t("documents").select(F.col("source").alias("dataset"), F.col("doc_id").alias("line_no"))
    sizes = rows.groupBy("dataset").agg(F.count("*").alias("rows"))
    drawn = mixture.draw_with_replacement(rows, sizes.select("dataset", F.lit(100).cast("long").alias("quota")), "line_no")
    counts = drawn.groupBy(F.col("dataset").alias("q_dataset")).agg(F.count("*").alias("drawn"))
    return sizes.join(counts, F.col("dataset").eqNullSafe(F.col("q_dataset"))).drop("q_dataset")


@query("""SELECT l_linenumber, round(avg(greatest(0, least(x + q, u + 20) - greatest(x, u))), 6) AS overlap FROM (SELECT l_linenumber, l_partkey % 50 AS x, l_quantity AS q, l_partkey % 41 AS u FROM lineitem) GROUP BY l_linenumber""")
def box_overlap(t):
    """Boxes of height 1: their intersection is the length they share, here from IoU and the areas."""
    x, q, u = F.col("l_partkey") % 50, F.col("l_quantity"), F.col("l_partkey") % 41
    d = lambda c: c.cast("double")
    a, b = F.array(d(x), F.lit(0.0), d(x + q), F.lit(1.0)), F.array(d(u), F.lit(0.0), d(u + 20), F.lit(1.0))
    o = iou(a, b)
    return t("lineitem").groupBy("l_linenumber").agg(F.round(F.avg(o / (1 + o) * (q + 20)), 6).alias("overlap"))
