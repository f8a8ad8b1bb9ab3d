"""Benchmark metrics over derived predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.boxes import iou, iou_pixels
from ..operators import joins, metrics
from .registry import query


@query("""SELECT lang AS category, (count(*) FILTER (p AND q))::BIGINT AS tp, (count(*) FILTER (p AND NOT q))::BIGINT AS fp, (count(*) FILTER (NOT p AND NOT q))::BIGINT AS tn, (count(*) FILTER (NOT p AND q))::BIGINT AS fn, count(*)::BIGINT AS n,
  round((count(*) FILTER (p AND q)) / nullif(count(*) FILTER (p), 0)::DOUBLE, 6) AS precision, round((count(*) FILTER (p AND q)) / nullif(count(*) FILTER (q), 0)::DOUBLE, 6) AS recall,
  round((count(*) FILTER (p = q)) / count(*)::DOUBLE, 6) AS accuracy, round((count(*) FILTER (p)) / count(*)::DOUBLE, 6) AS yes_ratio,
  round(2.0 * (count(*) FILTER (p AND q)) / nullif((count(*) FILTER (p)) + (count(*) FILTER (q)), 0)::DOUBLE, 6) AS f1
FROM (SELECT lang, n_chars % 3 > 0 AS p, quality = 1 AS q FROM labels JOIN documents USING (doc_id)) GROUP BY lang""")
def binary_metrics(t):
    rows = t("labels").join(t("documents"), "doc_id").select(F.col("lang").alias("category"), F.when(F.col("n_chars") % 3 > 0, "yes").otherwise("no").alias("pred"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("gt"))
    out = metrics.binary_metrics(rows, ["category"])
    return out.select("category", "tp", "fp", "tn", "fn", "n", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy", "yes_ratio", "f1")))


@query("""WITH r AS (SELECT lang AS task, CASE n_chars % 5 WHEN 0 THEN 'other' WHEN 1 THEN 'no' ELSE 'yes' END AS p, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS g, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 2 AS pair FROM labels JOIN documents USING (doc_id)),
b AS (SELECT task, pair, sum((p = g)::INTEGER) AS k FROM r GROUP BY ALL), q AS (SELECT task, avg((k = 2)::INTEGER) AS plus FROM b GROUP BY task),
a AS (SELECT task, avg((p = g)::INTEGER) AS acc, count(*) FILTER (p = 'other') AS other, count(*) FILTER (p = 'yes' AND g = 'yes') AS tp, count(*) FILTER (p = 'yes') AS py, count(*) FILTER (p <> 'other' AND g = 'yes') AS gy FROM r GROUP BY task)
SELECT task, round(acc, 6) AS accuracy, round(plus, 6) AS accuracy_plus, round(tp / nullif(py, 0)::DOUBLE, 6) AS precision, round(tp / nullif(gy, 0)::DOUBLE, 6) AS recall, other::BIGINT AS other, round(100 * (acc + plus), 6) AS score FROM a JOIN q USING (task)""")
def yesno_pairs(t):
    rows = t("labels").join(t("documents"), "doc_id").select(F.col("lang").alias("task"), F.col("doc_id").alias("line_no"), F.when(F.col("n_chars") % 5 == 0, "maybe").when(F.col("n_chars") % 5 == 1, "No, it is").otherwise("Yes.").alias("pred"), F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("gt"))
    out = metrics.yes_no_tasks(rows)
    return out.select("task", *(F.round(c, 6).alias(c) for c in ("accuracy", "accuracy_plus", "precision", "recall")), "other", F.round("score", 6).alias("score"))


_BOX = """b AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS x1, l_suppkey % 50 AS y1, l_partkey % 50 + l_quantity AS x2, l_suppkey % 50 + l_quantity AS y2, l_partkey % 41 AS u1, l_suppkey % 43 AS v1, l_partkey % 41 + 20.0 AS u2, l_suppkey % 43 + l_quantity AS v2 FROM lineitem),
i AS (SELECT *, {0} AS e FROM b),
o AS (SELECT *, greatest(0, least(x2, u2) - greatest(x1, u1) + e) * greatest(0, least(y2, v2) - greatest(y1, v1) + e) AS inter, (x2 - x1 + e) * (y2 - y1 + e) AS a, (u2 - u1 + e) * (v2 - v1 + e) AS c FROM i),
s AS (SELECT l_linenumber, inter / (a + c - inter) AS iou FROM o)"""


def _boxes(t):
    x, y, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    d = lambda c: c.cast("double")
    return t("lineitem").select("l_linenumber", F.array(d(x % 50), d(y % 50), d(x % 50 + q), d(y % 50 + q)).alias("box"), F.array(d(x % 41), d(y % 43), d(x % 41 + 20.0), d(y % 43 + q)).alias("gt_box"))


@query(f"WITH {_BOX.format(0)} SELECT l_linenumber, count(*)::BIGINT AS n, round(avg(iou), 6) AS mean_iou, round(avg((iou >= 0.5)::INTEGER), 6) AS precision FROM s GROUP BY l_linenumber")
def grounding_iou(t):
    rows = _boxes(t).withColumn("iou", iou("box", "gt_box"))
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(metrics.rate(F.col("iou") >= 0.5), 6).alias("precision"))


@query(f"WITH {_BOX.format(1)} SELECT l_linenumber, count(*)::BIGINT AS n, round(avg((iou > 0.5)::INTEGER), 6) AS accuracy FROM s GROUP BY l_linenumber")
def detection_iou(t):
    rows = _boxes(t).withColumn("iou", iou_pixels("box", "gt_box"))
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(metrics.rate(F.col("iou") > 0.5), 6).alias("accuracy"))


_PLACES = "SELECT r_name AS domain, n_name AS category, (o_orderkey % 3 > 0)::INTEGER AS ok, c_mktsegment AS segment, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _placed(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("r_name").alias("domain"), F.col("n_name").alias("category"), (F.col("o_orderkey") % 3 > 0).alias("correct"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), "o_orderkey", "o_totalprice")


@query(f"SELECT domain, category, round(avg(ok), 6) AS accuracy, count(*)::BIGINT AS n, (grouping(domain) + grouping(category))::INTEGER AS level FROM ({_PLACES}) GROUP BY ROLLUP (domain, category)")
def group_accuracy_rollup(t):
    return metrics.rollup_accuracy(_placed(t), ["domain", "category"]).withColumn("accuracy", F.round("accuracy", 6))


@query(f"SELECT round(avg(a), 6) AS accuracy, count(*)::BIGINT AS tasks FROM (SELECT category, avg(ok) AS a FROM ({_PLACES}) GROUP BY category)")
def macro_accuracy(t):
    return metrics.macro_accuracy(_placed(t), "category").withColumn("accuracy", F.round("accuracy", 6))


@query(f"SELECT category, round(100 * avg(ok), 6) AS accuracy, count(*)::BIGINT AS n, grouping(category)::INTEGER AS level FROM ({_PLACES}) GROUP BY ROLLUP (category)")
def micro_accuracy(t):
    return metrics.micro_accuracy(_placed(t), "category").withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH m AS (SELECT segment AS ability, avg(ok) AS score FROM ({_PLACES}) GROUP BY segment) SELECT ability, round(score, 6) AS score FROM m UNION ALL SELECT 'overall', round(sum(score), 6) FROM m")
def summed_abilities(t):
    rows = _placed(t).withColumn("score", F.col("correct").cast("double")).withColumnRenamed("segment", "ability")
    return metrics.summed_abilities(rows).withColumn("score", F.round("score", 6))


@query(f"""WITH p AS ({_PLACES}), l AS (SELECT 'segment' AS key, segment AS value, ok FROM p UNION ALL SELECT 'priority', priority, ok FROM p UNION ALL SELECT 'tags', unnest([domain, left(priority, 1)]), ok FROM p)
SELECT key, value, round(100 * avg(ok), 2) AS accuracy, count(*)::BIGINT AS n FROM l GROUP BY ALL""")
def attribute_accuracy(t):
    rows = _placed(t).withColumn("tags", F.array("domain", F.left("priority", F.lit(1))))
    return metrics.attribute_accuracy(rows, ["segment", "priority"], ("tags",))


@query("""SELECT CASE WHEN q BETWEEN 1 AND 4 THEN 'image' ELSE 'video' END AS kind, q AS question_type_id, round(avg((o_orderkey % 3 = 0)::INTEGER), 6) AS accuracy, count(*)::BIGINT AS n
FROM (SELECT o_orderkey, left(o_orderpriority, 1)::INTEGER AS q FROM orders) GROUP BY GROUPING SETS ((kind, q), (kind), ())""")
def type_accuracy(t):
    rows = t("orders").select(F.left("o_orderpriority", F.lit(1)).cast("int").alias("question_type_id"), (F.col("o_orderkey") % 3).alias("pred"), F.lit(0).alias("gt"))
    return metrics.type_accuracy(rows, image_types=(1, 4)).withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH e AS (SELECT event_type, value, value * (1 + event_id % 3) AS other FROM events), b AS (SELECT event_type AS category, value, other FROM e UNION ALL SELECT 'all', value, other FROM e),
m AS (SELECT category, avg(value) AS a, avg(other) AS b FROM b GROUP BY category)
SELECT category, round(b / a * 100, 1) AS relative, round(a * 10, 1) AS first, round(b * 10, 1) AS second FROM m""")
def judge_summary(t):
    rows = t("events").select(F.col("event_type").alias("category"), F.col("value").alias("first"), (F.col("value") * (1 + F.col("event_id") % 3)).alias("second"))
    return metrics.judge_summary(rows)


@query("""SELECT (event_id % 8)::BIGINT AS kind, round(avg(r), 6) AS rating, round(avg((r < 3)::INTEGER), 6) AS hallucination, count(*)::BIGINT AS n FROM (SELECT event_id, (event_id * 7 % 13 % 7) AS r FROM events) GROUP BY ROLLUP (event_id % 8)""")
def rating_summary(t):
    rows = t("events").select(F.col("event_id").alias("index"), (F.col("event_id") * 7 % 13 % 7).alias("rating"))
    return metrics.rating_summary(rows).select("kind", F.round("rating", 6).alias("rating"), F.round("hallucination", 6).alias("hallucination"), "n")


_LEN = "length(coalesce(text, ''))"


@query("""WITH d AS (SELECT doc_id AS k, lang, regexp_extract_all(lower(text), '[a-z0-9]+') AS p FROM documents),
e AS (SELECT a.k, a.p, b.p AS t FROM d a JOIN d b ON b.k = a.k - 1 ),
a AS (SELECT k, n, unnest(list_transform(range(1, len(p) - n + 2), lambda i: array_to_string(p[i:i + n - 1], ' '))) AS g FROM e CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(p) >= n),
b AS (SELECT k, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS g FROM e CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(t) >= n),
ca AS (SELECT k, n, g, count(*) AS c FROM a GROUP BY ALL), cb AS (SELECT k, n, g, count(*) AS c FROM b GROUP BY ALL),
h AS (SELECT ca.n, sum(least(ca.c, coalesce(cb.c, 0))) AS hit, sum(ca.c) AS total FROM ca LEFT JOIN cb USING (k, n, g) GROUP BY ca.n),
l AS (SELECT sum(len(p)) AS c, sum(len(t)) AS r FROM e), x AS (SELECT count(*) FILTER (hit > 0) AS o, avg(ln(hit / total)) FILTER (hit > 0) AS m FROM h)
SELECT round(coalesce(CASE WHEN o = 4 THEN CASE WHEN c > r THEN 1 ELSE exp(1 - r / c) END * exp(m) END, 0), 6) AS bleu, c::BIGINT AS pred_words, r::BIGINT AS truth_words FROM x, l""")
def bleu4(t):
    """Each document against the one with the id before it."""
    docs = t("documents")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("before"))
    rows = docs.select("doc_id", "text").join(before, "doc_id")
    out = metrics.bleu(rows.select(F.col("doc_id").alias("id"), F.col("text").alias("pred"), F.array("before").alias("gts")))
    return out.withColumn("bleu", F.round("bleu", 6))


@query("""SELECT source AS "group", round(avg(a), 6) AS accuracy, count(*)::BIGINT AS tasks FROM (SELECT source, lang, avg((n_chars % 2 = 0)::INTEGER) AS a FROM documents GROUP BY ALL) GROUP BY source""")
def grouped_macro(t):
    tasks = t("documents").groupBy("source", "lang").agg(F.avg((F.col("n_chars") % 2 == 0).cast("double")).alias("a"))
    return tasks.groupBy(F.col("source").alias("group")).agg(F.round(F.avg("a"), 6).alias("accuracy"), F.count("*").alias("tasks"))


@query("""SELECT source, round(avg(CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END), 6) AS mean_words FROM documents GROUP BY source""")
def mean_words(t):
    return metrics.mean_words(t("documents"), by=("source",)).withColumn("mean_words", F.round("mean_words", 6))


@query("""SELECT d.doc_id, l.quality AS label FROM documents d JOIN labels l USING (doc_id)""")
def dimension_join(t):
    return joins.dimension(t("documents").select("doc_id"), t("labels").select("doc_id", F.col("quality").alias("label")), ["doc_id"], "inner")
