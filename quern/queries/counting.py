"""Counts, manifests, shards and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.udfs import token_count
from ..operators import joins, mixture
from ..sources.writers import upsert_scores
from .registry import query

_TOKENS = "len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'))"


@query(f"""SELECT doc_id % 3 AS cluster, source AS dataset, count(*)::BIGINT AS entries, sum({_TOKENS})::BIGINT AS tokens, grouping(doc_id % 3, source)::BIGINT AS level
FROM documents GROUP BY ROLLUP (doc_id % 3, source)""")
def token_report(t):
    rows = t("documents").select((F.col("doc_id") % 3).alias("cluster"), F.col("source").alias("dataset"), "text")
    return mixture.token_counts(rows, token_count("text"))


@query(f"""WITH counts AS (SELECT doc_id % 3 AS cluster, source AS dataset, sum({_TOKENS})::BIGINT AS tokens FROM documents GROUP BY ALL),
r AS (SELECT DISTINCT source AS dataset, CASE WHEN length(source) = 4 THEN 2.0 WHEN source < 'src15' THEN 0.5 ELSE 1.0 END AS repeat_time FROM documents)
SELECT cluster, dataset, tokens, round(tokens * repeat_time, 6) AS adjusted, round(tokens * repeat_time / sum(tokens * repeat_time) OVER (PARTITION BY dataset), 6) AS share
FROM counts JOIN r USING (dataset)""")
def adjusted_tokens(t):
    rows = t("documents").select((F.col("doc_id") % 3).alias("cluster"), F.col("source").alias("dataset"), "text")
    counts = rows.groupBy("cluster", "dataset").agg(F.sum(token_count("text")).alias("tokens"))
    names = rows.select("dataset").distinct()
    own = names.where("length(dataset) = 4").withColumn("repeat_time", F.lit(2.0))
    others = names.where("dataset < 'src15'").select("dataset", F.lit(0).alias("cluster"), F.lit(0.5).alias("repeat_time")).unionByName(names.where("dataset < 'src15'").select("dataset", F.lit(1).alias("cluster"), F.lit(9.0).alias("repeat_time")))
    out = mixture.adjusted_tokens(counts, own, others)
    return out.select("cluster", "dataset", "tokens", F.round("adjusted", 6).alias("adjusted"), F.round("share", 6).alias("share"))


@query("""WITH m AS (SELECT DISTINCT source AS dataset, 'root/' || source AS root, 0.5::DOUBLE AS repeat_time FROM documents WHERE length(source) = 4)
SELECT c.dataset, coalesce(m.root, 'unknown') AS root, coalesce(m.repeat_time, 1.0) AS repeat_time, c.n::BIGINT AS length
FROM (SELECT source AS dataset, count(*) AS n FROM documents GROUP BY source) c LEFT JOIN m USING (dataset)""")
def manifest(t):
    rows = t("documents").select(F.col("source").alias("dataset"))
    known = rows.where("length(dataset) = 4").distinct().select("dataset", F.concat(F.lit("root/"), "dataset").alias("root"), F.lit(0.5).alias("repeat_time"), F.lit(0).alias("length"))
    return mixture.mixture_manifest(rows, known, {"root": "unknown", "repeat_time": 1.0})


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY source) AS n,
  CASE length(source) WHEN 4 THEN 0.5 ELSE 3.0 END AS f FROM documents),
c AS (SELECT *, CASE WHEN f < 1 THEN (rn < floor(n * f))::INTEGER ELSE floor(f)::INTEGER END AS copies FROM r)
SELECT source, sum(copies)::BIGINT AS n, sum(copies * doc_id)::BIGINT AS ids FROM c WHERE copies > 0 GROUP BY source""")
def repeat_factor(t):
    rows = t("documents").select("doc_id", "source")
    out = mixture.repeat_rows(rows, F.when(F.length("source") == 4, 0.5).otherwise(3.0), "doc_id", ["source"])
    return out.groupBy("source").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, rn FROM r WHERE rn >= 3 AND (rn - 3) % greatest(n // 100, 1) = 0 AND (rn - 3) // greatest(n // 100, 1) < 100""")
def stride_sample(t):
    rows = mixture.numbered(t("documents").select("doc_id"), "doc_id")
    total = rows.count()
    return rows.where(mixture.stride_sample(F.col("rn"), F.lit(total), 100, 3)).select("doc_id", "rn")


@query("""WITH s AS (SELECT source AS dataset, count(*)::BIGINT AS length FROM documents GROUP BY source)
SELECT dataset, length, round(sqrt(length) / sum(sqrt(length)) OVER (), 6) AS weight FROM s""")
def sqrt_weights(t):
    sizes = t("documents").groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("length"))
    return mixture.mixture_weights(sizes).withColumn("weight", F.round("weight", 6))


def _sharded(t, shard):
    rows = mixture.numbered(t("orders").select("o_orderkey"), "o_orderkey")
    total = F.lit(rows.count())
    return rows.withColumn("shard", shard(F.col("rn"), total)).where("shard is not null").groupBy("shard").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""SELECT (s - 1)::INTEGER AS shard, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) AS s FROM orders) GROUP BY s""")
def shards_block(t):
    return _sharded(t, lambda rn, n: mixture.shard_balanced(rn, n, 7))


@query("""SELECT (rn % 7)::INTEGER AS shard, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) GROUP BY rn % 7""")
def shards_stride(t):
    return _sharded(t, lambda rn, n: mixture.shard_stride(rn, 7))


@query("""SELECT (rn // (n // 7))::INTEGER AS shard, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders)
WHERE rn < (n // 7) * 7 GROUP BY ALL""")
def shards_truncated(t):
    return _sharded(t, lambda rn, n: mixture.shard_truncated(rn, n, 7))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY ALL), u AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT user_id, event_type, (15 - k)::BIGINT AS missing FROM u JOIN c USING (user_id, event_type) WHERE k < 15""")
def resume_deficit(t):
    events = t("events").select("user_id", "event_type")
    return joins.deficit(events.distinct(), events, ["user_id", "event_type"], 15)


@query("""WITH old AS (SELECT o_orderpriority AS dataset, o_orderstatus AS split, count(*)::BIGINT AS n FROM orders GROUP BY ALL),
new AS (SELECT o_orderpriority AS dataset, 'F' AS split, max(o_custkey)::BIGINT AS n FROM orders GROUP BY ALL)
SELECT * FROM old WHERE split <> 'F' UNION ALL SELECT * FROM new""")
def score_upsert(t):
    orders = t("orders")
    old = orders.groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("split")).agg(F.count("*").alias("n"))
    new = orders.groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.lit("F").alias("split"), F.max("o_custkey").alias("n"))
    return upsert_scores(old, new, ["dataset", "split"])


@query("""SELECT doc_id AS key, CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN d IS NULL THEN 'missing' END AS problem
FROM (SELECT doc_id AS d FROM documents WHERE doc_id % 5 <> 0) p FULL OUTER JOIN labels l ON p.d = l.doc_id WHERE l.doc_id IS NOT NULL AND d IS NULL
UNION ALL SELECT d, 'unknown' FROM documents JOIN (SELECT doc_id AS d FROM documents) x ON d = doc_id WHERE d % 5 <> 0 AND d NOT IN (SELECT doc_id FROM labels)""")
def truth_integrity(t):
    truth = t("labels").select(F.col("doc_id").alias("key"))
    predictions = t("documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("key"), F.col("text").alias("answer"))
    return joins.integrity(truth, predictions, "key", "answer")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_filter(t):
    return joins.only_known(t("documents").select("doc_id", "source"), t("labels").where("quality = 1"), "doc_id")


@query("""SELECT s.source, round(s.n - b.n, 2) AS gain FROM (SELECT source, avg(n_chars) AS n FROM documents GROUP BY source) s JOIN (SELECT source, avg(n_chars) AS n FROM documents WHERE lang = 'en' GROUP BY source) b USING (source)""")
def score_gain(t):
    docs = t("documents")
    mean = lambda rows: rows.groupBy("source").agg(F.avg("n_chars").alias("accuracy"))
    return joins.gains(mean(docs), mean(docs.where("lang = 'en'")), ["source"]).select("source", "gain")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) SELECT user_id, max(event_id) AS last FROM (SELECT user_id, event_id, rn, max(rn) OVER (PARTITION BY user_id) AS m FROM r) WHERE rn = m GROUP BY user_id""")
def last_wins(t):
    order = F.struct("ts", "event_id")
    return joins.last_by(t("events").select("user_id", order.alias("o"), F.col("event_id").alias("last")), ["user_id"], "o").select("user_id", "last")


