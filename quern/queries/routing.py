"""Clustering and routing over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering, joins, routing
from .registry import query

#: A few vectors serve as fixed centroids: the first of the table.
_V = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


def _routed(k: int) -> str:
    return f"""
v AS ({_V}), c AS (SELECT vec_id::INTEGER AS cluster, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS c FROM v WHERE vec_id < {k}),
sims AS (SELECT v.vec_id, c.cluster, list_dot_product(v.v, c.c) AS s FROM v CROSS JOIN c),
routed AS (SELECT vec_id, arg_max(cluster, struct_pack(s := s, n := -cluster)) AS cluster FROM sims GROUP BY vec_id)"""


def _centroids(t, k: int):
    return t("embeddings").where(F.col("vec_id") < k).select(F.col("vec_id").cast("int").alias("cluster"), F.col("embedding").cast("array<double>").alias("centroid"))


@query(f"""WITH {_routed(4)}
SELECT k.cluster, count(r.vec_id)::BIGINT AS n, round(100.0 * count(r.vec_id) / sum(count(r.vec_id)) OVER (), 6) AS percent
FROM (SELECT range::INTEGER AS cluster FROM range(4)) k LEFT JOIN routed r USING (cluster) GROUP BY k.cluster""")
def route_nearest(t):
    routed = routing.nearest(t("embeddings"), _centroids(t, 4))
    return routing.cluster_sizes(routed.select("cluster"), 4).withColumn("percent", F.round("percent", 6))


@query(f"""WITH {_routed(16)}
SELECT vec_id, cluster AS fine, cluster % 2 AS cluster FROM routed""")
def route_two_stage(t):
    centroids = _centroids(t, 16)
    mapping = centroids.select(F.col("cluster").alias("fine"), (F.col("cluster") % 2).alias("coarse"))
    return routing.nearest_two_stage(t("embeddings").select("vec_id", "embedding"), centroids, mapping).drop("embedding")


@query(f"""WITH {_routed(4)}
SELECT d.doc_id, coalesce(r.cluster, 0) % 2 AS cluster FROM documents d LEFT JOIN (SELECT * FROM routed WHERE vec_id % 7 <> 0) r ON d.doc_id = r.vec_id""")
def route_default(t):
    routes = routing.nearest(t("embeddings").where("vec_id % 7 <> 0"), _centroids(t, 4)).select(F.col("vec_id").alias("doc_id"), "cluster")
    return routing.default_route(t("documents").select("doc_id"), routes, "doc_id", 2)


@query(f"""WITH {_routed(4)},
parts AS (SELECT r.cluster, unnest(v.v) AS x, generate_subscripts(v.v, 1) - 1 AS pos FROM routed r JOIN v USING (vec_id)),
means AS (SELECT cluster, pos, avg(x) AS m FROM parts GROUP BY cluster, pos),
norms AS (SELECT cluster, sqrt(sum(m * m)) AS n FROM means GROUP BY cluster)
SELECT cluster, pos::INTEGER AS pos, round(m / greatest(n, 1e-8), 6) AS value FROM means JOIN norms USING (cluster)""")
def kmeans_one_step(t):
    updated = clustering.update_centroids(routing.nearest(t("embeddings"), _centroids(t, 4)))
    return updated.select("cluster", F.posexplode("centroid").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(f"""WITH {_routed(4)},
rows AS (SELECT d.source, r.cluster FROM documents d JOIN routed r ON d.doc_id = r.vec_id),
grid AS (SELECT source, range::INTEGER AS cluster FROM (SELECT DISTINCT source FROM rows) CROSS JOIN range(4))
SELECT g.source, g.cluster, count(r.source)::BIGINT AS n, round(100.0 * count(r.source) / sum(count(r.source)) OVER (PARTITION BY g.source), 6) AS percent
FROM grid g LEFT JOIN rows r ON g.source = r.source AND g.cluster = r.cluster GROUP BY g.source, g.cluster""")
def partition_counts(t):
    routed = routing.nearest(t("embeddings"), _centroids(t, 4)).select(F.col("vec_id").alias("doc_id"), "cluster")
    rows = t("documents").select("doc_id", "source").join(routed, "doc_id")
    return routing.cluster_sizes(rows.select("source", "cluster"), 4, ["source"]).withColumn("percent", F.round("percent", 6))


@query()
def spherical_kmeans(t):
    c = clustering.spherical_kmeans(t("embeddings"), 8)
    return routing.cluster_sizes(c.assignments, 8)


@query("""SELECT c::INTEGER AS cluster, (n // 4 + (c < n % 4)::INTEGER)::BIGINT AS n, 100.0::DOUBLE * (n // 4 + (c < n % 4)::INTEGER) / n AS percent FROM (SELECT count(*) AS n FROM embeddings) CROSS JOIN range(4) r(c)""")
def balanced_kmeans(t):
    c = clustering.balanced_kmeans(t("embeddings"), 4)
    return routing.cluster_sizes(c.assignments, 4)


@query()
def two_stage_kmeans(t):
    fine, mapping = clustering.two_stage(t("embeddings"), 16, 2)
    return fine.assignments.join(mapping, fine.assignments["cluster"] == mapping["fine"]).groupBy("fine", "coarse").count()


_PATHS = "SELECT page_id AS line_no, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN ' ./data/' || url WHEN 2 THEN 'other/' || regexp_extract(url, '[^/]*$') ELSE '' END AS image FROM pages"


@query(f"""WITH rows AS ({_PATHS}), f AS (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '^\\./', ''), '^data/', '') AS norm, regexp_extract(url, '[^/]*$') AS base FROM pages),
e AS (SELECT url, max(page_id) AS id FROM f GROUP BY url), n AS (SELECT norm, max(page_id) AS id FROM f GROUP BY norm), b AS (SELECT base, min(page_id) AS id FROM f GROUP BY base)
SELECT r.line_no, coalesce(e.id, n.id, b.id) AS feature FROM rows r
LEFT JOIN e ON r.image = e.url AND r.image <> ''
LEFT JOIN n ON regexp_replace(regexp_replace(trim(r.image), '^\\./', ''), '^data/', '') = n.norm AND r.image <> ''
LEFT JOIN b ON regexp_extract(r.image, '[^/]*$') = b.base AND r.image <> ''""")
def path_cascade_join(t):
    pages = t("pages").select(F.col("page_id").alias("line_no"), "url")
    base = F.substring_index("url", "/", -1)
    image = F.when(F.col("line_no") % 4 == 0, F.col("url")).when(F.col("line_no") % 4 == 1, F.concat(F.lit(" ./data/"), "url")).when(F.col("line_no") % 4 == 2, F.concat(F.lit("other/"), base)).otherwise("")
    rows = pages.select("line_no", image.alias("image"))
    features = pages.select(F.col("url").alias("path"), "line_no", F.col("line_no").alias("feature"))
    return joins.path_cascade(rows, features, "feature", drop_prefix=True).select("line_no", "feature")
