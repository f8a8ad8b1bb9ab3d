"""Text, chat and media functions over documents, conversations and integer columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat, media
from ..functions import text as T
from ..functions.answers import normalize_answer
from ..functions.basics import words
from ..operators import quality
from .registry import query

_SQUEEZED = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
_GRAMS = """w AS (SELECT doc_id, source, string_split({squeezed}, ' ') AS w FROM documents),
g AS (SELECT doc_id, source, w, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) AS g FROM w WHERE len(w) >= {n} AND w <> ['']),
c AS (SELECT doc_id, g, count(*) AS k FROM g GROUP BY doc_id, g),
r AS (SELECT doc_id, (count(*) FILTER (k > 1)) / sum(k)::DOUBLE AS r FROM c GROUP BY doc_id)"""


def _grams(n: int) -> str:
    return _GRAMS.format(squeezed=_SQUEEZED, n=n)


@query(f"WITH {_grams(3)} SELECT w.doc_id, round(coalesce(r, 0), 6) AS repetition FROM w LEFT JOIN r USING (doc_id)")
def ngram_repetition(t):
    return t("documents").select("doc_id", F.round(T.sentence_repetition("text", 3), 6).alias("repetition"))


@query(f"""WITH {_grams(2)} SELECT w.source, count(*)::BIGINT AS n, (count(*) FILTER (coalesce(r, 0) > 0.05))::BIGINT AS dropped, round(avg(coalesce(r, 0)), 6) AS mean_repetition FROM w LEFT JOIN r USING (doc_id) GROUP BY w.source""")
def repetition_filter(t):
    return quality.repetition_report(t("documents"), "text", "source", 2, 0.05).withColumn("mean_repetition", F.round("mean_repetition", 6))


@query("""WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE role END AS role, text FROM conversations),
f AS (SELECT conv_id, arg_min(role, turn) AS first FROM c GROUP BY conv_id)
SELECT conv_id, sha256(CASE WHEN first = 'system' THEN '' ELSE '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) END
  || string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text)) AS rendered FROM c JOIN f USING (conv_id) GROUP BY conv_id, first""")
def render_chat(t):
    return _conversations(t).select("conv_id", F.sha2(chat.render("conversations", chat.TEMPLATES["helpful"]), 256).alias("rendered"))


def _conversations(t):
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    turns = t("conversations").select("conv_id", F.struct("turn", role.alias("from"), F.col("text").alias("value")).alias("turn"))
    ordered = F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value")))
    return turns.groupBy("conv_id").agg(ordered.alias("conversations"))


@query("""WITH w AS (SELECT conv_id, role, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS n FROM conversations)
SELECT conv_id, sum(n)::BIGINT AS tokens, sum(CASE WHEN role = 'assistant' THEN greatest(n - 2, 0) ELSE 0 END)::BIGINT AS learned,
  round(CASE WHEN sum(CASE WHEN role = 'assistant' THEN greatest(n - 2, 0) ELSE 0 END) > 0 THEN 1 / sqrt(sum(CASE WHEN role = 'assistant' THEN greatest(n - 2, 0) ELSE 0 END)) ELSE 0 END, 6) AS weight
FROM w GROUP BY conv_id""")
def loss_mask_counts(t):
    """Learned words of assistant turns: without the first (as the role prefix) and the last."""
    rows = t("conversations").select("conv_id", "role", words("text").alias("w"))
    ids = F.transform("w", lambda x, i: i + 1)
    labels = chat.mask_turn(ids, F.col("role") == "assistant", 1)
    per = rows.select("conv_id", F.size("w").alias("n"), F.size(F.filter(labels, lambda x: x != -100)).alias("k"))
    out = per.groupBy("conv_id").agg(F.sum("n").alias("tokens"), F.sum("k").alias("learned"))
    return out.withColumn("weight", F.round(chat.length_weight("learned"), 6))


@query("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), e AS (SELECT *, ceil(len(s) / 5.0)::INTEGER AS each FROM s)
SELECT doc_id, CASE WHEN len(s) > 5 THEN ceil(len(s) / each::DOUBLE)::INTEGER ELSE len(s)::INTEGER END AS steps,
  sha256(array_to_string(CASE WHEN len(s) > 5 THEN list_transform(range(0, len(s), each), lambda i: array_to_string(s[i + 1:i + each], chr(10))) ELSE s END, '|')) AS digest FROM e""")
def steps_split(t):
    docs = t("documents").select("doc_id", T.split_steps("text", "\n", 5).alias("s"))
    return docs.select("doc_id", F.size("s").alias("steps"), F.sha2(F.array_join("s", "|"), 256).alias("digest"))


@query("""WITH s AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(array_to_string(w[1:floor(len(w) * 0.5)::INTEGER], ' '), '^\\s+', ''), '\\s+$', '')) AS digest FROM s""")
def prefix_truncate(t):
    return t("documents").select("doc_id", F.sha2(T.truncate_prefix("text", 0.5), 256).alias("digest"))


_WORDS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_À-ɏ]+')"


def _listed(items: list[str]) -> str:
    return "[" + ", ".join("'" + x + "'" for x in items) + "]"


@query(f"""WITH d AS (SELECT source, text, {_WORDS} AS w FROM documents)
SELECT source, count(*)::BIGINT AS n, (count(*) FILTER (regexp_matches(text, '[0-9]')))::BIGINT AS digit,
  (count(*) FILTER (regexp_matches(text, '[0-9]') OR list_has_any(w, {_listed(T.NUMBER_WORDS)})))::BIGINT AS number_word,
  (count(*) FILTER (list_has_any(w, {_listed(T.QUANTITY_WORDS)})))::BIGINT AS quantity_word,
  (count(*) FILTER (list_contains({_listed(T.BOOL_WORDS)}, text)))::BIGINT AS bool_word,
  (count(*) FILTER (regexp_full_match(regexp_replace(trim(text), '\\.0+$', ''), '[+-]?\\d+')))::BIGINT AS digit_string,
  (count(*) FILTER (contains(text, '.') AND regexp_full_match(trim(text), '[+-]?(\\d+\\.\\d*|\\.\\d+)([eE][+-]?\\d+)?')))::BIGINT AS float_string
FROM d GROUP BY source""")
def question_profile(t):
    return quality.question_profile(t("documents"), "text", "source")


def _normal_sql(c: str) -> str:
    """The normaliser for DuckDB, whose patterns have no look-ahead."""
    from ..functions.answers import ARTICLES, CONTRACTIONS, NUMBERS, PUNCTUATION

    q = lambda x: "'" + x.replace("'", "''") + "'"
    out = "g"
    for p in PUNCTUATION:
        if p not in ",?":
            out = f"replace({out}, {q(p)}, CASE WHEN contains(g, {q(p + ' ')}) OR contains(g, {q(' ' + p)}) THEN '' ELSE ' ' END)"
    dots = f"replace(replace(regexp_replace({out}, '\\.(\\d)', chr(1) || '\\1', 'g'), '.', ''), chr(1), '.')"
    pairs = lambda d: "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in d.items()) + "}"
    return f"""a AS (SELECT *, trim(regexp_replace(trim(replace(replace(replace(lower({c}), ',', ''), '?', ''), '''s', ' ''s'), ' ' || chr(9) || chr(10) || chr(13)), '[\\n\\t]', ' ', 'g')) AS g FROM given),
b AS (SELECT *, string_split(trim(regexp_replace({dots}, '\\s+', ' ', 'g')), ' ') AS w FROM a),
n AS (SELECT *, list_filter(list_transform(w, lambda x: coalesce(({pairs(NUMBERS)})[x], x)), lambda x: NOT list_contains({_listed(ARTICLES)}, x)) AS w2 FROM b),
normal AS (SELECT *, array_to_string(list_transform(w2, lambda x: coalesce(({pairs(CONTRACTIONS)})[x], x)), ' ') AS normal FROM n)"""


_NORMAL = _normal_sql("text")


@query(f"WITH given AS (SELECT conv_id, turn, text FROM conversations), {_NORMAL} SELECT conv_id, turn, sha256(normal) AS digest FROM normal")
def answer_normalise(t):
    return t("conversations").select("conv_id", "turn", F.sha2(normalize_answer("text"), 256).alias("digest"))


_GRIDS = media.grids(1, 12)


_GRID = f"""g AS (SELECT unnest({[i for i, _ in _GRIDS]}) AS c, unnest({[j for _, j in _GRIDS]}) AS r, unnest(range({len(_GRIDS)})) AS o),
p AS (SELECT p_partkey, (p_partkey % 2000 + 100)::DOUBLE AS w, (p_size * 37 + 50)::DOUBLE AS h FROM part),
d AS (SELECT p.*, g.*, abs(w / h - c / r) AS gap, min(abs(w / h - c / r)) OVER (PARTITION BY p_partkey) AS least FROM p CROSS JOIN g),
m AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY o) AS k FROM d WHERE gap = least),
b AS (SELECT p_partkey, arg_max(struct_pack(c := c, r := r), o) AS g FROM m WHERE k = 1 OR w * h > 0.5 * 448 * 448 * c * r GROUP BY p_partkey)"""


@query(f"""WITH {_GRID} SELECT p_partkey, g.c::INTEGER AS cols, g.r::INTEGER AS rows, (g.c * g.r + CASE WHEN g.c * g.r > 1 THEN 1 ELSE 0 END)::INTEGER AS tiles FROM b""")
def tile_plan(t):
    sized = t("part").select("p_partkey", (F.col("p_partkey") % 2000 + 100).alias("w"), (F.col("p_size") * 37 + 50).alias("h"))
    grid = sized.withColumn("g", media.tile_grid("w", "h"))
    return grid.select("p_partkey", "g.cols", "g.rows", media.tile_count(F.col("g")).alias("tiles"))


@query("""WITH o AS (SELECT o_orderkey, (o_orderkey % 300 + 1)::BIGINT AS n FROM orders), k AS (SELECT *, least(8, n) AS k FROM o),
f AS (SELECT o_orderkey, list_transform(range(0, k), lambda i: ((n * i // k) + (n * (i + 1) // k) - 1) // 2) AS f FROM k)
SELECT o_orderkey, list_sum(f)::BIGINT + (8 - len(f)) * f[-1]::BIGINT AS total, f[1]::BIGINT AS first, f[-1]::BIGINT AS last FROM f""")
def frame_plan(t):
    rows = t("orders").select("o_orderkey", media.frame_indices((F.col("o_orderkey") % 300 + 1).cast("int"), 8).alias("f"))
    return rows.select("o_orderkey", F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.get("f", F.lit(0)).cast("long").alias("first"), F.element_at("f", -1).cast("long").alias("last"))


@query(f"""WITH {_GRID}, x AS (SELECT p_partkey, (g.c * g.r + CASE WHEN g.c * g.r > 1 THEN 1 ELSE 0 END) AS own, greatest(1, 12 // (p_partkey % 3 + 1)) AS budget, p_partkey % 3 + 1 AS images FROM b),
t AS (SELECT p_brand AS dataset, CASE WHEN p_partkey % 5 = 0 THEN least(8, p_size) ELSE least(own, budget + CASE WHEN budget > 1 THEN 1 ELSE 0 END) * images END AS tiles FROM x JOIN part USING (p_partkey))
SELECT dataset, count(*)::BIGINT AS rows, sum(tiles)::BIGINT AS tiles, (256 * sum(tiles))::BIGINT AS image_tokens FROM t GROUP BY dataset""")
def media_cost(t):
    rows = t("part").select(F.col("p_brand").alias("dataset"), F.when(F.col("p_partkey") % 5 == 0, "video").otherwise("image").alias("kind"), (F.col("p_partkey") % 2000 + 100).alias("width"), (F.col("p_size") * 37 + 50).alias("height"), (F.col("p_partkey") % 3 + 1).cast("int").alias("images"), F.col("p_size").alias("frames"))
    return quality.media_totals(quality.media_plan(rows))
