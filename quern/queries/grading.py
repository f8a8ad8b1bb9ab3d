"""Answer extraction, grading, preference pairs and step labels. Predictions are derived from columns by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import preference
from .registry import query

#: Numbers near each other as strings: truth and prediction of each line item.
_NUMBERS = """n AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT::VARCHAR AS gt,
  CASE l_linenumber WHEN 1 THEN (l_quantity::BIGINT + l_suppkey % 4)::VARCHAR WHEN 2 THEN (l_quantity::BIGINT)::VARCHAR || '%' WHEN 3 THEN (l_quantity::BIGINT)::VARCHAR || ' cm' WHEN 4 THEN 'none' ELSE l_quantity::BIGINT::VARCHAR END AS pred FROM lineitem)"""


def _numbers(t):
    q = F.col("l_quantity").cast("long")
    pred = F.when(F.col("l_linenumber") == 1, (q + F.col("l_suppkey") % 4).cast("string")).when(F.col("l_linenumber") == 2, F.concat(q.cast("string"), F.lit("%"))).when(F.col("l_linenumber") == 3, F.concat(q.cast("string"), F.lit(" cm"))).when(F.col("l_linenumber") == 4, "none").otherwise(q.cast("string"))
    return t("lineitem").select("l_orderkey", "l_linenumber", q.cast("string").alias("gt"), pred.alias("pred"))


@query(f"""WITH {_NUMBERS},
v AS (SELECT *, try_cast(gt AS DOUBLE) AS t, CASE WHEN pred LIKE '%!%' ESCAPE '!' THEN try_cast(rtrim(pred, '%') AS DOUBLE) / 100 ELSE try_cast(pred AS DOUBLE) END AS p,
  try_cast(trim(replace(replace(pred, '%', ''), 'cm', '')) AS DOUBLE) AS m FROM n)
SELECT l_linenumber, count(*)::BIGINT AS n,
  sum(CASE WHEN t <> 0 AND p IS NOT NULL THEN (abs(p - t) / abs(t) <= 0.05)::INTEGER ELSE (lower(gt) = lower(pred))::INTEGER END)::BIGINT AS percent,
  sum(CASE WHEN t <> 0 AND try_cast(pred AS DOUBLE) IS NOT NULL THEN (abs((try_cast(pred AS DOUBLE) - t) / t) <= 0.05)::INTEGER ELSE (lower(gt) = lower(pred))::INTEGER END)::BIGINT AS plain,
  sum(CASE WHEN t <> 0 AND m IS NOT NULL THEN (abs(m - t) / abs(t) <= 0.001)::INTEGER ELSE (lower(gt) = lower(pred))::INTEGER END)::BIGINT AS math,
  sum((pred = gt)::INTEGER)::BIGINT AS exact
FROM v GROUP BY l_linenumber""".replace("LIKE '%!%' ESCAPE '!'", "LIKE '%!%' ESCAPE '!'"))
def numeric_match(t):
    """Equal pairs of truth and prediction are counted first and graded once."""
    rows = _numbers(t).groupBy("l_linenumber", "gt", "pred").agg(F.count("*").alias("k"))
    yes = lambda ok: F.sum(F.when(ok, F.col("k")).otherwise(F.lit(0)))
    return rows.groupBy("l_linenumber").agg(F.sum("k").alias("n"), yes(A.relaxed_match("gt", "pred", "percent")).alias("percent"), yes(A.relaxed_match("gt", "pred", "plain")).alias("plain"), yes(A.math_match("pred", "gt")).alias("math"), yes(F.col("pred") == F.col("gt")).alias("exact"))


_TEN = "list_transform(range(10), lambda i: 'a' || ((o_orderkey * (i + 1)) % 7 % 3)::VARCHAR)"


@query(f"""WITH a AS (SELECT o_orderpriority, {_TEN} AS ts, 'a' || (o_orderkey % 3)::VARCHAR AS p FROM orders), m AS (SELECT o_orderpriority, len(list_filter(ts, lambda x: x = p)) AS m FROM a)
SELECT o_orderpriority, round(avg(CASE WHEN m = 0 THEN 0 ELSE (m * least(1.0::DOUBLE, (m - 1) / 3::DOUBLE) + (10 - m) * least(1.0::DOUBLE, m / 3::DOUBLE)) / 10 END), 6) AS score FROM m GROUP BY o_orderpriority""")
def vqa_consensus(t):
    truths = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("a"), ((F.col("o_orderkey") * (i + 1)) % 7 % 3).cast("string")))
    pred = F.concat(F.lit("a"), (F.col("o_orderkey") % 3).cast("string"))
    return t("orders").groupBy("o_orderpriority").agg(F.round(F.avg(A.vqa_consensus(pred, truths)), 6).alias("score"))


@query("""SELECT page_id, round(CASE WHEN s < 0.5 THEN 0 ELSE s END, 6) AS anls FROM (
  SELECT page_id, greatest(1 - levenshtein(lower(p), lower(url)) / greatest(length(p), length(url))::DOUBLE, 1 - levenshtein(lower(p), lower(t)) / greatest(length(p), length(t))::DOUBLE) AS s
  FROM (SELECT page_id, url, upper(left(url, (length(url) - page_id % 20)::BIGINT)) AS p, left(url, 12) AS t FROM pages))""")
def anls(t):
    """Addresses cut short against the whole address and its first characters."""
    rows = t("pages")
    pred = F.upper(F.left("url", (F.char_length("url") - F.col("page_id") % 20).cast("int")))
    return rows.select("page_id", F.round(A.anls(pred, F.array("url", F.left("url", F.lit(12)))), 6).alias("anls"))


@query("""SELECT conv_id, turn, CASE WHEN f LIKE '%yes%' THEN 'yes' WHEN f LIKE '%no%' THEN 'no' ELSE 'other' END AS answer, CASE WHEN list_has_any(string_split(replace(string_split(text, '.')[1], ',', ''), ' '), ['No', 'not', 'no']) THEN 'no' ELSE 'yes' END AS sentence
FROM (SELECT *, left(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))), 4) AS f FROM conversations)""")
def yes_no_parse(t):
    return t("conversations").select("conv_id", "turn", A.yes_no_other("text").alias("answer"), A.yes_no_sentence("text").alias("sentence"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '-?\\b\\d{1,3}(?:,\\d{3})+\\b'))::INTEGER AS with_commas, len(regexp_extract_all(text, '-?\\d+(?:\\.\\d+)?[eE][+-]?\\d+'))::INTEGER AS scientific FROM documents""")
def number_extract(t):
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    return t("documents").select("doc_id", count(A.COMMA_NUMBERS).alias("with_commas"), count(A.SCIENTIFIC_NUMBERS).alias("scientific"))


@query("""WITH o AS (SELECT p_partkey, ['A', 'B', 'C'] AS l, [p_brand, p_type, p_name] AS x, CASE p_partkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C. ' || p_brand WHEN 2 THEN 'it is ' || p_type ELSE 'unknown' END AS p FROM part)
SELECT p_partkey, CASE WHEN length(p) = 1 THEN p WHEN list_contains(l, left(p, 1)) THEN left(p, 1) WHEN contains(p, x[1]) THEN 'A' WHEN contains(p, x[2]) THEN 'B' WHEN contains(p, x[3]) THEN 'C' ELSE p END AS letter FROM o""")
def option_letter(t):
    k = F.col("p_partkey") % 4
    pred = F.when(k == 0, "B").when(k == 1, F.concat(F.lit("C. "), "p_brand")).when(k == 2, F.concat(F.lit("it is "), "p_type")).otherwise("unknown")
    return t("part").select("p_partkey", A.option_letter(pred, F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.array("p_brand", "p_type", "p_name")).alias("letter"))


@query("SELECT p_partkey, chr((65 + p_partkey % 3)::INTEGER) AS letter FROM part")
def option_parse(t):
    """Letters out of whole sentences, by the last mention."""
    said = F.concat(F.lit("I think (A) is near but ("), F.char((F.col("p_partkey") % 3 + 65).cast("int")), F.lit(") is right: "), "p_name")
    return t("part").select("p_partkey", A.choice_from_response(said, ["A", "B", "C"], F.array("p_brand", "p_type", "p_name"), F.col("p_partkey")).alias("letter"))


_ROLLOUTS = """r AS (SELECT event_id % 1000 AS image, event_type AS question, '10' AS answer, event_id,
  CASE WHEN event_id % 11 = 0 THEN 'no answer' ELSE 'step one' || chr(10) || 'step two' || chr(10) || 'Final answer: ' || CASE WHEN event_id % 3 = 0 THEN '10' WHEN event_id % 3 = 1 THEN 'x10' ELSE (event_id % 9)::VARCHAR END END AS response FROM events),
g AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'format' WHEN event_id % 3 = 0 THEN 'pos' ELSE 'neg' END AS label FROM r)"""


def _rollouts(t):
    said = F.when(F.col("event_id") % 3 == 0, "10").when(F.col("event_id") % 3 == 1, "x10").otherwise((F.col("event_id") % 9).cast("string"))
    response = F.when(F.col("event_id") % 11 == 0, "no answer").otherwise(F.concat(F.lit("step one\nstep two\nFinal answer: "), said))
    return t("events").select((F.col("event_id") % 1000).alias("image"), F.col("event_type").alias("question"), F.lit("10").alias("answer"), "event_id", response.alias("response"), F.lit("en").alias("prompt_version"))


def _graded(t):
    return preference.grade(_rollouts(t), F.array(F.lit("vqa"), F.lit("choice"), F.lit("math")))


@query(f"WITH {_ROLLOUTS} SELECT question, label, count(*)::BIGINT AS n FROM g GROUP BY ALL")
def grade_rollouts(t):
    return _graded(t).groupBy("question", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {_ROLLOUTS}, c AS (SELECT image, question, count(*) FILTER (label = 'pos') AS p, count(*) FILTER (label = 'neg') AS n, count(*) FILTER (label = 'neg' AND event_id % 3 = 1) AS e FROM g WHERE label <> 'format' GROUP BY ALL)
SELECT (count(*) FILTER (p > 0 AND n = 0))::BIGINT AS only_pos, (count(*) FILTER (p = 0 AND n > 0))::BIGINT AS only_neg, (count(*) FILTER (p > 0 AND n > 0))::BIGINT AS both,
  sum(p * n)::BIGINT AS possible_pairs, sum(p * e)::BIGINT AS entail_skip, (count(*) FILTER (p * n > 0 AND n = e))::BIGINT AS keys_without_pairs FROM c""")
def pair_stats(t):
    return preference.pair_stats(_graded(t))


@query()
def pair_build(t):
    pairs = preference.build_pairs(_graded(t), 15)
    return pairs.select("image", "question", "answer_gt", "chosen", "rejected")


@query(f"WITH {_ROLLOUTS}, k AS (SELECT image, question, bool_or(label = 'pos') AS p, bool_or(label = 'neg') AS n FROM g GROUP BY ALL) SELECT image, question, '10' AS answer FROM k WHERE n AND NOT p")
def all_wrong(t):
    return preference.all_wrong_questions(_graded(t))


@query("""WITH s AS (SELECT conv_id, turn, text, ((length(text) % 4 = 0))::INTEGER AS fail FROM conversations),
w AS (SELECT *, coalesce(max(fail) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM s)
SELECT conv_id, (2 * count(*))::INTEGER AS turns, string_agg(CASE fail WHEN 0 THEN '+' ELSE '-' END, '' ORDER BY turn) AS labels FROM w WHERE stopped = 0 GROUP BY conv_id""")
def steps_to_conversations(t):
    steps = t("conversations").select("conv_id", F.col("turn").alias("step_idx"), F.col("text").alias("step"), (F.char_length("text") % 4).cast("double").alias("score"), F.lit("q").alias("question"))
    out = preference.steps_to_conversations(steps, ["conv_id"], "question")
    labels = F.array_join(F.transform(F.filter("conversations", lambda x: x["from"] == "gpt"), lambda x: x["value"]), "")
    return out.select("conv_id", F.size("conversations").alias("turns"), labels.alias("labels"))


@query("""WITH c AS (SELECT user_id, event_type AS step, sum((value > 120)::INTEGER)::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY ALL),
w AS (SELECT *, coalesce(max((k = 0)::INTEGER) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM c)
SELECT user_id, step, CASE stopped WHEN 1 THEN 0 ELSE k END AS num_correct, CASE stopped WHEN 1 THEN 0 ELSE n END AS num_total, round(CASE stopped WHEN 1 THEN 0 ELSE k / n::DOUBLE END, 6) AS score FROM w""")
def step_scores(t):
    rollouts = t("events").select("user_id", F.col("event_type").alias("step"), (F.col("value") > 120).alias("is_correct"))
    return preference.step_scores(rollouts, ["user_id"]).withColumn("score", F.round("score", 6))
