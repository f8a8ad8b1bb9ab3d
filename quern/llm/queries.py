"""Registered queries of the corpus operators, with the same results in SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, divergence, exact_dedup, line_dedup, lm_scoring, mixing, near_dedup, packing, periodic_runs, piece_codec, token_counts, topk_search, toxicity

TOKEN_LIMIT = 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file lies on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_STRIPPED = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_KEY = f"translate({_STRIPPED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (SELECT *, {_KEY} AS k FROM lines),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
flagged AS (SELECT keyed.*, coalesce(owner <> doc_id, false) AS gone FROM keyed LEFT JOIN owners USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(_table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.e AS q, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0) q JOIN v c ON c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.mix(docs)
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


OP3_SQL = """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM sources),
runs AS (
  SELECT *, 3 * source_size AS most,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM weighed),
level AS (SELECT rest AS l_rest, ws AS l_ws FROM runs WHERE rest * w <= most * ws ORDER BY most / w LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN l_rest IS NULL OR w * l_rest >= most * l_ws THEN most::DOUBLE ELSE (w * l_rest)::DOUBLE / l_ws::DOUBLE END AS target
  FROM runs LEFT JOIN level ON true),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM targets),
sums AS (
  SELECT d.source, d.h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY d.h) AS run
  FROM docs d GROUP BY d.source, d.h),
ends AS (
  SELECT p.source, arg_min(CASE WHEN s.run - (p.target - p.copies * p.source_size) < (p.target - p.copies * p.source_size) - s.run + s.words THEN s.h + 1 ELSE s.h END, s.h) AS h_end
  FROM plan p JOIN sums s ON p.source IS NOT DISTINCT FROM s.source
  WHERE s.run > p.target - p.copies * p.source_size GROUP BY p.source)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.copies + CASE WHEN p.target - p.copies * p.source_size > 0 AND d.h < coalesce(e.h_end, 281474976710656) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN ends e ON d.source IS NOT DISTINCT FROM e.source
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path("piece_bpe_32k.model"), TOKEN_LIMIT)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    digests = chat_format.conversation_digests(chat_format.format_turns(turns.unionByName(extra)))
    return digests.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "in_order")


_CONTROL = chat_format.ChatTemplate().control
#: Each escaped control string is one character longer.
_ADDED = " + ".join(f"len(regexp_extract_all({{0}}, '{c[0].replace('[', chr(92) + '[')}{chr(92) * 2}*{c[1:].replace('|', chr(92) + '|').replace(']', chr(92) + ']')}'))" for c in _CONTROL)

OP5_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
states AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)) + {_ADDED.format("text")})::BIGINT AS formatted_chars,
       bool_and((before IS NULL AND role IN ('system', 'user')) OR (before IN ('system', 'assistant') AND role = 'user') OR (coalesce(before, '') = 'user' AND role = 'assistant')) AS in_order
FROM states GROUP BY conv_id
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       (count(*) OVER (PARTITION BY coalesce(text, '')))::BIGINT AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    network = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, network)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Every text's shingles meet through an index of shingles; equal word sequences count once.
OP9_SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
docs AS (SELECT doc_id, w, md5(array_to_string(w, ' ')) AS k FROM worded),
reps AS (SELECT k, min(doc_id) AS rep, any_value(w) AS w FROM docs WHERE len(w) > 0 GROUP BY k),
sets AS (SELECT k, rep, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM reps),
items AS (SELECT rep, len(s) AS n, hash(unnest(s)) AS h FROM sets),
pairs AS (
  SELECT a.rep AS x, b.rep AS y FROM items a JOIN items b ON a.h = b.h AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT rep AS node, rep AS seen FROM reps UNION SELECT r.node, e.y FROM reach r JOIN edges e ON r.seen = e.x),
comps AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN sets s ON d.k = s.k AND len(d.w) > 0 LEFT JOIN comps c ON s.rep = c.node
"""


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = """
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(list_prepend(NULL, w[:-2])) AS before FROM docs),
uni AS (SELECT word, count(*) AS n FROM words GROUP BY word),
bi AS (SELECT before, word, count(*) AS n FROM words WHERE before IS NOT NULL GROUP BY before, word),
total AS (SELECT greatest(1, count(*)) AS n FROM words),
scored AS (
  SELECT w.doc_id, CASE WHEN w.before IS NULL THEN round(1e6 * ln(u.n))::BIGINT - round(1e6 * ln(t.n))::BIGINT
    WHEN b.n > 0 THEN round(1e6 * ln(b.n))::BIGINT - round(1e6 * ln(ub.n))::BIGINT
    ELSE round(1e6 * ln(0.4::DOUBLE))::BIGINT + round(1e6 * ln(u.n))::BIGINT - round(1e6 * ln(t.n))::BIGINT END AS s
  FROM words w JOIN uni u ON w.word = u.word LEFT JOIN bi b ON w.before = b.before AND w.word = b.word LEFT JOIN uni ub ON w.before = ub.word CROSS JOIN total t),
sums AS (SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(s.s, 0)::DOUBLE / 1e6 AS log_score,
       CASE WHEN len(d.w) > 0 THEN coalesce(s.s, 0)::DOUBLE / 1e6 / len(d.w)::DOUBLE END AS mean_log_score FROM docs d LEFT JOIN sums s USING (doc_id)
"""


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_codec.encode_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", F.col("n_ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


def planted_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where one document in ten, by the checksum of its id, repeats a few of its words to its end.

    A document without an id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.withColumn("g", F.floor(h / 10)).withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    placed = chosen.withColumn("a", F.when(F.size("words") > 0, F.col("g") % F.size("words"))).withColumn("p", F.lit(1) + F.floor((F.size("words") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    # Words up to a + p, then that part's last p words again and again, then what the last turn has too much is cut off.
    again = F.expr("concat(slice(words, 1, int(a + p)), flatten(array_repeat(slice(words, int(a + 1), int(p)), int((size(words) - a) div p))))")
    return placed.select("doc_id", F.when(F.size("words") > 0, F.array_join(F.slice(again, 1, F.size("words")), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    top = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = found.withColumn("top", top)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: A run has five words and more that come again one period later; stretches of such places in a row are runs.
OP12_SQL = """
WITH bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits),
split AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
          xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
          FROM documents, crc),
planned AS (SELECT *, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
docs AS (SELECT id, doc_id, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0
           THEN list_transform(range(len(w)), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) END + 1]) ELSE w END AS w
         FROM planned),
grams AS (SELECT id, n, unnest(range(n - 4)) AS i, unnest(list_transform(range(n - 4), lambda j: hash(w[j + 1:j + 5]))) AS k FROM docs WHERE n >= 6),
again AS (SELECT x.id, x.i, y.i - x.i AS d FROM grams x JOIN grams y ON x.id = y.id AND x.k = y.k AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT id, d, min(i) AS s, max(i) - min(i) + 5 + d AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY id, d ORDER BY i) AS island FROM again) GROUP BY id, d, island),
runs AS (SELECT id, s, len, min(d) AS q FROM islands WHERE len >= greatest(6, 4 * d) GROUP BY id, s, len),
gone AS (SELECT DISTINCT id, unnest(range(s + q, s + len)) AS i FROM runs),
stays AS (SELECT x.id, string_agg(x.word, ' ' ORDER BY x.i) AS t FROM (SELECT id, unnest(w) AS word, unnest(range(n)) AS i FROM docs) x LEFT JOIN gone g ON x.id = g.id AND x.i = g.i WHERE g.i IS NULL GROUP BY x.id),
tops AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len DESC, s, q) AS r FROM runs),
sums AS (SELECT id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY id)
SELECT d.doc_id, coalesce(m.n_runs, 0)::BIGINT AS n_runs, p.s::BIGINT AS start, p.len::BIGINT AS length, p.q::BIGINT AS period, (1000 * p.len // p.q)::BIGINT AS exponent_milli,
       sha256(coalesce(m.t, '')) AS runs_sha256, sha256(coalesce(y.t, '')) AS collapsed_sha256
FROM docs d LEFT JOIN sums m USING (id) LEFT JOIN stays y USING (id) LEFT JOIN (SELECT * FROM tops WHERE r = 1) p USING (id)
"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence.audit(_table(spark, sf_dir, "documents").select("lang", "source", "text"))
    return found.select("lang", "source", "part", "item", "value", "rank")


OP13_SQL = """
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT id, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
grp AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT g.lang, g.source, coalesce(c.n, 0) AS n, coalesce(s.v, 0) AS v FROM grp g LEFT JOIN sizes s ON g.lang = s.lang
           LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source) c ON g.lang = c.lang AND g.source = c.source),
shares AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)::HUGEINT) // (t.n + t.v)::HUGEINT AS p
           FROM totals t JOIN kept k ON t.lang = k.lang LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
whole AS (SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.n) + 1)::HUGEINT) // (any_value(a.n) + any_value(s.v))::HUGEINT AS q
          FROM counts c JOIN (SELECT lang, sum(n) AS n FROM counts GROUP BY lang) a ON a.lang = c.lang JOIN sizes s ON s.lang = c.lang GROUP BY c.lang, c.term),
sums AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT x.lang, x.source, 'term', x.term, ((x.p - w.q) * (x.p - w.q) // w.q)::BIGINT FROM shares x JOIN whole w ON x.lang = w.lang AND x.term = w.term WHERE x.n > 0 AND x.p > w.q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found) WHERE part = 'pair' OR rank <= 200
"""


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_topk_search": op2_topk_search,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_chat_format": op5_chat_format,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_near_dedup": op9_near_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_piece_codec": op11_piece_codec,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op2_topk_search": OP2_SQL, "op3_mixing": OP3_SQL, "op5_chat_format": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op9_near_dedup": OP9_SQL, "op10_lm_scoring": OP10_SQL, "op12_periodic_runs": OP12_SQL, "op13_divergence": OP13_SQL}
