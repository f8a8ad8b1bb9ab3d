"""Column functions over whole tables. Inputs are made from columns by fixed forms; the SQL says what each form must give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import boxes, chat, media, paths, udfs
from ..functions import text as T
from ..functions.vectors import unit_norm
from .registry import query


def _pick(key: str, *cases: Column | str) -> Column:
    """One of the cases in turn, by the key."""
    out = F.lit(None).cast("string")
    for i, c in enumerate(cases):
        out = F.when(F.col(key) % len(cases) == i, F.lit(c) if isinstance(c, str) else c).otherwise(out)
    return out


def _case(key: str, *cases: str) -> str:
    return f"(CASE {key} % {len(cases)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END)"


def _said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _letters(n: int = 3) -> Column:
    return F.array(*(F.lit(chr(65 + i)) for i in range(n)))


def _options() -> Column:
    return F.array(F.col("p_brand"), F.col("p_type"), F.col("p_name"))


@query(f"""SELECT page_id, {_case("page_id", "'/abs/' || page_id", "'root/a/' || page_id || '.jpg'", "'s3://b/' || page_id")} AS path, {_case("page_id", "-1", "page_id % 1000", "-1")}::INTEGER AS frame FROM pages""")
def root_paths(t):
    i = F.col("page_id").cast("string")
    path = _pick("page_id", _said("/abs/", i), _said("a/", i, ".jpg"), i)
    root = _pick("page_id", "root", "root/", "s3://b/")
    name = _pick("page_id", _said("f_", i, ".png"), _said("v_", (F.col("page_id") % 1000).cast("string"), ".jpg"), "none.jpg")
    return t("pages").select("page_id", paths.join_root(root, path).alias("path"), paths.frame_number(name).alias("frame"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 5)) AS v FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM v)
SELECT vec_id, round(CASE WHEN n > 0 THEN v[1] / n END, 9) + 0 AS first, round(v[1] / greatest(n, 1e-8), 9) + 0 AS clipped, CASE WHEN n > 0 THEN len(v)::INTEGER END AS width FROM n""")
def unit_vectors(t):
    v = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5))
    rows = t("embeddings").select("vec_id", unit_norm(v).alias("u"), unit_norm(v, compat=True).alias("c"))
    return rows.select("vec_id", F.round(F.get("u", F.lit(0)), 9).alias("first"), F.round(F.get("c", F.lit(0)), 9).alias("clipped"), F.when(F.col("u").isNotNull(), F.size("u")).alias("width"))


@query(f"""SELECT p_partkey, {_case("p_partkey", "'Ask: What is ' || p_name || '?'", "'Ask: What is ' || p_name || '?'", "'Ask: ' || p_name || ' Answer now. Really'")} AS swapped,
  {_case("p_partkey", "'<image>' || chr(10) || p_name", "'<image>' || chr(10) || p_name || ' there'", "'<image> and <image> ' || p_name")} AS placed,
  {_case("p_partkey", "'a<img>xx</img>b<img>x</img>'", "'<img></img>' || p_name", "p_name || '<img>xx</img><img>x</img><i>'")} AS expanded,
  {_case("p_partkey", "'Frame1: <image>'", "'Frame1: <image>' || chr(10) || 'Frame2: <image>'", "'Frame1: <image>' || chr(10) || 'Frame2: <image>' || chr(10) || 'Frame3: <image>'")} AS frames FROM part""")
def prompt_forms(t):
    n = F.col("p_name")
    asked = _pick("p_partkey", _said("What is ", n, "? Answer now."), _said("What is ", n, "?"), _said(n, " Answer now. Really"))
    marked = _pick("p_partkey", n, _said("<image>", n, " there"), _said("<image> and <image> ", n))
    holes = _pick("p_partkey", "a<i>b<i>", _said("<i>", n), _said(n, "<i><i><i>"))
    counts = F.when(F.col("p_partkey") % 3 == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(2), F.lit(1)))
    return t("part").select(
        "p_partkey", T.swap_instruction(asked, ["Answer now.", "now."], "Ask: {question}").alias("swapped"), T.one_placeholder(marked).alias("placed"),
        chat.expand_markers(holes, "<i>", counts, "x").alias("expanded"), chat.frame_lines((F.col("p_partkey") % 3 + 1).cast("int")).alias("frames"))


@query("""WITH c AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS r FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, r, list_filter(r, lambda x: x <> 'system') AS said FROM c)
SELECT conv_id, len(list_filter(list_transform(said, lambda x, i: x = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END), lambda x: NOT x)) = 0 AS alternating,
  len(CASE WHEN r[1] IN ('user', 'system') THEN r ELSE r[2:] END)::INTEGER AS turns FROM s""")
def alternation(t):
    from .texts import _conversations

    return _conversations(t).select("conv_id", chat.alternates("conversations").alias("alternating"), F.size(chat.turns_array("conversations")).alias("turns"))


@query("""WITH c AS (SELECT conv_id, list(struct_pack(r := role, v := text) ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(array_to_string(list_transform(t, lambda x: '<|im_start|>' || x.r || x.v || '<|im_end|>'), '')) AS joined,
  sha256(array_to_string(list_transform(t, lambda x: '<|' || CASE x.r WHEN 'system' THEN 'system|>' WHEN 'user' THEN 'user|>' WHEN 'assistant' THEN 'assistant|>' ELSE x.r END || chr(10) || x.v || '<|end|>' || chr(10)), '')) AS tagged,
  sha256(array_to_string(list_transform(t, lambda x: '<|im_start|>' || x.r || chr(10) || x.v || '<|im_end|>' || chr(10)), '')) AS unknown FROM c""")
def encoded_by_template(t):
    from .texts import _conversations

    return _conversations(t).select("conv_id", *(F.sha2(chat.encoder(n)("conversations"), 256).alias(n) for n in ("joined", "tagged", "unknown")))


@query("""WITH c AS (SELECT conv_id, list(struct_pack(r := role, v := text) ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(CASE WHEN t[1].r = 'system' THEN '' ELSE '[[system: Be brief.]]: ' END ||
  array_to_string(list_transform(t, lambda x: '[[' || CASE x.r WHEN 'user' THEN 'Q' WHEN 'assistant' THEN 'A' ELSE x.r END || ': ' || x.v || ']]: '), '')) AS rendered, true AS known FROM c""")
def registered_template(t):
    """A template of a user's own, found by its name from then on."""
    from .texts import _conversations

    chat.register_template(chat.Template("asked", "Be brief.", start="[[", end="]]", separator=": ", roles=(("human", "Q"), ("gpt", "A"))))
    return _conversations(t).select("conv_id", F.sha2(chat.encoder("asked")("conversations"), 256).alias("rendered"), F.lit("asked" in chat.TEMPLATES).alias("known"))


@query("""SELECT p_partkey, greatest(1, floor(12.0 / (p_size % 9 + 1)))::INTEGER AS shared, greatest(1, least(6, floor(24.0 / (p_size % 9 + 1))))::INTEGER AS whole FROM part""")
def tile_budgets(t):
    n = F.col("p_size") % 9 + 1
    return t("part").select("p_partkey", media.tile_budget(12, n).alias("shared"), media.tile_budget(6, n, 24).alias("whole"))


@query("""WITH v AS (SELECT p_partkey, p_size * 3 AS n FROM part), s AS (SELECT *, ceil(n / 10.0 / 2.0)::INTEGER AS k FROM v),
f AS (SELECT *, list_filter(list_transform(range(0, k), lambda i: (10 + 20 * i)::INTEGER), lambda x: x < n) AS f FROM s)
SELECT p_partkey, len(f)::INTEGER AS frames, list_sum(f)::BIGINT AS total, len(f[1:3])::INTEGER AS few,
  list_sum(list_transform(range(0, 4), lambda i: floor((n / 4.0) / 2 + round_even((n / 4.0) * i, 0))))::BIGINT AS segments FROM f""")
def frames_by_rate(t):
    n = (F.col("p_size") * 3).cast("int")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    f = media.frame_indices(n, 0, "fps0.5", fps=10.0)
    rows = t("part").select("p_partkey", f.alias("f"), media.frame_indices(n, 0, "fps0.5", fps=10.0, most=3).alias("few"), media.segment_indices(n, 4, 10.0).alias("s"))
    return rows.select("p_partkey", F.size("f").alias("frames"), F.when(F.size("f") > 0, total("f")).alias("total"), F.size("few").alias("few"), total("s").alias("segments"))


@query(f"""SELECT p_partkey, {_case("p_partkey", "lower(p_brand)", "'red'", "'big car'", "lower(p_brand)")} AS short, {_case("p_partkey", "p_name", "'is red'", "'It is the big car of ' || p_name || '.'", "p_brand")} AS final FROM part""")
def short_answers(t):
    n, b = F.col("p_name"), F.col("p_brand")
    said = _pick("p_partkey", _said(b, ", I say"), "colour is red. Yes", "It is the big car of Bob!", _said(" ", b, "  "))
    final = _pick("p_partkey", _said("so\nFinal answer: ", n), "answer: is red\nmore", _said("It is the big car of ", n, "."), _said("x Answer:   ", b))
    return t("part").select("p_partkey", A.short_answer(said).alias("short"), A.final_answer(final).alias("final"))


@query(f"""SELECT p_partkey, {_case("p_partkey", "p_name", "'a{b}c'", "'none here'", "'\\boxed{open'")} AS boxed, {_case("p_partkey", "true", "false", "false", "false")} AS think,
  {_case("p_partkey", "p_name", "'a{b}c'", "NULL", "p_brand")} AS parsed FROM part""".replace("\\b", "\\b"))
def boxed_answers(t):
    n, b = F.col("p_name"), F.col("p_brand")
    said = _pick("p_partkey", _said("first \\boxed{1} then \\boxed{", n, "}."), "\\boxed{a{b}c}", "none here", "\\boxed{open")
    thought = _pick("p_partkey", _said("<think>long enough to be a thought</think> \\boxed{", n, "}"), _said("<think>short</think> \\boxed{", n, "}"), _said("<think>long enough to be a thought</think> ", n), _said("no mark \\boxed{", n, "}"))
    reply = _pick("p_partkey", _said("<think>long enough to be a thought</think> \\boxed{", n, "}"), "a long way of saying \\boxed{a{b}c}", "short", _said("why\nbecause\nFinal Answer: ", b))
    version = _pick("p_partkey", "en_r1", "zh_v2", "en_v2", "en")
    return t("part").select("p_partkey", A.boxed_answer(said).alias("boxed"), A.is_think_format(thought).alias("think"), A.parse_answer(reply, version).alias("parsed"))


@query(f"""SELECT p_partkey, {_case("p_partkey", "'B'", "'C'", "'D'", "NULL", "'A'")} AS strict, {_case("p_partkey", "'C'", "'A'", "'B'", "''", "'B'")} AS sentence FROM part""")
def option_forms(t):
    n = F.col("p_name")
    strict = _pick("p_partkey", " b ", _said("c. ", n), _said("(D) ", n), _said("because ", n), "**A**")
    named = F.lower(F.col("p_type"))
    said = _pick("p_partkey", "The best answer is C", "The answer is A.", named, "one two three four five six seven eight nine ten eleven", "Best option: B")
    return t("part").select("p_partkey", A.strict_option(strict).alias("strict"), A.option_in_sentence(said, F.array(F.lit("zzz"), named, F.lit("yyy"))).alias("sentence"))


@query(f"""SELECT p_partkey, {_case("p_partkey", "'B'", "'C'", "'A'", "'B'", "NULL")} AS letter, {_case("p_partkey", "'C'", "'A'", "'B'", "'B'", "'C'")} AS after FROM part""")
def option_last(t):
    """The last letter in brackets, alone, or by its text; and the letter after "Answer:"."""
    kind = F.lower("p_type")
    said = _pick("p_partkey", _said("Not (A) but (B): ", kind), "I take A or rather C .", "all else fails so A !", _said("we all think here that it is ", kind), "short x")
    after = _pick("p_partkey", "Answer: (A)\nAnswer: C", "Answer: A or B, so (A)", _said("take B. now ", F.lit("ok")), _said("we all think here that it is ", kind), "(A) and (C)")
    texts = F.array(F.lit("zzzz"), F.col("p_type"), F.lit("yyyy"))
    return t("part").select("p_partkey", A.choice_from_response(said, ["A", "B", "C"], texts).alias("letter"), A.choice_after_answer(after, ["A", "B", "C"], texts).alias("after"))


@query("""SELECT p_partkey, len(p)::INTEGER AS n, array_to_string(p, '|') AS options, p[1] AS first FROM (SELECT p_partkey, [p_brand, p_type, p_name][1:(p_partkey % 4)::BIGINT] AS p FROM part)""")
def option_maps(t):
    some = F.slice(_options(), 1, (F.col("p_partkey") % 4).cast("int"))
    m = A.options_map(some)
    rows = t("part").select("p_partkey", m.alias("m"))
    return rows.select("p_partkey", F.size("m").alias("n"), F.array_join(F.map_values("m"), "|").alias("options"), F.element_at("m", F.lit("A")).alias("first"))


@query("""SELECT l_orderkey, l_linenumber, '1,' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') || '|2e' || l_linenumber || '|' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') || '|' || (l_suppkey + 1000000)::VARCHAR || '.5|' || l_linenumber AS found,
  '1' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') || '.0' AS first, 'is ' || (l_suppkey + 1000000)::VARCHAR AS statement, l_suppkey + 1000000 AS number FROM lineitem""")
def numbers_found(t):
    n, s = F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), (F.col("l_suppkey") + 1000000).cast("string")
    line = F.col("l_linenumber").cast("string")
    said = _said("of 1,", n, " and ", s, ".5 or 2e", line, ", item ", line)
    found = A.numbers_in(said)
    return t("lineitem").select("l_orderkey", "l_linenumber", F.array_join(found, "|").alias("found"), A.normal_item(F.get(found, F.lit(0))).alias("first"), A.first_statement(_said(" is ", s, "\nor more. x")).alias("statement"), A.first_integer(_said("about ", s, " of 3")).alias("number"))


@query(f"""SELECT o_orderkey, {_case("o_orderkey", "'7.5|the 7.5'", "'41.0'", "o_orderkey::VARCHAR || '.0'")} AS candidates FROM orders""")
def open_candidates(t):
    k = F.col("o_orderkey").cast("string")
    said = _pick("o_orderkey", "we look\nIt could be the 7.5", "x = 41", _said("The result is ", k, "."))
    found = A.open_answers(said)
    return t("orders").select("o_orderkey", F.array_join(F.array_sort(found), "|").alias("candidates"))


@query(f"""SELECT p_partkey, {_case("p_partkey", "p_type", "p_size::VARCHAR", "'2.35'", "p_name", "p_type")} AS normal, {_case("p_partkey", "p_type", "p_size::VARCHAR", "'2.346'", "p_name", "NULL")} AS ruled FROM part""")
def extraction_rules(t):
    size = F.col("p_size").cast("string")
    said = _pick("p_partkey", "(b)", size, "2.346", F.col("p_name"), F.concat(F.col("p_type"), F.lit("x")))
    kind = _pick("p_partkey", "multi_choice", "free", "free", "free", "multi_choice")
    answer = _pick("p_partkey", "text", "integer", "float", "text", "text")
    choices = F.array(F.lit("zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz"), F.col("p_type"), F.lit("yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy"))
    raw = _pick("p_partkey", F.col("p_type"), size, "2.346", _said("Answer: ", F.col("p_name")), "who knows")
    return t("part").select("p_partkey", A.normal_extraction(said, choices, kind, answer, F.lit(2)).alias("normal"), A.rule_extraction(raw, choices, kind, answer).alias("ruled"))


@query(f"""SELECT o_orderkey, {_case("o_orderkey", "'yes'", "'no it is'", "'yes no'", "lower(o_clerk)")} AS clean FROM (SELECT o_orderkey, o_orderpriority AS o_clerk FROM orders)""")
def yes_no_cleaned(t):
    said = _pick("o_orderkey", "是", "否 it\tis", "TRUE\nfalse", _said(F.col("o_orderpriority"), "的"))
    return t("orders").select("o_orderkey", A.yes_no_clean(said).alias("clean"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 900 AS x, l_suppkey % 800 AS y, l_quantity::BIGINT * 9 AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 4 THEN least(640, floor(x / 1000.0::DOUBLE * 640))::DOUBLE END AS x1, CASE WHEN l_linenumber <> 4 THEN least(480, floor((y + q) / 1000.0::DOUBLE * 480))::DOUBLE END AS y2,
  'at <c1,FRONT,' || round_even((x + 100) / 2000.0::DOUBLE * 1000, 0)::INTEGER || ',' || round_even((y + 50) / 1500.0::DOUBLE * 1000, 0)::INTEGER || '> ok' AS tags FROM b""")
def boxes_json(t):
    x, y, q = F.col("l_partkey") % 900, F.col("l_suppkey") % 800, F.col("l_quantity").cast("long") * 9
    said = F.when(F.col("l_linenumber") == 4, "none").otherwise(F.format_string("[[%d, %d, %d, %d], [1, 2, 3, 4]]", x, y, x + q, y + q))
    box = boxes.parse_box_json(said, F.lit(640.0), F.lit(480.0))
    tags = boxes.remap_tags(F.format_string("at <c1,FRONT,%d,%d> ok", x, y), {"FRONT": (100.0, 50.0)}, (2000.0, 1500.0))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.get(box, F.lit(0)).alias("x1"), F.get(box, F.lit(3)).alias("y2"), tags.alias("tags"))


@query("""WITH p AS (SELECT page_id, lower(url) AS u, lower(left(url, (length(url) - page_id % 25)::BIGINT)) AS p FROM pages), s AS (SELECT page_id, 1 - levenshtein(p, u) / greatest(length(p), length(u))::DOUBLE AS s FROM p)
SELECT page_id, round(CASE WHEN s >= 0.8 THEN s ELSE 0 END, 6) AS scene FROM s""")
def anls_scenes(t):
    pred = _said("  ", F.upper(F.left("url", (F.char_length("url") - F.col("page_id") % 25).cast("int"))), "\n")
    return t("pages").select("page_id", F.round(A.anls_scene(pred, F.array("url"), 0.8), 6).alias("scene"))


@query(f"""SELECT p_partkey, {_case("p_partkey", "'relaxed'", "'anls'", "'relaxed,vqa,choice'", "'vqa,choice,math'")} AS modes, {_case("p_partkey", "true", "true", "true", "false")} AS latex FROM part""")
def mode_keywords(t):
    name = _pick("p_partkey", _said("chartqa_", F.col("p_brand")), "my_docvqa_x", "CLEVR_math_en", F.col("p_brand"))
    formula = _pick("p_partkey", _said("\\frac ", F.col("p_brand")), " 3 / 4 ", _said(F.col("p_size").cast("string"), "/7"), F.col("p_name"))
    return t("part").select("p_partkey", F.array_join(A.grading_modes(name), ",").alias("modes"), A.needs_latex(formula).alias("latex"))


@query(f"""SELECT p_partkey, {_case("p_partkey", "'so it is' || chr(10) || 'Final answer: ' || p_brand", "'because' || chr(10) || 'Final answer: ' || p_name", "'why' || chr(10) || 'Final answer: B'")} AS fixed FROM part""")
def answers_fixed(t):
    b, n = F.col("p_brand"), F.col("p_name")
    pred = _pick("p_partkey", _said("the ", b, " one"), n, "B. yes")
    said = _pick("p_partkey", _said("so it is\nFinal answer: the ", b, " one"), _said("because\n**Final answer: ", n), "why\nFinal answer: B. yes")
    truth = _pick("p_partkey", b, n, "B")
    return t("part").select("p_partkey", A.fix_answer(said, pred, truth).alias("fixed"))


@query(f"""SELECT p_partkey, {_case("p_partkey", "true", "true", "true", "false")} AS contained, {_case("p_partkey", "true", "true", "false", "true")} AS correct, {_case("p_partkey", "true", "false", "true", "false")} AS word,
  round({_case("p_partkey", "1.0", "0.5", "0.0", "1.0")}::DOUBLE, 6) AS rank, {_case("p_partkey", "true", "true", "false", "false")} AS first FROM part""")
def truth_matches(t):
    b = F.col("p_brand")
    return t("part").select(
        "p_partkey",
        A.option_contained(_pick("p_partkey", "Answer: A. x", "(a", _said("z ", F.lower(b)), "q w"), _pick("p_partkey", "A. one", "(A) one", _said("b ", b), "(B) two")).alias("contained"),
        A.choice_correct(_pick("p_partkey", "(B)", b, "C", "b"), F.lit("B"), F.array(F.lit("x"), b, F.lit("y"))).alias("correct"),
        A.has_word(_pick("p_partkey", "a red, car", "a reddish car", "RED", "blue"), F.lit("red")).alias("word"),
        F.round(A.reciprocal_rank(_pick("p_partkey", "a red car", "a blue car", "none", "blue and red"), F.array(F.lit("red"), F.lit("blue"))), 6).alias("rank"),
        A.first_part_equals(_pick("p_partkey", "Yes., it is", " yes", "no, yes", "yes it is"), F.lit("Yes")).alias("first"))


@query("""SELECT p_partkey, 'Part_' || p_size AS category, 'a.jpg|' || p_partkey || '.png' AS images, 'see <image> and <image>' AS marks, lower(p_brand) AS clean,
  '[Context]' || chr(10) || p_name || chr(10) || chr(10) || '[Question]' || chr(10) || p_brand || chr(10) || chr(10) || '[Assistant 1]' || chr(10) || 'x' || chr(10) || chr(10) || '[End of Assistant 1]' || chr(10) || chr(10) || '[Assistant 2]' || chr(10) || 'y' || chr(10) || chr(10) || '[End of Assistant 2]' || chr(10) || chr(10) || '[System]' || chr(10) || 'rule' || chr(10) || chr(10) AS prompt,
  (CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END)::INTEGER AS prefix, (CASE p_partkey % 4 WHEN 0 THEN 'multi_image' WHEN 1 THEN 'image' WHEN 2 THEN 'video' ELSE 'text' END) AS kind FROM part""")
def identifiers(t):
    key, b, n = F.col("p_partkey").cast("string"), F.col("p_brand"), F.col("p_name")
    images = F.when(F.col("p_partkey") % 4 == 0, F.array(key, b)).when(F.col("p_partkey") % 4 == 1, F.array(key, F.lit(""))).otherwise(F.array().cast("array<string>"))
    other = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit(1), F.lit(2), F.lit(9))).otherwise(F.array(F.lit(1), F.lit(3)))
    return t("part").select(
        "p_partkey", A.category_of_id(_said("validation_Part_", F.col("p_size").cast("string"), "_", key)).alias("category"), F.array_join(A.image_references(_said("<img='a.jpg'> or <img='", key, ".png'>")), "|").alias("images"),
        A.one_image_mark(F.lit("see <image 1> and <image 7>")).alias("marks"), A.leaderboard_clean(_said(" ", b, "..")).alias("clean"), A.judge_prompt(n, b, F.lit("x"), F.lit("y"), F.lit("rule")).alias("prompt"),
        T.common_prefix_length(F.array(F.lit(1), F.lit(2), F.lit(3)), other).alias("prefix"), T.modality(images, F.when(F.col("p_partkey") % 4 == 2, "v.mp4")).alias("kind"))


@query("""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'))::INTEGER AS words FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', ' ', 'g') AS text FROM documents)""")
def tokenizer_words(t):
    """Ids of the extension point's own tokenizer: as many as there are words, with other marks left out."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^ -~]", " "), r"[^A-Za-z0-9_ ]", " ")
    return t("documents").select("doc_id", F.size(udfs.tokenizer()(plain)).alias("words"))


@query("""SELECT page_id, length(url)::DOUBLE AS first, 1.0::DOUBLE AS second FROM pages""")
def embedder_hook(t):
    out = udfs.embed(t("pages").select("page_id", F.col("url").alias("path")), lambda urls: [[float(len(u)), 1.0] for u in urls])
    return out.select("page_id", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.get("embedding", F.lit(1)).cast("double").alias("second"))


@query("""WITH s AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS s FROM documents WHERE text IS NOT NULL), e AS (SELECT *, CASE WHEN len(s) > 4 THEN ceil(len(s) / 4.0)::INTEGER ELSE 1 END AS each FROM s),
x AS (SELECT doc_id, s, each, unnest(range(0, len(s), each)) AS i FROM e)
SELECT doc_id, (i // each)::INTEGER AS step_idx, sha256(array_to_string(s[i + 1:i + each], chr(10) || chr(10))) AS digest FROM x""")
def step_expander(t):
    docs = t("documents").where("text is not null").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    spark = docs.sparkSession
    udfs.register_step_expander(spark, "quern_split_steps")
    docs.createOrReplaceTempView("quern_step_texts")
    return spark.sql("SELECT d.doc_id, s.step_idx, sha2(s.step, 256) AS digest FROM quern_step_texts d, LATERAL quern_split_steps(d.text, 4) s")
