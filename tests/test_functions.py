"""Hand-worked rows for the column functions, quirks in both modes."""

import pytest
from pyspark.sql import functions as F

from quern.functions import answers as A
from quern.functions import boxes, chat, media, paths, text, udfs, vectors


def value(spark, column, **given):
    rows = spark.createDataFrame([tuple(given.values()) or (0,)], ", ".join(f"{k} {t}" for k, t in ((k, {str: "string", int: "int", float: "double", list: "array<string>", type(None): "string"}[type(v)]) for k, v in given.items())) or "q int")
    return rows.select(column.alias("v")).first().v


def arr(*items):
    return F.array(*map(F.lit, items))


def test_paths(spark):
    assert value(spark, paths.normalize_path("p"), p=" x\\a.jpg\n") == "x/a.jpg"
    assert value(spark, paths.normalize_path("p", True), p="./data/x/a.jpg") == "x/a.jpg"
    assert value(spark, paths.normalize_path("p"), p="data/x/a.jpg") == "data/x/a.jpg"
    assert value(spark, paths.basename("p"), p="a\\b/c.jpg") == "c.jpg"
    assert value(spark, paths.join_root(F.lit("s3://b/"), "p"), p="x.jpg") == "s3://b/x.jpg"
    assert value(spark, paths.join_root(F.lit("/r"), "p"), p="/x.jpg") == "/x.jpg"
    assert value(spark, paths.frame_number("p"), p="clip_012.jpg") == 12 and value(spark, paths.frame_number("p"), p="clip.jpg") == -1


def test_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in v.select(vectors.unit_norm("v")).collect()] == [[0.6, 0.8], None]
    assert v.select(vectors.unit_norm("v", compat=True)).collect()[1][0] == [0.0, 0.0]
    assert v.select(vectors.cosine("v", F.array(F.lit(4.0), F.lit(3.0)))).first()[0] == pytest.approx(0.96)


def test_text(spark):
    assert value(spark, text.sentence_repetition("t", 2), t="a b a b a b") == pytest.approx(0.4)
    assert value(spark, text.sentence_repetition("t", 2), t="a") == 0 and value(spark, text.sentence_repetition("t", 2), t="") == 0
    assert value(spark, text.truncate_prefix("t", 0.5), t="a b c d e") == "a b"
    assert value(spark, text.split_steps("t", most=2), t="a\n\nb\n\nc") == ["a\n\nb", "c"]
    assert value(spark, text.split_steps("t"), t="a") == ["a"]
    assert value(spark, text.one_placeholder("t"), t="what <image>?") == "<image>\nwhat ?"
    assert value(spark, text.one_placeholder("t"), t="what?") == "<image>\nwhat?"
    assert value(spark, text.one_placeholder("t"), t="<image> <image>") == "<image> <image>"
    assert value(spark, text.swap_instruction("t", ["Answer briefly."], "Q: {question}"), t="Why? Answer briefly.") == "Q: Why?"
    assert value(spark, text.has_quantity_word("t"), t="the fewest of all") and not value(spark, text.has_quantity_word("t", True), t="the fewest of all")
    assert value(spark, text.has_number_word("t"), t="seven dogs") and not value(spark, text.has_number_word("t"), t="dogs")
    assert value(spark, text.is_digit_string("t"), t="12.000") and value(spark, text.is_float_string("t"), t="1.5") and not value(spark, text.is_float_string("t"), t="15")
    assert value(spark, text.common_prefix_length(arr("a", "b", "c"), arr("a", "b", "d"))) == 2
    assert value(spark, text.modality(arr("a", "b"), F.lit(""))) == "multi_image" and value(spark, text.modality(F.array().cast("array<string>"), F.lit("v"))) == "video"


def test_normalizer(spark):
    n = lambda s: value(spark, A.normalize_answer("t"), t=s)
    assert n("The Dogs, two!") == "dogs 2"
    assert n("dont") == "don't" and n("a cat's tail") == "cat 's tail" and n("3.5 a.m.") == "3.5 am"
    assert n("and/or") == "and or" and n("x - y") == "x y" and n("") == ""


def test_answer_extraction(spark):
    assert value(spark, A.short_answer("t"), t="It is a red car, I think.") == "red car"
    assert value(spark, A.short_answer("t"), t="the top of the hill") == "top"
    assert value(spark, A.final_answer("t"), t="so\nfinal ANSWER: 42\nx") == "42" and value(spark, A.final_answer("t"), t="42") == "42"
    assert value(spark, A.trigger_answer("t"), t="a\nb\nFinal answer: 7") == "7"
    assert value(spark, A.trigger_answer("t"), t="a\nFinal answer: 7") is None and value(spark, A.trigger_answer("t"), t="\n\nFinal answer: 7") is None
    assert value(spark, A.boxed_answer("t"), t=r"so \boxed{1} or \boxed{\frac{1}{2}}.") == r"\frac{1}{2}"
    assert value(spark, A.boxed_answer("t"), t=r"\boxed{1") == r"\boxed{1"
    assert value(spark, A.is_think_format("t"), t=r"<think>long enough to count as thought</think> \boxed{4}")
    assert not value(spark, A.is_think_format("t"), t=r"<think>x</think> \boxed{4}")
    assert value(spark, A.strict_option("t"), t="**b**") == "B" and value(spark, A.strict_option("t"), t="(c) x") == "C" and value(spark, A.strict_option("t"), t="cat") is None
    assert value(spark, A.option_in_sentence("t"), t="The best answer is (D)") == "D"
    assert value(spark, A.numbers_in("t"), t="1,234 and 2e5 and 7") == ["1,234", "2e5", "234", "5", "7"]
    assert value(spark, A.open_answers("t"), t="We add.\nSo the answer is 12") == ["12.0"]
    assert value(spark, A.choice_from_response("t", ["A", "B"], arr("red", "blue")), t="not (A) but (B)") == "B"
    assert value(spark, A.choice_from_response("t", ["A", "B"], arr("red", "blue")), t="I believe that the colour is blue") == "B"
    assert value(spark, A.nearest_option(F.col("t"), arr("cat", "dog")), t="dot") == "dog"
    assert value(spark, A.yes_no_other("t"), t="not sure") == "no" and value(spark, A.yes_no_sentence("t"), t="Yes, it is. No dog.") == "yes"
    assert value(spark, A.yes_no_clean("t"), t="是\n") == "yes" and value(spark, A.first_integer("t"), t="about three") == 3


def test_scores(spark):
    assert value(spark, A.anls("t", arr("sitting")), t="kitten") == pytest.approx(1 - 3 / 7)
    assert value(spark, A.anls("t", arr("xyz")), t="kitten") == 0 and value(spark, A.anls("t", arr("")), t="") == 1
    r = lambda t, p, v: value(spark, A.relaxed_match("a", "b", v), a=t, b=p)
    assert r("100", "105", "plain") and not r("100", "106", "plain") and r("105.2", "100", "plain") and not r("100", "105.2", "plain")
    assert r("0.5", "50%", "percent") and not r("0.5", "50%", "year") and not r("2010", "2011", "year") and r("2010", "2011", "percent")
    assert value(spark, A.math_match("a", "b"), a="30°", b="30.01") and value(spark, A.math_match("a", "b"), a="X", b="x")
    ten = lambda m: arr(*["y"] * m, *["n"] * (10 - m))
    assert [value(spark, A.vqa_consensus(F.lit("y"), ten(m))) for m in (0, 3, 4)] == [0, pytest.approx(0.9), 1]
    far = {"a": "abcdefghij", "b": "0123456789"}
    assert value(spark, A.check_answer("a", "b", arr("anls")), **far) == 0 and value(spark, A.check_answer("a", "b", arr("anls"), True), **far) == 1
    assert value(spark, A.check_answer("a", "b", arr("choice")), a="A. cat", b="a") == 1
    assert value(spark, A.count_bucket("t"), t="122m2") == 2 and value(spark, A.count_bucket("t", True), t="122m2") == 1
    assert value(spark, A.judge_scores("t"), t="8 7.5\nwhy") == [8, 7.5] and value(spark, A.judge_scores("t"), t="good") == [-1, -1]
    assert value(spark, A.judge_rating("t"), t="Rating: 4, yes") == 4 and value(spark, A.judge_rating("t"), t="rating: 4 rating: 5") == 0
    assert value(spark, A.reciprocal_rank(F.col("t"), arr("dog", "cat")), t="a cat.") == 0.5
    assert value(spark, A.category_of_id("t"), t="validation_Art_Theory_12") == "Art_Theory" and value(spark, A.leaderboard_clean("t"), t="Red..") == "red"
    assert value(spark, A.fix_answer("r", "p", "g"), r="a\nFinal answer: the cat", p="the cat", g="cat") == "a\nFinal answer: cat"
    assert value(spark, A.grading_modes("d"), d="my_chartqa") == ["relaxed"] and value(spark, A.needs_latex("d"), d="1/2")
    assert value(spark, A.option_prompt("q", arr("x", "y"), "bracket"), q="Q") == "Q\n(A) x\n(B) y"


def test_boxes(spark):
    b = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert value(spark, boxes.iou(b(0, 0, 2, 2), b(0, 0, 2, 2))) == 1 and value(spark, boxes.iou(b(0, 0, 1, 1), b(1, 0, 2, 1))) == 0
    assert value(spark, boxes.iou_pixels(b(0, 0, 1, 1), b(1, 0, 2, 1))) > 0
    assert value(spark, boxes.parse_box("t", F.lit(200.0), F.lit(100.0)), t="x [[100, 200, 500, 500]]") == [20, 20, 100, 50]
    assert value(spark, boxes.parse_box("t", F.lit(2.0), F.lit(2.0)), t="none") == [0, 0, 0, 0]
    assert value(spark, boxes.parse_box_json("t", F.lit(100.0), F.lit(100.0)), t="[[0, 100, 1200, 500]]") == [0, 10, 100, 50]
    assert value(spark, boxes.remap_tags("t", {"FRONT": (100, 0)}, (1000, 1000)), t="<c1,FRONT,100,50> x") == "<c1,FRONT,200,50> x"


def test_media_and_chat(spark):
    g = lambda w, h: tuple(value(spark, media.tile_grid(F.lit(w), F.lit(h))))
    assert g(448, 448) == (1, 1) and g(896, 448) == (2, 1) and g(2000, 2000) == (3, 3)
    assert value(spark, media.frame_indices(F.lit(16), 4)) == [1, 5, 9, 13] and value(spark, media.frame_indices(F.lit(2), 4)) == [0, 1, 1, 1]
    assert value(spark, media.tile_budget(12, F.lit(5))) == 2 and value(spark, media.tile_budget(12, F.lit(50))) == 1
    assert value(spark, chat.length_weight(F.lit(4))) == 0.5 and value(spark, chat.length_weight(F.lit(0), "sample")) == 0
    turns = F.array(F.struct(F.lit("human").alias("from"), F.lit("q").alias("value")), F.struct(F.lit("gpt").alias("from"), F.lit("a").alias("value")))
    assert value(spark, chat.render(turns, chat.TEMPLATES["plain"])) == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert value(spark, chat.alternates(turns)) and not value(spark, chat.alternates(F.reverse(turns)))
    assert value(spark, chat.expand_markers(F.lit("a<image>b<image>"), "<image>", F.array(F.lit(2)), "T")) == "a<img>TT</img>b<image>"
    assert value(spark, chat.mask_turn(arr(5, 6, 7, 8), F.lit(True), 1)) == [-100, 6, 7, -100]


def test_udfs(spark):
    assert len(value(spark, udfs.tokenizer()(F.col("t")), t="a b, c")) == 4 and value(spark, udfs.token_count("t"), t="a b, c") == 4
    udfs.register_step_expander(spark)
    spark.createDataFrame([("a\n\nb\n\nc",)], "t string").createOrReplaceTempView("q_steps")
    assert [r.step for r in spark.sql("SELECT s.* FROM q_steps, LATERAL split_steps(t, 2) s ORDER BY 1").collect()] == ["a\n\nb", "c"]


def test_repetition_of_long_texts_is_one_pass(spark):
    import time
    from collections import Counter

    words = [f"w{(i * 7919) % 3001}" for i in range(20_000)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None), (4, "a b"), (5, "a b c a b c a b c")], "i int, t string")
    began = time.time()
    got = {r.i: r.x for r in rows.select("i", text.sentence_repetition("t", 3).alias("x")).collect()}
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    assert abs(got[1] - sum(n > 1 for n in grams.values()) / sum(grams.values())) < 1e-12
    assert got[4] == 0 and got[2] == 0 and abs(got[5] - 3 / 7) < 1e-12
    assert time.time() - began < 60


def test_contractions_by_word(spark):
    pairs = {"im here": "im here", "Im": "im", "she's": "she 's", "dont": "don't", "yall'll": "y'all'll", "somebodyll": "somebody'll", "theyve two cats": "they've 2 cats", "let's go": "let 's go", "ow's'at": "ow 's'at"}
    rows = spark.createDataFrame(list(pairs.items()), "a string, b string")
    bad = [(r.a, r.x, r.b) for r in rows.select("a", "b", A.normalize_answer("a").alias("x")).collect() if r.x != r.b]
    assert not bad, bad


def test_frames_by_rate_keep_a_last_centre_inside(spark):
    row = spark.range(1).select(media.frame_indices(F.lit(27), 0, "fps1", fps=10.0).alias("a"), media.frame_indices(F.lit(27), 0, "fps1", fps=10.0, most=2).alias("b"), media.frame_indices(F.lit(24), 0, "fps1", fps=10.0).alias("c")).first()
    assert (row.a, row.b, row.c) == ([5, 15, 25], [5, 15], [5, 15])
