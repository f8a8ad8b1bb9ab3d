"""Pairs of chosen and rejected responses against all pairs of small tables, and on a key with many responses."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quern.operators import pairs, preference


def graded(spark, rows):
    return spark.createDataFrame(rows, "image string, question string, answer string, answer_pred string, response string, label string, meta string")


def made(seed, n):
    draw = random.Random(seed)
    answers = ["", "1", "10", "x10", "a b", "A B c", "b", None, "longer answer 10", "ß10"]
    return [(draw.choice(["i", "j", None]), draw.choice(["p", "q"]), "t", a := draw.choice(answers), f"{a} said {draw.randrange(6)}", draw.choice(["pos", "neg", "neg", "format"]), f"m{i}") for i in range(n)]


def all_pairs(rows, entailment=False, rejected="neg"):
    sides = defaultdict(lambda: (set(), set()))
    for image, question, answer, pred, response, label, _ in rows:
        if label in ("pos", rejected):
            sides[image, question, answer][label == rejected].add(((pred or "").lower(), response))
    allowed = entailment or rejected != "neg"
    return {k: {(c, r) for a, c in pos for b, r in neg if allowed or a not in b} for k, (pos, neg) in sides.items()}


def test_pairs_match_brute_force(spark):
    for seed, n, k in ((2, 200, 4), (3, 120, 1000)):
        rows = made(seed, n)
        table = graded(spark, rows)
        for options in ({}, {"entailment": True}, {"rejected": "format"}):
            want = all_pairs(rows, **options)
            found = defaultdict(list)
            for p in preference.build_pairs(table, k, **options).collect():
                found[p.image, p.question, p.answer_gt].append((p.chosen, p.rejected))
            for key, every in want.items():
                assert set(found[key]) <= every and len(set(found[key])) == len(found[key]) == min(k, len(every)), (key, options)
            assert set(found) <= set(want)


def test_no_rows_and_no_meta(spark):
    table = graded(spark, made(1, 30)).drop("meta")
    assert preference.build_pairs(table.limit(0)).count() == 0
    assert preference.build_pairs(table).columns == ["image", "question", "answer_gt", "chosen", "rejected"]


def test_entailed_answers_from_the_index(spark):
    a, b = ["", "1", "10", "zz", "ß1"], ["", "10", "110", "x", "zzz", "ß10"]
    key = F.struct(F.lit(None).cast("string").alias("k"))
    side = lambda v, n: spark.createDataFrame([(x,) for x in v], f"{n} string").withColumn("q_key", key)
    got = sorted((r.q_a, r.q_b) for r in pairs.entailed(side(a, "q_a"), side(b, "q_b")).collect())
    assert got == sorted((x, y) for x in a for y in b if x in y)


def test_a_hot_key_opens_few_buckets(spark):
    """8,000 answers on each side, all rejected ones hold the first chosen one: partners come without 64 million pairs."""
    n = 8000
    pos = spark.range(n).select(F.struct(F.lit(1).alias("k")).alias("q_key"), F.when(F.col("id") == 0, "7").otherwise(F.concat(F.lit("c"), "id")).alias("q_a"))
    neg = spark.range(n).select(F.struct(F.lit(1).alias("k")).alias("q_key"), F.concat(F.lit("7 r"), "id").alias("q_b"))
    entails = pairs.entailed(pos, neg).persist()
    assert entails.count() == n
    found = pairs.partners(pos, neg, entails, 5, 1).collect()
    counts = Counter(r.q_a for r in found)
    assert len(counts) == 5 and "7" not in counts and set(counts.values()) == {5}
    entails.unpersist()


def test_statistics_count_without_pairs(spark):
    rows = made(9, 150)
    pos, neg = defaultdict(list), defaultdict(list)
    for image, question, answer, pred, _, label, _ in rows:
        (pos if label == "pos" else neg)[image, question, answer] += [(pred or "").lower()] * (label != "format")
    both = [k for k in pos if neg.get(k) and pos[k]]
    skipped = {k: sum(a in b for a in pos[k] for b in neg[k]) for k in both}
    s = preference.pair_stats(graded(spark, rows)).first()
    assert s.both == len(both) and s.possible_pairs == sum(len(pos[k]) * len(neg[k]) for k in both)
    assert s.entail_skip == sum(skipped.values()) and s.keys_without_pairs == sum(skipped[k] == len(pos[k]) * len(neg[k]) for k in both)
