"""Preference pairs and process rewards from graded responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import check_answer, fix_answer, parse_answer
from ..functions.chat import Template, render
from .joins import settled
from .pairs import entailed, first_of, pair_up

KEY = ["image", "question", "answer"]


def grade(rollouts: DataFrame, modes: Column, use_cache: bool = False, repair: bool = False, compat: bool = False) -> DataFrame:
    """Rollouts with answer_pred and label: pos, neg, or format where no answer can be read."""
    if use_cache:
        return rollouts.withColumn("answer_pred", F.col("answer")).withColumn("label", F.when(F.col("is_correct").cast("int") == 1, "pos").otherwise("neg"))
    out = rollouts.withColumn("answer_pred", parse_answer("response", F.coalesce("prompt_version", F.lit("en"))))
    if repair:
        fixed = F.when(F.col("answer_pred").isNotNull() & F.coalesce("prompt_version", F.lit("en")).isin("en", "zh"), fix_answer("response", "answer_pred", "answer"))
        out = out.withColumn("response", F.coalesce(fixed, F.col("response")))
    ok = check_answer("answer_pred", "answer", modes, compat) == 1
    # Graders are long expressions and the label is used several times over, so it is computed once.
    return settled(out.withColumn("label", F.when(F.col("answer_pred").isNull(), "format").when(ok, "pos").otherwise("neg")))


def capped(rows: DataFrame, by: list[str], k: int, seed: int, *columns: str) -> DataFrame:
    """At most ``k`` rows of each group, in hash order of ``columns``."""
    return first_of(rows, by, k, F.xxhash64(F.lit(seed), *columns), *columns)


def build_pairs(graded: DataFrame, k: int = 15, seed: int = 42, entailment: bool = False, rejected: str = "neg") -> DataFrame:
    """At most ``k`` pairs of chosen and rejected responses per (image, question, answer); fewer only where there are no more.

    A rejected answer that contains the chosen one makes no pair, unless ``entailment`` allows it or responses are rejected
    for their format. Equal responses count once; an answer that is null counts as empty.
    """
    meta = ["meta"] if "meta" in graded.columns else []
    side = lambda label, name: graded.where(F.col("label") == label).select(*KEY, F.coalesce(F.lower("answer_pred"), F.lit("")).alias(name), "response", *meta)
    return unique_pairs(pair_up(side("pos", "q_a"), side(rejected, "q_b"), KEY, k, seed, entailment or rejected != "neg", meta))


def unique_pairs(pairs: DataFrame) -> DataFrame:
    """One row for each (image, question, chosen, rejected)."""
    return pairs.dropDuplicates([*KEY, "chosen", "rejected"]).withColumnRenamed("answer", "answer_gt")


def pair_stats(graded: DataFrame, entailment: bool = False) -> DataFrame:
    """Keys with only positives, only negatives, both; possible pairs; pairs left out as entailed. From counts per distinct
    answer, not from the pairs themselves."""
    counts = graded.where("label in ('pos', 'neg')").groupBy(*KEY).agg(F.count_if(F.col("label") == "pos").alias("p"), F.count_if(F.col("label") == "neg").alias("n"))
    totals = counts.agg(
        F.count_if((F.col("p") > 0) & (F.col("n") == 0)).alias("only_pos"),
        F.count_if((F.col("p") == 0) & (F.col("n") > 0)).alias("only_neg"),
        F.count_if((F.col("p") > 0) & (F.col("n") > 0)).alias("both"),
        F.coalesce(F.sum(F.col("p") * F.col("n")), F.lit(0)).cast("long").alias("possible_pairs"),
    )
    by_answer = lambda label, name: settled(graded.where(F.col("label") == label).groupBy(F.struct(*KEY).alias("q_key"), F.coalesce(F.lower("answer_pred"), F.lit("")).alias(name)).agg(F.count("*").alias(f"n_{name}")))
    pos, neg = by_answer("pos", "q_a"), by_answer("neg", "q_b")
    # Counts of answers that contain another, from the index of their parts.
    skipped = entailed(pos, neg).join(pos, ["q_key", "q_a"]).join(neg, ["q_key", "q_b"]).groupBy("q_key").agg(F.sum(F.col("n_q_a") * F.col("n_q_b")).alias("s"))
    sides = pos.groupBy("q_key").agg(F.sum("n_q_a").alias("p")).join(neg.groupBy("q_key").agg(F.sum("n_q_b").alias("n")), "q_key").join(skipped, "q_key", "left")
    s = F.lit(0) if entailment else F.coalesce("s", F.lit(0))
    left_out = sides.agg(F.coalesce(F.sum(s), F.lit(0)).cast("long").alias("entail_skip"), F.count_if(s == F.col("p") * F.col("n")).alias("keys_without_pairs"))
    both = totals.unionByName(left_out, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in [*totals.columns, *left_out.columns]))


def all_wrong_questions(graded: DataFrame) -> DataFrame:
    """Distinct questions that only negatives answer."""
    keys = lambda label: graded.where(F.col("label") == label).select(*KEY).distinct()
    return keys("neg").join(keys("pos"), KEY, "left_anti")


def preference_rows(pairs: DataFrame, template: Template) -> DataFrame:
    """Pairs with both answers rendered behind the same question."""
    talk = lambda answer: F.array(F.struct(F.lit("human").alias("from"), F.col("question").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col(answer).alias("value")))
    return pairs.withColumns({"chosen_text": render(talk("chosen"), template), "rejected_text": render(talk("rejected"), template)})


def step_scores(rollouts: DataFrame, keys: list[str], step: str = "step", correct: str = "is_correct", early_stop: bool = True) -> DataFrame:
    """Per sample and step the share of correct continuations; with early stop, steps after one without any count 0 of 0."""
    counted = rollouts.groupBy(*keys, step).agg(F.sum(F.col(correct).cast("int")).cast("long").alias("num_correct"), F.count("*").alias("num_total"))
    if early_stop:
        before = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        stopped = F.coalesce(F.max((F.col("num_correct") == 0).cast("int")).over(before), F.lit(0)) == 1
        counted = counted.withColumn("q_s", stopped).withColumns({c: F.when(F.col("q_s"), 0).otherwise(F.col(c)) for c in ("num_correct", "num_total")}).drop("q_s")
    return counted.withColumn("score", F.coalesce(F.try_divide(F.col("num_correct"), F.col("num_total")), F.lit(0.0)))


def steps_to_conversations(steps: DataFrame, keys: list[str], question: str, threshold: float = 0.0, early_stop: bool = True, outcome: bool = False) -> DataFrame:
    """Steps (keys, step_idx, step, score, question) as turns: the question stands before the first step, and each step is
    answered + above the threshold and - otherwise. With early stop, steps after the first - go. ``outcome`` keeps one turn
    with all steps, answered by the last score."""
    steps = steps.withColumn("fail", (F.col("score") <= threshold).cast("int"))
    if outcome:
        item = F.array_sort(F.collect_list(F.struct("step_idx", "step", "fail")))
        grouped = steps.groupBy(*keys, question).agg(item.alias("s"))
        said = F.concat(F.col(question), F.lit("\n\n"), F.array_join(F.transform("s", lambda x: x["step"]), "\n\n"))
        turns = F.array(F.struct(F.lit("human").alias("from"), said.alias("value")), F.struct(F.lit("gpt").alias("from"), F.when(F.element_at("s", -1)["fail"] == 0, "+").otherwise("-").alias("value")))
        return grouped.select(*keys, turns.alias("conversations"))
    if early_stop:
        before = Window.partitionBy(*keys).orderBy("step_idx").rowsBetween(Window.unboundedPreceding, -1)
        steps = steps.withColumn("stopped", F.coalesce(F.max("fail").over(before), F.lit(0))).where("stopped = 0")
    grouped = steps.groupBy(*keys, question).agg(F.array_sort(F.collect_list(F.struct("step_idx", "step", "fail"))).alias("s"))
    turn = lambda x, i: F.array(
        F.struct(F.lit("human").alias("from"), F.when(i == 0, F.concat(F.lit("### Question:\n"), F.col(question), F.lit("\n\n### Solution Process:\n"), x["step"])).otherwise(x["step"]).alias("value")),
        F.struct(F.lit("gpt").alias("from"), F.when(x["fail"] == 0, "+").otherwise("-").alias("value")))
    return grouped.select(*keys, F.flatten(F.transform("s", turn)).alias("conversations"))


def turn_stats(rows: DataFrame, turns: str = "conversations") -> DataFrame:
    n = F.size(turns)
    return rows.agg(F.max(n).alias("max_turns"), F.min(n).alias("min_turns"), F.avg(n).alias("mean_turns"), F.sum(n).cast("long").alias("turns"), F.count("*").alias("rows"))
