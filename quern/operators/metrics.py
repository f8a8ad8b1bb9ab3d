"""Benchmark metrics as aggregates. Each takes a DataFrame of predictions and returns a DataFrame of scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.basics import ratio, strip, words
from ..functions.boxes import iou, iou_pixels
from .mixture import numbered


def rate(ok: Column) -> Column:
    """Share of rows where ``ok`` holds; null counts as no."""
    return F.avg(F.coalesce(ok, F.lit(False)).cast("double"))


def exact_accuracy(rows: DataFrame, pred: str = "pred", truth: str = "gt") -> DataFrame:
    return rows.agg(rate(F.col(pred) == F.col(truth)).alias("accuracy"), F.count("*").alias("n"))


def any_match_accuracy(rows: DataFrame, pred: str = "pred", truths: str = "gts") -> DataFrame:
    """Equal to one of several truths, ignoring case and blanks at the ends."""
    ok = F.exists(F.col(truths), lambda t: F.lower(strip(t)) == F.lower(strip(pred)))
    return rows.agg(rate(ok).alias("accuracy"), F.count("*").alias("n"))


def relaxed_accuracy(rows: DataFrame, pred: str = "pred", truths: str = "gts", variant: str = "percent", swapped: bool = False) -> DataFrame:
    """Best relaxed match over the truths; ``swapped`` takes the tolerance relative to the prediction."""
    p = strip(pred)
    ok = F.exists(F.col(truths), lambda t: A.relaxed_match(p, t, variant) if swapped else A.relaxed_match(t, p, variant))
    return rows.agg(rate(ok).alias("accuracy"), F.count("*").alias("n"))


def vqa_accuracy(rows: DataFrame, pred: str = "pred", truths: str = "gts") -> DataFrame:
    """Consensus score over ten normalised answers."""
    score = A.vqa_consensus(A.normalize_answer(pred), F.transform(F.col(truths), A.normalize_answer))
    return rows.agg(F.avg(score).alias("accuracy"), F.count("*").alias("n"))


def normalized_any_accuracy(rows: DataFrame, pred: str = "pred", truths: str = "gts") -> DataFrame:
    ok = F.array_contains(F.transform(F.col(truths), A.normalize_answer), A.normalize_answer(pred))
    return rows.agg(rate(ok).alias("accuracy"), F.count("*").alias("n"))


def anls_score(rows: DataFrame, pred: str = "pred", truths: str = "gts", scene: bool = False) -> DataFrame:
    score = (A.anls_scene if scene else A.anls)(pred, F.col(truths))
    return rows.agg(F.avg(score).alias("anls"), F.count("*").alias("n"))


def anls_by(rows: DataFrame, labels: str, pred: str = "pred", truths: str = "gts", excluded: DataFrame | None = None, key: str = "question_id") -> DataFrame:
    """Mean score for each label of an array column; excluded ids leave numerator and denominator."""
    if excluded is not None:
        rows = rows.join(excluded.select(key), key, "left_anti")
    return rows.withColumn("s", A.anls(pred, F.col(truths))).select(F.explode(labels).alias("label"), "s").groupBy("label").agg(F.avg("s").alias("anls"), F.count("*").alias("n"))


def grounding_precision(rows: DataFrame, pred: str = "box", truth: str = "gt_box", threshold: float = 0.5) -> DataFrame:
    return rows.agg(rate(iou(pred, truth) >= threshold).alias("precision"), F.count("*").alias("n"))


def detection_accuracy(rows: DataFrame, pred: str = "box", truth: str = "gt_box", threshold: float = 0.5) -> DataFrame:
    """Overlap of inclusive pixels above the threshold; a missing box is wrong."""
    return rows.agg(rate(iou_pixels(pred, truth) > threshold).alias("accuracy"), F.count("*").alias("n"))


def binary_metrics(rows: DataFrame, by: list[str], pred: str = "pred", truth: str = "gt", positive: str = "yes") -> DataFrame:
    """Confusion counts and ratios per group; ratios are null where nothing can be divided."""
    p, t = F.col(pred) == positive, F.col(truth) == positive
    counts = rows.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & ~t).alias("tn"), F.count_if(~p & t).alias("fn"), F.count("*").alias("n"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumns({"precision": precision, "recall": recall, "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("n")), "yes_ratio": ratio(F.col("tp") + F.col("fp"), F.col("n"))})
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(rows: DataFrame, category: str = "category", **names: str) -> DataFrame:
    return binary_metrics(rows, [category], **names).agg((F.avg("f1") * 100).alias("f1"))


def with_pairs(rows: DataFrame, by: list[str], order: str = "line_no") -> DataFrame:
    """``rows`` with pair, the number of their pair: rows two by two in their group."""
    return numbered(rows, order, name="q_rn", by=by).withColumn("pair", F.floor(F.col("q_rn") / 2).cast("long")).drop("q_rn")


def pair_accuracy(rows: DataFrame, by: list[str], correct: str = "correct", order: str = "line_no") -> DataFrame:
    """Share of consecutive pairs that are right in both."""
    pairs = with_pairs(rows, by, order).groupBy(*by, "pair").agg(F.min(F.col(correct).cast("int")).alias("both"))
    return pairs.groupBy(*by).agg(F.avg("both").alias("pair_accuracy"), F.count("*").alias("pairs"))


def yes_no_tasks(rows: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Per task (task, image, line_no, pred, gt): accuracy over all, precision and recall without "other", accuracy of
    pairs, and score 100 * (accuracy + pair accuracy)."""
    p = A.yes_no_other("pred")
    t = F.lower(strip("gt"))
    rows = rows.withColumns({"p": p, "t": t}).withColumn("ok", (F.col("p") == F.col("t")).cast("int"))
    rows = with_pairs(rows, ["task"])
    clear = F.col("p") != "other"
    yes = lambda a, b: F.count_if(clear & (F.col("p") == a) & (F.col("t") == b))
    by_pair = rows.groupBy("task", "pair").agg(F.sum("ok").alias("right"), F.count("*").alias("k"), yes("yes", "yes").alias("tp"), yes("yes", "no").alias("fp"), yes("no", "yes").alias("fn"), F.count_if(~clear).alias("other"))
    out = by_pair.groupBy("task").agg(ratio(F.sum("right"), F.sum("k")).alias("accuracy"), F.avg((F.col("right") == 2).cast("double")).alias("accuracy_plus"), ratio(F.sum("tp"), F.sum("tp") + F.sum("fp")).alias("precision"), ratio(F.sum("tp"), F.sum("tp") + F.sum("fn")).alias("recall"), F.sum("other").alias("other"))
    out = out.withColumn("score", 100 * (F.col("accuracy") + F.col("accuracy_plus")))
    if groups:
        names = F.create_map(*(F.lit(x) for g, tasks in groups.items() for t in tasks for x in (t, g)))
        out = out.withColumn("group", F.element_at(names, F.col("task")))
    return out


def type_accuracy(rows: DataFrame, type_id: str = "question_type_id", image_types: tuple[int, int] = (1, 9)) -> DataFrame:
    """Accuracy per question type, and totals over image and video types."""
    kind = F.when(F.col(type_id).between(*image_types), "image").otherwise("video")
    each = rows.withColumn("ok", (F.col("pred") == F.col("gt")).cast("double")).withColumn("kind", kind)
    return each.groupingSets([[F.col("kind"), F.col(type_id)], [F.col("kind")], []], F.col("kind"), F.col(type_id)).agg(F.avg("ok").alias("accuracy"), F.count("*").alias("n"))


def rollup_accuracy(rows: DataFrame, by: list[str], correct: Column | str = "correct") -> DataFrame:
    """Accuracy per group, per outer group and overall, weighted by rows; level counts the columns rolled up."""
    ok = (F.col(correct) if isinstance(correct, str) else correct).cast("double")
    level = sum((F.grouping(c).cast("int") for c in by[1:]), F.grouping(by[0]).cast("int"))
    return rows.withColumn("q_ok", ok).rollup(*by).agg(F.avg("q_ok").alias("accuracy"), F.count("*").alias("n"), level.alias("level"))


def counted_accuracy(rows: DataFrame, file: str, expected: int) -> DataFrame:
    """Accuracy of files that have the expected number of rows."""
    return rows.groupBy(file).agg(rate(F.col("pred") == F.col("gt")).alias("accuracy"), F.count("*").alias("n")).where(F.col("n") == expected)


def macro_accuracy(rows: DataFrame, task: str = "task", correct: str = "correct") -> DataFrame:
    """Plain mean of the tasks' accuracies."""
    return rows.groupBy(task).agg(F.avg(F.col(correct).cast("double")).alias("a")).agg(F.avg("a").alias("accuracy"), F.count("*").alias("tasks"))


def micro_accuracy(rows: DataFrame, task: str = "task", correct: str = "correct") -> DataFrame:
    """Accuracy in percent per task and over all rows."""
    return rollup_accuracy(rows, [task], correct).withColumn("accuracy", F.col("accuracy") * 100)


def rule_scores(rows: DataFrame, yes_no_tasks: list[str], contain_tasks: list[str], groups: dict[str, str]) -> DataFrame:
    """Per group of tasks the mean of its tasks' accuracies; a task is scored exactly, by yes and no, or by containment."""
    p, t = F.lower(strip("pred")), F.lower(strip("gt"))
    ok = F.when(F.col("task").isin(*yes_no_tasks), A.yes_no_other("pred") == t).when(F.col("task").isin(*contain_tasks), F.contains(p, t)).otherwise(p == t)
    names = F.create_map(*(F.lit(x) for pair in groups.items() for x in pair))
    tasks = rows.withColumn("ok", ok.cast("double")).groupBy("task").agg(F.avg("ok").alias("a")).withColumn("group", F.element_at(names, F.col("task")))
    return tasks.groupBy("group").agg(F.avg("a").alias("accuracy"), F.count("*").alias("tasks"))


def useful_scores(rows: DataFrame, left_out: tuple[str, ...] = ("count", "area")) -> DataFrame:
    """Score by type, over all, and over all types but the ones left out; to four places. Equal answers are graded once."""
    rows = rows.groupBy("type", "pred", "gt").agg(F.count("*").alias("q_n"))
    ok = F.when(F.col("type").isin(*left_out), A.count_bucket("pred") == A.count_bucket("gt")).otherwise(A.first_part_equals("pred", "gt"))
    right = F.sum(F.when(ok, F.col("q_n")).otherwise(F.lit(0)))
    types = rows.groupBy("type").agg(right.alias("right"), F.sum("q_n").alias("q_n"))
    keys = F.array(F.col("type"), F.lit("total"), F.when(~F.col("type").isin(*left_out), "useful"))
    each = types.select(F.explode(keys).alias("type"), "right", "q_n").where("type is not null")
    return each.groupBy("type").agg(F.round(ratio(F.sum("right"), F.sum("q_n")), 4).alias("score"), F.sum("q_n").alias("n"))


def summed_abilities(rows: DataFrame, ability: str = "ability", score: str = "score") -> DataFrame:
    """Mean per ability, and overall as the sum of the means."""
    means = rows.groupBy(ability).agg(F.avg(score).alias("score"))
    return means.unionByName(means.agg(F.lit("overall").alias(ability), F.sum("score").alias("score")))


def attribute_accuracy(rows: DataFrame, attributes: list[str], arrays: tuple[str, ...] = (), correct: str = "correct") -> DataFrame:
    """Accuracy in percent for each value of each attribute, best first within an attribute."""
    one = [F.struct(F.lit(a).alias("key"), F.col(a).cast("string").alias("value")) for a in attributes]
    many = [F.arrays_zip(F.array_repeat(F.lit(a), F.size(a)).alias("key"), F.col(a).cast("array<string>").alias("value")) for a in arrays]
    long = rows.select(F.explode(F.concat(F.array(*one), *many)).alias("kv"), correct)
    return long.groupBy("kv.key", "kv.value").agg(F.round(100 * F.avg(F.col(correct).cast("double")), 2).alias("accuracy"), F.count("*").alias("n")).orderBy("key", F.desc("accuracy"))


def judge_summary(rows: DataFrame, first: str = "first", second: str = "second", category: str = "category") -> DataFrame:
    """Mean scores per category and overall: ratio in percent, and both means times ten."""
    both = rows.select(F.explode(F.array(F.col(category), F.lit("all"))).alias("category"), first, second)
    means = both.groupBy("category").agg(F.avg(first).alias("a"), F.avg(second).alias("b"))
    return means.select("category", F.round(F.try_divide(F.col("b"), F.col("a")) * 100, 1).alias("relative"), F.round(F.col("a") * 10, 1).alias("first"), F.round(F.col("b") * 10, 1).alias("second"))


def rating_summary(rows: DataFrame, rating: str = "rating", index: str = "index", kinds: int = 8) -> DataFrame:
    """Mean rating and share below 3, over all (kind null) and by index mod ``kinds``."""
    each = rows.withColumn("kind", F.pmod(F.col(index), F.lit(kinds)))
    return each.rollup("kind").agg(F.avg(rating).alias("rating"), F.avg((F.col(rating) < 3).cast("double")).alias("hallucination"), F.count("*").alias("n"))


def mean_words(rows: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.size(words(text))).alias("mean_words"))


def gram_hits(texts: pa.Array, most: int, words: int = 1 << 18) -> tuple[list[int], list[int]]:
    """For each n up to ``most``, the n-grams of texts of role 0 that others of their row have too, clipped at the most that one
    role has, and all n-grams of role 0. ``texts``: a list of (role, words) in each row; rows are taken by ``words`` at a time."""
    hit, every = [0] * most, [0] * most
    sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    flat = texts.flatten()
    lists = flat.field("words")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.r_[0, np.cumsum(sizes)]  # texts before each row
    before = np.r_[0, np.cumsum(lengths)][ends]  # words before each row
    roles, a = flat.field("role").to_numpy(zero_copy_only=False), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(before, before[a] + words, "right")) - 1)
        part = slice(ends[a], ends[b])
        code = lists[part].flatten().dictionary_encode()
        code, n = code.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(code.dictionary)
        length = lengths[part]
        row = np.repeat(np.repeat(np.arange(b - a), sizes[a:b]), length)
        role = np.repeat(roles[part], length)
        left = np.repeat(np.cumsum(length), length) - np.arange(len(code))  # words from here to the text's end
        at, gram = np.arange(len(code)), row
        for i in range(most):
            stays = left[at] > i
            at = at[stays]
            if not len(at):
                break
            # Numbers of n-grams within their row: those of one word less with the word that follows.
            kinds, gram = np.unique(gram[stays] * n + code[at + i], return_inverse=True)
            by = role[at]
            have, may = np.bincount(gram[by == 0], minlength=len(kinds)), np.zeros(len(kinds), np.int64)
            for r in np.unique(by[by > 0]):
                may = np.maximum(may, np.bincount(gram[by == r], minlength=len(kinds)))
            hit[i] += int(np.minimum(have, may).sum())
            every[i] += int(have.sum())
        a = b
    return hit, every


def bleu(rows: DataFrame, key: str = "id", pred: str = "pred", truths: str = "gts", most: int = 4) -> DataFrame:
    """Corpus BLEU over words [a-z0-9]+ of the lower-cased text: clipped n-gram precisions, with the brevity penalty of the
    references nearest in length (the shorter of two)."""
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))
    # The texts of a key meet in one row, whose n-grams are counted where they are; only sums by n leave a task.
    keyed = rows.groupBy(F.col(key).alias("k")).agg(F.collect_list(F.struct(F.col(pred).alias("p"), F.col(truths).alias("ts"))).alias("s"))
    split = keyed.select("k", F.transform("s", lambda x: F.struct(tokens(x["p"]).alias("p"), F.transform(x["ts"], tokens).alias("ts"))).alias("s"))
    nearest = lambda x: F.array_min(F.transform(x["ts"], lambda t: F.struct(F.abs(F.size(t) - F.size(x["p"])).alias("d"), F.size(t).alias("n"))))["n"]
    total = lambda of: F.aggregate("s", F.lit(None).cast("long"), lambda a, x: F.coalesce(a + of(x), a, of(x).cast("long")))
    said = F.transform("s", lambda x: F.struct(F.lit(0).alias("role"), x["p"].alias("words")))
    none = F.array().cast("array<struct<role: int, words: array<string>>>")
    given = F.flatten(F.transform("s", lambda x: F.coalesce(F.transform(x["ts"], lambda t, i: F.struct((i + 1).alias("role"), t.alias("words"))), none)))
    texts = split.select(F.when(F.col("k").isNull(), said).otherwise(F.concat(said, given)).alias("texts"), total(lambda x: F.size(x["p"])).alias("c"), total(nearest).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = gram_hits(batch.column(0), most)
            c, r = (pc.sum(batch.column(i)).as_py() for i in (1, 2))
            columns = [[*range(1, most + 1), None], [*found[0], None], [*found[1], None], [None] * most + [c], [None] * most + [r]]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], ["n", "hit", "all", "c", "r"])

    every = texts.mapInArrow(run, "n long, hit long, all long, c long, r long").groupBy("n").agg(*(F.sum(c).alias(c) for c in ("hit", "all", "c", "r")))
    row = every.agg(F.count_if(F.col("hit") > 0).alias("orders"), F.avg(F.when(F.col("hit") > 0, F.ln(F.col("hit") / F.col("all")))).alias("mean"), F.max("c").alias("c"), F.max("r").alias("r"))
    brevity = F.when(F.col("c") > F.col("r"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("r"), F.col("c"))))
    return row.select(F.coalesce(F.when(F.col("orders") == most, brevity * F.exp("mean")), F.lit(0.0)).alias("bleu"), F.col("c").alias("pred_words"), F.col("r").alias("truth_words"))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, or of an array column's elements."""
    array = dict(rows.dtypes)[column].startswith("array")
    return rows.select((F.explode(column) if array else F.col(column)).alias("value")).distinct()
