"""Benchmarks by name: how predictions meet the truth, and which metric scores them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import parse_box
from ..operators import joins, metrics
from ..sources.writers import upsert_scores

Metric = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Benchmark:
    """A metric over rows with pred and gt or gts; ``value`` names its column of the score."""

    name: str
    label: str
    value: str
    metric: Metric
    key: str = "question_id"
    form: str = "json"
    #: Columns that are the prediction and the truth in the files.
    pred: str = "answer"
    truth: str = "gts"
    needs_truth: bool = True


REGISTRY: dict[str, Benchmark] = {}


def register(b: Benchmark) -> Benchmark:
    REGISTRY[b.name] = b
    return b


def _boxes(rows: DataFrame) -> DataFrame:
    width, height = F.element_at("hw", 2), F.element_at("hw", 1)
    return metrics.grounding_precision(rows.withColumn("box", parse_box("pred", width, height)).withColumnRenamed("gt", "gt_box"))


for _name, _label in (("vqav2", "accuracy"), ("okvqa", "accuracy"), ("textvqa", "accuracy"), ("vizwiz", "accuracy")):
    register(Benchmark(_name, _label, "accuracy", metrics.vqa_accuracy))
register(Benchmark("docvqa", "anls", "anls", metrics.anls_score, key="questionId"))
register(Benchmark("infovqa", "anls", "anls", metrics.anls_score, key="questionId"))
register(Benchmark("stvqa", "anls", "anls", lambda rows: metrics.anls_score(rows, scene=True)))
register(Benchmark("chartqa", "relaxed accuracy", "accuracy", lambda rows: metrics.relaxed_accuracy(rows, variant="plain"), needs_truth=False, truth="annotation"))
register(Benchmark("ai2d", "accuracy", "accuracy", metrics.any_match_accuracy, needs_truth=False, truth="annotation"))
register(Benchmark("scienceqa", "accuracy", "accuracy", metrics.exact_accuracy, needs_truth=False, truth="gt_answers", form="jsonl"))
register(Benchmark("gqa", "accuracy", "accuracy", metrics.exact_accuracy, truth="gt"))
register(Benchmark("refcoco", "precision", "precision", _boxes, needs_truth=False, truth="gt_bbox"))
register(Benchmark("pope", "f1", "f1", lambda rows: metrics.macro_f1(rows.withColumn("pred", metrics.A.yes_no_sentence("pred"))), needs_truth=False, truth="label"))
register(Benchmark("yesno", "score", "score", lambda rows: metrics.yes_no_tasks(rows).agg(F.sum("score").alias("score"), F.count("*").alias("n")), needs_truth=False, truth="gt"))


#: Which keys a benchmark's prediction rows keep: name in the file, and the column it comes from.
_BY_QUESTION = {"question": "question", "question_id": "question_id", "answer": "answer"}
_WITH_TRUTH = {"question": "question", "questionId": "question_id", "answer": "answer", "annotation": "annotation"}
PROJECTIONS: dict[str, dict[str, str]] = {
    **dict.fromkeys(("vqav2", "okvqa", "textvqa", "vizwiz"), _BY_QUESTION),
    **dict.fromkeys(("docvqa", "infovqa", "gqa", "chartqa"), _WITH_TRUTH),
    "ai2d": {"question": "question", "image": "question_id", "answer": "answer", "annotation": "annotation"},
    "docvqa_test": {"questionId": "question_id", "answer": "answer"},
}


def project_predictions(name: str, rows: DataFrame) -> DataFrame:
    """The prediction rows of a benchmark as its result file holds them."""
    if name not in PROJECTIONS:
        raise ValueError(f"no projection for {name}: one of {sorted(PROJECTIONS)}")
    return rows.select(*(F.col(c).alias(shown) for shown, c in PROJECTIONS[name].items()))


def filter_rows(rows: DataFrame, equal: dict[str, object] | None = None, between: dict[str, tuple] | None = None, ignored: dict[str, list] | None = None, starts: dict[str, str] | None = None, ends: dict[str, str] | None = None) -> DataFrame:
    """Rows that meet all conditions: equal values, inclusive ranges, values outside a list, prefixes and suffixes."""
    for c, v in (equal or {}).items():
        rows = rows.where(F.col(c) == F.lit(v))
    for c, (low, high) in (between or {}).items():
        rows = rows.where(F.col(c).between(low, high))
    for c, values in (ignored or {}).items():
        rows = rows.where(~F.col(c).isin(*values)) if values else rows
    for c, v in (starts or {}).items():
        rows = rows.where(F.startswith(c, F.lit(v)))
    for c, v in (ends or {}).items():
        rows = rows.where(F.endswith(c, F.lit(v)))
    return rows


def combine(parts: list[DataFrame]) -> DataFrame:
    """Any number of result files as one table."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def combine_and_score(name: str, parts: list[DataFrame], truth: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """One row: dataset, label, metric and n of the benchmark over all parts."""
    b = REGISTRY[name]
    rows = combine(parts)
    if b.needs_truth:
        rows = joins.with_truth(rows, truth, b.key, strict)
    target = "gt" if b.truth in ("gt", "label", "gt_answers", "gt_bbox") else "gts"
    rows = rows.withColumnsRenamed({c: t for c, t in ((b.pred, "pred"), (b.truth, target)) if c != t and c in rows.columns})
    if target == "gts" and dict(rows.dtypes)["gts"] == "string":
        rows = rows.withColumn("gts", F.array("gts"))
    score = b.metric(rows)
    n = F.col("n") if "n" in score.columns else F.lit(None).cast("long")
    return score.select(F.lit(b.name).alias("dataset"), F.lit(b.label).alias("label"), F.col(b.value).cast("double").alias("metric_value"), n.alias("n"))


def record(scores: DataFrame, new: DataFrame, split: str, keys: tuple[str, ...] = ("dataset", "split", "label")) -> DataFrame:
    return upsert_scores(scores, new.withColumn("split", F.lit(split)), list(keys))
