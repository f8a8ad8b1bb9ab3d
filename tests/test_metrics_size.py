"""Jobs whose cost is to grow no faster than their tables."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import udfs
from quern.operators import clustering, metrics, mixture, routing
from quern.queries import QUERIES


def grams(words, n):
    return collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def test_bleu_counts_ngrams_in_place(spark):
    """Against counting one by one; rows of one key count together, and no n-gram is shuffled."""
    texts = ["the cat the cat the cat sat", "the cat sat on the mat, the cat", "", None, "a b", "a b c d e f g " * 9, "b c d e f g a b c"]
    rows = [(i % 11, texts[i % 7], [texts[(i * 3 + 1) % 7], texts[(i * 5 + 2) % 7]]) for i in range(40)] + [(None, "a b c d e", ["a b c d e"])]
    table = spark.createDataFrame(rows, "id int, pred string, gts array<string>").repartition(3)
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    hit, every = [0] * 4, [0] * 4
    for n in range(1, 5):
        for key in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == key]
            have = sum((grams(words(p), n) for _, p, _ in mine), collections.Counter())
            may = [sum((grams(words(ts[t]), n) for _, _, ts in mine), collections.Counter()) for t in range(len(mine[0][2]))] if key is not None else []
            hit[n - 1] += sum(min(c, max([m[g] for m in may], default=0)) for g, c in have.items())
            every[n - 1] += sum(have.values())
    near = [min((abs(len(words(t)) - len(words(p))), len(words(t))) for t in ts if t is not None)[1] for _, p, ts in rows if p is not None and any(t is not None for t in ts)]
    got = metrics.bleu(table)
    row = got.first()
    assert row.pred_words == sum(len(words(p)) for _, p, _ in rows)
    precision = math.exp(sum(math.log(h / a) for h, a in zip(hit, every)) / 4)
    assert row.bleu == pytest.approx((1 if row.pred_words > row.truth_words else math.exp(1 - row.truth_words / row.pred_words)) * precision)
    assert row.truth_words >= sum(near)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert metrics.bleu(table.limit(0)).first().bleu == 0


def test_draws_repeat_at_any_size(spark, tmp_path):
    """A hundred draws of 40,000 rows mostly differ; a source without a name is one too."""
    source = F.when(F.col("id") % 40 == 39, None).otherwise(F.concat(F.lit("s"), F.col("id") % 4))
    spark.range(160_000).select(F.col("id").alias("doc_id"), source.alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["draws_repeat"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(s, 100, True, True) for s in (None, "s0", "s1", "s2", "s3")], key=str)
    assert sorted(r.drawn for r in QUERIES["draw_with_replacement"](spark, str(tmp_path)).collect()) == [100] * 5


def test_draws_in_blocks_are_the_draws(spark, monkeypatch):
    rows = spark.range(10).select(F.lit("d").alias("dataset"), F.col("id").alias("line_no"))
    quota = spark.createDataFrame([("d", 23)], "dataset string, quota long")
    whole = sorted(map(tuple, mixture.draw_with_replacement(rows, quota, "line_no").collect()))
    monkeypatch.setattr(mixture, "DRAWS", 5)
    assert sorted(map(tuple, mixture.draw_with_replacement(rows, quota, "line_no").collect())) == whole and len(whole) == 23


def test_kmeans_rounds_write_few_tables(spark):
    """Thirty rounds on one cloud write five tables at most and shuffle nothing after the first; sums are those of all rows."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(2000, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4).cache()
    x = routing.unit(x)
    now = clustering.first_centroids(rows, 5, 42, "vec_id", "embedding")
    for small in (clustering.SMALL_SUMS, 0):
        bounds, at = clustering.Rounds(rows, "embedding", "vec_id"), now
        clustering.SMALL_SUMS, kept = small, clustering.SMALL_SUMS
        for _ in range(30 if small else 4):
            sums, n = bounds.assign(at)
            nearest = (x @ at.T).argmax(axis=1)
            assert n.tolist() == np.bincount(nearest, minlength=5).tolist()
            assert np.abs(sums - np.array([x[nearest == i].sum(axis=0) for i in range(5)])).max() < 1e-9
            at = routing.unit(sums)
        clustering.SMALL_SUMS = kept
        assert bounds.tables <= 5


def test_tokenizer_keeps_ids_in_four_bytes(spark):
    ids = udfs.tokenizer().func(pa.array(["a b, c", None, "", "b"]))
    assert ids.type == pa.list_(pa.int32()) and [len(i) for i in ids.to_pylist()] == [4, 0, 0, 1]
    assert ids.to_pylist()[3] == [zlib.crc32(b"b") & 0x7FFFFFFF] == ids.to_pylist()[0][1:2]
    assert udfs.tokenizer(lambda t: [len(t)]).func(pa.array(["abc"])).to_pylist() == [[3]]


def test_long_labels_are_not_shuffled(spark, tmp_path):
    spark.range(9).select(F.col("id").alias("p_partkey"), (F.col("id") * 6 + 1).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    out = QUERIES["supervised_pieces"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "-100" in plan and "-100" not in plan[plan.rindex("Window [") :]
    assert {(r.p_partkey, r.learns, r.width) for r in out.collect()} == {(i, (s := i * 6 + 1) % 40 * 256 > 2560, max(s, i % 9 + 1)) for i in range(9)}


def test_equal_answers_are_graded_once(spark, tmp_path):
    """Grading follows the count of equal pairs, which combines before a shuffle."""
    rows = spark.range(400).select(F.col("id").alias("l_orderkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"), (F.col("id") % 5).alias("l_suppkey"), (F.col("id") % 6).cast("decimal(15,2)").alias("l_quantity"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    for name, keys in (("numeric_match", "l_linenumber"), ("useful_scores", "type")):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE" not in plan[plan.rindex("Aggregate [") :] and "RLIKE" in plan
    odd = spark.createDataFrame([("count", "7", "9"), ("count", "x", "9"), (None, "a", "a"), ("kind", "a, b", "A"), ("kind", None, "A"), ("kind", "b", "A")], "type string, pred string, gt string")
    assert {(r.type, r.score, r.n) for r in metrics.useful_scores(odd).collect()} == {("count", 0.5, 2), ("total", 0.5, 6), ("kind", 0.3333, 3), ("useful", 0.3333, 3)}
