"""Appends that a crash interrupts between any two steps."""

import pytest
from pyspark.sql import functions as F

from quern.sources import commits, writers


def table(spark, ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], "k int, v string")


def held(spark, path):
    return sorted(r.k if r.k is not None else -1 for r in spark.read.parquet(path).collect())


@pytest.mark.parametrize("step", ["put", "publish", "move"])
def test_a_crash_neither_loses_nor_doubles_rows(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    commits.append_once(table(spark, [1, 2]), path, ["k"], "a")
    owner = commits if step == "publish" else commits.Folder
    real = getattr(owner, step)

    def broken(*a):
        raise KeyboardInterrupt(step)

    monkeypatch.setattr(owner, step, broken)
    with pytest.raises(KeyboardInterrupt):
        commits.append_once(table(spark, [2, 3, 4]).repartition(2), path, ["k"], "b")
    monkeypatch.setattr(owner, step, real)
    commits.append_once(table(spark, [2, 3, 4]), path, ["k"], "b")
    assert held(spark, path) == [1, 2, 3, 4]
    commits.append_once(table(spark, [4, 5]), path, ["k"], "b")  # the name has been
    assert held(spark, path) == [1, 2, 3, 4]
    assert commits.Folder(spark, path).names("_staging") == []


def test_filters_let_known_keys_through_and_few_others(spark, tmp_path, monkeypatch):
    path, keys = str(tmp_path / "t"), ["k", "v"]
    spark.range(5000).select(F.col("id").cast("int").alias("k"), F.lit(None).cast("string").alias("v")).write.parquet(path)
    monkeypatch.setattr(commits, "SHARE", 500)
    same = spark.range(4990, 5010).select(F.col("id").cast("int").alias("k"), F.lit(None).cast("string").alias("v"))
    writers.append_missing(same, path, keys)
    assert held(spark, path) == list(range(5010))
    done = commits.recover(spark, path)
    assert len(done) == 2 and max(r["filter"] for r in done.values()) > 2
    other = spark.range(100_000, 101_000).select(F.col("id").cast("int").alias("k"), F.lit(None).cast("string").alias("v"))
    assert commits.maybe_known(other, path, keys, done).count() < 50
    assert commits.maybe_known(same, path, keys, done).select("k").distinct().count() == 20


def test_empty_batches_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.append_missing(table(spark, [1]).limit(0), path, ["k"])
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), (7, "c")], "k int, v string")
    for _ in range(2):
        writers.append_missing(nulls, path, ["k"])
    assert held(spark, path) == [-1, 7]


@pytest.mark.parametrize("step", ["put", "publish"])
def test_cursors_go_on_after_a_crash(spark, tmp_path, monkeypatch, step):
    from quern.streaming import cursors

    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(d, i) for d, n in (("a", 5), ("b", 7)) for i in range(n)], "dataset string, line_no long")
    quotas = spark.createDataFrame([("a", 4), ("b", 3)], "dataset string, quota int")
    cursors.take_next(rows, quotas, path)
    owner = commits if step == "publish" else commits.Folder
    real = getattr(owner, step)

    def broken(*a):
        raise KeyboardInterrupt(step)

    monkeypatch.setattr(owner, step, broken)
    with pytest.raises(KeyboardInterrupt):
        cursors.take_next(rows, quotas, path)
    monkeypatch.setattr(owner, step, real)
    while cursors.cursors(spark, path)[0] < 3:
        cursors.take_next(rows, quotas.where("dataset = 'a'") if cursors.cursors(spark, path)[0] == 2 else quotas, path)
    commits.recover(spark, path)
    got = sorted((r.dataset, r.line_no) for r in spark.read.parquet(path).collect())
    assert got == sorted([("a", i % 5) for i in range(12)] + [("b", i) for i in range(6)])
    assert {r.dataset: r.position for r in cursors.cursors(spark, path)[1].collect()} == {"a": 2, "b": 6}
