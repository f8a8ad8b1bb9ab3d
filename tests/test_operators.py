"""Jobs on small tables: routing, clustering, joins, mixtures, preference data, packing, metrics and the registry."""

import pytest
from pyspark.sql import functions as F

from quern.operators import clustering, joins, metrics, mixture, packing, preference, quality, routing
from quern.plans import registry
from quern.sources.artifacts import ClusterModel, load_model, save_model


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [float(i % 5 == j) + 0.01 * ((i * 7 + j) % 10) for j in range(5)]) for i in range(103)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").cache()


@pytest.fixture(scope="module")
def centroids(spark):
    return spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0])], "cluster int, centroid array<double>")


def test_nearest_ties_zeros_and_scale(spark, centroids):
    rows = spark.createDataFrame([(1, [3.0, 0.1]), (2, [0.0, 5.0]), (3, [0.0, 0.0]), (4, None), (5, [300.0, 10.0])], "id int, embedding array<double>")
    got = {r.id: r.cluster for r in routing.nearest(rows, centroids).collect()}
    assert got == {1: 0, 2: 1, 3: None, 4: None, 5: 0}
    assert {r.id: r.cluster for r in routing.nearest(rows, centroids, compat=True).collect()}[3] == 0
    assert {r.id: r.cluster for r in routing.nearest(rows, centroids, values=2).collect()} == got
    mapping = spark.createDataFrame([(0, 9), (1, 8), (2, 8)], "fine int, coarse int")
    assert {r.id: (r.fine, r.cluster) for r in routing.nearest_two_stage(rows, centroids, mapping).collect()}[2] == (1, 8)
    assert {r.cluster: r.n for r in routing.cluster_sizes(routing.nearest(rows, centroids).where("cluster is not null"), 3).collect()} == {0: 2, 1: 1, 2: 0}


def test_kmeans_and_balanced_sizes(vectors):
    c = clustering.spherical_kmeans(vectors, 5, iterations=5, runs=2)
    assert c.assignments.where("cluster is not null").count() == 103 and c.similarity > 90
    b = clustering.balanced_kmeans(vectors, 4, iterations=2)
    sizes = [r["count"] for r in b.assignments.groupBy("cluster").count().collect()]
    assert sum(sizes) == 103 and max(sizes) - min(sizes) <= 1 and b.assignments.select("vec_id").distinct().count() == 103
    fine, mapping = clustering.two_stage(vectors, 6, 2, iterations=2)
    assert sorted(r["count"] for r in mapping.groupBy("coarse").count().collect()) == [3, 3] and fine.centroids.count() == 6


def test_artifacts_and_partition(spark, tmp_path, vectors, centroids):
    root = str(tmp_path / "model")
    save_model(root, centroids, spark.createDataFrame([(1, 0), (2, 1)], "vec_id long, cluster int"))
    model = load_model(spark, root)
    assert model.stages == 1 and model.metadata.first().cluster_sizes == [1, 1, 0]
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path / "none"))
    features = spark.createDataFrame([("data/x/a.jpg", [1.0, 0.0], 0), ("y/b.jpg", [0.0, 1.0], 1), ("z/b.jpg", [1.0, 0.0], 2)], "path string, embedding array<double>, line_no long")
    rows = spark.createDataFrame([("d", 0, "x/a.jpg", "l0"), ("d", 1, "q\\b.jpg", "l1"), ("d", 2, "", "l2"), ("d", 3, "none.jpg", "l3"), ("d", 4, "data/x/a.jpg", "l4")], "dataset string, line_no long, image string, line string")
    got = lambda two: {r.line: r.cluster for r in routing.partition_datasets(rows, features, ClusterModel(centroids), drop_prefix=two).collect()}
    assert got(True) == {"l0": 0, "l1": 1, "l4": 0}
    assert got(False) == {"l0": 0, "l1": 1, "l4": 0}
    tasks = spark.createDataFrame([("t", 0, "y/b.jpg"), ("t", 1, "y/b.jpg"), ("t", 2, "no")], "task string, line_no long, image string")
    assert [r.cluster for r in routing.split_tasks(tasks, features, ClusterModel(centroids), 2).orderBy("line_no").collect()] == [1, 1, 0]


def test_joins(spark):
    truth = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    preds = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (9, "x")], "k int, answer string")
    assert {r.k: r.problem for r in joins.integrity(truth, preds, "k", "answer").collect()} == {1: "duplicate", 2: "empty", 3: "missing", 9: "unknown"}
    with pytest.raises(ValueError):
        joins.with_truth(preds, truth, "k", strict=True)
    assert joins.with_truth(preds, truth, "k").count() == 3
    labels = spark.createDataFrame([("i", "q", "yes"), ("i", "q\nmore", "no")], "image string, text string, label string")
    answers = spark.createDataFrame([("i", "q\nx"), ("j", "q")], "image string, text string")
    assert [r.label for r in joins.label_join(answers, labels).collect()] == ["yes"]
    assert joins.deficit(truth, preds, ["k"], 2).orderBy("k").select("missing").collect() == [(1,), (2,)]
    extra = joins.extra_positives(truth, spark.createDataFrame([(1,), (7,)], "k int"), ["k"])
    assert sorted(r.k for r in extra.collect()) == [1, 2, 3, 7]


def test_mixture(spark):
    rows = spark.range(10).select(F.lit("d").alias("dataset"), F.col("id").alias("line_no"))
    assert [r.rn for r in mixture.numbered(rows, "line_no").orderBy("line_no").collect()] == list(range(10))
    count = lambda shard: sorted(r["count"] for r in mixture.numbered(rows, "line_no").withColumn("s", shard).where("s is not null").groupBy("s").count().collect())
    assert count(mixture.shard_balanced(F.col("rn"), F.lit(10), 3)) == [3, 3, 4]
    assert count(mixture.shard_truncated(F.col("rn"), F.lit(10), 3)) == [3, 3, 3]
    assert count(mixture.shard_stride(F.col("rn"), 3)) == [3, 3, 4]
    five = rows.limit(5)
    assert mixture.repeat_rows(five, 0.5, "line_no", ["dataset"]).count() == 2 and mixture.repeat_rows(five, 3.0, "line_no", ["dataset"]).count() == 15
    quota = spark.createDataFrame([("d", 23)], "dataset string, quota long")
    drawn = mixture.draw_with_replacement(rows, quota, "line_no")
    times = {r.line_no: r["count"] for r in drawn.groupBy("line_no").count().collect()}
    assert sum(times.values()) == 23 and max(times.values()) > 3 and set(times) <= set(range(10))
    assert mixture.draw_with_replacement(rows.limit(0), quota, "line_no").count() == 0
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, mixture.draw_with_replacement(rows.repartition(3), quota, "line_no").collect()))
    groups = spark.createDataFrame([(g, i) for g in ("a", "b", None) for i in range(7)], "g string, i long")
    ranks = mixture.numbered(groups.where("g is not null"), "i", by=["g"]).collect()
    assert all(r.rn == r.i for r in ranks) and len(ranks) == 14
    cursors = spark.createDataFrame([("d", 8, 15), ("none", 2, 5)], "dataset string, position long, quota long")
    taken, after = mixture.take_from_cursors(rows, cursors)
    assert [(r.line_no, r.turn) for r in taken.orderBy("turn", "line_no").collect()] == [(8, 0), (9, 0)] + [(i, 1) for i in range(10)] + [(0, 2), (1, 2), (2, 2)]
    assert {r.dataset: r.position for r in after.collect()} == {"d": 3, "none": 2}
    manifest = spark.createDataFrame([("d", "x", 0.5)], "dataset string, annotation string, repeat_time double")
    assert mixture.build_mixture(lambda _: rows.drop("dataset"), manifest).count() == 5
    pool = spark.createDataFrame([(i, f"e{i}") for i in range(6)], "k int, t string")
    assert mixture.few_shot(five, pool, 2, "line_no", "k", "t").where("size(array_distinct(examples)) = 2").count() == 5
    assert mixture.few_shot(five, pool, 9, "line_no", "k", "t").where("size(array_distinct(examples)) = 6").count() == 5
    assert mixture.few_shot(five, pool.limit(0), 2, "line_no", "k", "t").where("size(examples) = 0").count() == 5


@pytest.fixture(scope="module")
def graded(spark):
    say = lambda a: f"one\ntwo\nFinal answer: {a}"
    rows = [("i", "q", "5", say("5"), "en")] * 2 + [("i", "q", "5", say("x5"), "en"), ("i", "q", "5", say("7"), "en"), ("i", "q", "5", "none", "en"), ("i", "p", "5", say("8"), "en")]
    return preference.grade(spark.createDataFrame(rows, "image string, question string, answer string, response string, prompt_version string"), F.array(F.lit("vqa"), F.lit("math"), F.lit("choice")))


def test_preference(spark, graded):
    assert {r.label: r["count"] for r in graded.groupBy("label").count().collect()} == {"pos": 2, "neg": 3, "format": 1}
    pairs = preference.build_pairs(graded).collect()
    assert [p.rejected[-1] for p in pairs] == ["7"]  # the answer that holds the right one makes no pair, copies make one
    assert preference.build_pairs(graded, entailment=True).count() == 2
    s = preference.pair_stats(graded).first()
    assert (s.only_pos, s.only_neg, s.both, s.possible_pairs, s.entail_skip, s.keys_without_pairs) == (0, 1, 1, 4, 2, 0)
    assert [r.question for r in preference.all_wrong_questions(graded).collect()] == ["p"]
    assert preference.build_pairs(graded, rejected="format").count() == 1
    steps = spark.createDataFrame([("s", "q", i, f"t{i}", x) for i, x in enumerate([1.0, 0.0, 1.0])], "id string, question string, step_idx int, step string, score double")
    turns = preference.steps_to_conversations(steps, ["id"], "question").first().conversations
    assert [t.value for t in turns if t["from"] == "gpt"] == ["+", "-"] and "q" in turns[0].value
    whole = preference.steps_to_conversations(steps, ["id"], "question", outcome=True).first().conversations
    assert len(whole) == 2 and whole[1].value == "+"
    rolls = spark.createDataFrame([("s", 0, 1), ("s", 0, 0), ("s", 1, 0), ("s", 2, 1)], "id string, step int, is_correct int")
    assert [(r.num_correct, r.num_total) for r in preference.step_scores(rolls, ["id"]).orderBy("step").collect()] == [(1, 2), (0, 1), (0, 0)]


def test_pairs_are_capped_only_where_there_are_more(spark):
    """Against all pairs of distinct responses, with answers that hold the right one, and copies."""
    rows = []
    for key in range(6):
        for i in range(key * 4):
            label, answer = ("pos", "5") if i % 3 == 0 else ("neg", ("15", "7", "8", "9")[i % 4])
            rows.append((f"i{key}", "q", "5", answer, f"r{key}-{i % 9}-{answer}", label))
    graded = spark.createDataFrame(rows, "image string, question string, answer string, answer_pred string, response string, label string")
    got = {}
    for p in preference.build_pairs(graded, k=5).collect():
        got.setdefault(p.image, set()).add((p.chosen, p.rejected))
    want = {}
    for i, _, _, a, r, la in rows:
        for j, _, _, b, s, lb in rows:
            if i == j and la == "pos" and lb == "neg" and a not in b:
                want.setdefault(i, set()).add((r, s))
    assert set(got) == set(want)
    assert all(got[i] <= want[i] and len(got[i]) == min(5, len(want[i])) for i in want)


def test_registered_packing_holds_all_tokens_of_long_documents(spark, tmp_path):
    from quern.queries import packing as registered
    from quern.queries.registry import QUERIES

    chars = {i: (i * 37) % 3000 for i in range(300)} | {300: 16_380, 301: 16_384, 302: 100_000, 303: 1_000_001}
    spark.createDataFrame(list(chars.items()), "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["pack_sequences"](spark, str(tmp_path)).collect()
    tokens, images, pieces = {}, {}, {}
    for x in out:
        tokens[x.sample] = tokens.get(x.sample, 0) + x.tokens
        images[x.sample] = images.get(x.sample, 0) + x.images
        pieces.setdefault((x.shard, x.pack, x.piece), []).append((x.offset, x.tokens, x.images))
    assert tokens == {i: n // 4 + 1 for i, n in chars.items()} and images == {i: i % 3 for i in chars}
    for spans in pieces.values():
        ends = [0]
        for offset, n, _ in sorted(spans):
            assert offset == ends[-1] and n > 0
            ends.append(offset + n)
        assert ends[-1] <= 4096 and sum(m for _, _, m in spans) <= 6
    report = QUERIES["pack_report"](spark, str(tmp_path)).first()
    assert (report.samples, report.packs) == (len(chars), len(pieces))
    assert report.padding_tokens == 4096 * len(pieces) - sum(tokens.values())
    assert report.padding_images == 6 * len(pieces) - sum(images.values())
    rows = 9 * registered._SHARD_ROWS
    spark.range(rows).selectExpr("id AS doc_id", "id % 900 AS n_chars").write.parquet(f"{tmp_path}/more/documents.parquet")
    assert QUERIES["pack_sequences"](spark, f"{tmp_path}/more").select("shard").distinct().count() == 9


def test_packing_bounds_and_rows(spark):
    lengths = [5, 4, 3, 2] * 20
    rows = spark.createDataFrame([(i, n, 1) for i, n in enumerate(lengths)], "sample long, tokens int, images int")
    limits = packing.Limits(tokens=8, images=4, buffers=5, overflow=False)
    for shards in (1, 3):
        packs = packing.pack_samples(rows, limits, shards)
        assert packs.select("sample").distinct().count() == packs.count() == 80
        assert packs.groupBy("shard", "pack").agg(F.sum("tokens").alias("t"), F.sum("images").alias("m")).where("t > 8 or m > 4").count() == 0
    over = packing.pack_samples(rows, packing.Limits(tokens=8, images=4, buffers=4, overflow=True), 2)
    cut = packing.cut_packs(over, 8)
    assert cut.groupBy("shard", "pack", "piece").agg(F.sum("tokens").alias("t")).where("t > 8").count() == 0
    assert cut.agg(F.sum("tokens")).first()[0] == sum(lengths)
    whole = packing.packed_rows(packs.withColumn("learned", F.lit(4)))
    r = whole.first()
    assert r.cu_seqlens[-1] == r.tokens == len(r.position_ids) == len(r.data_index) and set(r.loss_weight) == {0.5}
    ids, spans = F.sequence(F.lit(0), F.lit(9)), F.array(F.struct(F.lit(3).alias("start"), F.lit(6).alias("stop")))
    assert spark.range(1).select(packing.split_packed(ids, spans, 4)).first()[0] == [3, 7, 10]
    batches = packing.length_batches(rows.withColumnRenamed("tokens", "length"), 2, 4, "sample")
    assert batches.count() == 80 and batches.groupBy("mega").count().where("count > 8").count() == 0
    even = packing.even_split(batches.drop("shard"), 2, "mega", "length", "sample")
    assert even.groupBy("mega", "shard").count().where("count <> 4").count() == 0


def test_metrics_and_registry(spark):
    rows = spark.createDataFrame([("t", "i", 0, "Yes", "yes"), ("t", "i", 1, "No", "no"), ("t", "j", 2, "yes", "no"), ("t", "j", 3, "no", "no")], "task string, image string, line_no long, pred string, gt string")
    r = metrics.yes_no_tasks(rows).first()
    assert (r.accuracy, r.accuracy_plus, r.score) == (0.75, 0.5, 125)
    assert metrics.pair_accuracy(rows.withColumn("correct", F.lower("pred") == F.col("gt")), ["task"]).first().pair_accuracy == 0.5
    one = spark.createDataFrame([(1, "the cat sat on the mat", ["the cat sat on the mat"])], "id int, pred string, gts array<string>")
    assert metrics.bleu(one).first().bleu == pytest.approx(1.0)
    preds = spark.createDataFrame([("1", "two dogs")], "question_id string, answer string")
    truth = spark.createDataFrame([("1", ["2 dogs"] * 10)], "question_id string, gts array<string>")
    got = registry.combine_and_score("vqav2", [preds, preds.limit(0)], truth).first()
    assert (got.dataset, got.metric_value, got.n) == ("vqav2", 1.0, 1)
    box = spark.createDataFrame([("[0, 0, 500, 500]", [0.0, 0.0, 50.0, 50.0], [100.0, 100.0])], "answer string, gt_bbox array<double>, hw array<double>")
    assert registry.combine_and_score("refcoco", [box]).first().metric_value == 1
    chart = spark.createDataFrame([("105", ["100"])], "answer string, annotation array<string>")
    assert registry.combine_and_score("chartqa", [chart]).first().metric_value == 1
    a = registry.combine_and_score("chartqa", [chart]).withColumn("split", F.lit("test"))
    assert registry.record(a, registry.combine_and_score("chartqa", [chart]), "test").count() == 1


def test_quality(spark):
    rows = spark.createDataFrame([("d", "image", 896, 448, 1, 0), ("d", "video", 1, 1, 1, 5), ("d", "text", 1, 1, 0, 0)], "dataset string, kind string, width int, height int, images int, frames int")
    assert quality.media_totals(quality.media_plan(rows)).first().tiles == 8
    talk = spark.createDataFrame([([("gpt", "a a b b")],), ([("gpt", "fine")],)], "conversations array<struct<from: string, value: string>>")
    assert quality.drop_repetitive(talk, n=1).count() == 1
