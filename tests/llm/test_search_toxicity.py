"""Top-k search against brute force, the classifier on held-out rows, and the pipeline's decisions."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import topk_search, toxicity

SF = "/root/testdata/sf0.01"


def brute(rows, k=10, every=1):
    """Every row but those of the query's own id is a candidate; equal rows of an id ask once."""
    v = []
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            v.append((i, tuple(int(np.floor(1024 * float(np.float32(y)))) for y in e)))
    out = []
    for q, x in set(v):
        if q % every == 0:
            score = lambda y: max(min(sum(a * b for a, b in zip(x, y, strict=True)), 2**63 - 1), -(2**63))  # noqa: E731, B023
            best = sorted((-score(y), c) for c, y in v if c != q and len(y) == len(x))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def test_search_matches_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(0, 1, 6).astype(np.float32).tolist()) for i in range(700)]
    rows += [(i, [0.5] * 6) for i in range(700, 1100)] + [(1200, None), (1201, [1.0] * 5 + [None]), (1202, [float("nan")] * 6), (1203, [float("inf")] * 6), (None, [1.0] * 6), (1300, [0.0] * 6), (1400, [1.0, 2.0]), (5, rows[6][1]), (1500, [])]
    table = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<float>, score string, key int")
    got = sorted(map(tuple, topk_search.search(table, every=100).collect()))
    assert got == brute(rows, every=100)
    assert topk_search.search(table.limit(0)).count() == 0
    few = table.where("vec_id in (100, 200, 300)")
    assert topk_search.search(few).groupBy("query_id").count().where("count = 2").count() == 3


def test_search_keeps_large_components_and_repeated_ids(spark):
    r = np.random.default_rng(7)
    rows = [(i, r.normal(0, 1, 3).astype(np.float32).tolist()) for i in range(300)]
    rows += [(301, [2e12, 0.0, 1.0]), (302, [-3e12, 5.0, 0.25]), (303, [1e30, -1e30, 1.0]), (400, [4e12, 1.0, 1.0]), (3, [1.0, 1.0, 1.0]), (3, [9.0, 1.0, 1.0]), (100, [2.0, 0.0, 0.0]), (200, rows[200][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk_search.search(table, every=100).collect()))
    assert got == brute(rows, every=100)
    two = spark.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 1.0]), (3, [9.0, 1.0]), (4, [2e12, 0.0])], "vec_id long, embedding array<double>")
    assert [(x.vec_id, x.score) for x in topk_search.search(two).orderBy("rank").collect()] == [(4, 1024 * 1024 * 2 * 10**12), (3, 9 * 1024 * 1024), (3, 1024 * 1024)]


def test_search_passes_over_pages_of_clustered_vectors(spark):
    r = np.random.default_rng(8)
    centres = r.normal(0, 10, (40, 16))
    rows = [(i, (centres[i % 40] + r.normal(0, 0.3, 16)).tolist()) for i in range(12_000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    parts, pages = topk_search.visited(table)
    assert parts < 1 and pages < 0.2, (parts, pages)


def test_network_gradients_match_differences():
    net = toxicity.Network(seed=1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    r = np.random.default_rng(0)
    x, mask, y, w = r.normal(size=(3, 5, 6 * toxicity.HIDDEN)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool), np.array([1.0, 0.0, 1.0]), np.array([1.0, 0.5, 2.0])

    def loss():
        p = 1 / (1 + np.exp(-net.forward(x.astype(np.float64), mask)))
        return float((w * -(y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    grads, _ = net.gradients(x, mask, y, w)
    for name in ("Uf", "Ub", "A", "v", "o"):
        at = tuple(0 for _ in net.p[name].shape)
        keep, h = net.p[name][at], 1e-3
        net.p[name][at] = keep + h
        up = loss()
        net.p[name][at] = keep - h
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / (2 * h) - grads[name][at]) < 1e-3, name


def test_classifier_learns_and_never_sees_held_out_labels(spark):
    r = np.random.default_rng(2)
    words = [f"wo{a}rd{b}" for a in "abcdefg" for b in "klmnopq"]
    rows = []
    for i in range(500):
        text = list(r.choice(words, r.integers(3, 90)))
        if i % 3 == 0:
            for j in r.integers(0, len(text), max(1, len(text) // 12)):
                text[j] = f"vile{r.choice(words)[2:]}"
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    table = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, q_x string")
    labels = spark.createDataFrame([(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, _, y in rows] + [(None, 1), (7, None), (8, 5)], "doc_id long, toxic int")
    net = toxicity.train(table, labels)
    scored = toxicity.score(table.withColumn("held", toxicity.held_out(F.col("doc_id"))), net).collect()
    held = [(x.score >= 0.5) == (x.doc_id % 3 == 0) for x in scored if x.held]
    assert len(held) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(500)) and np.mean(held) > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 10_000), (4, "vileak " * 3000), (None, "a")], "doc_id long, text string")
    got = {x.doc_id: x.score for x in toxicity.score(odd, net).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[1] == got[2] and got[4] > 0.5
    assert toxicity.train(table, labels.limit(0)) is None
    clash = odd.select("doc_id", "text", F.lit("kept").alias("q_score"), F.lit("gone").alias("score"))
    assert toxicity.score(clash, net).columns == ["doc_id", "text", "q_score", "score"]
    assert toxicity.drop_toxic(clash, labels).columns == clash.columns
    assert toxicity.score(odd.limit(0), net).count() == 0 and toxicity.train(odd.limit(0), labels) is None
    assert toxicity.score(odd, None).agg(F.sum("score")).first()[0] == 0


def test_long_documents_train_too(spark):
    """Texts above 150,000 characters, of one label only, and toxic in one place."""
    r = np.random.default_rng(6)
    words = [f"wo{a}rd{b}" for a in "abcdefg" for b in "klmnopq"]
    long = lambda i: " ".join(r.choice(words, 25_000)) if i else None
    rows = [(i, " ".join(r.choice(words, 40)), 0) for i in range(1, 200, 2)]
    for i in range(0, 40, 2):
        text = long(1).split()
        text[int(r.integers(0, 25_000))] = "vile"
        rows.append((i, " ".join(text), 1))
    assert max(len(t) for _, t, _ in rows) > 150_000
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    windows = toxicity.sample_windows(table.withColumn("q_y", F.lit(1)), "doc_id", "text")
    assert sum(not whole for _, _, whole in windows) == 20 and max(len(w) for _, w, _ in windows) == toxicity.WINDOWS
    assert toxicity.train(table, labels) is not None


def plain_score(net, text):
    """One window after the other, one word after the other, with the formulas of the network written out."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    words, best, h = toxicity.tokens(text), -np.inf, toxicity.HIDDEN
    for start in toxicity.window_starts(len(words)):
        part = words[start : start + toxicity.WINDOW]
        x = net.project(net.features(part)).astype(float) if part else np.zeros((0, 6 * h))
        sides = []
        for way, cols in (("f", x[:, : 3 * h]), ("b", x[::-1, 3 * h :])):
            state, states, u = np.zeros(h), [], net.p[f"U{way}"].astype(float)
            for xi in cols:
                z, k = sig(xi[:h] + state @ u[:, :h]), sig(xi[h : 2 * h] + state @ u[:, h : 2 * h])
                state = (1 - z) * state + z * np.tanh(xi[2 * h :] + (k * state) @ u[:, 2 * h :])
                states.append(state)
            sides.append(states if way == "f" else states[::-1])
        s = np.array([np.concatenate(p) for p in zip(*sides, strict=True)]) if part else np.zeros((1, 2 * h))
        e = np.exp(np.tanh(s @ net.p["A"]) @ net.p["v"])
        best = max(best, float((e / e.sum()) @ s @ net.p["o"] + net.p["o0"][0]))
    return sig(best)


def test_long_words_and_repeated_ids_train_whole(spark, monkeypatch):
    long = "z" * 1000 + " y"
    assert [len(w) for w in toxicity.tokens(long)] == [256, 256, 256, 232, 1]
    free = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, int(k % 2)) for k, i in enumerate(free)], "doc_id long, toxic int")
    texts = [(i, ("bad " * 40 if k % 2 else "good " * 40) + "x" * 9000) for k, i in enumerate(free)]
    table = spark.createDataFrame(texts + [(free[0], f"again {n}") for n in range(400)], "doc_id long, text string")
    seen = []
    find = toxicity.sample_windows
    monkeypatch.setattr(toxicity, "sample_windows", lambda *a, **b: seen.append(find(*a, **b)) or seen[-1])
    assert toxicity.train(table, labels) is not None
    assert len(seen[0]) == len(free)  # one text of each id, none without windows
    assert max(len(x) for _, w, _ in seen[0] for x in w) > 4096


def test_blocks_of_words_change_no_score(monkeypatch):
    net = toxicity.Network()
    text = " ".join(f"w{i * i % 977}" for i in range(700))
    whole = toxicity.Scorer(net).scores([text, "w1", None])
    monkeypatch.setattr(toxicity, "BLOCK", 48)
    monkeypatch.setattr(toxicity, "HELD", 60)
    scorer = toxicity.Scorer(net)
    assert np.allclose(scorer.scores([text, "w1", None]), whole) and scorer.size <= 60 + 48


def test_scores_match_a_plain_scorer():
    net, r = toxicity.Network(seed=3), np.random.default_rng(9)
    words = [f"{a}{b}o" for a in "abcdefgh" for b in "mnpqrs"]
    texts = ["", None, "one", " ".join(r.choice(words, 31)), " ".join(r.choice(words, 32)), " ".join(r.choice(words, 33)), " ".join(r.choice(words, 700)), "Ünï, CODE! x"]
    got = toxicity.Scorer(net).scores(texts)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-5)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages_act_on_what_came_before(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] <= counts[2]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
