"""Runs of repeated words against a search over all periods."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quern.llm import periodic_runs
from quern.llm.queries import op12_periodic_runs, planted_repeats


def brute(text):
    words, found = (text or "").encode().split(), {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    runs = sorted((s, q, e) for (s, e), q in found.items())
    gone = {i for s, q, e in runs for i in range(s + q, e)}
    return [(s, e - s, q) for s, q, e in runs], b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def made(draw):
    letters = draw.choice([1, 2, 3, 5, 50])
    words = [str(draw.randrange(letters)) for _ in range(draw.choice([0, 1, 5, 6, 7, 20, 100]))]
    for _ in range(draw.choice([0, 1, 2, 3])):
        unit = [str(draw.randrange(letters + 1)) for _ in range(draw.choice([1, 2, 3, 4, 5, 7, 8, 10, 11, 16, 20, 21, 33, 50]))]
        words += unit * draw.choice([2, 3, 4, 5, 8, 20]) + unit[: draw.randrange(len(unit))] + [str(draw.randrange(letters)) for _ in range(draw.randrange(6))]
    return draw.choice([" ", "\n", "\t ", " \x0b"]).join(words)


ODD = ["", None, " \n", "a", "a a a a a", "a a a a a a", "x" * 9000, "a " * 3000, "ab ba " * 700 + "end", " a" * 6 + " b" * 6, "A a A a A a A a", "é é é é é é é é"]


def test_runs_match_brute_force():
    draw = random.Random(5)
    for _ in range(60):
        texts = [made(draw) for _ in range(9)]
        runs, collapsed = periodic_runs.runs_and_collapsed(texts)
        assert [([(r["start"], r["length"], r["period"]) for r in x], c) for x, c in zip(runs, collapsed)] == list(map(brute, texts))


def test_transform_is_a_convolution():
    draw = np.random.default_rng(3)
    for n in (2, 4, 32, 256):
        a, b = draw.integers(0, periodic_runs.PRIME, (2, n, 3))
        want = [[sum(int(a[j, c]) * int(b[(i - j) % n, c]) for j in range(n)) % periodic_runs.PRIME for c in range(3)] for i in range(n)]
        got = periodic_runs.inverse(periodic_runs.transform(a.copy()) * periodic_runs.transform(b.copy()) % periodic_runs.PRIME)
        assert got.tolist() == want


def test_sums_that_the_prime_divides_are_no_copies():
    words = np.array([9, 0, 5, 7, 7, 3, 8, 2, 11, 12, 13], np.int64)
    assert list(periodic_runs._seeds(words, np.array([1, 3]), np.array([2, 2]), 2)) == []


def test_rows_keep_their_columns(spark):
    rows = [(i, t, "x", n) for n, (i, t) in enumerate([*enumerate(ODD), (1, "b b b b b b b"), (1, "b b b b b b b"), (None, "c d " * 9)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, collapsed string, q_text int").repartition(2)
    got = periodic_runs.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.doc_id == rows[r.q_text][0]
        assert ([tuple(x) for x in map(lambda y: (y.start, y.length, y.period), r.runs)], r.collapsed) == brute(rows[r.q_text][1])
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def planted(doc, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_over_documents(spark):
    path = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for r in op12_periodic_runs(spark, path).collect():
        runs, collapsed = brute(b" ".join(planted(r.doc_id, docs[r.doc_id])).decode())
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed.encode()).hexdigest()


def test_planting_meets_odd_rows(spark):
    rows = [(i, t) for i in range(40) for t in ("", None, "one", "a b c d e f g h")] + [(None, "x y"), (None, None)]
    got = planted_repeats(spark.createDataFrame(rows, "doc_id long, text string")).where(F.col("text").isNotNull()).collect()
    assert sorted((str(r.doc_id), *r.text.split()) for r in got) == sorted((str(i), *b" ".join(planted(i, t)).decode().split()) for i, t in rows if t is not None)
