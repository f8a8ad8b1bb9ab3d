"""Divergence of sources against plain Python with whole numbers of any size."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from quern.llm import divergence
from quern.llm.queries import op13_divergence

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least=3, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in sources}
        n_all = sum(total.values())
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 1) // (n_all + len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, r) for r, (value, item) in enumerate(ranked, 1)}
    return out


def made(seed, n):
    draw = random.Random(seed)
    words = ["the", "The", "ÉTÉ", "été", "a1b", "x_y", "z\x00z", "ß", "漢字", "don't", "-", "42", "q" * 300]
    return [(draw.choice(["en", "de", None, "", "xx"]), draw.choice(["s1", "s2", None, "ß", "S1"]), draw.choice([None, "", " ".join(draw.choices(words, k=draw.randrange(30)))])) for _ in range(n)]


def as_set(found):
    return {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in found.collect()}


def test_audit_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "AT_ONCE", 12)
    rows = made(4, 150) + [("none", "s1", "!!"), ("none", "s2", None), ("one", "s", "word word")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n int, term string").repartition(5)
    for top, shard_rows in ((200, 1000), (2, 7)):
        got = divergence.audit(docs, top=top, shard_rows=shard_rows)
        assert as_set(got) == brute(rows, top=top) and got.count() == len(brute(rows, top=top))


def test_other_thresholds_names_and_no_rows(spark):
    rows = made(6, 60)
    docs = spark.createDataFrame(rows, "l string, s string, body string")
    assert as_set(divergence.audit(docs, least_docs=1, lang_col="l", source_col="s", text_col="body")) == brute(rows, least=1)
    assert as_set(divergence.audit(docs.limit(0), lang_col="l", source_col="s", text_col="body")) == set()


def test_shares_are_exact():
    draw = random.Random(1)
    totals = [draw.randrange(1, 2 ** draw.randrange(1, 53)) for _ in range(2000)] + [1, 2**53 - 1]
    counts = [draw.randrange(t) for t in totals]
    got = divergence.shares(np.array(counts), np.array(totals)).tolist()
    assert got == [1 + 10**9 * (c + 1) // t for c, t in zip(counts, totals, strict=True)]


def test_partial_counts_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en", "de"], "source": ["a", "a", "a"], "text": ["It it, IT", "it", "  "]})
    assert sorted(map(tuple, (r.values() for r in divergence.partial_counts(batch).to_pylist()))) == [("de", "a", "", 0, 0), ("en", "a", "", 0, 0), ("en", "a", "it", 4, 2)]


def test_query_over_documents(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert as_set(op13_divergence(spark, path)) == brute(rows)
