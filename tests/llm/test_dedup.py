"""Line, exact and near deduplication: brute force, and nulls, ties, repeats, long texts, empty tables, clashing columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import exact_dedup, line_dedup, near_dedup

DOCS = "doc_id long, text string, n_lines int, q_x string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], DOCS)


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def kept_lines(rows, least=10):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    first = {k: min(v, key=lambda x: (x is not None, x or 0)) for k, v in holders.items() if len(v) > 1}
    return sorted(((i, [x for x in (t or "").split("\n") if first.get(key(x), i) == i]) for i, t in rows), key=str)


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(3)
    pool = [f"Common line number {i}" for i in range(12)] + ["short", "", " \t", "ÄÖ common LINE é ", "äÖ common line é"]
    rows = [(i, "\n".join(r.choices(pool, k=r.randrange(0, 9)) + [f"own line of document {i}"])) for i in range(60)]
    rows += [(70, None), (71, ""), (None, "Common line number 1\nnull id"), (72, "\n".join(f"common line NUMBER {i % 12} " for i in range(200))), (5, "Common line number 2\nrepeat of five"), (5, "Common line number 2\nrepeat of five")]
    out = line_dedup.dedup_lines(docs(spark, rows))
    assert "q_x" in out.columns and out.columns.count("n_lines") == 1
    got = sorted(((x.doc_id, x.text.split("\n") if x.text else [""] if x.n_lines == 1 and x.n_dropped == 0 else []) for x in out.collect()), key=str)
    want = [(i, lines if lines else []) for i, lines in kept_lines(rows)]
    assert [(i, "\n".join(x)) for i, x in got] == [(i, "\n".join(x)) for i, x in want]
    n = {x.doc_id: (x.n_lines, x.n_dropped) for x in out.collect()}
    assert n[72] == (200, 200) and n[70] == (1, 0)


def test_line_dedup_of_an_empty_table_and_a_hot_line(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    rows = [(i, f"the same line everywhere\nown {i} line here") for i in range(3000)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.agg(F.sum("n_dropped")).first()[0] == 2999
    assert out.where("n_dropped = 0").first().doc_id == 0
    whole = line_dedup.dedup_lines(docs(spark, [(1, "a line of text\nmine"), (2, "a line of text")]), counts=False)
    assert whole.columns == ["doc_id", "text", "n_lines", "q_x"] and {x.n_lines for x in whole.collect()} == {7}
    long = "\n".join(f"line number {i} of a long text" for i in range(20_000))
    got = {x.doc_id: x.n_dropped for x in line_dedup.dedup_lines(docs(spark, [(1, long), (2, long + "\nmore")])).collect()}
    assert got == {1: 0, 2: 20_000}


def test_exact_dedup_names_blocks_of_any_length(spark):
    r = random.Random(5)
    base = ["".join(r.choices("ab é", k=n)) for n in (0, 1, 3, 4, 5, 8, 9, 17, 64, 65)]
    rows = [(i, r.choice(base)) for i in range(80)] + [(90, None), (91, ""), (None, "ab"), (None, "ab"), (3, base[5]), (3, base[5])]
    out = exact_dedup.dedup_exact(docs(spark, rows), chars=4).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(out) == len(rows)
    for x in out:
        text = next(t for t in groups if sha(t) == x.text_sha256)
        ids = [i for i in groups[text] if i is not None]
        assert x.group_size == len(groups[text]) and x.keep_id == (max(ids) if ids else None)
    assert sum(x.kept for x in out) == len(groups)
    assert exact_dedup.drop_copies(docs(spark, rows)).count() == len(groups)
    assert exact_dedup.dedup_exact(docs(spark, [])).count() == 0


def test_exact_dedup_of_hot_groups_and_clashing_columns(spark):
    rows = [(i, "copied by many" if i % 3 else f"text {i}", "a", "b", "c") for i in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, q_hash string, q_keep string, name string")
    kept = exact_dedup.drop_copies(table)
    assert kept.columns == table.columns
    assert {x.doc_id for x in kept.collect()} == {3998} | {i for i in range(4000) if i % 3 == 0}
    sizes = exact_dedup.dedup_exact(table).groupBy("group_size").count().collect()
    assert {(x.group_size, x["count"]) for x in sizes} == {(2666, 2666), (1, 1334)}


def test_exact_dedup_tells_long_texts_apart(spark):
    a = "x" * 50_000
    rows = [(1, a), (2, a + "y"), (3, a), (4, "y" + a)]
    out = {x.doc_id: (x.keep_id, x.kept) for x in exact_dedup.dedup_exact(docs(spark, rows)).collect()}
    assert out == {1: (3, False), 2: (2, True), 3: (3, True), 4: (4, True)}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}, sets


def test_near_dedup_matches_brute_force(spark):
    r = random.Random(8)
    rows, words = [], [f"w{i}" for i in range(500)]
    for g in range(12):
        text = r.choices(words, k=120)
        for _ in range(12):
            text = list(text)
            for _ in range(r.randrange(0, 4)):
                text[r.randrange(len(text))] = r.choice(words).upper()
            rows.append((len(rows), " ".join(text)))
        rows.append((len(rows), "one two three"))
    rows += [(900, None), (901, " \t\n"), (None, "one two three"), (902, "ONE two\tthree"), (903, "one two"), (5, rows[5][1])]
    out = near_dedup.near_classes(docs(spark, rows)).collect()
    want, sets = brute_components(rows)
    assert len(out) == len(rows)
    for x in out:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert (x.component_id, x.n_shingles, x.kept) == (want[x.doc_id], len(sets[x.doc_id]), want[x.doc_id] == x.doc_id), x
    kept = near_dedup.drop_near_copies(docs(spark, rows))
    assert kept.where("doc_id is not null").select("doc_id").distinct().count() == len(set(want.values()))
    assert near_dedup.near_classes(docs(spark, [])).count() == 0


def test_near_dedup_judges_texts_that_share_an_id_by_themselves(spark):
    a, b = " ".join(f"w{i}" for i in range(200)), " ".join(f"v{i}" for i in range(150))
    near, nearer = a.replace("w100 ", "x "), b.replace("v50 ", "x ")
    rows = [(3, a), (5, near), (5, b), (7, nearer), (7, "nothing like it"), (5, near)]
    table = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, q_gone int, q_doc string")
    kept = near_dedup.drop_near_copies(table)
    assert kept.columns == table.columns
    assert sorted((x.doc_id, x.text) for x in kept.collect()) == sorted([(3, a), (5, b), (7, "nothing like it")])


def test_near_dedup_keeps_texts_apart_that_share_half_a_hash(spark, monkeypatch):
    """All word sequences have the same first half of their hash: links go by classes, not by halves."""
    import zlib

    monkeypatch.setattr(near_dedup, "word_key", lambda words: (7, zlib.crc32(b" ".join(words))))
    base = [" ".join(f"{t}{i}" for i in range(60)) for t in ("a", "b")]
    rows = [(1, base[0]), (2, base[0] + " more"), (3, base[1]), (4, base[1] + " more"), (5, "quite another text of a few words")]
    got = {r.doc_id: r.component_id for r in near_dedup.near_classes(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_finds_what_lies_at_its_threshold(spark, percent):
    """Recall on pairs barely above the threshold, each alone, and on families whose members lie just below it."""
    r, rows, linked = random.Random(percent), [], 0
    for g in range(250):
        n = r.randrange(40, 300)
        text = [f"g{g}w{i}" for i in range(n)]
        # A cut of c words at the end leaves n - 4 - c of n - 4 shingles.
        most = (n - 4) * (100 - percent) // 100
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(text[: n - most]))]
        linked += most > 0
    for g in range(3):
        base = [f"f{g}w{i}" for i in range(400)]
        for m in range(12):
            rows.append((len(rows), " ".join(base[: 400 - (396 * (100 - percent) // 100 + 2) // 2] + [f"f{g}m{m}x{i}" for i in range(396 * (100 - percent) // 200)])))
    want, sets = brute_components(rows, percent)
    got = {x.doc_id: x.component_id for x in near_dedup.near_classes(docs(spark, rows), percent=percent).collect()}
    assert got == want and linked > 200


def test_the_pipeline_stage_drops_copies_from_a_similarity_of_080(spark):
    r = random.Random(11)
    rows = []
    for g in range(40):
        text = [f"g{g}w{i}" for i in range(204)]
        # Each change takes five of 200 shingles: 195/205 = 0.95, 185/215 = 0.86, 180/220 = 0.82, 178/222 = 0.80, 177/223 = 0.79.
        for changes, extra in ((1, 0), (3, 0), (4, 0), (4, 2), (4, 3)):
            other = list(text)
            for i in range(changes):
                other[10 + 40 * i + r.randrange(5)] = "changed"
            rows.append((len(rows), " ".join(text)))
            rows.append((len(rows), " ".join(other[: len(other) - extra] + ["end"] * extra)))
    want, sets = brute_components(rows, 80)
    alike = [len(sets[a] & sets[a + 1]) / len(sets[a] | sets[a + 1]) for a in range(0, len(rows), 2)]
    assert sum(0.8 <= x < 0.85 for x in alike) >= 40 and sum(x < 0.8 for x in alike) >= 40
    kept = corpus_pipeline.near_dedup_stage(spark, docs(spark, rows), "")
    assert {x.doc_id for x in kept.collect()} == {i for i, c in want.items() if i == c}
    assert kept.columns == ["doc_id", "text", "n_lines", "q_x"]


@pytest.mark.parametrize("percent", [30, 50, 70, 80, 85, 95, 100])
def test_bands_hold_their_threshold(percent):
    p = near_dedup.plan(percent)
    assert (1 - (percent / 100) ** p.rows) ** p.bands <= 1e-6 and p.hashes <= near_dedup.MOST_HASHES and p.hashes % 32 == 0
    assert len(near_dedup.band_keys(near_dedup.minima(near_dedup.Shingler().shingles([b"a", b"b"]), p.hashes), p.bands)) == p.bands


def test_a_threshold_below_all_bands_is_refused():
    with pytest.raises(ValueError):
        near_dedup.plan(1)
