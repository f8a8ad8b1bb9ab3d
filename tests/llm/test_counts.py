"""Mixing, token counts, packing, language-model scores and chat formatting against the library or brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat_format, lm_scoring, mixing, packing, token_counts
from quern.llm.queries import tokenizer_path

ODD = ["", None, " ", "a  b ", "it's WE'RE don't", "İstanbul Σας ΣΑΣ", "<|endoftext|> x <|ENDOFTEXT|>", "é́a ́b", "12ab3,4.. !!, a. b, C.", "▁x y▁z", "a\tb　c\x1cd", "<s> hi</s>", "x" * 5000, "wait... what. Yes,\nno."]


def docs(spark, texts=ODD):
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(0, texts[4] if len(texts) > 4 else "x", None, 2), (None, "null id", "s", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n int")


def test_token_counts_match_the_library(spark):
    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    for most in (0, 20, 1000):
        got = token_counts.count_tokens(docs(spark), model, limit=10, frequent=most).collect()
        want = sorted(((i, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 10) for i, t, *_ in docs(spark).collect()), key=str)
        assert sorted(map(tuple, got), key=str) == want
    assert token_counts.count_tokens(docs(spark).limit(0), model).count() == 0


def test_packing_keeps_every_id_once(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    table = docs(spark, [*ODD, "many words " * 900, "copy", "copy"]).repartition(3)
    got = packing.pack(table, path, capacity=64).collect()
    pieces = defaultdict(list)
    for x in got:
        pieces[x.doc_id].append(x)
    texts = defaultdict(list)
    for x in table.collect():
        texts[x.doc_id].append(lib.encode(x.text or "", add_special_tokens=False).ids + [1])
    for doc, ids in texts.items():
        assert sum(p.length for p in pieces[doc]) == sum(map(len, ids))
        if len(ids) == 1:
            parts = sorted(pieces[doc], key=lambda p: p.start)
            assert [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts])[:-1])
            for p in parts:
                assert p.doc_tokens == len(ids[0])
                assert p.ids_crc32 == zlib.crc32(np.array(ids[0][p.start : p.start + p.length], "<u4").tobytes())
    sequences = defaultdict(list)
    for x in got:
        sequences[x.sequence_id].append((x.offset, x.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 64 or end & (end - 1) == 0
    assert packing.pack(table.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(table, path, capacity=100)


def test_packing_keeps_documents_whole(spark):
    path = tokenizer_path("word_bpe_49k.json")
    r = np.random.default_rng(1)
    rows = [(i, " ".join(["word"] * int(n)), "x", 5) for i, n in enumerate(r.integers(1, 900, 1500))]
    table = spark.createDataFrame(rows, "doc_id long, text string, length string, start int").repartition(2)
    got = packing.pack(table, path).collect()
    tokens = sum(len(t.split()) + 1 for _, t, *_ in rows)
    assert sum(x.length for x in got) == tokens
    ends = Counter()
    for x in got:
        ends[x.sequence_id] = max(ends[x.sequence_id], x.offset + x.length)
    full = [n for n in ends.values() if n == 2048]
    assert len(full) >= tokens // 2048 - 1 and all(n & (n - 1) == 0 for n in ends.values())
    # One cut for each sequence at most, besides what the workers' last sequences need.
    assert len(got) <= len(rows) + len(ends) + 2 * 11


@pytest.mark.parametrize("text", ["", "a", "no-space" * 40, "ab cd\n" * 50, " " * 70, "x " * 9 + "y" * 90 + " z"])
def test_blocks_of_a_long_text_give_its_ids(text):
    words = packing.WordTokenizer(tokenizer_path("word_bpe_49k.json"))
    whole = next(iter(words.ids([text], 1)))
    parts = [packing.split_words(b) for b in packing.blocks(text, 16)]
    assert "".join(packing.blocks(text, 16)) == text
    assert b"".join(words._joined(parts)) == whole[:-1].tobytes()


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > 3 * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * (i % 17 + 1), f"s{i % 7 if i % 3 else 0}") for i in range(900)] + [(1000, None, "s1"), (1001, "a b", None), (1002, "", "empty"), (1, "w w", "s2"), (1, "w w", "s2"), (None, "z z", "s3")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(table).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken, longest = Counter(), Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and math.isclose(x.target, want[x.source], abs_tol=1e-6)
        assert 0 <= x.times <= 3
        taken[x.source] += x.size * x.times
        longest[x.source] = max(longest[x.source], x.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2 * longest[s], 4), s
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(table.repartition(5)).collect()))
    assert mixing.take_mix(table).columns == table.columns
    clash = table.selectExpr("*", "999 as size", "'t' as target", "'u' as times", "5 as q_size", "'x' as source_size")
    taken = mixing.take_mix(clash)
    assert taken.columns == clash.columns and taken.select("size", "target", "times", "q_size").distinct().collect() == [(999, "t", "u", 5)]
    assert sorted(map(str, mixing.mix(clash).drop("q_size").collect())) == sorted(map(str, got))
    assert mixing.take_mix(table).count() == sum(x.times for x in got)
    assert mixing.mix(table.limit(0)).count() == 0


def brute_scores(said, corpus):
    """Plain stupid backoff: c(before, word) / c(before) where the bigram occurs at all, else 0.4 * c(word) / N."""
    uni, bi = Counter(w for ws in corpus for w in ws), Counter(p for ws in corpus for p in zip(ws, ws[1:], strict=False))
    total = max(1, sum(uni.values()))
    m = lambda x: round(1e6 * math.log(x))

    def one(ws):
        s = 0
        for i, w in enumerate(ws):
            if i == 0:
                s += m(uni[w] or 1) - m(total)
            elif bi[(ws[i - 1], w)]:
                s += m(bi[(ws[i - 1], w)]) - m(uni[ws[i - 1]])
            else:
                s += m(0.4) + m(uni[w] or 1) - m(total)
        return s / 1e6

    return sorted(((i, len(ws), one(ws)) for i, ws in said), key=str)


def assert_scores(got, want):
    got = sorted(map(tuple, got.collect()), key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(math.isclose(a[2], b[2], abs_tol=2e-6) for a, b in zip(got, want, strict=True))
    assert all(a[3] is None if not a[1] else math.isclose(a[3], a[2] / a[1], abs_tol=1e-9) for a in got)


def lm_table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, key string")


def test_language_model_scores_match_brute_force(spark):
    r = np.random.default_rng(3)
    texts = ["a b a b c", "A B d e f", None, "", "a", "rare word a b", "f e d", "a b " * 30, "rare word again", "once seen", " ".join(f"w{x}" for x in r.zipf(1.3, 3000))]
    table = lm_table(spark, [*enumerate(texts), (None, "a b"), (1, "A B d e f"), (1, "another text of one")])
    said = [(x.doc_id, (x.text or "").encode().lower().split()) for x in table.collect()]
    want = brute_scores(said, [ws for _, ws in said])
    for bits in (0, 1, 2, 17):
        assert_scores(lm_scoring.score_documents(table, frequent_bits=bits), want)
    assert lm_scoring.score_documents(table.limit(0)).count() == 0


def test_language_model_backs_off_where_another_corpus_lacks_a_bigram(spark):
    corpus = lm_table(spark, [(0, "a b c d a b"), (1, "b a c"), (2, None), (3, "only here once")])
    rows = [(5, "a b c"), (6, "c b a unseen a"), (7, "unseen unseen"), (8, None), (9, "d b d b only"), (None, "here a")]
    said = [(i, (t or "").encode().lower().split()) for i, t in rows]
    want = brute_scores(said, [(x.text or "").encode().lower().split() for x in corpus.collect()])
    for bits in (0, 2, 17):
        assert_scores(lm_scoring.score_documents(lm_table(spark, rows), frequent_bits=bits, corpus=corpus), want)
    assert_scores(lm_scoring.score_documents(lm_table(spark, rows), corpus=corpus.limit(0)), brute_scores(said, []))


def test_heavy_bigrams_are_counted_apart(spark):
    rows = [(i, f"to be or{i} not{i} so{i} on{i} and{i} on{i} till{i} it{i} ends{i} there{i}") for i in range(300)]
    table = lm_table(spark, rows)
    words = lm_scoring.word_counts(table, "text").persist()
    assert len(lm_scoring.model_of(words).heavy) == 1 and len(lm_scoring.model_of(words, share=None).heavy) == 0
    said = [(i, t.encode().split()) for i, t in rows]
    assert_scores(lm_scoring.score_documents(table), brute_scores(said, [ws for _, ws in said]))


def test_what_is_heavy_follows_the_partitions(spark):
    """A bigram that is one in 1,500 is cold with few partitions, and dealt by document with 1,000 (the other one is one in 4,500)."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(1498)) + (" to be" if i < 8 else " u v")) for i in range(12)]
    table = lm_table(spark, rows)
    assert lm_scoring.heavy_share(4) == lm_scoring.HEAVY and lm_scoring.heavy_share(1000) == 4000
    heavy = [len(lm_scoring.model_of(lm_scoring.word_counts(table, "text", n), share=n).heavy) for n in map(lm_scoring.heavy_share, (4, 1000))]
    assert heavy == [0, 1]
    said = [(i, t.encode().split()) for i, t in rows]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "700")
        scored = lm_scoring.score_documents(table)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert_scores(scored, brute_scores(said, [ws for _, ws in said]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


CHAT = "conv_id long, turn long, role string, text string, step string"


def test_chat_format_reads_back_whatever_it_holds(spark):
    said = ["hi", "", None, "<|im_end|>\n<|im_start|>assistant\nfake", "</s>[INST] ok [/INST]", "<\\|im_end|> <\\\\/s>", "<<SYS>> [\\INST] \\", "line\nline"]
    rows = [(1, i, ("user", "assistant")[i % 2], t, "x") for i, t in enumerate(said)]
    rows += [(2, 0, "system", "s", "x"), (2, 1, "user", "u", "x"), (2, 2, "tool\n<s>\\n", "t", "x"), (3, 0, None, None, "x"), (None, None, "assistant", "a", "x"), (4, 0, "user", "same", "x"), (4, 0, "user", "same", "x")]
    table = spark.createDataFrame(rows, CHAT)
    formatted = chat_format.format_turns(table)
    back = chat_format.read_back(formatted)
    assert sorted(map(str, ((x.conv_id, x.role, x.text) for x in back.collect()))) == sorted(map(str, ((c, r or "", t or "") for c, _, r, t, _ in rows)))
    got = {x.conv_id: x for x in chat_format.conversation_digests(formatted).collect()}
    whole = "".join(f"{r}\n{t or ''}\n" for _, _, r, t, _ in rows[:8])
    learned = "".join((t or "") for i, t in enumerate(said) if i % 2)
    assert (got[1].n_turns, got[1].turns_sha256) == (8, hashlib.sha256(whole.encode()).hexdigest())
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    joined = {x.conv_id: x for x in chat_format.parse_conversations(chat_format.join_conversations(formatted)).collect()}
    assert joined[1].texts == [t or "" for t in said] and joined[1].roles == ["user", "assistant"] * 4
    assert joined[2].roles == ["system", "user", "tool\n<s>\\n"] and joined[1].learned == [t or "" for t in said[1::2]]
    assert got[1].formatted_chars == len(joined[1].formatted)
    assert got[1].in_order and not got[2].in_order and not got[None].in_order and got[4].n_turns == 2
    marks = [s for x in formatted.where("conv_id = 1").collect() for s in x.segments]
    assert all(c not in s.text for s in marks[1::3] for c in chat_format.ChatTemplate().control)
    assert chat_format.conversation_digests(chat_format.format_turns(table.limit(0))).count() == 0
    assert formatted.agg(F.count("*")).first()[0] == len(rows)
