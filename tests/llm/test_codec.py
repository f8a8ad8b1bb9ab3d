"""Encoding and decoding with piece models against the library."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import piece_codec
from quern.llm.queries import op11_piece_codec, tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
ODD = ["", None, " ", "▁", " a  b ", "</s><s> hi <unk>", "<0x0A>\n\x00", "İstanbul ΣΑΣ 梦𝄞é́", "x" * 5000, "ab " * 3000, "▁ ▁▁", "\t\r\n", "￿​  z"]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def words(seed, n):
    draw = random.Random(seed)
    letters = ["abcdefghij  ▁▁\n\t</s>éüß梦𝄞́​﻿Z09\x00\x01", "the of and ", "".join(map(chr, range(0x20, 0x3000)))]
    return ["".join(draw.choices(draw.choice(letters), k=draw.choice([1, 2, 3, 8, 40, 200, 2000]))) for _ in range(n)]


def test_both_agendas_give_the_librarys_ids():
    model, lib = piece_codec.load(MODEL), library()
    for text in [t or "" for t in ODD] + words(1, 400):
        tokens = [t for part in piece_codec.chunks(text, 50) for t in piece_codec._SPLIT.findall(part)]
        assert "".join(tokens)[1:] == text
        want = lib.encode(text)
        for ids in (model.by_columns(tokens), list(map(model.by_heap, tokens))):
            assert [int(i) for t in ids for i in t.split(" ")] == want


def test_any_ids_decode_as_the_library_does():
    model, lib, draw = piece_codec.load(MODEL), library(), random.Random(2)
    for _ in range(3000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(260), draw.randrange(3), 29871]) for _ in range(draw.randrange(9))]
        assert model.decode(list(map(str, ids))) == lib.decode(ids), ids


def test_rows_keep_their_columns_and_match(spark, monkeypatch):
    monkeypatch.setattr(piece_codec, "CHUNK", 3000)
    lib = library()
    rows = [(i, t, "x") for i, t in enumerate([*ODD, *words(3, 60)])] + [(1, "twice", None), (1, "twice", None), (None, "no id", "y")]
    rows = [(*r, n) for n, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_ids string, q_text int").repartition(3)
    got = piece_codec.encode_decode(docs, MODEL).withColumn("numbers", piece_codec.id_array(F.col("ids"))).collect()
    assert len(got) == len(rows) and all(r.agrees for r in got)
    for r in got:
        doc, text, _, _ = rows[r.q_text]
        ids = lib.encode(text or "", add_eos=True)
        assert r.doc_id == doc and r.numbers == ids and r.n_ids == len(ids) and r.decoded == lib.decode(ids)
    assert piece_codec.encode_decode(docs.limit(0), MODEL).count() == 0


def test_a_difference_is_seen():
    known = piece_codec.Remembered(MODEL)
    right = dict(zip(t := [" aa", " bb", " cc"], known.model.encode(t)))
    assert known.compare(right) == set()
    assert known.compare(right | {" bb": "5"}) == {" bb"}


def test_other_models_are_refused(tmp_path):
    with open(MODEL, "rb") as file:
        data = file.read()
    (tmp_path / "other.model").write_bytes(data + b"\x12\x02\x18\x01")
    with pytest.raises(ValueError, match="merge-type"):
        piece_codec.MergeModel(str(tmp_path / "other.model"))


def test_query_over_documents(spark):
    lib = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op11_piece_codec(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest() and r.agrees
