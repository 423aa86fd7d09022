"""Merge rounds against the library: the same ids, the same texts back."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from plumbline.llm import sentence_pieces
from plumbline.llm.queries import op11_sentence_pieces, tokenizer_path

ALPHABETS = ["ab", " a", "the in ", "abcdefghijklmnopqrstuvwxyz ", "\n\t ab", "éèàüñ日本語中文 的", "01234. ", "ABCabc123+/"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


@pytest.fixture(scope="module")
def p():
    return sentence_pieces.pieces(tokenizer_path())


def same(p, model, texts):
    ids, offsets = sentence_pieces.encode_texts(p, pa.array(texts, pa.large_string()))
    back = sentence_pieces.decode_ids(p, pa.array(p.surfaces, pa.large_binary()), ids, offsets).to_pylist()
    for k, text in enumerate(texts):
        want = model.encode(text or "") + [model.eos_id()]
        assert ids[offsets[k]:offsets[k + 1]].tolist() == want
        assert back[k] == model.decode(want)


def test_awkward_texts(p, model):
    same(p, model, ["", None, " ", "  ", "a", "aaaaaaa", "x" * 20000, "▁▁a ▁", "two  and   three\n\n\t x", "é日本 🎉 \x00",
                    " " * 37 + "a" + " " * 19, "<s></s><unk><0x41>", "﻿​�"])


@pytest.mark.parametrize("long_word", [1, 3, 512])
def test_random_texts(p, model, monkeypatch, long_word):
    """With the bucket form from the second or fourth symbol on, too."""
    monkeypatch.setattr(sentence_pieces, "LONG_WORD", long_word)
    draw = random.Random(long_word)
    for letters in ALPHABETS:
        same(p, model, ["".join(draw.choice(letters) for _ in range(draw.randrange(300))) for _ in range(40)])


def test_long_words(p, model):
    draw = random.Random(5)
    same(p, model, [base64.b64encode(draw.randbytes(30000)).decode(), "".join(draw.choice("etaoinshrdlu") for _ in range(30000))])


def test_any_code_point(p, model):
    draw = random.Random(6)
    same(p, model, ["".join(chr(draw.choice([draw.randrange(0xD800), draw.randrange(0xE000, 0x110000)])) for _ in range(99)) for _ in range(20)])


def test_decoding_of_any_ids(p, model):
    draw, surfaces = random.Random(7), pa.array(p.surfaces, pa.large_binary())
    for _ in range(300):
        ids = np.array([draw.choice([draw.randrange(32000), draw.randrange(270)]) for _ in range(draw.randrange(12))], np.int32)
        assert sentence_pieces.decode_ids(p, surfaces, ids, np.array([0, len(ids)])).to_pylist() == [model.decode(ids.tolist())]


def test_frames(spark, awkward, nothing, model):
    rows = sentence_pieces.decode(sentence_pieces.encode(awkward, tokenizer_path()), tokenizer_path()).collect()
    wanted = sorted((repr(x.doc_id), model.encode(x.text or "") + [2]) for x in awkward.collect())
    assert sorted((repr(x.doc_id), list(x.ids)) for x in rows) == wanted
    assert all(x.text == model.decode(list(x.ids)) for x in rows)
    assert sentence_pieces.digests(nothing, tokenizer_path()).count() == 0
    empty = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert {x.text for x in sentence_pieces.decode(empty, tokenizer_path()).collect()} == {""}


def test_query_on_whole_table(spark, model):
    folder = "/root/testdata/sf0.001"
    got = {x.doc_id: x for x in op11_sentence_pieces(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = model.encode(doc.text or "") + [2]
        row = got[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
