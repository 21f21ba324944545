"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from framepair.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.public_model()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_file=model)


@pytest.fixture(scope="module")
def own(model):
    return pieces.load(model)


def ids(own, text):
    return np.frombuffer(pieces.Encoder(own).encode(text), "<u4").tolist()


CASES = [
    "", " ", "  ", " " * 13, " " * 14, " " * 15, " " * 29, " " * 1000, "a", " a", "a  b   c", "\n\n a\tb\r\n", "▁", "a▁▁b", "ﬁ ① Å",
    "\x00\x01", "\U0001f600 ok \U0001f468‍\U0001f469", "<s> </s> <unk> <0x41>", "x" * 5000, "ab" * 3000, "the" * 2000, "中文" * 500,
    "supercalifragilistic" * 50, "   the   the", "﻿a​", "é" * 20, "...---...", "1234567890" * 30,
]


def same(own, library, text):
    want = library.encode(text, add_bos=True, add_eos=True)
    assert ids(own, text) == want
    assert own.decode(want) == library.decode(want)


@pytest.mark.parametrize("text", CASES)
def test_chosen_texts(own, library, text):
    same(own, library, text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\nabcdehinorst.éü中\U0001f600"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(own, library, text):
    same(own, library, text)


def test_joined_pieces(own, library):
    r = random.Random(3)
    known = list(own.of_text)
    for _ in range(3000):
        same(own, library, "".join(r.choice(known) for _ in range(r.randint(1, 6))))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=12))
def test_decoding_any_ids(own, library, some):
    assert own.decode(some) == library.decode(some)


def test_every_piece_has_its_merge(own):
    assert all(i in own.left for i, n in own.size.items() if n > 1)


def test_query(spark, frame, library, model):
    rows = [(1, "Some text  of words"), (1, "Some text  of words"), (None, None), (2, ""), (3, "long " * 40000), (4, "é" * 300)]
    docs = frame(rows).withColumnRenamed("kept", "IDS")
    done = pieces.decode_ids(pieces.encode_texts(docs, model), model, "_ids")
    assert done.columns == ["doc_id", "text", "IDS", "_ids", "decoded"]
    got = {(r.doc_id, r.text): r for r in done.collect()}
    for i, t in rows:
        want = library.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got[i, t]._ids, "<u4").tolist() == want and got[i, t].decoded == library.decode(want)
    assert pieces.encode_texts(frame([]), model).count() == 0


def test_whole_table(spark, library):
    from framepair.llm.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in QUERIES["op12_piece_codec"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        want = library.encode(d.text or "", add_bos=True, add_eos=True)
        r = found[d.doc_id]
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
