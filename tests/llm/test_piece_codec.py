"""Encoding and decoding against the library, on random and whole texts."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from trowel.llm import piece_codec  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
with open(PATH, "rb") as f:
    CODEC = piece_codec.PieceCodec(f.read())

TEXT = st.one_of(st.text(max_size=40), st.text(alphabet="aeinrst  \n", max_size=60), st.text(alphabet=" ▁\n\tx\xa0", max_size=20), st.lists(st.sampled_from(sorted(CODEC.id)), max_size=6).map(lambda p: "".join(p).replace("▁", " ")))


@settings(max_examples=1500, deadline=None)
@given(TEXT)
def test_equals_the_library(text):
    ids = LIBRARY.encode(text)
    joined, decoded = CODEC.encode_text(text)
    assert joined == ",".join(map(str, ids)) and decoded == CODEC.decode(ids) == LIBRARY.decode(ids)


def test_rows(spark):
    texts = [None, "", "  two  spaces ", "x" * 20000, "line\n\nline", "日本語 und ▁ mark"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in piece_codec.encode_texts(df, PATH, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = LIBRARY.encode(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == LIBRARY.decode(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert piece_codec.encode_texts(df.limit(0), PATH).count() == 0


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHE", 50)
    with open(PATH, "rb") as f:
        codec = piece_codec.PieceCodec(f.read())
    text = " ".join(f"word{i % 90}" for i in range(1000))
    assert codec.encode(text) == LIBRARY.encode(text) and len(codec.segments) <= 50 and len(codec.segments.older) <= 50
