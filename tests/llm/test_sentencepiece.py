"""The SentencePiece codec against the library: short, long, odd and split texts, BPE and unigram."""

import random
import struct

import numpy as np
import pytest
import sentencepiece

from kinweave.llm import sentencepiece_codec as codecs
from kinweave.llm.piece_model import BPE, UNIGRAM
from kinweave.llm.suffix_array import pack, suffix_array

ODD = [
    "a", "", " ", "  ", "\n", "Hello  world\tthe\n été 日本 😀 ▁x", " lead  two", "   ", "a" * 50, "aaaa aaaaa   \n zz", " " * 40 + "the",
    "x" + " " * 37 + "y", "\0", "a\0b", "(word), \"word\"; word...", "❤️ 1️⃣", " nbsp", "http://a.b/c?d=e&f=%20", "漢字かな交じり文", "▁▁▁", "́",
]


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _bytes(number, data):
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def hand_made(pieces, model_type, dummy=True, extra=False, byte_fallback=False):
    """A model file of (piece, score) rows after the unknown piece."""
    out = b""
    rows = [("<unk>", 0.0, 2), *[(p, s, 1) for p, s in pieces]]
    if byte_fallback:
        rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    for piece, score, kind in rows:
        out += _bytes(1, _bytes(1, piece.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _varint(3 << 3) + _varint(kind))
    off = b"".join(_varint(k << 3) + _varint((1 << 64) - 1) for k in (41, 42, 43))  # no <s>, </s>, <pad>
    out += _bytes(2, _varint(3 << 3) + _varint(model_type) + _varint(35 << 3) + _varint(int(byte_fallback)) + _varint(40 << 3) + _varint(0) + off)
    return out + _bytes(3, _bytes(1, b"identity") + b"".join(_varint(n << 3) + _varint(int(v)) for n, v in ((3, dummy), (4, extra), (5, True))))


@pytest.fixture(scope="module")
def model():
    with open(codecs.MODEL, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def test_short_input_of_every_kind(model, library):
    """One text, one unit, one character at a time: no batch may be too short to index."""
    codec = codecs.Codec(model)
    for text in ODD:
        codec.table.clear()
        assert codec.encode([text])[0].tolist() == library.encode(text), repr(text)
        assert codec.decode(codec.encode([text])[0]) == text.replace("▁", " ")
    codec.table.clear()
    for text in ["hello there", "hello cat", "hello", "cat hello x"]:  # one new unit at a time
        assert codec.encode([text])[0].tolist() == library.encode(text)
    assert codec.encode([]) == []


def test_whole_documents(model, library):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    for got, text in zip(codecs.Codec(model).encode(texts), texts, strict=True):
        assert got.tolist() == library.encode(text)


@pytest.mark.parametrize("remembered, window, index", [(1 << 16, 1 << 20, 200_000), (4, 40, 30), (64, 7, 9)])
def test_limits_change_no_token(model, library, monkeypatch, remembered, window, index):
    """Small tables, windows and groups: units are forgotten, texts and units are cut in windows."""
    monkeypatch.setattr(codecs, "INDEX_CHARS", index)
    codec, rng = codecs.Codec(model, remembered, window), random.Random(7)
    words = ["the", "under", "stand", "ing", "zz", "aaaa", "été", "日本", "😀", " ", "  ", "\n", ",", "...", "q" * 30]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += ["".join(rng.choice("abcdeghilnorstu") for _ in range(500)), "a" * 300, " " * 300, *ODD]
    for got, text in zip(codec.encode(texts), texts, strict=True):
        assert got.tolist() == library.encode(text), repr(text)
    flat, at = codec.encode_flat(texts)
    assert codec.round_trips(texts, flat, at).all()


def test_long_runs_take_time_in_proportion(model, library):
    import time

    codec = codecs.Codec(model)
    for text in (" " * 60_000, "a" * 60_000, "".join(random.Random(3).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))):
        begun = time.time()
        got = codec.encode([text])[0]
        assert time.time() - begun < 30
        assert got.tolist() == library.encode(text)


PIECES = [("▁", -2.0), ("a", -3.0), ("b", -3.2), ("c", -4.0), ("▁a", -2.5), ("ab", -2.7), ("abc", -3.9), ("ca", -3.6), ("bca", -5.0), ("▁ab", -4.4), ("▁▁", -4.0), ("c▁", -5.5), ("xy", -3.0)]


@pytest.mark.parametrize("kind", [UNIGRAM, BPE])
@pytest.mark.parametrize("byte_fallback", [False, True])
@pytest.mark.parametrize("extra", [False, True])
def test_hand_made_models(kind, byte_fallback, extra, monkeypatch):
    """Unknown characters in a row, characters inside pieces only, pieces with an inner or last space mark."""
    data = hand_made(PIECES, kind, extra=extra, byte_fallback=byte_fallback)
    library, rng = sentencepiece.SentencePieceProcessor(model_proto=data), random.Random(11)
    texts = ["", "abc", "xy", "x", "yx", "éé", "a éé b", *("".join(rng.choice("aabbcc  xyé") for _ in range(rng.randint(1, 30))) for _ in range(300))]
    for index in (codecs.INDEX_CHARS, 3):
        monkeypatch.setattr(codecs, "INDEX_CHARS", index)
        for got, text in zip(codecs.Codec(data).encode(texts), texts, strict=True):
            assert got.tolist() == library.encode(text), repr(text)


def test_unsupported_models_are_refused():
    with pytest.raises(ValueError, match="map"):
        codecs.Codec(hand_made(PIECES, BPE) + _bytes(3, _bytes(2, b"xx")))


def test_suffix_array_of_short_input():
    for codes in ([], [1], [2, 1], [1, 1, 1]):
        codes = np.array(codes, np.int64)
        assert len(pack(codes, 5, 3)) == len(codes)
        assert suffix_array(codes, 16).tolist() == sorted(range(len(codes)), key=lambda i: codes[i:].tolist())


def test_tables(spark, library):
    """Null and empty texts, one row, repeated rows and ids, clashing column names, a table without rows."""
    schema = "doc_id long, text string, n_tokens string, ids string, n_bytes long"
    rows = [(1, "a", "x", "y", 5), (1, "a", "x", "y", 5), (None, None, None, None, None), (2, "", "", "", 0), (3, "The cat\n sat", "q", "r", 1)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_bytes, r.round_trip) for r in codecs.encode_query(df).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 0, True), (3, len(library.encode(rows[-1][1])), 12, True)]
    assert codecs.encode_query(df.limit(0)).count() == 0
    assert codecs.encode_query(df.filter("text = 'a'").limit(1)).first().n_tokens == 1
    tokens = codecs.encode(df.select("doc_id", "text"), ["doc_id"])
    back = sorted((r.doc_id or 0, r.text) for r in codecs.decode(tokens, ["doc_id"]).collect())
    assert back == [(0, ""), (1, "a"), (1, "a"), (2, ""), (3, "The cat\n sat")]
    with pytest.raises(ValueError, match="n_tokens"):
        codecs.encode(df, ["doc_id", "n_tokens"])
