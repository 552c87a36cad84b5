"""Nulls, repeats, extremes and clashing names, operator by operator; each case has a defined result."""

import hashlib
import math
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from kinweave.llm import chat_format, embedding_neardup, exact_dedup, language_id, mixing, ppm, sharding, suffix_dedup

LONG = "Über den Wolken muss die Freiheit wohl grenzenlos sein " * 4000
ROWS = [
    (None, "same words here", "en", None), (None, None, None, None), (4, "same words here", "en", "a"), (4, "SAME words here", "en", "a"),
    (4, "other", "de", "b"), (7, "", None, "b"), (8, LONG, "de", "b"), (9, LONG + "!", "de", "a"), (10, "❤️", "en", "a"), (11, "1️⃣ 2", "en", "a"), (12, "́", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(2)


def test_language_id(spark, docs):
    train = [(i, t, k, None) for i, (t, k) in enumerate([("the cat sat on the mat", "en"), ("der Hund und die Katze", "de")] * 30, 100)]
    odd = [(50, "漢字かな", None, None), (51, "Привет мир", None, None), (52, "the '' mat", None, None), (53, "'''", None, None)]
    df = spark.createDataFrame([*ROWS, *train, *odd], docs.schema).withColumns({"lang_pred": F.lit(1), "score": F.lit("x"), "_p": F.lit(2)})
    got = language_id.identify(df).collect()
    assert len(got) == df.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    for k in (10, 11, 12, 7, 53):
        assert by[k] == [("und", 0.0)]
    assert sorted(x for x, _ in by[None]) == ["en", "und"]
    assert by[8][0][0] == by[9][0][0] == "de" and by[52][0][0] == "en"
    for k in (50, 51):  # letters of a script not learned: the language with most words, an even score
        assert by[k] == [("de" if by[k][0][0] == "de" else "en", pytest.approx(0.5))]
    kept = language_id.keep_documents(df)
    assert kept.columns == df.columns and {8, 9} <= {r.doc_id for r in kept.collect()}
    assert language_id.identify(df.limit(0)).count() == 0 and language_id.keep_documents(df.limit(0)).count() == 0
    nothing = language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_embedding_magnitudes_and_ids(spark, monkeypatch):
    monkeypatch.setattr(embedding_neardup, "STRIPE_ROWS", 4)
    monkeypatch.setattr(embedding_neardup, "LEAST_STRIPES", 9)
    ring = [(i, [math.cos(i / 20), math.sin(i / 20), 0.3]) for i in range(120)]
    odd = [
        (1000, [1e-170, 1e-170, 0.0]), (1001, [2e-170, 2e-170, 0.0]), (1002, [1e200, 1e200, 0.0]), (1003, [5e-324, 5e-324, 0.0]), (1004, [1.7e308, 1.7e308, 0.0]),
        (2000, [0.0, 0.0, -1.0]), (2000, [0.0, 0.0, -2.0]), (None, [0.0, 0.0, -1.0]), (None, None), (2001, [1e300, 1e-300, float("inf")]),
    ]
    df = spark.createDataFrame([*ring, *odd], "vec_id long, embedding array<double>").withColumn("stripe", F.lit(1)).withColumn("row", F.lit("x"))
    got = embedding_neardup.near_duplicates(df).collect()
    assert len(got) == len(ring) + len(odd)

    def unit(v):
        most = max(map(abs, v))
        v = [x / most for x in v]
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v]

    fine = {i: unit(v) for i, v in [*ring, *odd[:5]]}
    n = {i: sum(a != i and sum(x * y for x, y in zip(u, w, strict=True)) >= 0.9 for a, w in fine.items()) for i, u in fine.items()}
    for r in got:
        if r.vec_id in fine:
            assert r.n_links == n[r.vec_id] and r.component_id == 0
    assert [(r.n_links, r.component_id) for r in got if r.vec_id == 2000] == [(1, 2000)] * 2
    assert all(r.n_links == 0 for r in got if r.vec_id in (None, 2001))


def test_mixing_keeps_clashing_columns(spark, docs):
    clash = docs.withColumns({"rate": F.lit(99.0), "copy_no": F.lit(7), "n_copies": F.lit("x"), "shuffle_key": F.lit(None).cast("int"), "mix_rate": F.lit("y")})
    got = mixing.mix(clash, growth=3.0)
    assert got.columns == [*clash.columns, "mix_mix_rate", "mix_n_copies", "mix_copy_no", "mix_shuffle_key"]
    rows = got.collect()
    assert {(r.rate, r.copy_no, r.n_copies, r.shuffle_key, r.mix_rate) for r in rows} == {(99.0, 7, "x", None, "y")}
    kept = mixing.mix_documents(clash, growth=3.0)
    assert kept.columns == clash.columns and kept.count() == len(rows)
    assert mixing.mix(clash.limit(0)).count() == 0
    named = Counter(r.source for r in mixing.mix(docs, weights={None: 5.0, "a": 0.0}, rest=1.0, growth=20.0).collect())
    assert named["a"] == 0 and named[None] > named["b"] > 0


def feistel(at, n, seed):
    """The permutation of [0, n) in plain Python."""
    a, b = sharding.domain(n)
    while True:
        left, right = divmod(at, b)
        for r in range(sharding.ROUNDS):
            h = 42
            for raw in (struct.pack("<q", seed), struct.pack("<i", r), struct.pack("<q", right if r % 2 == 0 else left)):
                h = xxhash.xxh64(raw, seed=h).intdigest()
            h -= (h >> 63) << 64
            if r % 2 == 0:
                left = (left + h) % a
            else:
                right = (right + h) % b
        at = left * b + right
        if at < n:
            return at


def test_sharding(spark, docs):
    for n in (1, 2, 7, 90, 1000):
        got = {r.was: r.id for r in sharding.permute(spark.range(n).selectExpr("id", "id AS was"), "id", n, 11).collect()}
        assert got == {i: feistel(i, n, 11) for i in range(n)}
    got = sharding.shard_documents(docs, 3).collect()
    assert len(got) == len(ROWS) and sorted(r.row_number for r in got) == list(range(len(ROWS)))
    assert Counter(r["shard"] for r in got) == Counter(feistel(i, len(ROWS), 20240117) % 3 for i in range(len(ROWS)))
    clash = docs.withColumns({"row_number": F.lit("a"), "shard": F.lit("b"), "slot": F.lit("c"), "_part": F.lit("d"), "_at": F.lit("e"), "_n": F.lit("f")})
    out = sharding.shard_rows(clash, ["doc_id"], 2)
    assert out.columns == [*clash.columns, "shard_row_number", "shard_shard", "shard_slot"]
    assert {(r.row_number, r["shard"], r.slot, r._part, r._at, r._n) for r in out.collect()} == {tuple("abcdef")}


def test_chat_with_very_long_texts(spark):
    text = "word <| " * 300_000
    df = spark.createDataFrame([(1, 1, "user", text), (1, 2, "gpt", text), (2, 1, None, None)], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in chat_format.format_chats(df.withColumn("head", F.lit(1))).collect()}
    assert got[1, 1].rendered == "<|im_start|>user\n" + text.replace("<|", "<\\|")
    assert got[1, 2].rendered == "<|im_end|>\n<|im_start|>assistant\n" + text.replace("<|", "<\\|") + "<|im_end|>\n"
    assert got[2, 1].rendered.startswith("<|im_start|>user\n<|im_end|>\n")


def test_exact_dedup_long_and_clashing(spark, docs):
    got = exact_dedup.dedup_query(docs.withColumns({"key": F.lit(1), "keep": F.lit(2), "n": F.lit(3)})).collect()
    size = Counter((r[1] or "").lower() if (r[1] or "").isascii() else r[1] for r in ROWS)
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len(size)
    assert {r.text_sha256: r.group_size for r in got} == {hashlib.sha256(t.encode()).hexdigest(): n for t, n in ((k if k.isascii() else k.translate({i: i + 32 for i in range(65, 91)}), n) for k, n in size.items())}


def test_ppm_and_suffix_dedup(docs):
    scored = ppm.score_query(docs.withColumn("key", F.lit(1))).collect()
    assert len(scored) == len(ROWS) and all(r.score < 0 and math.isfinite(r.score) for r in scored)
    same = [r.score for r in scored if r.doc_id is None or r.doc_id == 4]
    assert len(same) == 5 and len({round(x, 9) for x in same}) == 3
    cut = suffix_dedup.dedup_query(docs.withColumn("start", F.lit("x"))).collect()
    assert len(cut) == len(ROWS)
    total = {r.doc_id: r.n_removed for r in cut if r.doc_id in (8, 9)}
    raw = len(LONG.encode())
    period = len("Über den Wolken muss die Freiheit wohl grenzenlos sein ".encode())
    assert total == {8: raw - period, 9: raw}
