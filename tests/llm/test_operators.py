"""The dealt operators against brute force on small tables with awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from kinweave.llm import chat_format, embedding_neardup, exact_dedup, language_id, mixing, ngram_join, ppm, sentencepiece_codec, sharding, suffix_dedup
from kinweave.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rate double, _kw_other string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def make_text(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [make_text(rng, n) for n in (60, 80, 40, 300)]
    out = [base[0], base[0], base[0].upper(), base[1] + " tail words here", base[1], base[2] + " " + base[1][:200], "", None, "  \t ", "one", "One", "a b c d", "a b c d", base[3], base[3] + " x", "ÄÖ ä"]
    words = base[0].split()
    for k in range(12):
        w = list(words)
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"new{k}"
        out.append(" ".join(w))
    out += [make_text(rng, rng.randint(1, 50)) for _ in range(15)] + ["z" * 400, "z" * 150 + "y" + "z" * 120]
    langs = ["en", "de", None]
    return [(i, t, langs[i % 3], f"s{i % 4}" if i % 9 else None, len(t or ""), 1.5, "x") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return (t or "").translate(UPPER)


def tokens(t):
    out, word = [], ""
    for c in norm(t):
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, word] if word else out


def reachable(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = reachable({x for e in edges for x in e}, edges)
    assert {k: v for k, v in want.items() if k != v} == got


def test_sharding(spark, docs, rows, empty):
    got = sharding.shard_documents(docs, 7).collect()
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    by = Counter(r["shard"] for r in got)
    assert max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r.slot for r in got if r["shard"] == s) == list(range(k)) for s, k in by.items())
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r["size"] == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.grown_shard is None for r in got)
    places = spark.createDataFrame([(r["shard"], r.slot, r.row_number) for r in got], "shard int, slot long, was long")
    back = sharding.locate(places, len(rows), 7, 20240117).collect()
    assert all(r.was == r.row_number for r in back) and len(back) == len(rows)
    assert sharding.shard_documents(empty).count() == 0
    for n in (1, 2, 5, 37, 1000):
        ids = sharding.permute(spark.range(n), "id", n, 5)
        assert sorted(r.id for r in ids.collect()) == list(range(n))


def test_mixing(docs, rows, empty):
    got = Counter((r.doc_id, r.n_copies) for r in mixing.mix(docs.drop("n_chars"), weights={"s1": 3.0, "s2": 1.0}, growth=8.0).collect())
    sizes = Counter(r[3] for r in rows)
    want = {}
    for i, _, _, source, *_ in rows:
        rate = {"s1": 3.0, "s2": 1.0}.get(source, 0.0) * (8.0 * len(rows) / 4.0) / sizes[source]
        parts = max(1, math.ceil(rate / 16.0))
        n = 0
        for j in range(1, parts + 1):
            u = (int(hashlib.md5(f"7u|{i}|{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = c = math.exp(-rate / parts)
            k = 0
            while c < u and k < 110:
                k += 1
                p *= rate / parts / k
                c += p
            n += k
        if n:
            want[i, n] = n
    assert got == want and max(want.values()) > 16
    assert mixing.mix(empty).count() == 0
    keys = [r.shuffle_key for r in mixing.mix(docs).collect()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("digits", [64, 0])
def test_exact_dedup(docs, rows, empty, digits):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.deduplicate(docs, digits, files_per_batch=1).collect()}
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    for g, ids in groups.items():
        for i in ids:
            assert got[i] == (max(ids), len(ids), i == max(ids), hashlib.sha256(g.encode()).hexdigest())
    if digits:
        assert exact_dedup.dedup_query(empty).count() == 0
        kept = exact_dedup.keep_documents(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(v) for v in groups.values())


def test_exact_dedup_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None), (2, "")], "doc_id long, text string")
    got = exact_dedup.dedup_query(df).collect()
    assert sum(r.kept for r in got) == 2 and {r.group_size for r in got} == {2, 3}


def test_ngram_join(docs, rows, empty):
    sets = {}
    for i, t, *_ in rows:
        w = tokens(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = {i: (len(sets[i]), c) for i, c in reachable(sets, links).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()}
    assert got == want and len(links) > 10
    assert ngram_join.join(empty).count() == 0


def test_tree_join_is_exact():
    rng = random.Random(5)
    hub = np.array(sorted(rng.sample(range(400), 60)), np.uint64)
    sets = []
    for _ in range(200):
        s = set(hub.tolist())
        for _ in range(rng.randint(0, 14)):
            s.discard(rng.choice(sorted(s)))
            if rng.random() < 0.5:
                s.add(rng.randrange(400))
        sets.append(np.array(sorted(s), np.uint64))
    got = ngram_join.tree_join(hub, sets)
    for g, s in zip(got, sets, strict=True):
        both = len(set(s.tolist()) & set(hub.tolist()))
        assert g == (100 * both >= 80 * (len(s) + len(hub) - both))


@pytest.mark.parametrize("shard", [20_000, 4])
def test_suffix_dedup(docs, rows, empty, shard):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_query(docs, shard).collect()}
    seen = set()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            gone[k : k + 100] |= w in seen
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert got[i] == (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()), i
    if shard > 4:
        assert suffix_dedup.dedup_query(empty).count() == 0


def test_embedding_neardup(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    vectors = [b + 0.15 * rng.normal(size=16) * rng.random() for b in base for _ in range(6)]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    data += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, data[0][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_neardup.near_duplicates(df).collect()}
    fine = {i: np.array(v) for i, v in data if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    cos = lambda a, b: float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))
    links = [(a, b) for a in fine for b in fine if a < b and len(fine[a]) == len(fine[b]) and cos(fine[a], fine[b]) >= 0.9]
    label = reachable([i for i, _ in data], links)
    n = Counter(x for e in links for x in e)
    assert got == {i: (n[i], c, i == c) for i, c in label.items()}
    assert embedding_neardup.near_duplicates(df.limit(0)).count() == 0


def test_ppm(docs, rows, empty):
    got = {r.doc_id: r for r in ppm.score_query(docs).collect()}
    train = [t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in tokens(t))
    counts["<end>"] = len(train)
    n, v = sum(counts.values()), len(counts)
    for i, t, *_ in rows:
        own = [*tokens(t), "<end>"]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0 and r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    assert ppm.score_query(empty).count() == 0


def test_ppm_rare_words_are_joined(docs, monkeypatch):
    whole = {r.doc_id: r.base_score for r in ppm.score_query(docs).collect()}
    monkeypatch.setattr(ppm, "MAX_WORDS", 3)
    few = {r.doc_id: r.base_score for r in ppm.score_query(docs).collect()}
    assert few == pytest.approx(whole)


def test_ppm_rare_ngrams_are_joined(docs, rows, monkeypatch):
    train = [(t or "").translate(UPPER).encode() for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    off = np.cumsum([0, *map(len, train)])
    trie = ppm.Trie(*ppm.tally(ppm.packed(np.frombuffer(b"".join(train), np.uint8), off)[0]))
    want = {}
    for i, t, *_ in rows:
        text = np.frombuffer((t or "").translate(UPPER).encode(), np.uint8)
        want[i] = trie.log10(ppm.packed(text, np.array([0, len(text)]))[0]).sum()
    for most in (ppm.MAX_GRAMS, 40, 0):
        monkeypatch.setattr(ppm, "MAX_GRAMS", most)
        assert {r.doc_id: r.score for r in ppm.score_query(docs).collect()} == pytest.approx(want)


def test_ppm_is_a_distribution():
    text = np.frombuffer(b"abracadabra abra", np.uint8)
    trie = ppm.Trie(*ppm.tally(ppm.packed(text, np.array([0, 5, 16]), 3)[0]), order=3)
    for context in (b"abr", b"zzz", b"xab", b"\xff\xff\xff", b"ra "):
        head = int.from_bytes(context, "big") << 8
        keys = np.array([head | s for s in range(ppm.SYMBOLS)], np.uint64)
        assert (10 ** trie.log10(keys)).sum() == pytest.approx(1)
    assert ppm.adaptive_log10(b"abababababababab") > ppm.adaptive_log10(b"qwertyuiopasdfgh")


def test_language_id(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    told = [r for r in got if r.lang_pred != "und"]
    assert len(told) > 100 and sum(r.lang_pred == r.lang for r in told) / len(told) > 0.95
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 ...", "en"), (3, "the the", "en"), (3, "und der die", "de"), (None, "漢字", None)], "doc_id long, text string, lang string")
    kinds = {(r.doc_id, r.lang_pred) for r in language_id.identify(odd).collect()}
    assert (1, "und") in kinds and (2, "und") in kinds and (None, "und") not in kinds
    assert language_id.keep_documents(df.withColumn("score", df.doc_id)).columns == [*df.columns, "score"]


def test_sentencepiece(spark, docs, rows, empty):
    import sentencepiece

    model = sentencepiece_codec.MODEL
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    codec = sentencepiece_codec.Codec(open(model, "rb").read())
    odd = ["Hello  world\tthe\n été 日本 😀 ▁x", " lead  two", "", "   ", "a" * 50, "aaaa aaaaa   \n zz", " " * 40 + "the", *(r[1] or "" for r in rows)]
    for text, ids in zip(odd, codec.encode(odd), strict=True):
        assert ids.tolist() == library.encode(text)
        assert codec.decode(ids) == text.replace("▁", " ")
    got = sentencepiece_codec.encode_query(docs).collect()
    assert all(r.round_trip for r in got) and len(got) == len(rows)
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs, ["doc_id"]), ["doc_id"]).collect()}
    assert back == {r[0]: r[1] or "" for r in rows}
    assert sentencepiece_codec.encode_query(empty).count() == 0


def best_cost(roles):
    """Cheapest repair by trying every way, step by step."""
    states = {0: 0}
    for r in roles:
        new = {}
        for s, cost in states.items():
            for q in range(1, 4):
                relabel = 0 if q == r else 1 if r == 0 else 4
                for k in range(4):  # inserted turns
                    for path in _paths(s, q, k):
                        new[q] = min(new.get(q, 1 << 30), cost + relabel + 3 * len(path))
                if q == s:
                    new[q] = min(new.get(q, 1 << 30), cost + relabel + 2)
        states = new
    return min(c + 3 * len(chat_format.CLOSING[s]) for s, c in states.items())


def _paths(s, q, k):
    if k == 0:
        return [()] if q in chat_format.OPENS[s] else []
    return [(m, *p) for m in chat_format.OPENS[s] if m > 1 for p in _paths(m, q, k - 1)]


def cost_of(roles, turns):
    total = 0
    for r, (q, merged, inserted) in zip(roles, turns, strict=True):
        total += (0 if q == r else 1 if r == 0 else 4) + 2 * merged + 3 * len(inserted)
    return total + 3 * len(chat_format.CLOSING[turns[-1][0]] if turns else ())


def test_role_repair_is_cheapest():
    rng = random.Random(4)
    for _ in range(300):
        roles = [rng.randrange(4) for _ in range(rng.randint(1, 7))]
        turns = chat_format.solve(roles)
        assert cost_of(roles, turns) == best_cost(roles)


@pytest.mark.parametrize("block", [1024, 3])
def test_chat_format(spark, block):
    rng = random.Random(8)
    names = ["user", "Assistant ", "system", None, "gpt", "robot"]
    data = [(c if c else None, t, rng.choice(names), rng.choice([None, "hi", "a <|x"])) for c in range(8) for t in range(rng.randint(1, 11))]
    df = spark.createDataFrame([*data, data[0]], "conv_id long, turn long, role string, text string").withColumn("row", __import__("pyspark").sql.functions.lit(1))
    got = {}
    for r in sorted(chat_format.format_chats(df, block).collect(), key=lambda r: r.row):
        got.setdefault(r.conv_id, []).append(r)
    for turns in got.values():
        text = "".join(r.rendered for r in turns)
        shown = [p.split("\n")[0] for p in text.split("<|im_start|>")[1:]]
        state = 0
        for q in map(chat_format.STATES.index, shown):
            assert q in chat_format.OPENS[state]
            state = q
        assert state == 3 and text.count("<|im_end|>") == len(shown)
        roles = [chat_format.role_code(r.role) for r in turns]
        found = [(chat_format.STATES.index(r.role_out), "merge" in r.action, (0,) * r.n_inserted) for r in turns]
        assert cost_of(roles, found) == best_cost(roles)
    assert chat_format.format_chats(df.limit(0)).count() == 0
