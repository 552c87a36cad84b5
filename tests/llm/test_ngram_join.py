"""The n-gram join against brute force: crowded prefixes, common passages, awkward rows."""

import random

import pytest

from kinweave.llm import idfilter, ngram_join


def brute(rows):
    """component_id and set size by doc_id, all pairs compared; ids must be unique."""
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label, links, changed = {i: i for i in sets}, [], True
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links.append((a, b))
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}, links


def edited(rng, words, k):
    out = list(words)
    for at in rng.sample(range(len(out)), k):
        out[at] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def crowded():
    """One family of copies at all distances, most too far from each other to link, and copies of copies."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = [edited(rng, base, rng.randint(0, 9)) for _ in range(220)]
    texts += [edited(rng, t.split(), 1) for t in texts[:40]]
    passage = " ".join(f"p{k}" for k in range(30))
    texts += [f"{' '.join(f'u{rng.randrange(10**6)}' for _ in range(rng.randint(1, 60)))} {passage}" for _ in range(300)]
    texts += [passage, passage + " tail", "", None, "one", "One", "a b c d", "a b c d e", " ".join(f"z{k % 7}" for k in range(3000))]
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("many, sets", [(3, 5)])
def test_crowded_prefixes(spark, crowded, monkeypatch, many, sets):
    """Small bounds send common tokens with their block and split every tree; results stay those of brute force."""
    monkeypatch.setattr(ngram_join, "TRIE_SETS", sets)
    want, links = brute(crowded)
    assert len(links) > 1000 and len({c for _, c in want.values()}) > 300
    docs = spark.createDataFrame(crowded, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, many, 100).collect()} == want


def test_family_too_far_apart_is_not_listed(spark, monkeypatch):
    """Rows that the pair join makes grow with the sets, not with their square."""
    rng, seen = random.Random(5), {}
    base = [f"w{k}" for k in range(400)]
    written = ngram_join.materialise

    def watch(df, name):
        out = written(df, name)
        if name == "listed":
            seen["listed"] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialise", watch)
    for n in (100, 400):
        rows = [(i, edited(rng, base, rng.randint(6, 30))) for i in range(n)]
        ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).count()
        assert seen["listed"] <= 4 * n


def test_awkward_rows(spark):
    """Null and repeated ids, equal rows, other columns with internal names, a table without rows."""
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text, 1), (5, text, 2), (5, text + " x", 3), (5, "quite another text of its own", 4), (9, text, 5), (9, text, 5), (3, None, 6), (2, " \t", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long").withColumn("token", ngram_join.F.lit("t"))
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.join(df).collect())
    assert got == sorted([(0, 36, None), (5, 36, 5), (5, 37, 5), (5, 2, 5), (9, 36, 5), (9, 36, 5), (3, 0, 3), (2, 0, 2)])
    kept = ngram_join.keep_documents(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 5, 5, 5]
    assert ngram_join.join(df.limit(0)).count() == 0 and ngram_join.keep_documents(df.limit(0)).count() == 0


def test_long_text(spark):
    rng = random.Random(2)
    long = " ".join(f"v{rng.randrange(10**5)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, long[: len(long) // 2])]
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_filter_passes_members(spark):
    import numpy as np

    ids = spark.range(1000).selectExpr("id * 7919 AS x")
    bitmap = idfilter.build(ids, 1 << 14)
    assert idfilter.member(bitmap, np.arange(1000) * 7919).all()
    assert idfilter.member(bitmap, np.arange(10**6, 10**6 + 5000) * 7919 + 1).mean() < 0.2


def test_listed_pairs_carry_no_shingles(spark, monkeypatch):
    """Long texts just below the threshold are listed in the second phase; nothing there has a row per pair and shared shingle."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    rows = [(i, edited(rng, base, rng.randint(14, 22))) for i in range(1, 25)]
    want, _ = brute(rows)
    plans, listed, verify = [], [], ngram_join.verify

    def watched(pairs, *rest):
        plans.append(pairs._jdf.queryExecution().optimizedPlan().toString())
        listed.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(ngram_join, "verify", watched)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(plans) == 2 and listed[1] > 0
    assert "Join" not in plans[1]  # listed pairs don't meet the shingles again
