"""Counting pairs by partner against one row per block hit."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.operators import blocking, candidates, evaluate, evidence, graph, paircount
from kinweave.operators import rules as R
from kinweave.operators.scoring import LogisticScorer
from kinweave.plans import catalog

_NAMES = ("context__np_geoname_id", "identity_rescue__phone_digits", "behavior__fs_has_click_365", "behavior_context__np_geoname_id__fs_has_click_365",
          "registration_time_window__np_geoname_id__registration_60m", "behavior_context_device__np_subdivision__fs_has_click_365__np_osfamily")
RULES = R.named(f"rule__{x}" for x in _NAMES)
COLUMNS = ["profile_id_l", "profile_id_r", "rules", "families", "scopes", "sum_block_weight", "hits", "min_block_size", "n_small_blocks_le5", "n_strong_family_hits", "n_time_aware_hits"]


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(4)
    rows = []
    for i in range(90):
        p = f"P{i // 3}_{i % 3}"
        rows += [(p, "np", "geoname_id", f"10{rng.randrange(4)}") for _ in range(2)] + [(p, "np", "subdivision_1_iso_code", f"R{i % 2}"), (p, "np", "osfamily", "ios")]
        rows += [(p, "fs", "has_click_365", str(rng.randrange(9))) for _ in range(4)] + [(p, "identity", "phone", f"7900000{i // 6:04d}"), (p, "np", "device", "pc")]
        rows += [(p, "derived", "registration_60m_bucket", f"2024-01-0{1 + rng.randrange(4)} 10:00")]
    rows += [("Q0_0", "np", "geoname_id", "999"), ("no values_0", "np", "browser", "x")]
    return spark.createDataFrame(rows, "profile_id string, source string, feature string, value_norm string").distinct().cache()


def by_hits(values, per_profile):
    rows = blocking.block_rows(values, RULES).cache()
    packet = F.col("profile_id").endswith("_0")
    across = candidates.history_pairs(rows.filter(packet), blocking.limited(rows.filter(~packet)))
    across = candidates.limit_history(across, R.STRONG, per_profile)
    return candidates.internal_pairs(blocking.limited(rows.filter(packet))).unionByName(across), across


@pytest.mark.parametrize("chunk, per_profile", [(2, 3)])
def test_counts_are_those_of_hits(spark, values, monkeypatch, chunk, per_profile):
    monkeypatch.setattr(paircount, "LEAST_CHUNKS", chunk)
    monkeypatch.setattr(paircount, "BATCH", 7)
    packet = F.col("profile_id").endswith("_0")
    events, across = by_hits(values, per_profile)
    show = lambda df: sorted(map(tuple, df.select(*COLUMNS).collect()))
    got = paircount.counted_pairs(values, RULES, packet, per_profile, evidence.value_group()).cache()
    want = show(evidence.pair_counts(events))
    assert len(want) > 200 and show(got) == want
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(got.select(*evidence.PAIR, *evidence.similarities())) == same(evidence.pair_similarity(events, values))
    columns = ["profile_id_l", "profile_id_r", "block_rule", "block_value", "block_size"]
    assert same(paircount.kept_history_events(values, RULES, packet, per_profile).select(*columns)) == same(across.select(*columns))


def test_no_packet_or_history(spark, values):
    for packet in (F.lit(False), F.lit(True)):
        got = paircount.counted_pairs(values, RULES, packet, 300, evidence.value_group())
        assert set(got.select(F.explode("scopes")).distinct().toPandas().iloc[:, 0]) <= {"packet"}
    assert paircount.counted_pairs(values.limit(0), RULES, F.lit(True), 300).count() == 0


@pytest.mark.parametrize("name", ["history_cap_per_profile", "history_cap_global"])
def test_query_joins_no_hits(spark, name):
    """Capped history lists no hit of a pair that is not kept: no join on a block's value."""
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and "block_value" in line for line in plan.splitlines())


@pytest.fixture(scope="module")
def scored(spark, values):
    events, _ = by_hits(values, 3)
    return LogisticScorer().score(evidence.features(events, values)).select(*evidence.PAIR, "score").cache()


def _args(values):
    return values, RULES, F.col("profile_id").endswith("_0"), 3, evidence.value_group(), LogisticScorer()


@pytest.mark.parametrize("doubtful", [False, True])
def test_scores_are_those_of_features(values, scored, monkeypatch, doubtful):
    """All, those from a score on, and those that are best at either end; also where every score is left to Spark to round."""
    monkeypatch.setattr(paircount, "LEAST_CHUNKS", 3)
    monkeypatch.setattr(paircount, "BATCH", 7)
    if doubtful:
        rounded = paircount._rounded
        monkeypatch.setattr(paircount, "_rounded", lambda x: (rounded(x)[0], np.arange(len(x)) % 2 == 0))
    show = lambda df: sorted(map(tuple, df.select(*evidence.PAIR, "score").collect()))
    want = show(scored)
    assert len({x[2] for x in want}) > 20 and show(paircount.scored_pairs(*_args(values))) == want
    least = sorted(x[2] for x in want)[len(want) // 2]
    assert show(paircount.scored_pairs(*_args(values), least=least)) == [x for x in want if x[2] >= least]
    for k in (1, 2):
        best = paircount.scored_pairs(*_args(values), best=k).cache()
        assert show(graph.mutual_top_k(best, least, k)) == show(graph.mutual_top_k(scored, least, k))
        same = lambda df: sorted(map(tuple, graph.best_scores(df).collect()))
        assert same(best) == same(scored)
        if not doubtful:
            assert best.count() <= 4 * k * 92


def test_score_counts(spark, values, scored, monkeypatch):
    monkeypatch.setattr(paircount, "LEAST_CHUNKS", 3)
    owners = values.select("profile_id", F.regexp_extract("profile_id", "^(.*)_", 1).alias("entity_id")).distinct()
    owners = owners.withColumn("entity_id", F.when(F.col("entity_id") != "P3", F.col("entity_id")))
    want = evaluate.with_labels(scored, owners).groupBy("score", "label").count()
    got = paircount.score_counts(*_args(values), owners)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    pairs = evaluate.with_labels(scored, owners)
    for f in (evaluate.roc_auc, evaluate.average_precision, lambda x, n=None: evaluate.confusion(x, 0.2, n=n)):
        assert f(got, n="n").collect() == f(pairs).collect()


def test_rule_pairs(values, monkeypatch):
    """Distinct pairs by rule without listing them: profiles that meet in several blocks count once, clients may be unknown."""
    monkeypatch.setattr(paircount, "LEAST_CHUNKS", 3)
    owners = values.select("profile_id", F.when(~F.col("profile_id").startswith("P3_"), F.regexp_extract("profile_id", "^(.*)_", 1)).alias("entity_id")).distinct()
    hits = candidates.internal_pairs(blocking.blocking_index(values, RULES)).select("block_rule", *evidence.PAIR)
    pairs = hits.distinct()
    assert pairs.count() < hits.count()
    want = evaluate.with_labels(pairs, owners).groupBy("block_rule").agg(F.count("label"), F.sum("label"))
    got = paircount.rule_pairs(values, RULES, owners).select("block_rule", "candidate_pairs", "positive_pairs")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("most", [1000, 5])
def test_hits_from_blocks_are_those_of_the_join(values, monkeypatch, most):
    """Every hit once, in blocks within the limits; packet members beyond a slice too."""
    monkeypatch.setattr(blocking, "LARGEST_BLOCK", most)
    packet, rows = F.col("profile_id").endswith("_0"), blocking.block_rows(values, RULES).cache()
    show = lambda df: sorted(map(tuple, df.withColumn("block_weight", F.round("block_weight", 9)).collect()))
    limited = lambda r: blocking.limited(r, 2, most)
    want = show(candidates.internal_pairs(limited(rows)))
    assert len(want) > 10 and show(candidates.internal_hits(values, RULES)) == want
    want = show(candidates.history_pairs(rows.filter(packet), limited(rows.filter(~packet))))
    assert len(want) > 10 and show(candidates.history_hits(values, RULES, packet)) == want


def test_internal_hits_are_listed_in_pieces(values, monkeypatch):
    """No row of the last stage gives more than LISTED hits, or those of one member, and every hit comes once."""
    want = sorted(map(tuple, candidates.internal_hits(values, RULES).collect()))
    for most in (1, 7, 10**6):
        monkeypatch.setattr(candidates, "LISTED", most)
        blocks = candidates._dealt(values, RULES, m=F.lit(True)).filter("size(m) > 1")
        pieces = candidates._pieces(blocks, "m", F.size("m") - 1, "m")
        assert pieces.filter((F.size("some") > 1) & (F.size("some") * F.size("m") > most)).count() == 0
        assert pieces.filter("size(some) = 0").count() == 0 and (pieces.count() > blocks.count()) == (most < 10**6)
        got = candidates.internal_hits(values, RULES)
        assert len(want) > 10 and sorted(map(tuple, got.collect())) == want
        listed = got._jdf.queryExecution().optimizedPlan().toString().split("explode(some")[1]
        assert "transform(slice(" in listed.split("explode(")[0]  # ends the compiled stage before the explodes that list


def test_history_hits_are_listed_in_pieces(values, monkeypatch):
    """Packet members of a block are listed few at a time, in a stage that begins anew with every piece; every hit comes once."""
    packet = F.col("profile_id").endswith("_0")
    want = sorted(map(tuple, candidates.history_hits(values, RULES, packet).collect()))
    monkeypatch.setattr(candidates, "LISTED", 3)
    got = candidates.history_hits(values, RULES, packet)
    assert len(want) > 10 and sorted(map(tuple, got.collect())) == want
    assert "transform(slice(mine" in got._jdf.queryExecution().optimizedPlan().toString().split("explode(some")[1]


@pytest.mark.parametrize("name", ["pairs_internal", "pairs_history"])
def test_listed_hits_meet_in_no_join(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line for line in plan.splitlines())


def test_members_travel_as_steps(spark, values):
    """Blocks and compared values are written as distances of sorted numbers, which read back as they were."""
    ids = paircount.numbers(values)
    index = paircount.blocks(values, RULES, ids, F.col("profile_id").endswith("_0")).filter("size(h) > 0").toArrow()
    off, items = paircount._stepped(index, "h")
    lists = [items[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]
    assert len(lists) > 20 and all(x == sorted(set(x)) for x in lists)
    assert [x.as_py() for x in index["h"]] == [[b - a for a, b in zip([0, *x[:-1]], x, strict=True)] for x in lists]
    at = {r.profile_id: r.at for r in ids.collect()}
    rows = blocking.block_rows(values, RULES).filter("not endswith(profile_id, '_0')").collect()
    want = {}
    for r in rows:
        want.setdefault((r.block_rule, r.block_value), []).append(at[r.profile_id])
    got = {(RULES[r].name, v): x for r, v, x in zip(index["rule"].to_pylist(), index["value"].to_pylist(), lists, strict=True)}
    assert all(sorted(want[k]) == x for k, x in got.items())


def test_blocks_are_dealt_packed(spark, values, monkeypatch):
    """A chunk gets its blocks in few compressed rows, with its own packet members of each and all others, and not a row a block."""
    monkeypatch.setattr(paircount, "PACKED", 50)
    index = paircount.blocks(values, RULES, paircount.numbers(values), F.col("profile_id").endswith("_0")).select("rule", "block", "mine", "p", "h").toArrow()
    width, want = 23, {}
    for r in index.to_pylist():
        for c in {x // width for x in r["mine"]}:
            want.setdefault(c, []).append((r["rule"], r["block"], [x for x in r["mine"] if x // width == c], r["p"], r["h"]))
    got = {}
    packs = [b for part in index.to_batches(max_chunksize=40) for b in paircount._packs([part], width)]
    for b in packs:
        got.setdefault(b["chunk"][0].as_py(), []).extend(tuple(r.values()) for r in paircount._unpacked(pa.Table.from_batches([b])).to_pylist())
    assert len(want) > 2 and len(packs) < sum(map(len, want.values())) / 3
    show = lambda rows: sorted((*r[:2], sorted(r[2]), *r[3:]) for r in rows)
    assert {c: show(x) for c, x in got.items()} == {c: show(x) for c, x in want.items()}
    many = np.repeat(np.arange(1, 200, dtype=np.int32), 50)
    assert len(paircount._squeezed(many)) < len(many) and (paircount._unsqueezed([paircount._squeezed(many)], [len(many)], np.int32) == many).all()


def test_shared_families_are_those_of_hits(values, monkeypatch):
    """The families of pairs without their counts, where many history pairs tie at the limit."""
    monkeypatch.setattr(paircount, "LEAST_CHUNKS", 3)
    show = lambda df: sorted(map(tuple, df.select(*evidence.PAIR, "families").collect()))
    for per_profile in (2, 5):
        want = show(evidence.pair_counts(by_hits(values, per_profile)[0]))
        assert len(want) > 100 and show(paircount.shared_families(values, RULES, F.col("profile_id").endswith("_0"), per_profile)) == want
