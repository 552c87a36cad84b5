"""Running sums, chi-square tails, guardrails, profile rows, universes and training grids on hand-written rows."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kinweave.operators import evaluate, evidence, mart, prefix, stats, training
from kinweave.operators.scoring import LogisticScorer
from kinweave.plans import studies


def test_running_sums(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(50), rng.randrange(9)) for _ in range(400)]
    rows = [(k, i, v) for i, (k, v) in enumerate(rows)]
    out = prefix.running_sums(spark.createDataFrame(rows, "k int, i int, v int"), ["k", "i"], ["v"]).collect()
    total, want = 0, {}
    for k, i, v in sorted(rows):
        total += v
        want[(k, i)] = total
    assert {(r.k, r.i): r.v_upto for r in out} == want
    numbers = prefix.numbered(spark.createDataFrame(rows, "k int, i int, v int"), ["k", "i"], "at").collect()
    assert [(r.k, r.i) for r in sorted(numbers, key=lambda r: r["at"])] == sorted((k, i) for k, i, _ in rows)
    assert sorted(r["at"] for r in numbers) == list(range(400))
    assert prefix.running_sums(spark.createDataFrame([], "k int, v int"), ["k"], ["v"]).count() == 0


def test_ranking_metrics(spark):
    rng = random.Random(6)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(auc, abs=1e-6)
    ap = sum(sum(y for s, y in rows if s == p) / len(pos) * sum(y for s, y in rows if s >= p) / sum(s >= p for s, _ in rows) for p in set(pos))
    assert evaluate.average_precision(df).first()[0] == pytest.approx(ap, abs=1e-6)


@pytest.mark.parametrize(("x", "dof", "want"), [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (35.172462, 23, 0.05), (16.811894, 6, 0.01), (0.0, 4, 1.0)])
def test_chi_square_tail(x, dof, want):
    assert stats.chi_square_tail(x, dof) == pytest.approx(want, abs=1e-6)


def test_chi_square_corrected(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 15
    got = stats.chi_square_test(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    expected = {("a", "x"): 30 * 40 / 75, ("a", "y"): 30 * 35 / 75, ("b", "x"): 45 * 40 / 75, ("b", "y"): 45 * 35 / 75}
    chi2 = sum((abs(rows.count(c) - e) - 0.5) ** 2 / e for c, e in expected.items())
    assert got.dof == 1 and got.chi2 == pytest.approx(chi2, abs=1e-5)
    assert got.p_value == pytest.approx(math.erfc(math.sqrt(chi2 / 2)), abs=1e-5)


def test_guardrails(spark):
    points = [("m", 1, 0.2, 90.0, 80.0), ("m", 1, 0.5, 70.0, 91.0), ("t", 0, 0.5, 70.0, 92.0), ("t", 0, 0.9, 40.0, 94.0)]
    df = spark.createDataFrame(points, "strategy string, k int, threshold double, existing_found_pct double, new_correct_pct double")
    got = {r.guardrail_pct: (r.strategy, r.threshold) for r in evaluate.guardrails(df).collect()}
    assert got == {85: ("t", 0.5), 90: ("t", 0.5)}  # no point reaches 95


def _events(spark):
    at = datetime(2024, 1, 1)
    rows = [
        (1, "p", "E1", at, "a@x.ru", None, "male", ["device:pc", "device:phone", "browser:b"], '{"geoname": "C", "local_hour": 3}', ["is_man", None]),
        (2, "p", "E2", at, "A@y.ru", "nan", "None", None, "broken", []),
        (3, "p", "E2", at, None, "7", None, [], '{"geoname": "D", "local_hour": "x"}', None),
        (4, "q", "E1", at, "b@x.ru", "7", "male", ["device:phone"], '{"geoname": "D", "local_hour": 5}', ["is_man", "is_phone"]),
        (5, "r", "E3", at, None, None, None, None, None, None),
    ]
    kinds = "event_id long, profile_id string, entity_id string, created_at timestamp, email string, phone string, sex string, non_processing_features array<string>, realtime_features string, fs_features array<string>"
    return spark.createDataFrame(rows, kinds)


def test_path_profiles(spark):
    got = {r.profile_id: r for r in mart.path_profile(_events(spark)).collect()}
    p = got["p"]
    assert (p.row_count, p.entity_id, p.device_set, p.phone_set, p.sex_set) == (3, "E2", ["phone"], ["7"], ["male"])
    assert (p.city_set, p.n_domain, p.local_hour_mean, p.fs_is_man_mean) == (["C", "D"], 2, 3.0, pytest.approx(1 / 3))
    assert got["r"].email_set == [] and got["r"].n_email == 0 and got["r"].visit_count_mean is None
    pairs = spark.createDataFrame([("p", "q"), ("p", "r")], "profile_id_l string, profile_id_r string")
    rows = {r.profile_id_r: r for r in evidence.path_pair_features(pairs, mart.path_profile(_events(spark))).collect()}
    assert len(rows["q"].asDict()) == 2 + 18 + 10 + 51
    q = rows["q"]
    assert (q.same_phone_any, q.common_city_cnt, q.city_jaccard, q.city_overlap, q.row_count_diff, q.local_hour_mean_max) == (1, 1, 0.5, 1.0, 2, 5.0)
    assert rows["r"].local_hour_mean_diff is None and rows["r"].local_hour_mean_min == 3.0 and rows["r"].email_jaccard == 0.0


def test_universes(spark):
    profiles = spark.createDataFrame([(f"p{i:02}", f"E{i // 3}") for i in range(30)], "profile_id string, entity_id string")
    same = lambda pairs: pairs.select("profile_id_l", "profile_id_r", (F.col("profile_id_l") < "p15").cast("double").alias("x"))
    scorer = LogisticScorer({"x": 4.0}, -2.0)
    full = evaluate.full_universe(profiles, same, scorer, 0.5).first()
    assert full.tp + full.fp + full.fn + full.tn == 435 and (full.tp, full.fn) == (15, 15)
    sample = evaluate.sampled_universe(profiles, same, scorer, 0.5, ratio=4).first()
    assert (sample.tp, sample.fn) == (15, 15) and 0 < sample.fp + sample.tn <= 120
    assert evaluate.sampled_universe(profiles, same, scorer, 0.5, ratio=4).first() == sample
    with pytest.raises(ValueError):
        evaluate.full_universe(profiles, same, scorer, 0.5, most=29)


def test_training_grid(spark):
    assert len(training.tree_settings()) * len(training.MULTIPLES) == 32
    rng = random.Random(8)
    rows = [(f"a{i}", f"b{i}", float(y) + rng.random() * 0.5, rng.random(), y) for i in range(300) for y in [int(i % 3 == 0)]]
    df = spark.createDataFrame(rows, "profile_id_l string, profile_id_r string, f double, g double, label int").cache()
    small = training.tree_settings(((2, 2, 0.3, 1.0, 1.0, 1), (3, 2, 0.3, 1.0, 1.0, 1)))
    scorer, table = training.grid_search(df, df, ["f", "g"], small, weights=(1.0,))
    assert len(table) == 2 and max(r["average_precision"] for r in table) > 0.9
    importance = training.permutation_importance(scorer, df, ["f", "g"])
    assert importance[0]["feature"] == "f" and importance[0]["importance"] > importance[1]["importance"]
    held = training.fit_with_holdout(df, ["f", "g"], maxIter=4, maxDepth=2).score(df)
    assert evaluate.average_precision(held).first()[0] > 0.9


def test_full_universe_by_shared_values(spark):
    """Pairs without a common value are counted, not listed; no universe is too large."""
    rows = [(f"p{i:03d}", f"e{i // 3}" if i < 40 else None, [f"c{i % 7}"], [f"m{i // 2}"] if i % 3 else []) for i in range(60)]
    profiles = spark.createDataFrame(rows, "profile_id string, entity_id string, city_set array<string>, email_set array<string>")
    universe = profiles.select("profile_id", "entity_id")
    features = lambda pairs: evidence.profile_pair_features(pairs, profiles, ["city", "email"], [])
    scorer = LogisticScorer({"city_jaccard": 2.0, "email_jaccard": 3.0}, -1.0)
    near = profiles.selectExpr("profile_id", "explode(map('city', city_set, 'email', email_set)) AS (feature, s)").selectExpr("profile_id", "feature", "explode(s) AS value")
    want = evaluate.full_universe(universe, features, scorer, 0.5).first()
    got = evaluate.full_universe(universe, features, scorer, 0.5, most=1, near=near).first()
    assert want.asDict() == got.asDict() and want.tp and want.fp and want.fn and want.tn
    assert studies._deciding(studies.PATH_WEIGHTS, studies.PATH_BIAS) == ["phone", "email", "city"]
