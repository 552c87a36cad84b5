"""Engine operators on hand-written rows: edge cases, properties and small brute force."""

import itertools
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kinweave.functions import text as X
from kinweave.operators import blocking, candidates, evaluate, evidence, graph, mart, report, stats, training, values
from kinweave.operators import rules as R
from kinweave.plans import catalog
from kinweave.sources import tables


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [(" NaN ", None), ("none", None), ("NULL", None), ("", None), (" AbC ", "abc"), (None, None)])
def test_normalise(spark, text, want):
    assert one(spark, text, X.normalise("x")) == want


def test_scalars(spark):
    assert one(spark, "+7 (916) 123-45-67", X.phone("x")) == "79161234567"
    assert one(spark, "8 916 123 45 67", X.phone("x")) == "79161234567"
    assert one(spark, "nobody", X.email_domain("x")) == "missing_domain"
    assert one(spark, "@x", X.email_local("x")) == "missing_local"
    assert one(spark, "ivan.p", X.hash_bucket("x", 1024)) == "644"
    assert one(spark, "12345", X.prefix6("x")) is None
    assert [one(spark, h, X.daypart("x")) for h in ("10.0", "24", "-0.5", "x")] == ["morning_06_10", None, "sleep_00_05", None]
    assert [one(spark, h, X.weekpart("x")) for h in ("5", "7", "0")] == ["weekend", None, "weekday"]
    assert one(spark, datetime(2024, 3, 9, 10, 47, 12), X.registration_buckets("x"), "timestamp") == ["2024-03-09 10:30", "2024-03-09 10:00", "2024-03-09 09:30"]
    assert one(spark, "ﬁ  X", X.nfkc("x")) == "fi x"
    assert one(spark, "rule__a__b", X.rule_family("x")) == "a" and one(spark, "a__b", X.rule_family("x")) == "unknown"
    assert one(spark, float("inf"), X.finite_or("x", -999.0), "double") == -999.0


def test_tokens(spark):
    rows = [(1, "p", datetime(2024, 1, 1), ["a:b:c", " k : v ", "flag", "x:1", "x:2", "", None], '{"n": 5, "b": true}'), (2, "q", None, None, "[1]"), (3, "q", None, [], "broken")]
    df = spark.createDataFrame(rows, "event_id long, profile_id string, created_at timestamp, t array<string>, j string")
    long = {(r.feature, r.value_raw) for r in values.token_rows(df, "t", "np").collect()}
    assert long == {("a", "b:c"), ("k", "v"), ("flag", "true"), ("x", "1"), ("x", "2")}
    last = df.filter("event_id = 1").select(values.key_values("filter(t, y -> y is not null and y <> '')").alias("m")).first()["m"]
    assert last == {"a": "b:c", "k": "v", "flag": None, "x": "2"}
    assert {(r.feature, r.value_raw) for r in values.json_rows(df, "j").collect()} == {("n", "5"), ("b", "true")}


def test_catalogue():
    rules = R.catalogue()
    assert len(rules) == len({r.name for r in rules}) == 51 and len(R.recommended()) == 43
    assert len({r.family for r in rules}) == 12


def _values(spark, rows):
    return spark.createDataFrame(rows, "profile_id string, source string, feature string, value_norm string")


def test_block_products_and_limits(spark):
    pv = _values(spark, [(p, "np", "geoname_id", v) for p in "ab" for v in ("10", "20")] + [("a", "fs", "visited_30", "x"), ("b", "fs", "visited_30", "x"), ("b", "fs", "visited_30", "y"), ("c", "np", "geoname_id", "1")])
    rule = R.named(["rule__behavior_context__np_geoname_id__fs_visited_30"])
    rows = {(r.profile_id, r.block_value) for r in blocking.block_rows(pv, rule).collect()}
    assert rows == {("a", "10|x"), ("a", "20|x"), ("b", "10|x"), ("b", "10|y"), ("b", "20|x"), ("b", "20|y")}
    index = blocking.blocking_index(pv, rule)
    assert {(r.block_value, r.block_size) for r in index.collect()} == {("10|x", 2), ("20|x", 2)}
    assert index.first()["block_weight"] == pytest.approx(1 / math.log(3))
    for n, kept in ((1, 0), (2, 2), (5, 5), (6, 0)):
        many = spark.createDataFrame([(f"p{i}", "f", "r", "v") for i in range(n)], "profile_id string, block_family string, block_rule string, block_value string")
        assert blocking.limited(many, 2, 5).count() == kept


def test_pairs_have_no_self_and_are_ordered(spark):
    pv = _values(spark, [(f"p{i}", "np", "geoname_id", f"g{i % 3}0") for i in range(9)])
    pairs = candidates.internal_pairs(blocking.blocking_index(pv, R.named(["rule__context__np_geoname_id"]))).collect()
    assert len(pairs) == 9 and all(r.profile_id_l < r.profile_id_r for r in pairs)
    with pytest.raises(ValueError):
        candidates.all_pairs(spark.range(10), "id", most=5)


def test_evidence_formulas(spark):
    rows = [("a", "b", "coverage_fallback", "r1", "v", 2, 0.5, "packet"), ("a", "b", "registration_time_window", "r2", "v", 8, 0.25, "history"), ("a", "c", "coverage_fallback", "r1", "v", 20, 0.1, "packet")]
    events = spark.createDataFrame(rows, "profile_id_l string, profile_id_r string, block_family string, block_rule string, block_value string, block_size long, block_weight double, match_scope string")
    got = {r.profile_id_r: r for r in evidence.pair_evidence(events).collect()}
    b, c = got["b"], got["c"]
    assert (b.hits, b.n_block_families, b.has_strong_family, b.is_fallback_only, b.has_non_fallback_signal, b.registration_time_window_only) == (2, 2, 1, 0, 1, 0)
    assert (b.n_small_blocks_le2, b.n_small_blocks_le10, b.strong_family_hit_share, b.rules_key, b.match_scopes) == (1, 2, 0.5, "r1|r2", "history|packet")
    assert (c.is_fallback_only, c.only_weak_families, c.small_block_weak_family_only) == (1, 1, 0)


def test_similarity(spark):
    pv = _values(spark, [("a", "fs", "visited_30", "1"), ("a", "fs", "visited_30", "2"), ("b", "fs", "visited_30", "2"), ("b", "fs", "has_account", "y"), ("a", "identity", "email", "m"), ("b", "identity", "email", "m")])
    r = evidence.pair_similarity(spark.createDataFrame([("a", "b")], "profile_id_l string, profile_id_r string"), pv).first()
    assert (round(r.fs_total_jaccard, 6), r.geo_total_jaccard, r.fs_shared_count, r.identity_email_match, r.identity_phone_match, r.identity_strong_match) == (0.333333, 0.0, 1, 1, 0, 1)


def _scored(spark, rows):
    return spark.createDataFrame(rows, "profile_id_l string, profile_id_r string, score double")


def test_mutual_top_k_ties_and_degree(spark):
    rows = [("a", "b", 0.9), ("a", "c", 0.9), ("b", "c", 0.8), ("c", "d", 0.95), ("d", "e", 0.1)]
    got = {(r.profile_id_l, r.profile_id_r) for r in graph.mutual_top_k(_scored(spark, rows), 0.5, 1).collect()}
    assert got == {("a", "b"), ("c", "d")}
    assert graph.mutual_top_k(_scored(spark, rows), 0.5, None).count() == 4


def test_assignment_decisions(spark):
    edges = _scored(spark, [("p1", "h1", 0.9), ("p2", "h1", 0.9), ("p2", "h2", 0.8)])
    packet = spark.createDataFrame([("p1", "e"), ("p2", "e"), ("p3", "x")], "profile_id string, entity_id string")
    history = spark.createDataFrame([("h1", "E1"), ("h2", "E2")], "profile_id string, entity_id string")
    comps = graph.connected_components(packet, edges)
    got = {r.profile_id: (r.decision, r.predicted_entity_id, r.best_match_score) for r in graph.assign(packet, history, comps, edges).collect()}
    assert got == {"p1": ("ambiguous", "E1|E2", 0.9), "p2": ("ambiguous", "E1|E2", 0.9), "p3": ("new_client", None, 0.0)}
    none = edges.limit(0)
    got = graph.assign(packet, history, graph.connected_components(packet, none), none)
    assert {r.decision for r in got.collect()} == {"new_client"} and got.count() == 3


def test_components_of_long_paths(spark, monkeypatch):
    ids = [f"p{i:03d}" for i in range(300)]
    random.Random(5).shuffle(ids)
    chain = ["q000", *(f"q{i:03d}" for i in range(299, 0, -1))]  # the smallest id creeps along it
    edges = _scored(spark, [(*sorted(x), 0.9) for path in (ids, chain) for x in itertools.pairwise(path)])
    nodes = spark.createDataFrame([("p000",), ("z",)], "profile_id string")
    got = {r.profile_id: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert got == {**dict.fromkeys(ids, "p000"), **dict.fromkeys(chain, "q000"), "z": "z"}
    monkeypatch.setattr("kinweave.operators.components.MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        graph.connected_components(nodes, edges)


def test_pair_queries_keep_300_candidates_a_profile(spark, monkeypatch):
    from kinweave.plans import catalog

    rule = R.named(["rule__context__np_geoname_id"])
    block = lambda ids: blocking.block_rows(_values(spark, [(i, "np", "geoname_id", "10") for i in ids]), rule)
    packet, history = block(["p_0"]), block([f"h{i:03d}_1" for i in range(310)])
    monkeypatch.setattr(catalog, "split_rows", lambda *_: (None, packet, blocking.limited(packet), blocking.limited(history)))
    assert catalog.all_events(spark, "")[0].count() == 300


def test_two_links(spark):
    edges = _scored(spark, [("a", "b", 0.99)])
    scored = _scored(spark, [("a", "b", 0.99), ("a", "x", 0.97), ("b", "x", 0.96), ("a", "y", 0.97)])
    comps = graph.connected_components(spark.createDataFrame([("a",)], "profile_id string"), edges)
    got = {(r.profile_id_l, r.profile_id_r) for r in graph.extend_by_two_links(edges, comps, scored, 0.95).collect()}
    assert got == {("a", "x"), ("b", "x")}


def test_ranking_metrics(spark):
    rows = [("a", str(i), s, y) for i, (s, y) in enumerate([(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.2, 1)])]
    df = spark.createDataFrame(rows, "profile_id_l string, profile_id_r string, score double, label int")
    pos, neg = [s for *_, s, y in rows if y], [s for *_, s, y in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(auc, abs=1e-6)
    assert evaluate.average_precision(df).first()[0] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3, abs=1e-6)
    assert evaluate.grid(0.9, 1.0, 0.05) == [0.9, 0.95, 1.0]


def test_statistics(spark):
    exact = sum(math.comb(20, i) * 0.3**i * 0.7 ** (20 - i) for i in range(9, 21))
    assert stats.binomial_tail(9, 20, 0.3) == pytest.approx(exact)
    assert stats.binomial_tail(0, 5, 0.1) == 1.0


def test_training(spark):
    pairs = spark.createDataFrame([("a", f"n{i}", 0) for i in range(50)] + [("a", "b", 1)], "profile_id_l string, profile_id_r string, label int")
    first = training.select_training_pairs(pairs, 10)
    again = training.select_training_pairs(pairs.repartition(5), 10)
    assert first.count() == 11 and {r.profile_id_r for r in first.collect()} == {r.profile_id_r for r in again.collect()}
    core = spark.createDataFrame([(f"p{i}", f"e{i // 2}", 2) for i in range(40)], "profile_id string, entity_id string, entity_size int")
    split = core.withColumn("split", training.md5_split())
    assert split.groupBy("entity_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    with pytest.raises(ValueError):
        training.scoped(core, core, "test")
    assert training.test_packet(core, 6, 0.5).count() == 6
    with pytest.raises(ValueError):
        training.test_packet(core, 1000, 0.5)


def test_mart_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("b", "y")], "k string, v string")
    assert {(r.k, r.mode_v) for r in mart.most_frequent(df, "k", "v").collect()} == {("a", "x"), ("b", "y")}
    path = str(tmp_path / "out")
    built = report.read_through(spark, path, ("k",), lambda: df)
    assert built.count() == 4 and report.read_through(spark, path, ("k",), lambda: 1 / 0).count() == 4
    report.write_csv(df, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "k string, v string").count() == 4
    report.write_json({"b": 1, "a": 2}, str(tmp_path / "x.json"))
    assert tables.load_json(str(tmp_path / "x.json")) == {"a": 2, "b": 1}
    assert tables.artefact_status({"x": path, "y": path + "-none"}, spark) == {"x": True, "y": False}
    assert "<td>a</td>" in report.html_table(df, "t") and "| a |" in report.markdown(_scored(spark, [("a", "b", 0.5)]))


def test_lookup_stream(spark, tmp_path):
    from kinweave.streaming.lookup import lookup_stream

    raw = tables.raw_events(spark, "/root/testdata/sf0.001")
    rule = R.named(["rule__context__np_geoname_id"])
    packet = F.col("profile_id").endswith("_0")
    history = blocking.blocking_index(values.profile_values(raw.filter(~packet)), rule)
    src = str(tmp_path / "packets")
    raw.filter(packet).coalesce(1).write.parquet(src)
    query = lookup_stream(spark.readStream.schema(raw.schema).parquet(src), history, rule, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_expanded_columns(spark):
    df = spark.createDataFrame([("1", "1.5", "x", None, "a"), ("2", "2", "7", None, "b")], "np_device string, rt_geoid string, rt_k string, rt_none string, device string")
    named = values.with_friendly_names(df)
    assert [(r.device, r.city_geoid) for r in named.collect()] == [("a", "1.5"), ("b", "2")]
    typed = values.coerce_types(df, ["np_device", "rt_geoid", "rt_k", "rt_none"])
    assert [t for _, t in typed.dtypes] == ["bigint", "double", "string", "string", "string"]
    half = spark.createDataFrame([(str(i),) for i in range(39)] + [("?",)], "v string")
    assert values.coerce_types(half, ["v"]).filter("v is null").count() == 1


def test_uploaded_bytes(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "up"))
    data = next((tmp_path / "up").glob("*.parquet")).read_bytes()
    assert sorted(r.id for r in tables.read_bytes(spark, data).collect()) == list(range(5))


def test_resolve_decides_for_every_packet_profile(spark):
    from kinweave.plans.api import resolve
    from kinweave.sources.tables import raw_events

    raw = raw_events(spark, "/root/testdata/sf0.001")
    packet, history = raw.filter("profile_id like '%0'"), raw.filter("profile_id not like '%0'")
    got = resolve(packet, history)
    decided = got.assignment.collect()
    assert sorted(r.profile_id for r in decided) == sorted(r.profile_id for r in packet.select("profile_id").distinct().collect())
    assert {r.decision for r in decided} <= {"new_client", "matched_existing", "ambiguous"}
    assert all((r.predicted_entity_id is None) == (r.decision == "new_client") for r in decided)


def test_all_pairs_of_more_than_the_usual_ids(spark, tmp_path):
    spark.range(5200).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    assert catalog.queries()["pairs_all_small"](spark, str(tmp_path)).count() == 5200 * 5199 // 2
