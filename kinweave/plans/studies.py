"""Queries over the rich adapter: profile rows and their pairs, exhaustive and sampled universes, tests and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text as X
from kinweave.operators import blocking, candidates, evaluate, evidence, graph, mart, stats, training, values
from kinweave.operators.scoring import LogisticScorer
from kinweave.plans import catalog as C
from kinweave.plans import oracles as O
from kinweave.plans.catalog import register
from kinweave.sources.tables import raw_events, rich_events, table

RICH = [O.RICH, O.RICH_EV]


# --- parsing where keys repeat, names are given and profiles are mixed up


@register(O.query([O.RICH], """SELECT event_id, k AS key, arg_max(v, i) AS value FROM (SELECT event_id, i, CASE WHEN instr(tok, ':') > 0 THEN trim(split_part(tok, ':', 1)) ELSE tok END AS k,
  CASE WHEN instr(tok, ':') > 0 THEN trim(substr(tok, instr(tok, ':') + 1)) ELSE '~' END AS v FROM (SELECT event_id, unnest(fs_features) AS tok, generate_subscripts(fs_features, 1) AS i FROM raw) WHERE tok IS NOT NULL) GROUP BY ALL"""))
def kv_repeated_keys(spark, d):
    rows = rich_events(spark, d).withColumn("fs", F.filter("fs_features", lambda t: t.isNotNull()))
    return rows.select("event_id", F.explode(values.key_values("fs")).alias("key", "value")).withColumn("value", F.coalesce("value", F.lit("~")))


@register(O.query(RICH, "SELECT DISTINCT profile_id, feature, value_norm FROM ev WHERE source = 'identity'"))
def identity_all_columns(spark, d):
    return values.event_values(rich_events(spark, d)).filter("source = 'identity'").select("profile_id", "feature", "value_norm").distinct()


@register(O.query([O.RICH], "SELECT event_id, regexp_replace(regexp_replace(phone, '[^0-9]+', '', 'g'), '^8', '7') AS digits FROM raw WHERE phone IS NOT NULL"))
def phone_national(spark, d):
    return rich_events(spark, d).filter("phone is not null").select("event_id", X.phone("phone").alias("digits"))


@register(O.query([O.RICH], "SELECT event_id, profile_id, entity_id FROM raw WHERE profile_id NOT IN (SELECT profile_id FROM raw GROUP BY 1 HAVING count(DISTINCT entity_id) > 1)"))
def consistent_profiles_mixed(spark, d):
    return mart.consistent_profiles(rich_events(spark, d)).select("event_id", "profile_id", "entity_id")


# --- profile rows and their pairs

_NULLS = "('', 'nan', 'none', 'null')"
_MEANS = {"local_hour": "local_hour", "visit_count": "visit_count", "city_population": "population"}


def _np(key: str, column: str) -> str:
    return f"substr(list_filter(non_processing_features, lambda t: t LIKE '{key}:%')[1], {len(key) + 2}) AS {column}"


_PROFILE_ROWS = "pr AS (SELECT profile_id, entity_id, email, phone, sex, split_part(email, '@', 2) AS domain, json_extract_string(realtime_features, '$.geoname') AS city, " + ", ".join([
    _np("device", "device"), _np("subdivision_1_iso_code", "region"), _np("browser", "browser"), _np("osfamily", "os"),
    *[f"json_extract_string(realtime_features, '$.{k}')::DOUBLE AS {c}" for c, k in _MEANS.items()],
    *[f"list_contains(fs_features, '{c[3:]}')::INTEGER AS {c}" for c in mart.PATH_MEANS if c.startswith("fs_")],
]) + " FROM raw)"
_PROFILES = ("pp0 AS (SELECT profile_id, count(*) AS row_count, " + ", ".join([
    *[f"list_sort(coalesce(list(DISTINCT {c}) FILTER ({c} IS NOT NULL AND lower(trim({c})) NOT IN {_NULLS}), [])) AS {c}_set" for c in mart.PATH_SETS],
    *[f"avg({c}) AS {c}_mean" for c in mart.PATH_MEANS],
]) + " FROM pr GROUP BY 1),\npp AS (SELECT pp0.*, m.entity_id, " + ", ".join(f"len({c}_set) AS n_{c}" for c in mart.PATH_SETS if c != "sex") + """ FROM pp0 JOIN
  (SELECT profile_id, entity_id FROM (SELECT profile_id, entity_id, count(*) AS n FROM raw GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, entity_id) = 1) m USING (profile_id))""")  # fmt: skip
PATH = [O.RICH, _PROFILE_ROWS, _PROFILES]


@register(O.query(PATH, "SELECT profile_id, entity_id, row_count, " + ", ".join(
    [f"array_to_string({c}_set, ',') AS {c}_set" for c in mart.PATH_SETS] + [f"n_{c}" for c in mart.PATH_SETS if c != "sex"] + [f"round({c}_mean, 6) AS {c}_mean" for c in mart.PATH_MEANS]) + " FROM pp"))
def path_profiles(spark, d):
    rows = C.six(mart.path_profile(rich_events(spark, d)), *[f"{c}_mean" for c in mart.PATH_MEANS])
    return rows.withColumns({f"{c}_set": F.array_join(f"{c}_set", ",") for c in mart.PATH_SETS})


def _path_features() -> list[str]:
    both = lambda c: f"len(list_intersect(a.{c}_set, b.{c}_set))"
    out = [f"({both(c)} > 0)::INTEGER AS same_{c}_any, {both(c)} AS common_{c}_cnt" for c in mart.PATH_SETS]
    for c in evidence.RATIO_SETS:
        union, least = f"len(list_distinct(list_concat(a.{c}_set, b.{c}_set)))", f"least(len(a.{c}_set), len(b.{c}_set))"
        out.append(f"round(CASE WHEN {union} > 0 THEN {both(c)} / {union} ELSE 0 END, 6) AS {c}_jaccard, round(CASE WHEN {least} > 0 THEN {both(c)} / {least} ELSE 0 END, 6) AS {c}_overlap")
    out += [f"round(abs(a.{c} - b.{c}), 6) AS {c}_diff, round(least(a.{c}, b.{c}), 6) AS {c}_min, round(greatest(a.{c}, b.{c}), 6) AS {c}_max" for c in mart.PATH_NUMBERS]
    return out


_CITY_PAIRS = """cities AS (SELECT value_norm FROM pv WHERE source = 'rt' AND feature = 'geoname' GROUP BY 1 HAVING count(*) BETWEEN 2 AND 200),
prs AS (SELECT DISTINCT a.profile_id AS profile_id_l, b.profile_id AS profile_id_r FROM pv a JOIN pv b USING (source, feature, value_norm) SEMI JOIN cities USING (value_norm)
  WHERE source = 'rt' AND feature = 'geoname' AND a.profile_id < b.profile_id)"""
_PAIR_FROM = "FROM prs JOIN pp a ON a.profile_id = profile_id_l JOIN pp b ON b.profile_id = profile_id_r"


@register(O.query([*O.RICH_BASE, *PATH[1:], _CITY_PAIRS], f"SELECT profile_id_l, profile_id_r, {', '.join(_path_features())} {_PAIR_FROM}"))
def path_pair_features(spark, d):
    raw = rich_events(spark, d)
    pairs = candidates.two_hop_pairs(values.profile_values(raw), [("rt", "geoname")])
    rows = evidence.path_pair_features(pairs, graph.written(mart.path_profile(raw)))
    ratios = [f"{c}_{k}" for c in evidence.RATIO_SETS for k in ("jaccard", "overlap")]
    return C.six(rows, *ratios, *[f"{c}_{k}" for c in mart.PATH_NUMBERS for k in ("diff", "min", "max")])


_DIMS = 64  # width of the vectors of the table: every axis has its two columns


@register("SELECT a.vec_id AS l, b.vec_id AS r, " + ", ".join(
    f"round(abs(a.embedding[{i + 1}]::DOUBLE - b.embedding[{i + 1}]::DOUBLE), 6) AS absdiff_{i}, round(a.embedding[{i + 1}]::DOUBLE * b.embedding[{i + 1}]::DOUBLE, 6) AS mul_{i}" for i in range(_DIMS))
    + " FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id")
def embedding_axis_features(spark, d):
    rows = table(spark, d, "embeddings", ["vec_id", "embedding"])
    pairs = rows.select(F.col("vec_id").alias("l"), (F.col("vec_id") + 1).alias("r"), F.col("embedding").alias("a")).join(rows.select(F.col("vec_id").alias("r"), F.col("embedding").alias("b")), "r")
    names = [f"{k}_{i}" for i in range(_DIMS) for k in ("absdiff", "mul")]
    return C.six(evidence.embedding_axis_features(pairs, _DIMS), *names).select("l", "r", *names)


# --- exhaustive and sampled universes

# Weights of a transparent scorer over profile features.
PATH_WEIGHTS = {"domain_jaccard": 0.7, "device_jaccard": 0.9, "city_jaccard": 2.3, "phone_jaccard": 3.1, "email_jaccard": 2.9, "n_browser_diff": -0.37, "row_count_diff": -0.011}
PATH_BIAS, PATH_THRESHOLD = -3.3, 0.5
PATH_SCORER = LogisticScorer(PATH_WEIGHTS, PATH_BIAS)
_PATH_SCORE = f"round(1 / (1 + exp(-({PATH_BIAS} + " + " + ".join(f"{w} * {c}" for c, w in PATH_WEIGHTS.items()) + "))), 9)"
_COUNTS = "count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn"
_MEASURED = f"""fx AS (SELECT profile_id_l, profile_id_r, label, {", ".join(_path_features()).replace("round(CASE", "(CASE").replace("END, 6)", "END)")} {_PAIR_FROM}),
cf AS (SELECT {_COUNTS} FROM (SELECT label, {_PATH_SCORE} AS score FROM fx)),
pr2 AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM cf)"""
_RATIOS = 'SELECT tp, fp, fn, tn, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr2'
_ALL = f"""uni AS (SELECT profile_id, entity_id FROM pp WHERE {C.SPLIT_SQL} = 'valid'),
prs AS (SELECT a.profile_id AS profile_id_l, b.profile_id AS profile_id_r, (a.entity_id = b.entity_id)::INTEGER AS label FROM uni a JOIN uni b ON a.profile_id < b.profile_id)"""
_SAMPLE = """uni AS (SELECT profile_id, entity_id, row_number() OVER (ORDER BY profile_id) - 1 AS at FROM pp),
tru AS (SELECT a.profile_id AS profile_id_l, b.profile_id AS profile_id_r FROM uni a JOIN uni b USING (entity_id) WHERE a.profile_id < b.profile_id),
n AS (SELECT count(*) AS n FROM uni), k AS (SELECT least(10 * count(*), 200000) AS k FROM tru),
dr AS (SELECT ('0x' || substr(md5('42|l|' || i), 1, 8))::BIGINT % n AS l, ('0x' || substr(md5('42|r|' || i), 1, 8))::BIGINT % n AS r FROM n, (SELECT unnest(range(0, k)) AS i FROM k)),
prs AS (SELECT *, 1 AS label FROM tru UNION ALL SELECT DISTINCT least(a.profile_id, b.profile_id), greatest(a.profile_id, b.profile_id), 0 FROM dr JOIN uni a ON a.at = l JOIN uni b ON b.at = r
  WHERE a.profile_id <> b.profile_id AND a.entity_id <> b.entity_id)"""


def _deciding(weights: dict[str, float], bias: float) -> list[str]:
    """Sets without a common value in any of which a pair cannot reach a score of one half; the fewest, largest weights first.

    Jaccard features are at most 1, and 0 without a common value; the other weights must not raise the score.
    """
    if any(w > 0 and not c.endswith("_jaccard") for c, w in weights.items()):
        raise ValueError("only Jaccard features may raise the score")
    left, out = sorted((w, c) for c, w in weights.items() if w > 0), []
    while left and bias + sum(w for w, _ in left) > -1e-6:
        out.append(left.pop()[1].removesuffix("_jaccard"))
    if bias > -1e-6:
        raise ValueError("every pair may reach the threshold")
    return out


def _shared(profiles: DataFrame) -> DataFrame:
    """(profile_id, feature, value) of the sets one of which every pair above the threshold shares."""
    sets = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_set").alias("values")) for c in _deciding(PATH_WEIGHTS, PATH_BIAS)])
    rows = profiles.select("profile_id", F.explode(sets).alias("s"))
    return rows.select("profile_id", "s.feature", F.explode("s.values").alias("value"))


def _featurised(spark, d):
    profiles = graph.written(mart.path_profile(rich_events(spark, d)))
    return profiles, lambda pairs: evidence.path_pair_features(pairs, profiles)


@register(O.query([*PATH, _ALL, _MEASURED], _RATIOS))
def full_universe_eval(spark, d):
    profiles, features = _featurised(spark, d)
    universe = profiles.withColumn("split", training.md5_split()).filter("split = 'valid'").select("profile_id", "entity_id")
    return evaluate.full_universe(universe, features, PATH_SCORER, PATH_THRESHOLD, near=_shared(profiles))


@register(O.query([*PATH, _SAMPLE, _MEASURED], _RATIOS))
def sampled_universe_eval(spark, d):
    profiles, features = _featurised(spark, d)
    return evaluate.sampled_universe(profiles.select("profile_id", "entity_id"), features, PATH_SCORER, PATH_THRESHOLD)


# --- tests and verdicts


def _chi2_sql(a: str, b: str, p: str) -> str:
    return f"""c AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM raw GROUP BY ALL), r AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS cb FROM c GROUP BY 1), n AS (SELECT sum(o) AS n FROM c),
x AS (SELECT abs(coalesce(o, 0) - ra * cb / n) AS g, ra * cb / n AS e, r.a, k.b FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c ON c.a = r.a AND c.b = k.b),
t AS (SELECT (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof, sum(g * g / e) AS s, sum(greatest(g - 0.5, 0) ** 2 / e) AS y FROM x),
u AS (SELECT dof, round(CASE WHEN dof = 1 THEN y ELSE s END, 6) AS chi2 FROM t) SELECT chi2, dof{p} FROM u"""


@register("WITH " + O.RICH + ", " + _chi2_sql("isodow(created_at)", "sex", ", round(exp(-chi2 / 2) * (1 + chi2 / 2 + (chi2 / 2) ** 2 / 2), 6) AS p_value"))
def chi2_weekday_by_sex(spark, d):
    return stats.chi_square_test(rich_events(spark, d).withColumn("dow", F.weekday("created_at")), "dow", "sex")


@register("WITH " + O.RICH + ", " + _chi2_sql("split_part(email, '@', 2)", "sex", ", round(exp(-chi2 / 2), 6) AS p_value"))
def chi2_domain_by_sex(spark, d):
    return stats.chi_square_test(rich_events(spark, d).withColumn("domain", X.email_domain_second("email")), "domain", "sex")


@register("WITH " + O.RICH + ", " + _chi2_sql("phone IS NULL", "sex", ""))
def chi2_phone_by_sex(spark, d):
    """Two by two cells, so corrected for continuity; SQL has no error function for its p value."""
    return stats.chi_square(rich_events(spark, d).withColumn("none", F.col("phone").isNull()), "none", "sex")


_TAIL = """list_sum(list_transform(range(positive_pairs, candidate_pairs + 1), lambda i: exp(lgamma(candidate_pairs + 1) - lgamma(i + 1) - lgamma(candidate_pairs - i + 1) + i * ln(b) + (candidate_pairs - i) * ln(1 - b))))"""


@register("WITH " + O.RAW + f""", sizes AS (SELECT count(DISTINCT profile_id) AS k FROM raw GROUP BY entity_id), base AS (SELECT sum(k * (k - 1) // 2) / (sum(k) * (sum(k) - 1) // 2) AS b FROM sizes),
l AS ({C.oracle_sql()['rule_lift']})
SELECT block_rule, candidate_pairs, positive_pairs, lift, p95_block_size, CASE WHEN {_TAIL} < 0.01 AND lift >= 50 AND p95_block_size <= 100 THEN 'use' ELSE 'reject' END AS verdict,
  round(least({_TAIL}, 1), 4) AS p_value FROM l, base""")
def rule_verdicts(spark, d):
    raw = raw_events(spark, d)
    rows = stats.rule_verdict(stats.rule_lift(graph.written(values.profile_values(raw)), C.PAIR_RULES, graph.written(mart.profile_core(raw))))  # one row a rule
    cells = [(r["block_rule"], r["candidate_pairs"], r["positive_pairs"], r["lift"], r["p95_block_size"], r["verdict"], round(r["p_value"], 4)) for r in rows]
    return spark.createDataFrame(cells, "block_rule string, candidate_pairs long, positive_pairs long, lift double, p95_block_size double, verdict string, p_value double")


@register()
def sweep_guardrails(spark, d):
    """The best assignments at 85, 90 and 95 percent of new clients kept apart, over both ways to keep edges."""
    scored = C.scored_pairs(spark, d)
    packet, history = graph.written(C._packet(spark, d)), graph.written(C._history(spark, d))
    points: DataFrame | None = None
    for strategy, k in (("mutual_top_k", 1), ("threshold", None)):
        for t in (0.2, 0.5, 0.95):
            comps = graph.connected_components(packet, graph.mutual_top_k(scored, t, k))
            row = evaluate.assignment_points(evaluate.assignment_quality(graph.assign(packet, history, comps, scored), packet, history))
            row = row.select(F.lit(strategy).alias("strategy"), F.lit(k or 0).alias("k"), F.lit(t).alias("threshold"), "*")
            points = row if points is None else points.unionByName(row)
    return evaluate.guardrails(points)
