"""Registry of the engine's own queries, each over its whole tables, with its SQL oracle beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import text as X
from kinweave.operators import blocking, candidates, embeddings, evaluate, evidence, graph, mart, paircount, stats, training, values
from kinweave.operators import rules as R
from kinweave.operators.scoring import LogisticScorer
from kinweave.plans import oracles as O
from kinweave.plans.api import Policy, resolve
from kinweave.sources.tables import head_rows, raw_events, rich_events, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


#: Rules of the pair queries: all that are recommended, as in the shipped selection.
PAIR_RULES = R.recommended()
FLAGSHIP_RULE = R.named(["rule__behavior_context__np_geoname_id__fs_source_site_365"])
THRESHOLD, PER_PROFILE = 0.2, Policy.per_profile


# --- scans, limits, splits


@register("SELECT event_id, user_id, event_type FROM events")
def scan_projected(spark, d):
    return table(spark, d, "events", ["event_id", "user_id", "event_type"])


@register(f"SELECT event_id, {sql_stamp('ts')}, user_id FROM events ORDER BY event_id LIMIT 100")
def head_rows_events(spark, d):
    return head_rows(table(spark, d, "events", ["event_id", "ts", "user_id"]), 100, "event_id").select("event_id", stamp("ts"), "user_id")


SPLIT_SQL = "CASE WHEN ('0x' || substr(md5(entity_id), 1, 8))::BIGINT % 100 < 70 THEN 'train' WHEN ('0x' || substr(md5(entity_id), 1, 8))::BIGINT % 100 < 85 THEN 'valid' ELSE 'test' END"


@register(O.query([O.RAW], f"SELECT event_id, profile_id, entity_id FROM raw WHERE {SPLIT_SQL} = 'valid'"))
def split_filter(spark, d):
    return raw_events(spark, d).withColumn("split", training.md5_split()).filter("split = 'valid'").select("event_id", "profile_id", "entity_id")


# --- parsing


@register(O.query([O.RAW], """SELECT event_id, k AS key, arg_max(v, i) AS value FROM (SELECT event_id, i, CASE WHEN instr(tok, ':') > 0 THEN trim(split_part(tok, ':', 1)) ELSE tok END AS k,
  CASE WHEN instr(tok, ':') > 0 THEN trim(substr(tok, instr(tok, ':') + 1)) ELSE '~' END AS v FROM (SELECT event_id, unnest(fs_features) AS tok, generate_subscripts(fs_features, 1) AS i FROM raw)) GROUP BY ALL"""))
def kv_last_wins(spark, d):
    rows = raw_events(spark, d).select("event_id", F.explode(values.key_values("fs_features")).alias("key", "value"))
    return rows.withColumn("value", F.coalesce("value", F.lit("~")))


@register(O.query([O.RAW, O.EV], "SELECT event_id, source, feature, value_norm FROM ev WHERE source IN ('np', 'fs')"))
def kv_tokens_long(spark, d):
    return values.event_values(raw_events(spark, d)).filter("source in ('np', 'fs')").select("event_id", "source", "feature", "value_norm")


@register(O.query([O.RAW, O.EV], "SELECT event_id, feature, value_norm FROM ev WHERE source = 'rt'"))
def json_features_long(spark, d):
    return values.event_values(raw_events(spark, d)).filter("source = 'rt'").select("event_id", "feature", "value_norm")


_PIVOT = ["np_device", "np_osfamily", "fs_visited_30"]


@register(O.query([O.RAW, O.EV], """, n AS (SELECT profile_id, source || '_' || feature AS f, value_norm AS v, count(*) AS n FROM ev GROUP BY ALL),
b AS (SELECT profile_id, f, v FROM n QUALIFY row_number() OVER (PARTITION BY profile_id, f ORDER BY n DESC, v) = 1)
SELECT profile_id, max(v) FILTER (f = 'np_device') AS np_device, max(v) FILTER (f = 'np_osfamily') AS np_osfamily, max(v) FILTER (f = 'fs_visited_30') AS fs_visited_30 FROM b GROUP BY 1""".lstrip()))
def wide_pivot_selected(spark, d):
    return values.wide_selected(values.event_values(raw_events(spark, d)), _PIVOT)


@register(O.query([O.RAW, O.EV], "SELECT DISTINCT profile_id, feature, value_norm FROM ev WHERE source = 'identity'"))
def identity_unpivot(spark, d):
    return values.event_values(raw_events(spark, d)).filter("source = 'identity'").select("profile_id", "feature", "value_norm").distinct()


# --- scalars


@register(O.query([O.RAW], "SELECT event_id, nullif(regexp_replace(phone, '[^0-9]+', '', 'g'), '') AS digits, substr(regexp_replace(phone, '[^0-9]+', '', 'g'), 1, 6) AS prefix6 FROM raw WHERE phone IS NOT NULL"))
def normalize_phone(spark, d):
    return raw_events(spark, d).filter("phone is not null").select("event_id", X.phone("phone").alias("digits"), X.prefix6(X.phone("phone")).alias("prefix6"))


@register(O.query([O.RAW], """SELECT event_id, regexp_extract(email, '@([^@]+)$', 1) AS domain, regexp_extract(email, '^([^@]+)', 1) AS local, substr(email, 1, 1) AS initial1, substr(email, 1, 2) AS initial2 FROM raw"""))
def email_parts(spark, d):
    local = X.email_local("email")
    return raw_events(spark, d).select("event_id", X.email_domain("email").alias("domain"), local.alias("local"), X.initial(local, 1).alias("initial1"), X.initial(local, 2).alias("initial2"))


@register(O.query([O.RAW], "SELECT event_id, split_part(email, '@', -1) AS last_part, split_part(email, '@', 2) AS second_part FROM raw"))
def email_domain_variants(spark, d):
    return raw_events(spark, d).select("event_id", X.email_domain_last("email").alias("last_part"), X.email_domain_second("email").alias("second_part"))


@register(O.query([O.RAW], "SELECT event_id, CAST(('0x' || substr(md5(regexp_extract(email, '^([^@]+)', 1)), 1, 8))::BIGINT % 1024 AS VARCHAR) AS bucket FROM raw"))
def md5_bucket_1024(spark, d):
    return raw_events(spark, d).select("event_id", X.hash_bucket(X.email_local("email"), 1024).alias("bucket"))


@register(O.query([O.RAW], f"""SELECT event_id, {O._PART['daypart']} AS daypart, {O._PART['weekpart'].replace('h ', 'w ')} AS weekpart FROM
  (SELECT event_id, json_extract_string(realtime_features, '$.local_hour')::INTEGER AS h, json_extract_string(realtime_features, '$.day')::INTEGER AS w FROM raw)"""))
def daypart_weekpart(spark, d):
    get = lambda k: F.get_json_object("realtime_features", f"$.{k}")
    return raw_events(spark, d).select("event_id", X.daypart(get("local_hour")).alias("daypart"), X.weekpart(get("day")).alias("weekpart"))


@register("SELECT event_id, strftime(time_bucket(INTERVAL 30 minute, ts) - INTERVAL 30 minute * k, '%Y-%m-%d %H:%M') AS bucket FROM events, unnest(range(0, 3)) AS t(k)")
def registration_buckets(spark, d):
    return table(spark, d, "events", ["event_id", "ts"]).select("event_id", F.explode(X.registration_buckets("ts")).alias("bucket"))


@register("SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS dow, strftime(ts, '%Y-%m-%d') AS ymd FROM events")
def hour_dow(spark, d):
    return table(spark, d, "events", ["event_id", "ts"]).select("event_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("dow"), X.date_ymd("ts").alias("ymd"))


@register("SELECT name, split_part(name, '__', 2) AS family FROM (VALUES " + ", ".join(f"('{r.name}')" for r in R.catalogue()) + ") t(name)")
def rule_family_name(spark, d):
    return spark.createDataFrame([(r.name,) for r in R.catalogue()], "name string").select("name", X.rule_family("name").alias("family"))


@register("SELECT event_id, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)), -1) AS gap, CASE WHEN value > 50 THEN value ELSE -999.0 END AS filled FROM events")
def numeric_gap_fill(spark, d):
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, d, "events", ["event_id", "user_id", "value"]).withColumn("before", before)
    return rows.select("event_id", X.number_gap("value", "before").alias("gap"), X.finite_or(F.when(F.col("value") > 50, F.col("value")), -999.0).alias("filled"))


# --- mart


@register(O.query([O.RAW, O.CORE], f"SELECT profile_id, entity_id, event_count, entity_id_nunique, {sql_stamp('first_event_at')}, {sql_stamp('last_event_at')}, entity_size, entity_kind FROM core"))
def profile_core(spark, d):
    core = mart.profile_core(raw_events(spark, d))
    return core.select("profile_id", "entity_id", "event_count", "entity_id_nunique", stamp("first_event_at"), stamp("last_event_at"), "entity_size", "entity_kind")


_SUMMARY = """sm0 AS (SELECT profile_id, source, feature, value_norm, count(*) AS value_count, min(created_at) AS first_seen, max(created_at) AS last_seen, arg_min(value_raw, event_id) AS value_raw_example FROM ev GROUP BY 1, 2, 3, 4),
sm AS (SELECT *, sum(value_count) OVER (PARTITION BY profile_id, source, feature) AS feature_observation_count,
  row_number() OVER (PARTITION BY profile_id, source, feature ORDER BY value_count DESC, first_seen, value_norm) AS value_rank FROM sm0)"""


@register(O.query([O.RAW, O.EV, _SUMMARY], f"""SELECT profile_id, source || '__' || feature AS feature_key, value_norm, value_raw_example, value_count, {sql_stamp('first_seen')}, {sql_stamp('last_seen')},
  feature_observation_count, round(value_count / feature_observation_count, 6) AS value_share_within_feature FROM sm"""))
def value_summary(spark, d):
    rows = mart.value_summary(values.event_values(raw_events(spark, d)))
    return rows.select("profile_id", "feature_key", "value_norm", "value_raw_example", "value_count", stamp("first_seen"), stamp("last_seen"), "feature_observation_count", F.round("value_share_within_feature", 6).alias("value_share_within_feature"))


@register(O.query([O.RAW, O.EV, _SUMMARY], "SELECT profile_id, source, feature, value_norm, value_rank, value_rank = 1 AS is_primary_value FROM sm WHERE value_rank <= 3"))
def value_rank_primary(spark, d):
    rows = mart.value_summary(values.event_values(raw_events(spark, d)))
    return rows.filter("value_rank <= 3").select("profile_id", "source", "feature", "value_norm", "value_rank", "is_primary_value")


@register(O.query([O.RAW, O.EV], """SELECT source, feature, count(*) AS n_tokens, count(DISTINCT profile_id) AS n_profiles, count(DISTINCT value_norm) AS n_values,
  round(count(DISTINCT profile_id) / (SELECT count(DISTINCT profile_id) FROM raw), 6) AS profile_share FROM ev GROUP BY 1, 2"""))
def feature_dictionary(spark, d):
    raw = raw_events(spark, d)
    n = raw.select("profile_id").distinct().count()
    return mart.feature_dictionary(values.event_values(raw), n).withColumn("profile_share", F.round("profile_share", 6))


_SETS = {"domain": ("derived", "email_domain"), "device": ("np", "device"), "city": ("np", "geoname_id"), "browser": ("np", "browser"), "os": ("np", "osfamily"), "sex": ("identity", "sex"), "phone": ("identity", "phone")}


def _set_sql(name: str, s: str, f: str) -> str:
    return f"coalesce(string_agg(DISTINCT value_norm, ',' ORDER BY value_norm) FILTER (source = '{s}' AND feature = '{f}'), '') AS {name}_set, count(DISTINCT value_norm) FILTER (source = '{s}' AND feature = '{f}') AS n_{name}"


@register(O.query(O.BASE, "SELECT profile_id, " + ", ".join(_set_sql(k, *v) for k, v in _SETS.items()) + " FROM pv GROUP BY 1"))
def profile_sets(spark, d):
    rows = mart.profile_sets(values.profile_values(raw_events(spark, d)), _SETS)
    return rows.withColumns({f"{k}_set": F.array_join(f"{k}_set", ",") for k in _SETS})


@register(O.query([O.RAW], """SELECT profile_id, arg_max(email, (created_at, event_id)) AS last_email, arg_max(phone, (created_at, event_id)) FILTER (phone IS NOT NULL) AS last_phone,
  string_agg(DISTINCT sex, ',' ORDER BY sex) AS sexes, bool_or(phone IS NOT NULL) AS has_phone FROM raw GROUP BY 1"""))
def profile_last_snapshot(spark, d):
    return mart.last_snapshot(raw_events(spark, d)).withColumn("sexes", F.array_join("sexes", ","))


@register("SELECT user_id, event_type AS mode_event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def mode_tiebreak(spark, d):
    return mart.most_frequent(table(spark, d, "events", ["user_id", "event_type"]), "user_id", "event_type")


@register(O.query([O.RAW], "SELECT event_id, profile_id FROM raw WHERE profile_id NOT IN (SELECT profile_id FROM raw GROUP BY 1 HAVING count(DISTINCT entity_id) > 1)"))
def consistent_profiles(spark, d):
    return mart.consistent_profiles(raw_events(spark, d)).select("event_id", "profile_id")


# --- exploration


@register(O.query([O.RAW, O.CORE], """SELECT count(*) AS n_profiles, sum(event_count) AS n_events, count(DISTINCT entity_id) AS n_entities, count(*) FILTER (entity_size > 1) AS profiles_in_multi,
  count(DISTINCT entity_id) FILTER (entity_size > 1) AS multi_entities, max(entity_size) AS max_entity_size FROM core"""))
def duplicate_summary(spark, d):
    core = mart.profile_core(raw_events(spark, d))
    multi = F.col("entity_size") > 1
    return core.agg(
        F.count(F.lit(1)).alias("n_profiles"), F.sum("event_count").alias("n_events"), F.countDistinct("entity_id").alias("n_entities"), F.count_if(multi).alias("profiles_in_multi"),
        F.countDistinct(F.when(multi, F.col("entity_id"))).alias("multi_entities"), F.max("entity_size").alias("max_entity_size"),
    )


@register(O.query([O.RAW, O.CORE], "SELECT entity_size, count(DISTINCT entity_id) AS n_entities FROM core GROUP BY 1"))
def entity_size_dist(spark, d):
    return mart.profile_core(raw_events(spark, d)).select("entity_id", "entity_size").distinct().groupBy("entity_size").agg(F.count(F.lit(1)).alias("n_entities"))


@register(O.query([O.RAW, O.EV], """SELECT feature, count(DISTINCT profile_id) AS n_profiles, round(count(DISTINCT profile_id) FILTER (n > 1) / count(DISTINCT profile_id), 6) AS multi_value_share
  FROM (SELECT profile_id, feature, count(DISTINCT value_norm) AS n FROM ev WHERE source = 'identity' GROUP BY 1, 2) GROUP BY 1"""))
def identity_coverage(spark, d):
    rows = values.event_values(raw_events(spark, d)).filter("source = 'identity'").groupBy("profile_id", "feature").agg(F.countDistinct("value_norm").alias("n"))
    return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n_profiles"), F.round(F.count_if(F.col("n") > 1) / F.count(F.lit(1)), 6).alias("multi_value_share"))


@register(O.query([O.RAW], "SELECT split_part(email, '@', 2) AS domain, round(count(*) FILTER (sex = 'male') / count(*), 6) AS male, round(count(*) FILTER (sex = 'female') / count(*), 6) AS female FROM raw GROUP BY 1"))
def sex_crosstab(spark, d):
    share = lambda s: F.round(F.count_if(F.col("sex") == s) / F.count(F.lit(1)), 6).alias(s)
    return raw_events(spark, d).groupBy(X.email_domain_second("email").alias("domain")).agg(share("male"), share("female"))


@register(O.query([O.RAW], "SELECT entity_id, round(epoch(max(created_at) - min(created_at)) / 3600, 4) AS span_hours FROM raw GROUP BY 1 HAVING count(*) >= 2"))
def time_span_hours(spark, d):
    at = lambda f: F.unix_micros(f("created_at").cast("timestamp"))
    rows = raw_events(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.round((at(F.max) - at(F.min)) / 3.6e9, 4).alias("span_hours"))
    return rows.filter("n >= 2").select("entity_id", "span_hours")


_COLUMNS = ["profile_id", "entity_id", "email", "phone", "sex"]


@register(O.query([O.RAW], " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(1 - count({c}) / count(*), 6) AS null_share, count(DISTINCT {c}) AS n_unique FROM raw" for c in _COLUMNS)))
def column_profile(spark, d):
    return stats.column_profile(raw_events(spark, d), _COLUMNS)


@register("SELECT c_mktsegment, count(*) AS n, " + ", ".join(f"round(quantile_cont(c_acctbal, {q}), 6) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + " FROM customer GROUP BY 1")
def quantiles_customer(spark, d):
    q = [F.round(F.percentile("c_acctbal", p), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.95, 0.99)]
    return table(spark, d, "customer", ["c_mktsegment", "c_acctbal"]).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), *q)


@register(O.query([O.RAW, O.EV], "SELECT value_norm AS phone, count(DISTINCT profile_id) AS n_profiles FROM ev WHERE source = 'identity' AND feature = 'phone' GROUP BY 1 HAVING count(DISTINCT profile_id) > 1"))
def phones_on_many_profiles(spark, d):
    rows = values.event_values(raw_events(spark, d)).filter("source = 'identity' and feature = 'phone'")
    return rows.groupBy(F.col("value_norm").alias("phone")).agg(F.countDistinct("profile_id").alias("n_profiles")).filter("n_profiles > 1")


# --- blocking


def profile_values(spark, d) -> DataFrame:
    return values.profile_values(raw_events(spark, d))


INDEX_SQL = "profile_id, block_family, block_rule, block_value, block_size, round(block_weight, 6) AS block_weight"


def shown(index: DataFrame) -> DataFrame:
    return index.withColumn("block_weight", F.round("block_weight", 6))


@register(O.query(O.BASE, "SELECT profile_id, source, feature, value_norm FROM pv"))
def profile_values_long(spark, d):
    return profile_values(spark, d)


_ATOMIC = [r for r in R.catalogue() if len(r.parts) == 1]


@register(O.query([*O.BASE, O.block_rows(_ATOMIC)], "SELECT * FROM rows"))
def block_atomic(spark, d):
    return blocking.block_rows(profile_values(spark, d), _ATOMIC)


_COMPOSITE = [r for r in R.catalogue() if len(r.parts) > 1]


@register(O.query([*O.BASE, O.block_rows(_COMPOSITE)], "SELECT * FROM rows"))
def block_composite(spark, d):
    return blocking.block_rows(profile_values(spark, d), _COMPOSITE)


@register(O.query([*O.BASE, O.block_rows(_ATOMIC), O.limited(most=100)], f"SELECT {INDEX_SQL} FROM idx"))
def block_limits(spark, d):
    return shown(blocking.blocking_index(profile_values(spark, d), _ATOMIC, 2, 100))


@register(O.query([*O.BASE, O.block_rows(_ATOMIC)], "SELECT block_rule, block_value, count(DISTINCT profile_id) AS block_size, round(1 / ln(1 + greatest(count(DISTINCT profile_id), 1)), 6) AS block_weight FROM rows GROUP BY 1, 2"))
def block_stats(spark, d):
    sizes = blocking.block_rows(profile_values(spark, d), _ATOMIC).groupBy("block_rule", "block_value").agg(F.count(F.lit(1)).alias("block_size"))
    return sizes.withColumn("block_weight", F.round(1 / F.log1p(F.col("block_size").cast("double")), 6))


@register(O.query([*O.BASE, O.block_rows(R.recommended()), O.limited()], f"SELECT {INDEX_SQL} FROM idx"))
def blocking_index_full(spark, d):
    return shown(blocking.blocking_index(profile_values(spark, d), R.recommended()))


def rich_index(raw: DataFrame) -> DataFrame:
    """The index of all rules, written once: reports read it several times."""
    rows = graph.written(blocking.block_rows(graph.written(values.profile_values(raw)), R.catalogue()))
    return graph.written(blocking.limited(rows))


_SIZES = """sz AS (SELECT block_rule, block_family, count(*) AS n_blocks, max(n) AS max_block_size, sum(n * (n - 1) // 2)::BIGINT AS candidate_pairs
  FROM (SELECT block_rule, block_family, block_value, max(block_size) AS n FROM idx GROUP BY 1, 2, 3) GROUP BY 1, 2),
cov AS (SELECT block_rule, count(DISTINCT profile_id) AS n_covered FROM idx GROUP BY 1),
np AS (SELECT count(DISTINCT profile_id) AS n FROM raw)"""


@register(O.query([*O.RICH_BASE, O.block_rows(R.catalogue()), O.limited(), _SIZES], "SELECT sz.*, n_covered, round(n_covered / np.n, 6) AS profile_coverage FROM sz JOIN cov USING (block_rule), np"))
def rule_size_report(spark, d):
    raw = rich_events(spark, d)
    n = raw.select("profile_id").distinct().count()
    return blocking.rule_sizes(rich_index(raw), n).withColumn("profile_coverage", F.round("profile_coverage", 6))


_QUALITY = """pos AS (SELECT DISTINCT a.block_rule, p.entity_id, a.profile_id AS l, b.profile_id AS r FROM idx a JOIN idx b USING (block_rule, block_value)
    JOIN core p ON p.profile_id = a.profile_id JOIN core q ON q.profile_id = b.profile_id AND q.entity_id = p.entity_id WHERE a.profile_id < b.profile_id),
cap AS (SELECT block_rule, count(*) AS positive_pairs_captured, count(DISTINCT entity_id) AS entities_captured FROM pos GROUP BY 1),
tot AS (SELECT sum(k * (k - 1) // 2) AS p, count(*) AS e FROM (SELECT count(*) AS k FROM core GROUP BY entity_id HAVING count(*) > 1)),
qual AS (SELECT sz.block_rule, sz.block_family, n_blocks, max_block_size, candidate_pairs, coalesce(positive_pairs_captured, 0) AS positive_pairs_captured, coalesce(entities_captured, 0) AS entities_captured,
  round(coalesce(positive_pairs_captured, 0) / tot.p, 6) AS pair_recall, round(coalesce(entities_captured, 0) / tot.e, 6) AS client_recall,
  round(CASE WHEN positive_pairs_captured > 0 THEN candidate_pairs / positive_pairs_captured END, 6) AS pairs_per_positive,
  (candidate_pairs <= 6000000 AND max_block_size <= 1000 AND block_family <> 'identity_rescue') OR sz.block_rule = 'rule__identity_rescue__phone_digits' AS is_recommended,
  CASE WHEN sz.block_rule = 'rule__identity_rescue__phone_digits' THEN 'rescue' WHEN candidate_pairs <= 6000000 AND max_block_size <= 1000 AND block_family <> 'identity_rescue' THEN 'limits' ELSE 'too_broad' END AS selection_reason
  FROM sz LEFT JOIN cap USING (block_rule), tot)"""
_QUALITY_PARTS = [*O.RICH_BASE, O.block_rows(R.catalogue()), O.limited(), _SIZES, _QUALITY]


def _quality(spark, d) -> DataFrame:
    raw = rich_events(spark, d)
    return blocking.rule_quality(rich_index(raw), graph.written(mart.profile_core(raw)))


@register(O.query(_QUALITY_PARTS, "SELECT * EXCLUDE (is_recommended, selection_reason) FROM qual"))
def rule_quality_report(spark, d):
    rows = _quality(spark, d).withColumns({c: F.round(c, 6) for c in ("pair_recall", "client_recall", "pairs_per_positive")})
    return rows.drop("is_recommended", "selection_reason", "n_covered", "profile_coverage")


@register(O.query(_QUALITY_PARTS, "SELECT block_rule, is_recommended, selection_reason FROM qual"))
def rule_selection(spark, d):
    return _quality(spark, d).select("block_rule", "is_recommended", "selection_reason")


# --- candidates

_EVENT = ["profile_id_l", "profile_id_r", "block_family", "block_rule", "block_value", "block_size", "match_scope"]


@register(O.query([*O.BASE, O.block_rows(PAIR_RULES), O.limited(), O.INTERNAL], f"SELECT {', '.join(_EVENT)} FROM internal"))
def pairs_internal(spark, d):
    return candidates.internal_hits(profile_values(spark, d), PAIR_RULES).select(*_EVENT)


def split_rows(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Values, packet rows, limited packet index and limited history index of the pair rules."""
    pv = graph.written(profile_values(spark, d))  # read by blocking and twice by similarity
    rows = graph.written(blocking.block_rows(pv, PAIR_RULES))
    packet = F.col("profile_id").endswith("_0")
    return pv, rows.filter(packet), blocking.limited(rows.filter(packet)), blocking.limited(rows.filter(~packet))


_ACROSS = [*O.BASE, O.block_rows(PAIR_RULES), O.PACKET, O.limited("hrows", "hidx"), O.HISTORY]


@register(O.query(_ACROSS, f"SELECT {', '.join(_EVENT)} FROM across"))
def pairs_history(spark, d):
    return candidates.history_hits(profile_values(spark, d), PAIR_RULES, F.col("profile_id").endswith("_0")).select(*_EVENT)


def best_history(spark, d) -> DataFrame:
    """All events of the five best history pairs of each packet profile."""
    pv = graph.written(profile_values(spark, d))
    return paircount.kept_history_events(pv, PAIR_RULES, F.col("profile_id").endswith("_0"), 5)


@register(O.query([*_ACROSS, *O.kept(5)], f"SELECT {', '.join(_EVENT)} FROM history_events"))
def history_cap_per_profile(spark, d):
    return best_history(spark, d).select(*_EVENT)


@register(O.query([*_ACROSS, *O.kept(5, 100)], f"SELECT {', '.join(_EVENT)} FROM history_events"))
def history_cap_global(spark, d):
    return candidates.limit_history(graph.written(best_history(spark, d)), R.STRONG, None, 100).select(*_EVENT)


_HOPS = [("identity", "phone"), ("np", "geoname_id")]
_HOP_SQL = """held AS (SELECT * FROM pv WHERE source || '__' || feature IN ('identity__phone', 'np__geoname_id')),
hops AS (SELECT DISTINCT a.profile_id AS profile_id_l, b.profile_id AS profile_id_r FROM held a JOIN held b USING (source, feature, value_norm)
  JOIN (SELECT source, feature, value_norm FROM held GROUP BY 1, 2, 3 HAVING count(*) BETWEEN 2 AND 200) s USING (source, feature, value_norm) WHERE a.profile_id < b.profile_id)"""


@register(O.query([*O.BASE, _HOP_SQL], "SELECT * FROM hops"))
def pairs_2hop(spark, d):
    return candidates.two_hop_pairs(profile_values(spark, d), _HOPS)


@register("SELECT a.s_suppkey AS profile_id_l, b.s_suppkey AS profile_id_r FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")
def pairs_all_small(spark, d):
    return candidates.all_pairs(table(spark, d, "supplier", ["s_suppkey"]), "s_suppkey", None)


@register("SELECT 7::BIGINT AS profile_id_l, s_suppkey AS profile_id_r FROM supplier WHERE s_suppkey <> 7")
def pairs_one_against_all(spark, d):
    return candidates.one_against_all(table(spark, d, "supplier", ["s_suppkey"]), "s_suppkey", F.lit(7).cast("long"))


@register(O.query([*O.BASE, _HOP_SQL, O.block_rows(FLAGSHIP_RULE), O.limited(), O.INTERNAL], "SELECT * FROM hops UNION SELECT profile_id_l, profile_id_r FROM internal"))
def candidate_union(spark, d):
    pv = profile_values(spark, d)
    return candidates.candidate_union(candidates.two_hop_pairs(pv, _HOPS), candidates.internal_pairs(blocking.blocking_index(pv, FLAGSHIP_RULE)))


@register("""WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM u)
SELECT q, r, cosine, rank FROM (SELECT q.vec_id AS q, r.vec_id AS r, round(list_dot_product(q.e, r.e) / (q.n * r.n + 1e-12), 6) AS cosine,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, r.e) / (q.n * r.n + 1e-12), 6) DESC, r.vec_id) AS rank FROM n q JOIN n r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 10""")
def knn_cosine(spark, d):
    rows = table(spark, d, "embeddings", ["vec_id", "embedding"])
    return candidates.nearest(rows.filter("vec_id % 20 = 0"), rows, 10)


@register(O.query([O.RAW], "SELECT DISTINCT profile_id, profile_id LIKE '%\\_0' ESCAPE '\\' AS in_packet FROM raw WHERE entity_id IN (SELECT entity_id FROM raw WHERE phone IS NOT NULL) AND profile_id NOT IN (SELECT profile_id FROM raw WHERE phone IS NOT NULL)"))
def semi_anti_packet(spark, d):
    raw = raw_events(spark, d)
    phones = raw.filter("phone is not null")
    rows = raw.select("profile_id", "entity_id").distinct().join(phones.select("entity_id"), "entity_id", "left_semi").join(phones.select("profile_id"), "profile_id", "left_anti")
    return rows.select("profile_id", F.col("profile_id").endswith("_0").alias("in_packet"))


# --- evidence and similarity


def all_events(spark, d) -> tuple[DataFrame, DataFrame]:
    pv, prows, pidx, hidx = split_rows(spark, d)
    across = candidates.limit_history(candidates.history_pairs(prows, hidx), R.STRONG, PER_PROFILE)
    return graph.written(candidates.internal_pairs(pidx).unionByName(across)), pv


def counted(spark, d, similar: bool = False) -> DataFrame:
    """Evidence of packet pairs and of the best history pairs, counted without a row per block hit."""
    pv = paircount.settled(profile_values(spark, d))
    group = evidence.value_group() if similar else None
    return evidence.pair_flags(paircount.counted_pairs(pv, PAIR_RULES, F.col("profile_id").endswith("_0"), PER_PROFILE, group))


CHAIN = O.pair_chain(PAIR_RULES, PER_PROFILE)
_COUNT_COLUMNS = ["profile_id_l", "profile_id_r", "hits", "n_block_rules", "n_block_families", "min_block_size", "sum_block_weight", "n_small_blocks_le2", "n_small_blocks_le5",
                  "n_small_blocks_le10", "n_strong_family_hits", "n_weak_family_hits", "n_time_aware_hits", "n_registration_time_window_hits", "n_postman_hits"]


def six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register(O.query(CHAIN, "SELECT " + ", ".join("round(sum_block_weight, 6) AS sum_block_weight" if c == "sum_block_weight" else c for c in _COUNT_COLUMNS) + " FROM evid"))
def pair_evidence_counts(spark, d):
    return six(counted(spark, d).select(*_COUNT_COLUMNS), "sum_block_weight")


_SHARES = [c for c in evidence.MODEL_FEATURES if c.endswith("_share") or "_share_" in c]
_FLAGS = [c for c in evidence.MODEL_FEATURES if c not in _COUNT_COLUMNS and c not in _SHARES and not c.startswith(("fs_", "geo_", "identity_"))]


@register(O.query(CHAIN, "SELECT profile_id_l, profile_id_r, " + ", ".join([*_FLAGS, *(f"round({c}, 6) AS {c}" for c in _SHARES)]) + " FROM evid"))
def pair_evidence_flags(spark, d):
    return six(counted(spark, d).select(*evidence.PAIR, *_FLAGS, *_SHARES), *_SHARES)


@register(O.query(CHAIN, "SELECT pair_key, rules_key, match_scopes FROM evid"))
def pair_rules_key(spark, d):
    return counted(spark, d).select("pair_key", "rules_key", "match_scopes")


@register(O.query(CHAIN, "SELECT pair_key, only_weak_families, registration_time_window_only, array_to_string(families, '|') AS families FROM evid"))
def family_subset_flags(spark, d):
    pv = paircount.settled(profile_values(spark, d))
    rows = paircount.shared_families(pv, PAIR_RULES, F.col("profile_id").endswith("_0"), PER_PROFILE).withColumns(evidence.family_flags())
    return rows.select(F.concat_ws("|", *evidence.PAIR).alias("pair_key"), "only_weak_families", "registration_time_window_only", F.array_join("families", "|").alias("families"))


_SIM = ["fs_total_jaccard", "geo_total_jaccard"]


@register(O.query(CHAIN, "SELECT profile_id_l, profile_id_r, round(fs_total_jaccard, 6) AS fs_total_jaccard, round(geo_total_jaccard, 6) AS geo_total_jaccard, fs_shared_count, identity_email_match, identity_phone_match, identity_strong_match FROM sim"))
def pair_similarity_pooled(spark, d):
    return six(counted(spark, d, similar=True).select(*evidence.PAIR, *evidence.similarities()), *_SIM)


_NUMBERS = ["n_city", "n_browser"]


def _set_pair_sql() -> str:
    out = []
    for k in ("device", "city", "browser"):
        i, u = f"len(list_intersect(a.{k}, b.{k}))", f"len(list_distinct(list_concat(a.{k}, b.{k})))"
        out.append(f"({i} > 0)::INTEGER AS {k}_same_any, {i} AS {k}_common_cnt, round({i} / {u}, 6) AS {k}_jaccard, round({i} / least(len(a.{k}), len(b.{k})), 6) AS {k}_overlap")
    return ", ".join(out)


_LISTS = "lists AS (SELECT profile_id, " + ", ".join(f"list_sort(coalesce(list(DISTINCT value_norm) FILTER (source = '{s}' AND feature = '{f}'), [])) AS {k}" for k, (s, f) in _SETS.items() if k in ("device", "city", "browser")) + " FROM pv GROUP BY 1)"
_SET_PARTS = [*O.BASE, O.block_rows(FLAGSHIP_RULE), O.limited(), O.INTERNAL, _LISTS]
_SET_FROM = "FROM (SELECT DISTINCT profile_id_l, profile_id_r FROM internal) i JOIN lists a ON a.profile_id = profile_id_l JOIN lists b ON b.profile_id = profile_id_r"


def _set_pairs(spark, d, sets, numbers) -> DataFrame:
    pv = profile_values(spark, d)
    pairs = candidates.internal_pairs(blocking.blocking_index(pv, FLAGSHIP_RULE)).select(*evidence.PAIR).distinct()
    return evidence.profile_pair_features(pairs, mart.profile_sets(pv, {k: _SETS[k] for k in ("device", "city", "browser")}), sets, numbers)


@register(O.query(_SET_PARTS, f"SELECT profile_id_l, profile_id_r, {_set_pair_sql()} {_SET_FROM}"))
def set_jaccard_overlap(spark, d):
    sets = ["device", "city", "browser"]
    return six(_set_pairs(spark, d, sets, []), *[f"{k}_{m}" for k in sets for m in ("jaccard", "overlap")])


@register(O.query(_SET_PARTS, "SELECT profile_id_l, profile_id_r, " + ", ".join(f"abs(len(a.{c}) - len(b.{c})) AS n_{c}_diff, least(len(a.{c}), len(b.{c})) AS n_{c}_min, greatest(len(a.{c}), len(b.{c})) AS n_{c}_max" for c in ("city", "browser")) + " " + _SET_FROM))
def pair_numeric_diff(spark, d):
    return _set_pairs(spark, d, [], _NUMBERS)


@register("""WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id AS l, b.vec_id AS r, round(list_dot_product(a.e, b.e), 6) AS dot, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) + 1e-9), 6) AS cosine,
  round(list_distance(a.e, b.e), 6) AS l2, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2]))), 6) AS l1 FROM u a JOIN u b ON a.vec_id + 1 = b.vec_id""")
def embedding_pair_features(spark, d):
    rows = table(spark, d, "embeddings", ["vec_id", "embedding"])
    pairs = rows.select(F.col("vec_id").alias("l"), (F.col("vec_id") + 1).alias("r"), F.col("embedding").alias("a")).join(rows.select(F.col("vec_id").alias("r"), F.col("embedding").alias("b")), "r")
    return six(evidence.embedding_pair_features(pairs), "dot", "cosine", "l2", "l1").select("l", "r", "dot", "cosine", "l2", "l1")


# --- scores, graph, assignment


def _scoring(spark, d) -> tuple:
    return graph.written(profile_values(spark, d)), PAIR_RULES, F.col("profile_id").endswith("_0"), PER_PROFILE, evidence.value_group(), LogisticScorer()


def scored_pairs(spark, d, best: int | None = None) -> DataFrame:
    """(profile_id_l, profile_id_r, score) of every candidate pair, or at least of those among the ``best`` best of either end, written once: graphs read it several times."""
    return graph.written(paircount.scored_pairs(*_scoring(spark, d), best=best))


@register(O.query(CHAIN, "SELECT profile_id_l, profile_id_r, round(score, 6) AS score FROM scored"))
def scored_pairs_logistic(spark, d):
    return six(paircount.scored_pairs(*_scoring(spark, d)), "score")


@register(O.query(CHAIN, f"SELECT profile_id_l, profile_id_r FROM scored WHERE score >= {THRESHOLD}"))
def edges_threshold(spark, d):
    return paircount.scored_pairs(*_scoring(spark, d), least=THRESHOLD).select(*evidence.PAIR)


@register(O.query([*CHAIN, O.mutual(THRESHOLD, 2)], "SELECT profile_id_l, profile_id_r, round(score, 6) AS score FROM edges"))
def mutual_topk(spark, d):
    return six(graph.mutual_top_k(scored_pairs(spark, d, 2), THRESHOLD, 2).select(*evidence.PAIR, "score"), "score")


def _packet(spark, d) -> DataFrame:
    return raw_events(spark, d).filter(F.col("profile_id").endswith("_0")).select("profile_id", "entity_id").distinct()


def _history(spark, d) -> DataFrame:
    return raw_events(spark, d).filter(~F.col("profile_id").endswith("_0")).select("profile_id", "entity_id").distinct()


def resolved(spark, d, k: int = 1, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored pairs, edges and components; edges and best scores need only the k best pairs of each profile."""
    scored = scored_pairs(spark, d, None if whole else k)
    edges = graph.mutual_top_k(scored, THRESHOLD, k)
    return scored, edges, graph.connected_components(_packet(spark, d), edges)


GRAPH = [*CHAIN, O.mutual(THRESHOLD, 1), O.COMPONENTS]
GRAPH2 = [*CHAIN, O.mutual(THRESHOLD, 2), O.COMPONENTS]


@register(O.query(GRAPH2, "SELECT profile_id, component FROM comps"))
def connected_components(spark, d):
    return resolved(spark, d, 2)[2]


_SIZE_SQL = "count(*) FILTER (n >= 2) AS merge_groups_total, count(*) FILTER (n = 2) AS merge_groups_size_2, count(*) FILTER (n >= 3) AS merge_groups_size_3_plus, coalesce(max(n), 0) AS max_group_size"


@register(O.query(GRAPH2, f"SELECT {_SIZE_SQL} FROM (SELECT component, count(*) AS n FROM comps GROUP BY 1)"))
def component_sizes(spark, d):
    return graph.component_sizes(resolved(spark, d, 2)[2])


@register(O.query([*GRAPH2, O.ASSIGN], "SELECT * REPLACE (round(best_match_score, 6) AS best_match_score) FROM assignment"))
def assignment(spark, d):
    scored, _, comps = resolved(spark, d, 2)
    return six(graph.assign(_packet(spark, d), _history(spark, d), comps, scored), "best_match_score")


@register(O.query([*GRAPH, O.ASSIGN], "SELECT profile_id, round(best, 6) AS best_match_score FROM bests"))
def best_match_score(spark, d):
    return six(graph.best_scores(scored_pairs(spark, d, 1)), "best_match_score")


@register(O.query(GRAPH, """SELECT component, count(*) AS n_profiles, round(max(s), 6) AS max_score, CASE WHEN max(s) >= 0.98 THEN 'merge' ELSE 'review' END AS action
  FROM comps JOIN (SELECT component, max(score) AS s FROM edges JOIN comps ON profile_id = profile_id_l GROUP BY 1) USING (component) GROUP BY 1 HAVING count(*) >= 2 ORDER BY max(s) DESC, count(*) DESC, component LIMIT 50"""))
def merge_groups(spark, d):
    _, edges, comps = resolved(spark, d)
    return six(graph.merge_groups(comps, edges, THRESHOLD), "max_score")


@register(O.query(GRAPH, """, m AS (SELECT profile_id AS member, component AS grp FROM comps WHERE component IN (SELECT component FROM comps GROUP BY 1 HAVING count(*) = 2)),
linked AS (SELECT profile_id_l AS p FROM edges UNION SELECT profile_id_r FROM edges),
st AS (SELECT profile_id_l AS member, profile_id_r AS outsider, profile_id_l, profile_id_r FROM scored WHERE score >= 0.1 UNION ALL SELECT profile_id_r, profile_id_l, profile_id_l, profile_id_r FROM scored WHERE score >= 0.1),
lk AS (SELECT * FROM st JOIN m USING (member) WHERE outsider NOT IN (SELECT p FROM linked)),
offers AS (SELECT outsider, grp FROM lk GROUP BY 1, 2 HAVING count(DISTINCT member) = 2), sole AS (SELECT outsider, max(grp) AS grp FROM offers GROUP BY 1 HAVING count(*) = 1)
SELECT DISTINCT profile_id_l, profile_id_r FROM lk JOIN sole USING (outsider, grp)"""))
def two_link_extension(spark, d):
    scored, edges, comps = resolved(spark, d, whole=True)
    return graph.extend_by_two_links(edges, comps, scored, 0.1)


# --- evaluation


def labelled_scores(spark, d) -> DataFrame:
    """(score, label, n): the number of labelled pairs of each score."""
    return paircount.score_counts(*_scoring(spark, d), mart.profile_core(raw_events(spark, d)))


def labelled_pairs(spark, d) -> DataFrame:
    core = mart.profile_core(raw_events(spark, d))
    return training.labelled(scored_pairs(spark, d).select(*evidence.PAIR, "score"), core)


LABELLED = [*CHAIN, O.LABELLED]
_CONFUSION = "count(*) FILTER (score >= {t} AND label = 1) AS tp, count(*) FILTER (score >= {t} AND label = 0) AS fp, count(*) FILTER (score < {t} AND label = 1) AS fn"


@register(O.query(LABELLED, f"SELECT *, {O.RATIOS} FROM (SELECT {_CONFUSION.format(t=THRESHOLD)}, count(*) FILTER (score < {THRESHOLD} AND label = 0) AS tn FROM labelled)"))
def confusion_prf(spark, d):
    return evaluate.confusion(labelled_scores(spark, d), THRESHOLD, n="n")


_PACKET_CORE = "SELECT a.profile_id AS l, b.profile_id AS r FROM core a JOIN core b USING (entity_id) WHERE a.profile_id < b.profile_id AND (a.profile_id LIKE '%\\_0' ESCAPE '\\' OR b.profile_id LIKE '%\\_0' ESCAPE '\\')"


@register(O.query([*GRAPH, f"tru AS ({_PACKET_CORE})", "prd AS (SELECT a.profile_id AS l, b.profile_id AS r FROM comps a JOIN comps b USING (component) WHERE a.profile_id < b.profile_id AND (a.profile_id LIKE '%\\_0' ESCAPE '\\' OR b.profile_id LIKE '%\\_0' ESCAPE '\\'))"],
    f"SELECT *, {O.RATIOS} FROM (SELECT (SELECT count(*) FROM (FROM prd INTERSECT FROM tru)) AS tp, (SELECT count(*) FROM (FROM prd EXCEPT FROM tru)) AS fp, (SELECT count(*) FROM (FROM tru EXCEPT FROM prd)) AS fn)"))
def eval_pair_level(spark, d):
    _, _, comps = resolved(spark, d)
    packet = _packet(spark, d)
    true = blocking.positive_pairs(mart.profile_core(raw_events(spark, d))).filter(F.col("profile_id_l").endswith("_0") | F.col("profile_id_r").endswith("_0"))
    return evaluate.pair_level(evaluate.pairs_in_components(comps, packet), true)


@register(O.query([*GRAPH, """mg AS (SELECT component, count(*) AS n, count(DISTINCT entity_id) AS e, min(entity_id) AS entity_id, count(*) FILTER (c.profile_id LIKE '%\\_0' ESCAPE '\\') AS t
    FROM comps c JOIN core k ON k.profile_id = c.profile_id GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (c.profile_id LIKE '%\\_0' ESCAPE '\\') > 0),
  own2 AS (SELECT entity_id FROM core GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (profile_id LIKE '%\\_0' ESCAPE '\\') > 0)"""],
    f"SELECT *, {O.RATIOS} FROM (SELECT (SELECT count(*) FROM mg WHERE e = 1) AS tp, (SELECT count(*) FROM mg WHERE e > 1) AS fp, (SELECT count(*) FROM own2 WHERE entity_id NOT IN (SELECT entity_id FROM mg WHERE e = 1)) AS fn)"))
def eval_merge_level(spark, d):
    return evaluate.merge_level(resolved(spark, d)[2], mart.profile_core(raw_events(spark, d)), _packet(spark, d))


@register(O.query([*GRAPH, O.ASSIGN, """tru AS (SELECT a.*, k.entity_id, k.entity_id IN (SELECT entity_id FROM known) AS should, decision = 'matched_existing' AND coalesce(predicted_entity_id = k.entity_id, false) AS correct, decision = 'new_client' AS isnew
    FROM assignment a JOIN core k USING (profile_id)), ent AS (SELECT entity_id, should, bool_or(correct) AS found, bool_and(isnew) AS alln FROM tru GROUP BY 1, 2)"""],
    """SELECT * FROM (SELECT count(*) AS profiles_total, count(*) FILTER (should) AS existing_profiles_total, count(*) FILTER (should AND correct) AS existing_profiles_found, count(*) FILTER (NOT should) AS new_profiles_total,
  count(*) FILTER (NOT should AND isnew) AS new_profiles_correct, count(*) FILTER (decision = 'matched_existing' AND NOT correct) AS wrong_attachments, count(*) FILTER (decision = 'ambiguous') AS ambiguous_profiles FROM tru),
 (SELECT count(*) FILTER (should) AS existing_entities_total, count(*) FILTER (should AND found) AS existing_entities_found, count(*) FILTER (NOT should) AS new_entities_total, count(*) FILTER (NOT should AND alln) AS new_entities_correct FROM ent)"""))  # fmt: skip
def eval_assignment(spark, d):
    scored, _, comps = resolved(spark, d)
    packet, history = _packet(spark, d), _history(spark, d)
    return evaluate.assignment_quality(graph.assign(packet, history, comps, scored), packet, history)


_GRID, _KS = evaluate.grid(0.05, 0.4, 0.05), [1, 2, 3]
_SWEEP = f"""ends AS (SELECT profile_id_l AS p, profile_id_r AS q, * FROM labelled UNION ALL SELECT profile_id_r, profile_id_l, * FROM labelled),
ranked AS (SELECT profile_id_l, profile_id_r, score, label, max(r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, q) AS r FROM ends) GROUP BY ALL),
swept AS (SELECT k, threshold, tp, fp, fn, {O.RATIOS} FROM (SELECT k, t AS threshold, count(*) FILTER (score >= t AND r <= k AND label = 1) AS tp, count(*) FILTER (score >= t AND r <= k AND label = 0) AS fp,
  count(*) FILTER (NOT (score >= t AND r <= k) AND label = 1) AS fn FROM ranked, (SELECT unnest({_KS}) AS k), (SELECT unnest({_GRID})::DOUBLE AS t) GROUP BY 1, 2))"""


@register(O.query([*LABELLED, _SWEEP], "SELECT * FROM swept"))
def threshold_sweep(spark, d):
    return evaluate.sweep(labelled_pairs(spark, d), _GRID, _KS)


@register(O.query([*LABELLED, _SWEEP], """SELECT k, round(sum(greatest(recall - before, 0) * p), 6) AS pr_auc FROM (SELECT k, recall, p, lag(recall, 1, 0.0) OVER (PARTITION BY k ORDER BY recall) AS before
  FROM (SELECT k, recall, max(precision) AS p FROM swept GROUP BY 1, 2)) GROUP BY 1"""))
def step_pr_auc(spark, d):
    return evaluate.step_pr_auc(evaluate.sweep(labelled_pairs(spark, d), _GRID, _KS))


@register(O.query(LABELLED, """SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM labelled GROUP BY 1))"""))
def roc_auc(spark, d):
    return evaluate.roc_auc(labelled_scores(spark, d), n="n")


@register(O.query(LABELLED, """SELECT round(sum(pos * tp / n) / sum(pos), 6) AS average_precision FROM (SELECT pos, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS n
  FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM labelled GROUP BY 1) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""))
def average_precision(spark, d):
    return evaluate.average_precision(labelled_scores(spark, d), n="n")


# --- training


@register(O.query([O.RAW, O.CORE], f"SELECT profile_id, entity_id, {SPLIT_SQL} AS split FROM core"))
def md5_entity_split(spark, d):
    return mart.profile_core(raw_events(spark, d)).select("profile_id", "entity_id", training.md5_split().alias("split"))


@register(O.query([*O.BASE], f"SELECT profile_id, source, feature, value_norm FROM pv WHERE profile_id IN (SELECT profile_id FROM core WHERE {SPLIT_SQL} = 'train') AND (source, feature) IN ({', '.join(str(p) for p in evidence.PAIR_FEATURES)})"))
def split_scope(spark, d):
    raw = raw_events(spark, d)
    wanted = F.concat_ws("__", "source", "feature").isin(*[f"{s}__{f}" for s, f in evidence.PAIR_FEATURES])
    return training.scoped(values.profile_values(raw).filter(wanted), mart.profile_core(raw), "train")


@register(O.query([O.RAW, O.CORE], "SELECT a.profile_id AS profile_id_l, b.profile_id AS profile_id_r, entity_id FROM core a JOIN core b USING (entity_id) WHERE a.profile_id < b.profile_id"))
def positive_pairs(spark, d):
    return blocking.positive_pairs(mart.profile_core(raw_events(spark, d)))


@register(O.query(CHAIN, "SELECT block_rule, count(*) AS n_pairs, split_part(block_rule, '__', 2) AS block_family FROM (SELECT unnest(rules) AS block_rule FROM evid) GROUP BY 1 ORDER BY n_pairs DESC, block_rule LIMIT 30"))
def rule_usage(spark, d):
    return blocking.rule_usage(counted(spark, d))


@register(O.query([*LABELLED, O.mutual(THRESHOLD, 1)], "SELECT profile_id_l, profile_id_r, label FROM labelled SEMI JOIN edges USING (profile_id_l, profile_id_r)"))
def labelled_accepted_pairs(spark, d):
    rows = graph.mutual_top_k(scored_pairs(spark, d, 1), THRESHOLD, 1).select(*evidence.PAIR)
    return training.labelled(rows, mart.profile_core(raw_events(spark, d)))


@register()
def training_pairs_crc32(spark, d):
    return training.select_training_pairs(labelled_pairs(spark, d), 500)


@register()
def test_packet_builder(spark, d):
    return training.test_packet(mart.profile_core(raw_events(spark, d)), 20, 0.3)


@register()
def hash_split_strata(spark, d):
    core = mart.profile_core(raw_events(spark, d))
    return training.hash_split(core, "entity_id", "entity_kind", {"train": 0.6, "valid": 0.2, "test": 0.2}).select("profile_id", "entity_id", "split")


# --- statistics


@register("""WITH c AS (SELECT hour(ts) AS a, event_type AS b, count(*) AS o FROM events GROUP BY ALL), r AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS cb FROM c GROUP BY 1), n AS (SELECT sum(o) AS n FROM c)
SELECT round(sum((coalesce(o, 0) - ra * cb / n) ** 2 / (ra * cb / n)), 6) AS chi2, (count(DISTINCT r.a) - 1) * (count(DISTINCT k.b) - 1) AS dof FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c ON c.a = r.a AND c.b = k.b""")
def chi2_hour_by_type(spark, d):
    return stats.chi_square(table(spark, d, "events", ["ts", "event_type"]).withColumn("hour", F.hour("ts")), "hour", "event_type")


@register("""WITH v AS (SELECT n_chars, count(*) FILTER (lang = 'en') AS x, count(*) FILTER (lang = 'de') AS y FROM documents WHERE lang IN ('en', 'de') AND n_chars IS NOT NULL GROUP BY 1),
c AS (SELECT sum(x) OVER w AS cx, sum(y) OVER w AS cy FROM v WINDOW w AS (ORDER BY n_chars ROWS UNBOUNDED PRECEDING))
SELECT round(max(abs(cx / (SELECT sum(x) FROM v) - cy / (SELECT sum(y) FROM v))), 6) AS ks, (SELECT sum(x) FROM v)::BIGINT AS n_first, (SELECT sum(y) FROM v)::BIGINT AS n_second FROM c""")
def ks_two_sample(spark, d):
    return stats.ks_two_sample(table(spark, d, "documents", ["n_chars", "lang"]), "n_chars", "lang", "en", "de")


@register(O.query([*O.BASE, O.block_rows(PAIR_RULES), O.limited(), """prs AS (SELECT DISTINCT block_rule, a.profile_id AS l, b.profile_id AS r FROM idx a JOIN idx b USING (block_rule, block_value) WHERE a.profile_id < b.profile_id),
  base AS (SELECT (SELECT sum(k * (k - 1) // 2) FROM (SELECT count(*) AS k FROM core GROUP BY entity_id)) / ((SELECT count(*) FROM core) * ((SELECT count(*) FROM core) - 1) // 2) AS b),
  p95 AS (SELECT block_rule, round(quantile_cont(s, 0.95), 6) AS p95_block_size FROM (SELECT block_rule, block_value, max(block_size) AS s FROM idx GROUP BY 1, 2) GROUP BY 1)"""],
    """SELECT block_rule, candidate_pairs, positive_pairs, p95_block_size, round(positive_pairs / candidate_pairs, 6) AS observed_rate, round(positive_pairs / candidate_pairs / b, 4) AS lift FROM (SELECT block_rule, count(*) AS candidate_pairs,
  count(*) FILTER (p.entity_id = q.entity_id) AS positive_pairs FROM prs JOIN core p ON p.profile_id = l JOIN core q ON q.profile_id = r GROUP BY 1) JOIN p95 USING (block_rule), base"""))  # fmt: skip
def rule_lift(spark, d):
    raw = raw_events(spark, d)
    return stats.rule_lift(graph.written(values.profile_values(raw)), PAIR_RULES, graph.written(mart.profile_core(raw))).drop("random_rate")


@register(O.query([*LABELLED, """mt AS (SELECT DISTINCT profile_id_l, profile_id_r, label, a.source || '__' || a.feature AS feature_key FROM labelled JOIN pv a ON a.profile_id = profile_id_l
    JOIN pv b ON b.profile_id = profile_id_r AND a.source = b.source AND a.feature = b.feature AND a.value_norm = b.value_norm), tt AS (SELECT sum(label) AS t, sum(1 - label) AS o FROM labelled)"""],
    """SELECT feature_key, n_true, n_other, round(n_true / greatest(t, 1), 6) AS share_true, round(n_other / greatest(o, 1), 6) AS share_other, round(CASE WHEN n_other > 0 THEN (n_true / greatest(t, 1)) / (n_other / greatest(o, 1)) END, 4) AS lift
  FROM (SELECT feature_key, sum(label)::BIGINT AS n_true, sum(1 - label)::BIGINT AS n_other FROM mt GROUP BY 1), tt"""))  # fmt: skip
def shared_feature_lift(spark, d):
    return stats.shared_feature_lift(labelled_pairs(spark, d), profile_values(spark, d))


@register(O.query([*O.BASE, O.block_rows(FLAGSHIP_RULE), O.limited(), O.INTERNAL, "cl AS (SELECT DISTINCT profile_id, 'C' || substr(entity_id, length(entity_id), 1) || right(profile_id, 1) AS cluster_id FROM raw)",
    "tp AS (SELECT a.profile_id AS l, b.profile_id AS r FROM core a JOIN core b USING (entity_id) WHERE a.profile_id < b.profile_id)"],
    """SELECT CASE WHEN r2 AND c2 THEN 'both' WHEN r2 THEN 'rules_only' WHEN c2 THEN 'cluster_only' ELSE 'missed' END AS bucket, count(*) AS n_pairs FROM (SELECT (l, r) IN (SELECT (profile_id_l, profile_id_r) FROM internal) AS r2,
  x.cluster_id = y.cluster_id AS c2 FROM tp JOIN cl x ON x.profile_id = l JOIN cl y ON y.profile_id = r) GROUP BY 1"""))  # fmt: skip
def capture_buckets(spark, d):
    raw = raw_events(spark, d)
    by_rules = candidates.internal_pairs(blocking.blocking_index(values.profile_values(raw), FLAGSHIP_RULE))
    cluster = F.concat(F.lit("C"), F.right("entity_id", F.lit(1)), F.right("profile_id", F.lit(1)))
    return stats.capture_buckets(blocking.positive_pairs(mart.profile_core(raw)), by_rules, raw.select("profile_id", cluster.alias("cluster_id")).distinct())


_ATTRS = "(" + ", ".join(f"'{s}__{f}'" for s, f in embeddings.ATTRIBUTES) + ")"
_VOCAB = f"""fq AS (SELECT source || '__' || feature AS attr_type, value_norm AS attr_value, count(DISTINCT profile_id) AS freq FROM pv WHERE source || '__' || feature IN {_ATTRS} GROUP BY 1, 2 HAVING count(DISTINCT profile_id) <= 3000),
vocab AS (SELECT *, ln(1 + freq) AS lf FROM fq)"""


@register(O.query([*O.BASE, _VOCAB], "SELECT attr_type, attr_value, freq, round((lf - avg(lf) OVER w) / (stddev_pop(lf) OVER w + 1e-9), 4) AS log_freq_z FROM vocab WINDOW w AS (PARTITION BY attr_type)"))
def graph_schema_stats(spark, d):
    return embeddings.attribute_vocabulary(profile_values(spark, d)).select("attr_type", "attr_value", "freq", F.round("log_freq_z", 4).alias("log_freq_z"))


@register(O.query([*O.BASE, _VOCAB], "SELECT DISTINCT profile_id, attr_type, attr_value FROM pv JOIN vocab ON source || '__' || feature = attr_type AND value_norm = attr_value"))
def hetero_edges(spark, d):
    pv = profile_values(spark, d)
    return embeddings.hetero_edges(pv, embeddings.attribute_vocabulary(pv)).select("profile_id", "attr_type", "attr_value")


@register(O.query([*O.BASE, _VOCAB], """SELECT profile_id, round(sum(h), 6) AS h_freq FROM (SELECT profile_id, attr_type, avg(freq) AS h FROM (SELECT DISTINCT profile_id, attr_type, attr_value, freq FROM pv
  JOIN vocab ON source || '__' || feature = attr_type AND value_norm = attr_value) GROUP BY 1, 2) GROUP BY 1"""))
def neighbour_mean(spark, d):
    pv = profile_values(spark, d)
    vocab = embeddings.attribute_vocabulary(pv)
    return six(embeddings.neighbour_mean(embeddings.hetero_edges(pv, vocab), vocab.select("attr_type", "attr_value", "freq"), ["freq"]), "h_freq")


@register()
def profile_vectors_als(spark, d):
    pv = profile_values(spark, d)
    edges = embeddings.hetero_edges(pv, embeddings.attribute_vocabulary(pv))
    return embeddings.profile_vectors(edges, rank=8).select("profile_id", F.size("embedding").alias("dims"))


@register()
def value_clusters(spark, d):
    return embeddings.value_clusters(profile_values(spark, d))


@register()
def tree_scored_pairs(spark, d):
    events, pv = all_events(spark, d)
    rows = graph.written(training.labelled(evidence.features(events, pv), mart.profile_core(raw_events(spark, d))))
    from kinweave.operators.scoring import TreeScorer

    scorer = TreeScorer(evidence.MODEL_FEATURES).fit(rows, maxIter=5, maxDepth=3)
    return scorer.score(rows).select(*evidence.PAIR, "label", F.round("score", 6).alias("score"))


# --- names and types of expanded columns

_KEYS = {"np_device": "device", "np_geoname_id": "geoname_id"}
_RT = {"rt_geoid": "geoid", "rt_local_hour": "local_hour", "rt_k": "k"}
_RT_SQL = ", ".join(f"json_extract_string(realtime_features, '$.{k}') AS {c}" for c, k in _RT.items())


def _expanded(spark, d) -> DataFrame:
    raw = raw_events(spark, d).withColumn("_np", values.key_values("non_processing_features"))
    own = [F.col("_np")[k].alias(c) for c, k in _KEYS.items()]
    return raw.select("event_id", *own, *[F.get_json_object("realtime_features", f"$.{k}").alias(c) for c, k in _RT.items()], F.lit("kept").alias("device"))


@register(O.query([O.RAW], f"""SELECT event_id, np_device, np_geoname_id, rt_geoid, rt_local_hour, rt_k, 'kept' AS device, np_geoname_id AS geoname_id, rt_geoid AS city_geoid, rt_local_hour AS local_hour
FROM (SELECT event_id, substr(list_filter(non_processing_features, lambda t: t LIKE 'device:%')[1], 8) AS np_device, substr(list_filter(non_processing_features, lambda t: t LIKE 'geoname_id:%')[1], 12) AS np_geoname_id, {_RT_SQL} FROM raw)"""))
def friendly_names(spark, d):
    return values.with_friendly_names(_expanded(spark, d))


@register(O.query([O.RAW], "SELECT event_id, rt_geoid::BIGINT AS rt_geoid, rt_local_hour::BIGINT AS rt_local_hour, rt_k::BIGINT AS rt_k, email AS email FROM (SELECT event_id, email, " + _RT_SQL + " FROM raw)"))
def coerced_types(spark, d):
    raw = raw_events(spark, d).select("event_id", "email", *[F.get_json_object("realtime_features", f"$.{k}").alias(c) for c, k in _RT.items()])
    return values.coerce_types(raw, [*_RT, "email"]).select("event_id", *_RT, "email")


@register(O.query([O.RAW], "SELECT event_id, to_json(fs_features)::VARCHAR AS fs_text, event_id::VARCHAR AS id_text, phone AS phone_text, nullif(substr(regexp_replace(phone, '[^0-9]', '', 'g'), 1, 3), '') AS phone_area FROM raw"))
def values_as_text(spark, d):
    raw = raw_events(spark, d)
    text = lambda c: X.value_to_text(c, raw.schema[c].dataType)
    return raw.select("event_id", text("fs_features").alias("fs_text"), text("event_id").alias("id_text"), text("phone").alias("phone_text"), X.phone_area("phone").alias("phone_area"))


# --- the whole pipeline under the shipped policy


def _resolved_whole(spark, d):
    raw = raw_events(spark, d)
    packet = F.col("profile_id").endswith("_0")
    return resolve(raw.filter(packet), raw.filter(~packet), policy=Policy(overall=None))


@register(O.query(CHAIN, "SELECT profile_id_l, profile_id_r, round(score, 6) AS score FROM scored"))
def resolve_scored(spark, d):
    return six(_resolved_whole(spark, d).scored.select(*evidence.PAIR, "score"), "score")


@register(O.query([*CHAIN, O.mutual(Policy.threshold, Policy.top_k), O.COMPONENTS, O.ASSIGN], "SELECT * REPLACE (round(best_match_score, 6) AS best_match_score) FROM assignment"))
def resolve_assignment(spark, d):
    return six(_resolved_whole(spark, d).assignment, "best_match_score")


# --- flagship


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = candidates.internal_pairs(blocking.blocking_index(profile_values(spark, sf_dir), FLAGSHIP_RULE))
    rows = evidence.pair_evidence(events)
    return six(rows.select(*evidence.PAIR, "n_block_rules", "min_block_size", "sum_block_weight"), "sum_block_weight")


@register(O.query([*O.BASE, O.block_rows(FLAGSHIP_RULE), O.limited(), O.INTERNAL], "SELECT profile_id_l, profile_id_r, count(DISTINCT block_rule) AS n_block_rules, min(block_size) AS min_block_size, round(sum(block_weight), 6) AS sum_block_weight FROM internal GROUP BY 1, 2"))
def flagship_evidence(spark, d):
    return flagship(spark, d)


from kinweave.plans import studies  # noqa: E402, F401  registers its queries here
