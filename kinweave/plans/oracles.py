"""DuckDB SQL for the catalogue's queries, built from shared common table expressions."""

from __future__ import annotations

from kinweave.operators import evidence as E
from kinweave.operators import rules as R
from kinweave.operators.scoring import LogisticScorer
from kinweave.sources.tables import RAW_COLUMNS, RICH_COLUMNS

RAW = "raw AS (SELECT " + ", ".join(c.replace("{array}", "list_value") for c in RAW_COLUMNS) + " FROM events)"

_TOKEN = """SELECT event_id, profile_id, created_at, '{s}' AS source,
  CASE WHEN instr(tok, ':') > 0 THEN trim(split_part(tok, ':', 1)) ELSE tok END AS feature,
  CASE WHEN instr(tok, ':') > 0 THEN trim(substr(tok, instr(tok, ':') + 1)) ELSE 'true' END AS value_raw
  FROM (SELECT event_id, profile_id, created_at, trim(unnest({c})) AS tok FROM raw) WHERE tok <> ''"""

EV = f"""ev0 AS (
  SELECT event_id, profile_id, created_at, 'identity' AS source, 'email' AS feature, email AS value_raw FROM raw WHERE email IS NOT NULL
  UNION ALL SELECT event_id, profile_id, created_at, 'identity', 'phone', phone FROM raw WHERE phone IS NOT NULL
  UNION ALL SELECT event_id, profile_id, created_at, 'identity', 'sex', sex FROM raw WHERE sex IS NOT NULL
  UNION ALL {_TOKEN.format(s="np", c="non_processing_features")}
  UNION ALL {_TOKEN.format(s="fs", c="fs_features")}
  UNION ALL SELECT event_id, profile_id, created_at, 'rt', k, json_extract_string(realtime_features, '$.' || k)
    FROM (SELECT event_id, profile_id, created_at, realtime_features, unnest(json_keys(realtime_features)) AS k FROM raw)),
ev1 AS (SELECT *, CASE WHEN source = 'identity' AND feature = 'phone' THEN nullif(regexp_replace(value_raw, '[^0-9]+', '', 'g'), '')
    ELSE lower(trim(value_raw)) END AS v FROM ev0),
ev AS (SELECT event_id, profile_id, created_at, source, feature, value_raw,
    CASE WHEN source = 'identity' AND feature = 'phone' AND length(v) = 11 AND v LIKE '8%' THEN '7' || substr(v, 2) ELSE v END AS value_norm
  FROM ev1 WHERE v IS NOT NULL AND v NOT IN ('', 'nan', 'none', 'null'))"""

CORE = """core0 AS (SELECT profile_id, count(*) AS event_count, arg_min(entity_id, event_id) AS entity_id, count(DISTINCT entity_id) AS entity_id_nunique,
    min(created_at) AS first_event_at, max(created_at) AS last_event_at FROM raw GROUP BY profile_id),
core AS (SELECT c.*, entity_size, CASE WHEN entity_size > 1 THEN 'multi_profile' ELSE 'single_profile' END AS entity_kind
  FROM core0 c JOIN (SELECT entity_id, count(*) AS entity_size FROM core0 GROUP BY entity_id) s USING (entity_id))"""

_BUCKET = "CAST(('0x' || substr(md5({x}), 1, 8))::BIGINT % {n} AS VARCHAR)"
PV = f"""own AS (SELECT DISTINCT profile_id, source, feature, value_norm FROM ev),
mail AS (SELECT profile_id, value_norm AS m, coalesce(nullif(regexp_extract(value_norm, '^([^@]+)', 1), ''), 'missing_local') AS l
  FROM own WHERE source = 'identity' AND feature = 'email'),
pv AS (SELECT * FROM own
  UNION SELECT profile_id, 'derived', 'email_domain', coalesce(nullif(regexp_extract(m, '@([^@]+)$', 1), ''), 'missing_domain') FROM mail
  UNION SELECT profile_id, 'derived', 'email_local', l FROM mail
  UNION SELECT profile_id, 'derived', 'email_initial1', l[:1] FROM mail
  UNION SELECT profile_id, 'derived', 'email_initial2', l[:2] FROM mail
  UNION SELECT profile_id, 'derived', 'email_hash_bucket_1024', {_BUCKET.format(x="l", n=1024)} FROM mail
  UNION SELECT profile_id, 'derived', 'registration_60m_bucket', strftime(time_bucket(INTERVAL 30 minute, first_event_at) - INTERVAL 30 minute * k, '%Y-%m-%d %H:%M')
    FROM core0, unnest(range(0, 3)) AS t(k))"""

BASE = [RAW, EV, CORE, PV]

RICH = "raw AS (SELECT " + ", ".join(c.replace("{array}", "list_value") for c in RICH_COLUMNS) + " FROM events)"
_SEX = "UNION ALL SELECT event_id, profile_id, created_at, 'identity', 'sex', sex FROM raw WHERE sex IS NOT NULL"
RICH_EV = EV.replace(_SEX, "\n  ".join(_SEX.replace("sex", c) for c in ("sex", "first_name", "last_name", "birthday")))
RICH_BASE = [RICH, RICH_EV, CORE, PV]


def query(parts: list[str], body: str) -> str:
    """A body that begins with a comma goes on with further table expressions."""
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


_PART = {
    None: "value_norm",
    "prefix6": "CASE WHEN length(value_norm) >= 6 THEN substr(value_norm, 1, 6) END",
    "daypart": "CASE WHEN h BETWEEN 0 AND 5 THEN 'sleep_00_05' WHEN h BETWEEN 6 AND 10 THEN 'morning_06_10' WHEN h BETWEEN 11 AND 17 THEN 'work_11_17' WHEN h BETWEEN 18 AND 23 THEN 'evening_18_23' END",
    "weekpart": "CASE WHEN h IN (5, 6) THEN 'weekend' WHEN h BETWEEN 0 AND 4 THEN 'weekday' END",
}


def _rule_sql(rule: R.Rule, source: str) -> str:
    """A rule as a chain of joins on profile_id: one per part."""
    tables = []
    for p in rule.parts:
        inner = f"(SELECT profile_id, value_norm, try_cast(trunc(try_cast(value_norm AS DOUBLE)) AS INTEGER) AS h FROM {source} WHERE source = '{p.source}' AND feature = '{p.feature}')"
        tables.append(f"(SELECT DISTINCT profile_id, x FROM (SELECT profile_id, {_PART[p.transform]} AS x FROM {inner}) WHERE x IS NOT NULL AND length(x) >= {p.least})")
    joined = tables[0] + " p0 " + " ".join(f"JOIN {t} p{i + 1} USING (profile_id)" for i, t in enumerate(tables[1:]))
    value = " || '|' || ".join(f"p{i}.x" for i in range(len(tables)))
    return f"SELECT DISTINCT profile_id, '{rule.family}' AS block_family, '{rule.name}' AS block_rule, {value} AS block_value FROM {joined}"


def block_rows(rules: list[R.Rule], name: str = "rows", source: str = "pv") -> str:
    return f"{name} AS (" + "\nUNION ALL ".join(_rule_sql(r, source) for r in rules) + ")"


def limited(rows: str = "rows", name: str = "idx", least: int = 2, most: int = 1000) -> str:
    return f"""{name} AS (SELECT r.*, s.n AS block_size, 1 / ln(1.0 + s.n) AS block_weight FROM {rows} r
  JOIN (SELECT block_rule, block_value, count(*) AS n FROM {rows} GROUP BY ALL HAVING count(*) BETWEEN {least} AND {most}) s USING (block_rule, block_value))"""


INTERNAL = """internal AS (SELECT a.profile_id AS profile_id_l, b.profile_id AS profile_id_r, a.block_family, block_rule, block_value, a.block_size, a.block_weight, 'packet' AS match_scope
  FROM idx a JOIN idx b USING (block_rule, block_value) WHERE a.profile_id < b.profile_id)"""

PACKET = """prows AS (SELECT * FROM rows WHERE profile_id LIKE '%\\_0' ESCAPE '\\'), hrows AS (SELECT * FROM rows WHERE profile_id NOT LIKE '%\\_0' ESCAPE '\\')"""

HISTORY = """across AS (SELECT p.profile_id AS profile_id_l, h.profile_id AS profile_id_r, h.block_family, block_rule, block_value, h.block_size, h.block_weight, 'history' AS match_scope
  FROM prows p JOIN hidx h USING (block_rule, block_value) WHERE p.profile_id <> h.profile_id)"""


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


RANKING = f"""ranking AS (SELECT profile_id_l, profile_id_r, min(block_size) AS min_size, round(sum(block_weight), 9) AS weight, count(DISTINCT block_rule) AS n_rules,
  max((block_family IN {_in(R.STRONG)})::INTEGER) AS strong FROM across GROUP BY ALL)"""
PREFERENCE = "strong DESC, min_size, n_rules DESC, weight DESC, profile_id_r"


def kept(per_profile: int, overall: int | None = None) -> list[str]:
    limit = f"ORDER BY profile_id_l, {PREFERENCE} LIMIT {overall}" if overall else ""
    return [RANKING, f"""kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id_l ORDER BY {PREFERENCE}) AS r FROM ranking) WHERE r <= {per_profile} {limit})""",
            "history_events AS (SELECT a.* FROM across a SEMI JOIN kept k USING (profile_id_l, profile_id_r))"]


EVENTS = "events_all AS (SELECT * FROM pinternal UNION ALL SELECT * FROM history_events)"
PINTERNAL = INTERNAL.replace("internal AS", "pinternal AS", 1).replace("idx a", "pidx a").replace("idx b", "pidx b")


def _hits(families) -> str:
    return f"count(*) FILTER (block_family IN {_in(families)})"


COUNTS = f"""counts AS (SELECT profile_id_l, profile_id_r, count(*) AS hits, list_sort(list(DISTINCT block_rule)) AS rules, list_sort(list(DISTINCT block_family)) AS families,
  list_sort(list(DISTINCT match_scope)) AS scopes, min(block_size) AS min_block_size, round(sum(block_weight), 9) AS sum_block_weight,
  count(*) FILTER (block_size <= 2) AS n_small_blocks_le2, count(*) FILTER (block_size <= 5) AS n_small_blocks_le5, count(*) FILTER (block_size <= 10) AS n_small_blocks_le10,
  {_hits(R.STRONG)} AS n_strong_family_hits, {_hits(R.WEAK)} AS n_weak_family_hits, {_hits(R.TIME_AWARE)} AS n_time_aware_hits,
  {_hits(("registration_time_window",))} AS n_registration_time_window_hits, {_hits(("postman_context",))} AS n_postman_hits
  FROM events_all GROUP BY ALL)"""


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_has = lambda f: f"list_contains(families, '{f}')::INTEGER"
_any = lambda fs: f"list_has_any(families, {_list(fs)})::INTEGER"
_within = lambda fs: f"list_has_all({_list(fs)}, families)::INTEGER"
EVIDENCE = f"""evid0 AS (SELECT *, len(rules) AS n_block_rules, len(families) AS n_block_families, array_to_string(rules, '|') AS rules_key, array_to_string(scopes, '|') AS match_scopes,
  profile_id_l || '|' || profile_id_r AS pair_key, {_has("coverage_fallback")} AS hit_coverage_fallback,
  (n_small_blocks_le2 > 0)::INTEGER AS has_small_block_le2, (n_small_blocks_le5 > 0)::INTEGER AS has_small_block_le5, (n_small_blocks_le10 > 0)::INTEGER AS has_small_block_le10,
  n_small_blocks_le5 / greatest(hits, 1) AS small_block_share_le5, n_strong_family_hits / greatest(hits, 1) AS strong_family_hit_share,
  n_time_aware_hits / greatest(hits, 1) AS time_aware_hit_share, n_registration_time_window_hits / greatest(hits, 1) AS registration_time_window_hit_share,
  n_postman_hits / greatest(hits, 1) AS postman_context_hit_share, {_any(R.STRONG)} AS has_strong_family, {_has("behavior")} AS has_behavior,
  {_any(R.BEHAVIOR_CONTEXT)} AS has_behavior_context, {_has("postman_context")} AS has_postman_context, {_has("behavior_daypart_device")} AS has_time_aware_device_signal,
  {_has("registration_time_window")} AS has_registration_time_window, {_has("context")} AS has_context, {_has("coverage_compound")} AS has_coverage_compound,
  {_within(R.WEAK)} AS only_weak_families, {_within(("registration_time_window",))} AS registration_time_window_only,
  {_has("registration_time_window")} * {_any(R.BEHAVIOR_EVIDENCE)} AS registration_time_window_with_behavior FROM counts),
evid AS (SELECT *, (hit_coverage_fallback = 1 AND n_block_families = 1)::INTEGER AS is_fallback_only, (n_block_families > hit_coverage_fallback)::INTEGER AS has_non_fallback_signal,
  has_small_block_le10 * only_weak_families AS small_block_weak_family_only FROM evid0)"""

SIMILARITY = f"""grp AS (SELECT profile_id, source || '__' || feature AS key, value_norm,
    CASE WHEN source = 'fs' AND feature IN {_in(E.FS_KEYS)} THEN 'fs' WHEN source || '__' || feature IN {_in([f"{s}__{f}" for s, f in E.GEO_KEYS])} THEN 'geo'
      WHEN source = 'identity' AND feature IN ('email', 'phone') THEN feature END AS g FROM pv),
gsz AS (SELECT profile_id, count(*) FILTER (g = 'fs') AS n_fs, count(*) FILTER (g = 'geo') AS n_geo FROM grp WHERE g IS NOT NULL GROUP BY 1),
met AS (SELECT profile_id_l, profile_id_r, count(*) FILTER (a.g = 'fs') AS i_fs, count(*) FILTER (a.g = 'geo') AS i_geo, count(*) FILTER (a.g = 'email') AS i_email, count(*) FILTER (a.g = 'phone') AS i_phone
  FROM counts c JOIN grp a ON a.profile_id = profile_id_l JOIN grp b ON b.profile_id = profile_id_r AND a.g = b.g AND a.key = b.key AND a.value_norm = b.value_norm GROUP BY 1, 2),
sim0 AS (SELECT c.profile_id_l, c.profile_id_r, coalesce(i_fs, 0) AS i_fs, coalesce(i_geo, 0) AS i_geo, coalesce(i_email, 0) AS i_email, coalesce(i_phone, 0) AS i_phone,
    l.n_fs + r.n_fs - coalesce(i_fs, 0) AS u_fs, l.n_geo + r.n_geo - coalesce(i_geo, 0) AS u_geo
  FROM counts c LEFT JOIN met USING (profile_id_l, profile_id_r) JOIN gsz l ON l.profile_id = c.profile_id_l JOIN gsz r ON r.profile_id = c.profile_id_r),
sim AS (SELECT profile_id_l, profile_id_r, CASE WHEN u_fs > 0 THEN i_fs / u_fs ELSE 0.0 END AS fs_total_jaccard, CASE WHEN u_geo > 0 THEN i_geo / u_geo ELSE 0.0 END AS geo_total_jaccard,
  i_fs AS fs_shared_count, (i_email > 0)::INTEGER AS identity_email_match, (i_phone > 0)::INTEGER AS identity_phone_match, (i_email + i_phone > 0)::INTEGER AS identity_strong_match FROM sim0)"""

_SUM = " + ".join([f"({LogisticScorer.BIAS}::DOUBLE)", *(f"{k}::DOUBLE * {w}::DOUBLE" for k, w in LogisticScorer.WEIGHTS.items())])
SCORED = f"scored AS (SELECT e.*, s.* EXCLUDE (profile_id_l, profile_id_r), round(1 / (1 + exp(-({_SUM}))), 9) AS score FROM evid e JOIN sim s USING (profile_id_l, profile_id_r))"


def pair_chain(rules: list[R.Rule], per_profile: int = 300) -> list[str]:
    """Everything from raw records to scored candidate pairs of packet and history."""
    return [*BASE, block_rows(rules), PACKET, limited("prows", "pidx"), limited("hrows", "hidx"), PINTERNAL, HISTORY, *kept(per_profile), EVENTS, COUNTS, EVIDENCE, SIMILARITY, SCORED]


def mutual(threshold: float, k: int, name: str = "edges") -> str:
    return f"""both_{name} AS (SELECT profile_id_l AS p, profile_id_r AS q, score, profile_id_l, profile_id_r FROM scored WHERE score >= {threshold}
    UNION ALL SELECT profile_id_r, profile_id_l, score, profile_id_l, profile_id_r FROM scored WHERE score >= {threshold}),
{name} AS (SELECT profile_id_l, profile_id_r, score FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, q) AS r FROM both_{name}) WHERE r <= {k}
  GROUP BY ALL HAVING count(*) = 2)"""


COMPONENTS = """nodes AS (SELECT DISTINCT profile_id FROM raw WHERE profile_id LIKE '%\\_0' ESCAPE '\\' UNION SELECT profile_id_l FROM edges UNION SELECT profile_id_r FROM edges),
reach(profile_id, o) AS (SELECT profile_id, profile_id FROM nodes UNION SELECT r.profile_id, e.b FROM reach r
  JOIN (SELECT profile_id_l AS a, profile_id_r AS b FROM edges UNION SELECT profile_id_r, profile_id_l FROM edges) e ON e.a = r.o),
comps AS (SELECT profile_id, min(o) AS component FROM reach GROUP BY 1)"""

ASSIGN = """known AS (SELECT DISTINCT profile_id, entity_id FROM raw WHERE profile_id NOT LIKE '%\\_0' ESCAPE '\\'),
grps AS (SELECT component, list_sort(coalesce(list(DISTINCT entity_id) FILTER (entity_id IS NOT NULL), [])) AS entities,
  coalesce(string_agg(DISTINCT c.profile_id, '|' ORDER BY c.profile_id) FILTER (entity_id IS NOT NULL), '') AS matched_historical_profile_ids,
  string_agg(DISTINCT c.profile_id, '|' ORDER BY c.profile_id) AS component_profile_ids, count(DISTINCT c.profile_id) AS n_component_profiles
  FROM comps c LEFT JOIN known k ON k.profile_id = c.profile_id GROUP BY component),
bests AS (SELECT p AS profile_id, max(score) AS best FROM (SELECT profile_id_l AS p, score FROM scored UNION ALL SELECT profile_id_r, score FROM scored) GROUP BY 1),
assignment AS (SELECT c.profile_id, CASE len(entities) WHEN 0 THEN 'new_client' WHEN 1 THEN 'matched_existing' ELSE 'ambiguous' END AS decision,
  nullif(array_to_string(entities, '|'), '') AS predicted_entity_id, coalesce(best, 0.0) AS best_match_score, n_component_profiles, matched_historical_profile_ids, component_profile_ids
  FROM comps c JOIN grps USING (component) LEFT JOIN bests b ON b.profile_id = c.profile_id WHERE c.profile_id LIKE '%\\_0' ESCAPE '\\')"""

RATIOS = """round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / (tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1)) ELSE 0.0 END, 6) AS f1"""

LABELLED = """who AS (SELECT profile_id, entity_id FROM core),
labelled AS (SELECT s.profile_id_l, s.profile_id_r, s.score, (a.entity_id = b.entity_id)::INTEGER AS label FROM scored s
  JOIN who a ON a.profile_id = s.profile_id_l JOIN who b ON b.profile_id = s.profile_id_r)"""
