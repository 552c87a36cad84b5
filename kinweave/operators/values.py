"""Parsing and long form: tokens, JSON features, identity columns and derived features as (profile, source, feature, value) rows.

A profile is an entity's device or account; features are multi-valued, so rows
stay long and are never spread over data-dependent columns, but for reports.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text as X

IDENTITY = ("email", "phone", "first_name", "last_name", "birthday", "sex")


def key_values(items: str):
    """Map of the tokens of an array: split at the first colon, both sides trimmed; a bare token has no value; the last key wins.

    Written without duplicate keys, so it needs no session setting.
    """
    has = "instr(t, ':') > 0"
    key, value = f"if({has}, trim(substring_index(t, ':', 1)), t)", f"if({has}, trim(substring(t, instr(t, ':') + 1)), null)"
    entries = f"transform({items}, (t, i) -> named_struct('k', {key}, 'v', {value}, 'i', i))"
    last = f"filter({entries}, e -> not exists({entries}, n -> n.k = e.k and n.i > e.i))"
    return F.expr(f"if({items} is null, map(), map_from_entries(transform({last}, e -> struct(e.k, e.v))))")


def token_rows(df: DataFrame, column: str, source: str) -> DataFrame:
    """One row per token of an array: a bare flag is worth 'true', duplicates stay, blanks go."""
    rows = df.select("event_id", "profile_id", "created_at", F.explode(column).alias("token")).withColumn("token", F.trim("token"))
    has = F.instr("token", ":") > 0
    return rows.filter("token <> ''").select(
        "event_id", "profile_id", "created_at", F.lit(source).alias("source"),
        F.when(has, F.trim(F.substring_index("token", ":", 1))).otherwise(F.col("token")).alias("feature"),
        F.when(has, F.trim(F.expr("substring(token, instr(token, ':') + 1)"))).otherwise("true").alias("value_raw"),
    )


def json_rows(df: DataFrame, column: str = "realtime_features", source: str = "rt") -> DataFrame:
    """One row per entry of a JSON object; texts that are no object give none."""
    parsed = F.from_json(column, "map<string,string>")
    return df.select("event_id", "profile_id", "created_at", F.explode(parsed).alias("feature", "value_raw")).select(
        "event_id", "profile_id", "created_at", F.lit(source).alias("source"), "feature", "value_raw"
    )


def identity_rows(df: DataFrame, columns: tuple[str, ...] = IDENTITY) -> DataFrame:
    """One row per identity value; columns that the table lacks give none."""
    long = df.unpivot(["event_id", "profile_id", "created_at"], [c for c in columns if c in df.columns], "feature", "value_raw")
    return long.filter("value_raw is not null").select(
        "event_id", "profile_id", "created_at", F.lit("identity").alias("source"), "feature", "value_raw"
    )


def event_values(raw: DataFrame) -> DataFrame:
    """All observed values of all events with value_norm; values that mean null are left out."""
    parts = [identity_rows(raw), token_rows(raw, "non_processing_features", "np"), json_rows(raw), token_rows(raw, "fs_features", "fs")]
    rows = reduce(DataFrame.unionByName, parts)
    is_phone = (F.col("source") == "identity") & (F.col("feature") == "phone")
    rows = rows.withColumn("value_norm", F.when(is_phone, X.phone("value_raw")).otherwise(X.normalise("value_raw")))
    return rows.filter("value_norm is not null")


def derived_values(values: DataFrame, core: DataFrame) -> DataFrame:
    """Features derived from e-mail addresses and first observation times."""
    mail = values.filter("source = 'identity' and feature = 'email'").select("profile_id", F.col("value_norm").alias("m"))
    local = X.email_local("m")
    pairs = [("email_domain", X.email_domain("m")), ("email_local", local), ("email_initial1", X.initial(local, 1)),
             ("email_initial2", X.initial(local, 2)), ("email_hash_bucket_1024", X.hash_bucket(local, 1024))]
    entries = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value_norm")) for k, v in pairs])
    from_mail = mail.select("profile_id", F.explode(entries).alias("e")).select("profile_id", "e.feature", "e.value_norm")
    buckets = core.filter("first_event_at is not null").select(
        "profile_id", F.lit("registration_60m_bucket").alias("feature"), F.explode(X.registration_buckets("first_event_at")).alias("value_norm")
    )
    return from_mail.unionByName(buckets).select("profile_id", F.lit("derived").alias("source"), "feature", "value_norm").distinct()


def profile_values(raw: DataFrame) -> DataFrame:
    """Distinct (profile_id, source, feature, value_norm), derived features included."""
    own = event_values(raw).select("profile_id", "source", "feature", "value_norm").distinct()
    core = raw.groupBy("profile_id").agg(F.min("created_at").alias("first_event_at"))
    return own.unionByName(derived_values(own, core))


def wide_selected(rows: DataFrame, features: list[str]) -> DataFrame:
    """Most frequent value (ties: the smallest) of chosen features, one column each, for reports."""
    chosen = rows.withColumn("f", F.concat_ws("_", "source", "feature")).filter(F.col("f").isin(*features))
    counts = chosen.groupBy("profile_id", "f", "value_norm").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("profile_id", "f").agg(F.min(F.struct(-F.col("n"), F.col("value_norm").alias("v"))).alias("b"))
    return best.groupBy("profile_id").pivot("f", features).agg(F.first("b.v"))


# Short names of expanded columns.
FRIENDLY_NAMES = {
    "np_device": "device", "np_osfamily": "osfamily", "np_browser": "browser", "np_geoname_id": "geoname_id", "np_subdivision_1_iso_code": "region_code",
    "rt_country": "country", "rt_geoname": "city_name", "rt_geoid": "city_geoid", "rt_local_hour": "local_hour", "rt_population": "city_population", "rt_visit_count": "visit_count",
}


def with_friendly_names(df: DataFrame, names: dict[str, str] = FRIENDLY_NAMES) -> DataFrame:
    """Adds a copy of each expanded column under its short name where that name is free."""
    return df.withColumns({new: F.col(old) for old, new in names.items() if old in df.columns and new not in df.columns})


def coerce_types(df: DataFrame, columns: list[str], least_share: float = 0.95) -> DataFrame:
    """Text columns as long where at least ``least_share`` of the values are whole numbers' texts, as double where they are numbers'.

    One aggregation over all columns decides; values that do not fit then become null. A column without values stays text.
    """
    number = {c: F.expr(f"try_cast(`{c}` AS double)") for c in columns}
    seen = df.agg(*[
        F.struct(
            F.count(c).alias("n"), F.count(number[c]).alias("numbers"), F.coalesce(F.bool_and(number[c] == F.rint(number[c])), F.lit(False)).alias("whole")
        ).alias(c)
        for c in columns
    ]).first()
    fits = [c for c in columns if seen[c]["n"] and seen[c]["numbers"] >= least_share * seen[c]["n"]]
    return df.withColumns({c: number[c].cast("long") if seen[c]["whole"] else number[c] for c in fits})
