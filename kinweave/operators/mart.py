"""The profile mart: core rows, value summaries, dictionary, value sets and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import text as X
from kinweave.operators import values


def profile_core(raw: DataFrame) -> DataFrame:
    """One row per profile: events, entity, first and last event, and how many profiles its entity has."""
    core = raw.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.min_by("entity_id", "event_id").alias("entity_id"),
        F.countDistinct("entity_id").alias("entity_id_nunique"), F.min("created_at").alias("first_event_at"), F.max("created_at").alias("last_event_at"),
    )
    sizes = core.groupBy("entity_id").agg(F.count(F.lit(1)).alias("entity_size"))
    kind = F.when(F.col("entity_size") > 1, "multi_profile").otherwise("single_profile")
    return core.join(sizes, "entity_id", "left").withColumn("entity_kind", kind)


def value_summary(values: DataFrame) -> DataFrame:
    """Per profile and feature, every value with its count, times, share, rank and primary flag."""
    rows = values.groupBy("profile_id", "source", "feature", "value_norm").agg(
        F.count(F.lit(1)).alias("value_count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
        F.min_by("value_raw", "event_id").alias("value_raw_example"),
    )
    of = Window.partitionBy("profile_id", "source", "feature")
    rank = F.row_number().over(of.orderBy(F.desc("value_count"), "first_seen", "value_norm"))
    rows = rows.withColumn("feature_observation_count", F.sum("value_count").over(of)).withColumn("value_rank", rank)
    share = F.col("value_count") / F.col("feature_observation_count")
    key = F.concat_ws("__", "source", "feature")
    return rows.withColumns({"value_share_within_feature": share, "is_primary_value": F.col("value_rank") == 1, "feature_key": key})


def feature_dictionary(values: DataFrame, n_profiles: int) -> DataFrame:
    """Tokens, profiles, distinct values and profile share of every feature, aggregated in two steps to keep distinct counts cheap."""
    by_value = values.groupBy("source", "feature", "profile_id", "value_norm").agg(F.count(F.lit(1)).alias("n"))
    return by_value.groupBy("source", "feature").agg(
        F.sum("n").alias("n_tokens"), F.countDistinct("profile_id").alias("n_profiles"), F.countDistinct("value_norm").alias("n_values")
    ).withColumn("profile_share", F.col("n_profiles") / n_profiles)


def value_set(c) -> F.Column:
    """Sorted distinct non-null values, without the words that mean null."""
    return F.array_sort(F.collect_set(X.null_words(c)))


def profile_sets(values: DataFrame, features: dict[str, tuple[str, str]]) -> DataFrame:
    """One array of distinct values per named feature, with its size, from a single shuffle."""
    sets = {name: F.array_sort(F.collect_set(F.when((F.col("source") == s) & (F.col("feature") == f), F.col("value_norm")))) for name, (s, f) in features.items()}
    out = values.groupBy("profile_id").agg(*[v.alias(f"{k}_set") for k, v in sets.items()])
    return out.withColumns({f"n_{k}": F.size(f"{k}_set") for k in features})


def last_snapshot(raw: DataFrame) -> DataFrame:
    """Latest non-null identity values per profile, in order of time and event."""
    at = F.struct("created_at", "event_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"last_{c}")
    return raw.groupBy("profile_id").agg(
        last("email"), last("phone"), F.array_sort(F.collect_set("sex")).alias("sexes"), F.bool_or(F.col("phone").isNotNull()).alias("has_phone")
    )


def most_frequent(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent non-null value per key, ties to the smallest."""
    n = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min(F.struct(-F.col("n"), F.col(value).alias("v"))).alias("b")).select(key, F.col("b.v").alias(f"mode_{value}"))


def consistent_profiles(raw: DataFrame) -> DataFrame:
    """Rows of profiles that belong to one entity only."""
    mixed = raw.groupBy("profile_id").agg(F.countDistinct("entity_id").alias("n")).filter("n > 1")
    return raw.join(mixed, "profile_id", "left_anti")


# The sets, and the means of numbers and flags, of a profile row.
PATH_SETS = ("email", "phone", "domain", "device", "city", "region", "browser", "os", "sex")
PATH_MEANS = ("local_hour", "visit_count", "city_population", "fs_is_phone", "fs_is_gmail", "fs_is_yandex", "fs_is_man", "fs_is_woman")
PATH_NUMBERS = ("row_count", *[f"n_{k}" for k in PATH_SETS if k != "sex"], *[f"{k}_mean" for k in PATH_MEANS])


def path_profile(raw: DataFrame) -> DataFrame:
    """One row per profile: rows, most frequent entity (ties: the smallest), nine sets, their sizes and eight means.

    Means of flags are the share of rows that carry the flag; numbers that do not parse count as missing.
    """
    rows = raw.select(
        "profile_id", "entity_id", "email", "phone", "sex", X.email_domain_second("email").alias("domain"),
        values.key_values("non_processing_features").alias("_np"), F.coalesce("fs_features", F.array()).alias("_fs"),
        F.from_json("realtime_features", "map<string,string>").alias("_rt"),
    )
    number = lambda k: F.expr(f"try_cast(_rt['{k}'] AS double)")
    rows = rows.select(
        "profile_id", "entity_id", "email", "phone", "sex", "domain", F.col("_np")["device"].alias("device"), F.col("_rt")["geoname"].alias("city"),
        F.col("_np")["subdivision_1_iso_code"].alias("region"), F.col("_np")["browser"].alias("browser"), F.col("_np")["osfamily"].alias("os"),
        number("local_hour").alias("local_hour"), number("visit_count").alias("visit_count"), number("population").alias("city_population"),
        *[F.coalesce(F.array_contains("_fs", k[3:]), F.lit(False)).cast("double").alias(k) for k in PATH_MEANS if k.startswith("fs_")],
    )
    out = rows.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.mode("entity_id", deterministic=True).alias("entity_id"),
        *[value_set(F.col(k)).alias(f"{k}_set") for k in PATH_SETS], *[F.mean(k).alias(f"{k}_mean") for k in PATH_MEANS],
    )
    return out.withColumns({f"n_{k}": F.size(f"{k}_set") for k in PATH_SETS if k != "sex"})
