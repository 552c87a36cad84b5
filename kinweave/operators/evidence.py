"""Pair evidence: one row per pair with counts, flags and shares over its block hits, and value similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import rules as R
from kinweave.operators.mart import PATH_NUMBERS, PATH_SETS

# The features whose values are compared.
FS_KEYS = ("source_site_365", "source_site_30", "visited_30", "visited_365", "has_account", "has_click_365", "has_accept_365")
GEO_KEYS = (("np", "geoname_id"), ("np", "subdivision_1_iso_code"), ("rt", "geoid"), ("rt", "geoname"))
PAIR_FEATURES = (
    ("identity", "email"), ("identity", "phone"), ("identity", "first_name"), ("identity", "last_name"), ("identity", "birthday"), ("identity", "sex"),
    ("np", "geoname_id"), ("np", "subdivision_1_iso_code"), ("np", "device"), ("np", "browser"), ("np", "osfamily"),
    ("rt", "geoid"), ("rt", "geoname"), ("rt", "country"), *(("fs", f) for f in FS_KEYS),
)

# The order of the model's inputs.
MODEL_FEATURES = (
    "n_block_rules", "n_block_families", "min_block_size", "n_small_blocks_le2", "n_small_blocks_le5", "n_small_blocks_le10",
    "has_small_block_le2", "has_small_block_le5", "has_small_block_le10", "small_block_share_le5", "hit_coverage_fallback",
    "is_fallback_only", "has_non_fallback_signal", "has_strong_family", "n_strong_family_hits", "n_weak_family_hits",
    "strong_family_hit_share", "has_behavior", "has_behavior_context", "has_postman_context", "postman_context_hit_share",
    "has_time_aware_device_signal", "n_time_aware_hits", "time_aware_hit_share", "has_registration_time_window",
    "n_registration_time_window_hits", "registration_time_window_hit_share", "registration_time_window_only",
    "registration_time_window_with_behavior", "has_context", "has_coverage_compound", "only_weak_families",
    "small_block_weak_family_only", "fs_total_jaccard", "geo_total_jaccard", "fs_shared_count", "identity_email_match",
    "identity_phone_match", "identity_strong_match",
)
PAIR = ["profile_id_l", "profile_id_r"]


def pair_counts(events: DataFrame) -> DataFrame:
    """One shuffle by pair: counts over hits, and the sorted sets of rules, families and scopes."""
    family = F.col("block_family")
    hits = lambda families: F.count_if(family.isin(*families))
    return events.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_set("block_rule")).alias("rules"),
        F.array_sort(F.collect_set("block_family")).alias("families"), F.array_sort(F.collect_set("match_scope")).alias("scopes"),
        F.min("block_size").alias("min_block_size"), F.round(F.sum("block_weight"), 9).alias("sum_block_weight"),
        *[F.count_if(F.col("block_size") <= k).alias(f"n_small_blocks_le{k}") for k in (2, 5, 10)],
        hits(R.STRONG).alias("n_strong_family_hits"), hits(R.WEAK).alias("n_weak_family_hits"), hits(R.TIME_AWARE).alias("n_time_aware_hits"),
        hits(("registration_time_window",)).alias("n_registration_time_window_hits"), hits(("postman_context",)).alias("n_postman_hits"),
    )


def pair_evidence(events: DataFrame) -> DataFrame:
    """Counts, flags and shares of every pair; flags are 0 or 1."""
    return pair_flags(pair_counts(events))


def family_flags() -> dict:
    """The flags that say a pair's families are all of some."""
    within = lambda fs: (F.size(F.array_except("families", F.array(*map(F.lit, fs)))) == 0).cast("int")
    return {"only_weak_families": within(R.WEAK), "registration_time_window_only": within(("registration_time_window",))}


def pair_flags(out: DataFrame) -> DataFrame:
    """The flags and shares that follow from a pair's counts."""
    flag = lambda c: c.cast("int")
    families = F.col("families")
    has = lambda f: flag(F.array_contains(families, f))
    any_of = lambda fs: flag(F.arrays_overlap(families, F.array(*map(F.lit, fs))))
    share = lambda c: F.col(c) / F.greatest(F.col("hits"), F.lit(1))
    out = out.withColumns({
        "n_block_rules": F.size("rules"), "n_block_families": F.size("families"), "rules_key": F.array_join("rules", "|"),
        "match_scopes": F.array_join("scopes", "|"), "pair_key": F.concat_ws("|", *PAIR), "hit_coverage_fallback": has("coverage_fallback"),
        **{f"has_small_block_le{k}": flag(F.col(f"n_small_blocks_le{k}") > 0) for k in (2, 5, 10)},
        "small_block_share_le5": share("n_small_blocks_le5"), "strong_family_hit_share": share("n_strong_family_hits"),
        "time_aware_hit_share": share("n_time_aware_hits"), "registration_time_window_hit_share": share("n_registration_time_window_hits"),
        "postman_context_hit_share": share("n_postman_hits"), "has_strong_family": any_of(R.STRONG), "has_behavior": has("behavior"),
        "has_behavior_context": any_of(R.BEHAVIOR_CONTEXT), "has_postman_context": has("postman_context"),
        "has_time_aware_device_signal": has("behavior_daypart_device"), "has_registration_time_window": has("registration_time_window"),
        "has_context": has("context"), "has_coverage_compound": has("coverage_compound"), **family_flags(),
        "registration_time_window_with_behavior": has("registration_time_window") * any_of(R.BEHAVIOR_EVIDENCE),
    })
    return out.withColumns({
        "is_fallback_only": flag((F.col("hit_coverage_fallback") == 1) & (F.col("n_block_families") == 1)),
        "has_non_fallback_signal": flag(F.col("n_block_families") > F.col("hit_coverage_fallback")),
        "small_block_weak_family_only": F.col("has_small_block_le10") * F.col("only_weak_families"),
    })


def value_group():
    """The group in which a value is compared: fs, geo, email, phone, or null."""
    key = F.concat_ws("__", "source", "feature")
    fs, geo = [f"fs__{f}" for f in FS_KEYS], [f"{s}__{f}" for s, f in GEO_KEYS]
    return F.when(key.isin(*fs), "fs").when(key.isin(*geo), "geo").when(key == "identity__email", "email").when(key == "identity__phone", "phone")


def pair_similarity(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Pooled Jaccard over behaviour and geography features and identity matches.

    Shared values come from one join on (profile, feature, value); unions from the
    sizes of both sides, so no arrays are shuffled per pair.
    """
    key = F.concat_ws("__", "source", "feature")
    rows = values.withColumns({"g": value_group(), "key": key}).filter("g is not null").select("profile_id", "g", "key", "value_norm")
    sizes = rows.groupBy("profile_id").agg(*[F.count_if(F.col("g") == g).alias(f"n_{g}") for g in ("fs", "geo")])
    ids = pairs.select(*PAIR).distinct()
    left = ids.join(rows.withColumnRenamed("profile_id", "profile_id_l"), "profile_id_l")
    shared = left.join(rows.withColumnRenamed("profile_id", "profile_id_r"), ["profile_id_r", "g", "key", "value_norm"])
    shared = shared.groupBy(*PAIR).agg(*[F.count_if(F.col("g") == g).alias(f"i_{g}") for g in ("fs", "geo", "email", "phone")])
    side = lambda s: sizes.select(F.col("profile_id").alias(f"profile_id_{s}"), *[F.col(f"n_{g}").alias(f"{s}_{g}") for g in ("fs", "geo")])
    out = ids.join(shared, PAIR, "left").join(side("l"), "profile_id_l", "left").join(side("r"), "profile_id_r", "left").na.fill(0)
    return out.select(*PAIR, *similarities())


def similarities() -> list:
    """Similarity from shared values (i_) and the values of both sides (l_, r_) by group."""
    def pooled(g):
        union = F.col(f"l_{g}") + F.col(f"r_{g}") - F.col(f"i_{g}")
        return F.when(union > 0, F.col(f"i_{g}") / union).otherwise(0.0)
    email, phone = (F.col("i_email") > 0).cast("int"), (F.col("i_phone") > 0).cast("int")
    return [
        pooled("fs").alias("fs_total_jaccard"), pooled("geo").alias("geo_total_jaccard"), F.col("i_fs").alias("fs_shared_count"),
        email.alias("identity_email_match"), phone.alias("identity_phone_match"), F.greatest(email, phone).alias("identity_strong_match"),
    ]


def features(events: DataFrame, values: DataFrame) -> DataFrame:
    """Pair evidence with similarity: everything a scorer needs."""
    evidence = pair_evidence(events)
    return evidence.join(pair_similarity(evidence, values), PAIR)


def set_similarity(a: str, b: str) -> dict:
    """same_any, common count, Jaccard and overlap coefficient of two arrays of distinct values."""
    common, union, least = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), F.least(F.size(a), F.size(b))
    return {
        "same_any": F.arrays_overlap(a, b).cast("int"), "common_cnt": common,
        "jaccard": F.when(union > 0, common / union).otherwise(0.0), "overlap": F.when(least > 0, common / least).otherwise(0.0),
    }


def profile_pair_features(pairs: DataFrame, profiles: DataFrame, sets: list[str], numbers: list[str]) -> DataFrame:
    """Features of pairs from two profile rows: set similarity per set, and difference, least and greatest per number."""
    side = lambda s: profiles.select(*[F.col(c).alias(f"{c}_{s}") for c in ("profile_id", *[f"{x}_set" for x in sets], *numbers)])
    out = pairs.select(*PAIR).join(side("l"), "profile_id_l").join(side("r"), "profile_id_r")
    cols = {f"{x}_{k}": v for x in sets for k, v in set_similarity(f"{x}_set_l", f"{x}_set_r").items()}
    for c in numbers:
        a, b = F.col(f"{c}_l"), F.col(f"{c}_r")
        cols |= {f"{c}_diff": F.abs(a - b), f"{c}_min": F.least(a, b), f"{c}_max": F.greatest(a, b)}
    return out.select(*PAIR, *[v.alias(k) for k, v in cols.items()])


def embedding_pair_features(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """dot, cosine, L2 and L1 distance of two vectors per row."""
    total = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, t: s + t)
    d = lambda c: c.cast("double")
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, t: s + d(t) * d(t)))
    product = total(lambda x, y: d(x) * d(y))
    return pairs.withColumns({
        "dot": product, "cosine": product / (norm(a) * norm(b) + 1e-9),
        "l2": F.sqrt(total(lambda x, y: (d(x) - d(y)) * (d(x) - d(y)))), "l1": total(lambda x, y: F.abs(d(x) - d(y))),
    })


# Sets whose ratios are features beside same and common.
RATIO_SETS = ("domain", "device", "city", "phone", "email")


def path_pair_features(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Features of pairs of profile rows by name: nine sets (any, common), five ratios, and three of every number."""
    rows = profile_pair_features(pairs, profiles, list(PATH_SETS), list(PATH_NUMBERS))
    sets = [c for x in PATH_SETS for c in (F.col(f"{x}_same_any").alias(f"same_{x}_any"), F.col(f"{x}_common_cnt").alias(f"common_{x}_cnt"))]
    ratios = [f"{x}_{k}" for x in RATIO_SETS for k in ("jaccard", "overlap")]
    return rows.select(*PAIR, *sets, *ratios, *[f"{c}_{k}" for c in PATH_NUMBERS for k in ("diff", "min", "max")])


def embedding_axis_features(pairs: DataFrame, dims: int, a: str = "a", b: str = "b") -> DataFrame:
    """absdiff_i and mul_i of every axis of two vectors per row."""
    x, y = (lambda i: F.get(a, F.lit(i)).cast("double")), (lambda i: F.get(b, F.lit(i)).cast("double"))
    return pairs.withColumns({f"absdiff_{i}": F.abs(x(i) - y(i)) for i in range(dims)} | {f"mul_{i}": x(i) * y(i) for i in range(dims)})
