"""Blocking: values of each rule per profile, size limits, statistics and reports.

All rules are built in one pass. A profile's values are gathered once per feature
(one shuffle), every rule is the concatenated product of its parts' values, and
one explode lists the keys of all rules; there is no join per rule and no union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text as X
from kinweave.operators.rules import Part, Rule

LEAST_BLOCK, LARGEST_BLOCK = 2, 1000
TRANSFORMS = {"prefix6": X.prefix6, "daypart": X.daypart, "weekpart": X.weekpart}


def part_values(part: Part, values: Column) -> Column:
    """A part's values after its transform, long enough and distinct."""
    if part.transform:
        values = F.transform(values, lambda v: TRANSFORMS[part.transform](v))
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (F.length(v) >= part.least)))


def block_rows(values: DataFrame, rules: list[Rule], ranged: bool = False) -> DataFrame:
    """(profile_id, block_family, block_rule, block_value) of all rules, before size limits.

    A rule's values are the product of its parts' values, joined by '|'. The parts are filled up to the longest
    rule with one null, which concat_ws leaves out, and exploded one after the other: that is compiled code.
    With ``ranged`` profiles are dealt by ranges of their ids, so that those of neighbouring ids meet in a task.
    """
    parts = {p: f"part{i}" for i, p in enumerate(dict.fromkeys(p for r in rules for p in r.parts))}
    keys = sorted({(p.source, p.feature) for p in parts})
    number = {f"{s}__{f}": i for i, (s, f) in enumerate(keys)}
    numbers = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    needed = values.withColumn("k", F.concat_ws("__", "source", "feature")).filter(F.col("k").isin(*number)).withColumn("k", numbers[F.col("k")])
    if ranged:
        needed = needed.select("profile_id", "k", "value_norm").repartitionByRange("profile_id")
    wide = needed.groupBy("profile_id").agg(F.collect_list(F.struct("k", F.col("value_norm").alias("v"))).alias("own"))
    held = lambda p: F.transform(F.filter("own", lambda x: x["k"] == number[p.key]), lambda x: x["v"])
    wide = wide.select("profile_id", *[part_values(p, held(p)).alias(c) for p, c in parts.items()])
    places, none = [f"v{i}" for i in range(max(len(r.parts) for r in rules))], F.array(F.lit(None).cast("string"))
    lists = F.array(*[
        F.struct(
            F.lit(r.family).alias("block_family"), F.lit(r.name).alias("block_rule"),
            *[(F.col(parts[r.parts[i]]) if i < len(r.parts) else none).alias(v) for i, v in enumerate(places)],
        )
        for r in rules
    ])
    rows = wide.select("profile_id", F.explode(lists).alias("r")).select("profile_id", "r.*")
    for v in places:
        rows = rows.select(*[c for c in rows.columns if c != v], F.explode(v).alias(v))
    return rows.select("profile_id", "block_family", "block_rule", F.concat_ws("|", *places).alias("block_value"))


def limited(rows: DataFrame, least: int = LEAST_BLOCK, most: int = LARGEST_BLOCK) -> DataFrame:
    """Rows of blocks whose number of profiles is within the limits, with block_size and block_weight = 1 / ln(1 + size)."""
    sizes = rows.groupBy("block_rule", "block_value").agg(F.count(F.lit(1)).alias("block_size"))
    sizes = sizes.filter(F.col("block_size").between(least, most))
    return rows.join(sizes, ["block_rule", "block_value"]).withColumn("block_weight", 1 / F.log1p(F.col("block_size").cast("double")))


def blocking_index(values: DataFrame, rules: list[Rule], least: int = LEAST_BLOCK, most: int = LARGEST_BLOCK) -> DataFrame:
    return limited(block_rows(values, rules), least, most)


def rule_sizes(index: DataFrame, n_profiles: int) -> DataFrame:
    """Per rule: blocks, largest block, pairs offered, and the share of profiles it covers."""
    blocks = index.groupBy("block_rule", "block_family", "block_value").agg(F.max("block_size").alias("n"))
    per_rule = blocks.groupBy("block_rule", "block_family").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.max("n").alias("max_block_size"), F.sum(F.expr("n * (n - 1) div 2")).alias("candidate_pairs")
    )
    covered = index.select("block_rule", "profile_id").distinct().groupBy("block_rule").agg(F.count(F.lit(1)).alias("n_covered"))
    return per_rule.join(covered, "block_rule").withColumn("profile_coverage", F.col("n_covered") / n_profiles)


def positive_pairs(core: DataFrame) -> DataFrame:
    """Pairs l < r of profiles of one entity."""
    rows = core.filter("entity_id is not null").select("profile_id", "entity_id").distinct()
    left, right = rows.withColumnRenamed("profile_id", "profile_id_l"), rows.withColumnRenamed("profile_id", "profile_id_r")
    return left.join(right, "entity_id").filter("profile_id_l < profile_id_r").select("profile_id_l", "profile_id_r", "entity_id")


def rule_quality(index: DataFrame, core: DataFrame) -> DataFrame:
    """Pair and client recall, pairs per positive, and the selection of every rule with its reason."""
    n_profiles = core.count()
    entity_sizes = core.groupBy("entity_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    totals = entity_sizes.agg(F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0)).alias("p"), F.count(F.lit(1)).alias("e")).first()
    entities = core.select("profile_id", "entity_id")
    labelled = index.select("block_rule", "block_value", "profile_id").join(entities, "profile_id")
    together = labelled.groupBy("block_rule", "block_value", "entity_id").agg(F.collect_set("profile_id").alias("ps")).filter("size(ps) > 1")
    pairs = together.select("block_rule", "entity_id", F.explode("ps").alias("l"), "ps").select("block_rule", "entity_id", "l", F.explode("ps").alias("r"))
    captured = pairs.filter("l < r").distinct().groupBy("block_rule").agg(
        F.count(F.lit(1)).alias("positive_pairs_captured"), F.countDistinct("entity_id").alias("entities_captured")
    )
    out = rule_sizes(index, n_profiles).join(captured, "block_rule", "left").na.fill(0, ["positive_pairs_captured", "entities_captured"])
    fits = (F.col("candidate_pairs") <= 6_000_000) & (F.col("max_block_size") <= 1000) & (F.col("block_family") != "identity_rescue")
    forced = F.col("block_rule") == "rule__identity_rescue__phone_digits"
    return out.withColumns({
        "pair_recall": F.col("positive_pairs_captured") / F.lit(max(totals["p"], 1)),
        "client_recall": F.col("entities_captured") / F.lit(max(totals["e"], 1)),
        "pairs_per_positive": F.when(F.col("positive_pairs_captured") > 0, F.col("candidate_pairs") / F.col("positive_pairs_captured")),
        "is_recommended": fits | forced,
        "selection_reason": F.when(forced, "rescue").when(fits, "limits").otherwise("too_broad"),
    })


def rule_usage(evidence: DataFrame, top: int = 30) -> DataFrame:
    """How many pairs each rule found, by rule and family."""
    rules = evidence.select(F.explode(F.split("rules_key", r"\|")).alias("block_rule"))
    counts = rules.groupBy("block_rule").agg(F.count(F.lit(1)).alias("n_pairs"))
    return counts.withColumn("block_family", X.rule_family("block_rule")).orderBy(F.desc("n_pairs"), "block_rule").limit(top)
