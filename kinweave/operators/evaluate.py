"""Labelled evaluation: confusion counts, pair, merge and assignment level, threshold sweeps, ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.blocking import positive_pairs
from kinweave.operators.candidates import all_pairs
from kinweave.operators.components import written
from kinweave.operators.prefix import numbered, running_sums

PAIR = ["profile_id_l", "profile_id_r"]


def ratios(df: DataFrame, tp="tp", fp="fp", fn="fn") -> DataFrame:
    p = F.col(tp) / F.greatest(F.col(tp) + F.col(fp), F.lit(1))
    r = F.col(tp) / F.greatest(F.col(tp) + F.col(fn), F.lit(1))
    out = df.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6)})
    return out.withColumn("f1", F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6))


def with_labels(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """Pairs with label 1 if both profiles belong to one entity, else 0."""
    who = core.select("profile_id", "entity_id")
    rows = pairs.join(who.toDF("profile_id_l", "_el"), "profile_id_l", "left").join(who.toDF("profile_id_r", "_er"), "profile_id_r", "left")
    return rows.withColumn("label", F.coalesce(F.col("_el") == F.col("_er"), F.lit(False)).cast("int")).drop("_el", "_er")


def confusion(scored: DataFrame, threshold: float, label: str = "label", n: str | None = None) -> DataFrame:
    """Counts and ratios at a threshold; ``n`` names the column with a row's number of pairs, else a row is one."""
    hit, true = F.col("score") >= threshold, F.col(label) == 1
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col(n) if n else F.lit(1))), F.lit(0).cast("long"))
    counts = scored.agg(total(hit & true).alias("tp"), total(hit & ~true).alias("fp"), total(~hit & true).alias("fn"), total(~hit & ~true).alias("tn"))
    return ratios(counts)


def pairs_in_components(components: DataFrame, touching: DataFrame) -> DataFrame:
    """All pairs l < r inside a component with at least one of the given profiles: the transitive closure."""
    rows = components.join(touching.select("profile_id", F.lit(True).alias("t")).distinct(), "profile_id", "left").select("profile_id", "component", F.col("t").isNotNull().alias("t"))
    a = rows.select("component", F.col("profile_id").alias("profile_id_l"), F.col("t").alias("tl"))
    b = rows.select("component", F.col("profile_id").alias("profile_id_r"), F.col("t").alias("tr"))
    return a.join(b, "component").filter("profile_id_l < profile_id_r and (tl or tr)").select(*PAIR)


def pair_level(predicted: DataFrame, true: DataFrame) -> DataFrame:
    both = predicted.select(*PAIR).distinct().withColumn("p", F.lit(1)).join(true.select(*PAIR).distinct().withColumn("t", F.lit(1)), PAIR, "full_outer")
    return ratios(both.agg(
        F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"),
        F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"),
    ))


def merge_level(components: DataFrame, core: DataFrame, packet: DataFrame) -> DataFrame:
    """A group of two and more that touches the packet is right if it holds two or more profiles of one entity and no other."""
    touched = packet.select("profile_id", F.lit(1).alias("t")).distinct()
    rows = components.join(core.select("profile_id", "entity_id").distinct(), "profile_id").join(touched, "profile_id", "left")
    groups = rows.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("e"), F.min("entity_id").alias("entity_id"), F.count("t").alias("t")
    ).filter("n >= 2 and t > 0")
    right = F.col("e") == 1
    found = groups.filter(right).select("entity_id").distinct().withColumn("f", F.lit(1))
    owners = core.join(touched, "profile_id", "left").groupBy("entity_id").agg(F.countDistinct("profile_id").alias("n"), F.count("t").alias("t"))
    missed = owners.filter("n >= 2 and t > 0").join(found, "entity_id", "left_anti").agg(F.count(F.lit(1)).alias("fn"))
    counts = groups.agg(F.count_if(right).alias("tp"), F.count_if(~right).alias("fp"))
    return ratios(counts.join(missed))


def assignment_quality(assignment: DataFrame, packet: DataFrame, history: DataFrame) -> DataFrame:
    """Profiles and entities that should match or be new, and how many do."""
    outside = history.join(packet.select("profile_id"), "profile_id", "left_anti").select(F.col("entity_id")).distinct().withColumn("known", F.lit(1))
    truth = packet.select("profile_id", "entity_id").distinct().join(outside, "entity_id", "left").withColumn("should_match", F.col("known").isNotNull())
    rows = assignment.join(truth, "profile_id")
    correct = F.coalesce((F.col("decision") == "matched_existing") & (F.col("predicted_entity_id") == F.col("entity_id")), F.lit(False))
    rows = rows.withColumns({"correct": correct, "is_new": F.col("decision") == "new_client"})
    entities = rows.groupBy("entity_id", "should_match").agg(F.bool_or("correct").alias("found"), F.bool_and("is_new").alias("all_new"))
    per_profile = rows.agg(
        F.count(F.lit(1)).alias("profiles_total"), F.count_if("should_match").alias("existing_profiles_total"),
        F.count_if(F.col("should_match") & F.col("correct")).alias("existing_profiles_found"), F.count_if(~F.col("should_match")).alias("new_profiles_total"),
        F.count_if(~F.col("should_match") & F.col("is_new")).alias("new_profiles_correct"),
        F.count_if((F.col("decision") == "matched_existing") & ~F.col("correct")).alias("wrong_attachments"), F.count_if(F.col("decision") == "ambiguous").alias("ambiguous_profiles"),
    )
    per_entity = entities.agg(
        F.count_if("should_match").alias("existing_entities_total"), F.count_if(F.col("should_match") & F.col("found")).alias("existing_entities_found"),
        F.count_if(~F.col("should_match")).alias("new_entities_total"), F.count_if(~F.col("should_match") & F.col("all_new")).alias("new_entities_correct"),
    )
    return per_profile.join(per_entity)


def grid(start: float, stop: float, step: float) -> list[float]:
    out, i = [], 0
    while start + i * step <= stop + step / 10:
        out.append(round(start + i * step, 6))
        i += 1
    return out


def sweep(scored: DataFrame, thresholds: list[float], ks: list[int], label: str = "label") -> DataFrame:
    """Accepted edges and their precision and recall at every (k, threshold), all from one scored set.

    Ranks do not depend on the threshold, as all pairs above it outrank those
    below, so both ends are ranked once and the grid is a few conditions per row.
    """
    a = scored.select("*", F.col("profile_id_l").alias("p"), F.col("profile_id_r").alias("q"))
    b = scored.select("*", F.col("profile_id_r").alias("p"), F.col("profile_id_l").alias("q"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("score"), "q"))
    ranked = a.unionByName(b).withColumn("r", rank).groupBy(*PAIR, "score", label).agg(F.max("r").alias("r"))
    points = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("threshold")) for k in ks for t in thresholds])).alias("g")
    hit, true = (F.col("score") >= F.col("g.threshold")) & (F.col("r") <= F.col("g.k")), F.col(label) == 1
    counts = ranked.select("*", points).groupBy(F.col("g.k").alias("k"), F.col("g.threshold").alias("threshold")).agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn")
    )
    return ratios(counts)


def step_pr_auc(curve: DataFrame, by: str = "k") -> DataFrame:
    """Area under precision over recall in steps: starts at (0, 1), the last precision per recall counts."""
    last = curve.groupBy(by, "recall").agg(F.max("precision").alias("precision"))
    start = curve.select(by).distinct().select(by, F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    last = last.unionByName(start.join(last.filter("recall = 0").select(by), by, "left_anti"))
    before = F.lag("recall", 1, 0.0).over(Window.partitionBy(by).orderBy("recall"))
    return last.withColumn("area", F.greatest(F.col("recall") - before, F.lit(0.0)) * F.col("precision")).groupBy(by).agg(F.round(F.sum("area"), 6).alias("pr_auc"))


def _by_score(scored: DataFrame, label: str, n: str | None) -> DataFrame:
    """One row per distinct score with positives and negatives: what ranking metrics need, far smaller than the pairs."""
    n = F.col(n) if n else F.lit(1)
    return scored.groupBy("score").agg(F.sum(n * F.col(label)).alias("pos"), F.sum(n * (1 - F.col(label))).alias("neg"))


def roc_auc(scored: DataFrame, label: str = "label", n: str | None = None) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half."""
    rows = running_sums(_by_score(scored, label, n), ["score"], ["neg"])
    rows = rows.withColumn("wins", F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return rows.agg(F.round(F.try_divide(F.sum("wins"), F.sum("pos") * F.sum("neg")), 6).alias("roc_auc"))


def average_precision(scored: DataFrame, label: str = "label", n: str | None = None) -> DataFrame:
    """Sum over distinct scores of the step in recall times the precision there."""
    rows = running_sums(_by_score(scored, label, n).withColumn("_down", -F.col("score")), ["_down"], ["pos", "neg"])
    at = F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))
    return rows.agg(F.round(F.try_divide(F.sum(F.col("pos") * at), F.sum("pos")), 6).alias("average_precision"))


def assignment_points(quality: DataFrame) -> DataFrame:
    """Shares of existing clients found and of new ones kept apart, in percent; where there are none, all of them are."""
    share = lambda a, b: F.round(F.when(F.col(b) > 0, 100 * F.col(a) / F.col(b)).otherwise(100.0), 4)
    return quality.select(
        share("existing_entities_found", "existing_entities_total").alias("existing_found_pct"), share("new_entities_correct", "new_entities_total").alias("new_correct_pct")
    )


def guardrails(points: DataFrame, levels: tuple[int, ...] = (85, 90, 95)) -> DataFrame:
    """The best point of a sweep for every guardrail: of those whose new_correct_pct reaches it, most existing_found_pct.

    Ties go to the larger new_correct_pct, then to the smaller threshold, strategy
    and k. A guardrail that no point reaches has no row. ``points`` is the grid.
    """
    named = F.explode(F.array(*[F.lit(x) for x in levels])).alias("guardrail_pct")
    rows = points.select("*", named).filter(F.col("new_correct_pct") >= F.col("guardrail_pct"))
    best = F.row_number().over(
        Window.partitionBy("guardrail_pct").orderBy(F.desc("existing_found_pct"), F.desc("new_correct_pct"), "threshold", "strategy", "k")
    )
    return rows.withColumn("_best", best).filter("_best = 1").drop("_best")


def sampled_negatives(core: DataFrame, n_draws: int, seed: int = 42) -> DataFrame:
    """Pairs of profiles of different entities: draw k takes the two profiles that hashes of (seed, k) number.

    Draws that meet the same pair, one profile twice or one entity are left out, so there are at most ``n_draws``.
    """
    ids = written(numbered(core.select("profile_id", "entity_id"), ["profile_id"], "at"))
    n = ids.count()
    draw = lambda side: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{side}|"), "id").cast("binary")), 1, 8), 16, 10).cast("long") % max(n, 1)
    draws = core.sparkSession.range(n_draws).withColumn("id", F.col("id").cast("string")).select(draw("l").alias("l"), draw("r").alias("r"))
    a, b = ids.toDF("a", "ea", "l"), ids.toDF("b", "eb", "r")
    met = draws.join(a, "l").join(b, "r").filter("a <> b and ea <> eb")
    return met.select(F.least("a", "b").alias("profile_id_l"), F.greatest("a", "b").alias("profile_id_r")).distinct()


def full_universe(profiles: DataFrame, features, scorer, threshold: float, most: int = 20_000, near: DataFrame | None = None) -> DataFrame:
    """Confusion over every pair of a universe of profiles (profile_id, entity_id), one pass, nothing gathered.

    ``features`` turns pairs into feature rows. All pairs are the point of this evaluation, so a universe of more than
    ``most`` profiles is refused rather than cut. ``near`` are values (profile_id, feature, value) of which any pair that
    reaches the threshold shares one: then only such pairs are scored, a universe of any size is taken, and the others,
    which all stay below the threshold, are counted from the sizes of the universe and its entities.
    """
    if near is not None:
        return _by_shared_values(profiles, features, scorer, threshold, near)
    pairs = with_labels(all_pairs(profiles.select("profile_id"), "profile_id", most), profiles)
    scored = scorer.score(features(pairs))
    return confusion(scored.join(pairs, PAIR), threshold)


def _by_shared_values(profiles: DataFrame, features, scorer, threshold: float, near: DataFrame) -> DataFrame:
    rows = near.join(profiles.select("profile_id"), "profile_id", "left_semi").distinct()
    key = ["feature", "value"]
    a, b = (rows.select(*key, F.col("profile_id").alias(c)) for c in PAIR)
    pairs = a.join(b, key).filter("profile_id_l < profile_id_r").select(*PAIR).distinct()
    met = with_labels(scorer.score(features(pairs)), profiles).filter(F.col("score") >= threshold)
    hits = met.agg(F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("fp"))
    k = profiles.groupBy("entity_id").agg(F.count(F.lit(1)).alias("k"))
    known = F.when(F.col("entity_id").isNotNull(), F.expr("k * (k - 1) div 2")).otherwise(0)
    sizes = k.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(known), F.lit(0)).alias("same"))
    out = hits.join(sizes).withColumns({"fn": F.col("same") - F.col("tp"), "tn": F.expr("n * (n - 1) div 2 - same - fp")})
    return ratios(out.select("tp", "fp", "fn", "tn"))


def sampled_universe(core: DataFrame, features, scorer, threshold: float, ratio: int = 10, most: int = 200_000, seed: int = 42) -> DataFrame:
    """Confusion over all true pairs and a sample of others: ``ratio`` draws a true pair, ``most`` at most."""
    true = written(positive_pairs(core).select(*PAIR))
    others = sampled_negatives(core, min(ratio * true.count(), most), seed)
    pairs = written(true.withColumn("label", F.lit(1)).unionByName(others.withColumn("label", F.lit(0))))
    return confusion(scorer.score(features(pairs)).join(pairs, PAIR), threshold)
