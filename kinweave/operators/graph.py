"""Edges, components and assignments of profiles to clients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.components import components, written

PAIR = ["profile_id_l", "profile_id_r"]


def mutual_top_k(scored: DataFrame, threshold: float, k: int | None = 1) -> DataFrame:
    """Pairs at or above the threshold that are among the k best of both ends (ties: the smaller neighbour); all of them if k is None."""
    rows = scored.filter(F.col("score") >= threshold)
    if k is None:
        return rows
    a = rows.select(F.col("profile_id_l").alias("p"), F.col("profile_id_r").alias("q"), "score", F.lit(True).alias("forward"))
    b = rows.select(F.col("profile_id_r").alias("p"), F.col("profile_id_l").alias("q"), "score", F.lit(False).alias("forward"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("score"), "q"))
    best = a.unionByName(b).withColumn("r", rank).filter(F.col("r") <= k)
    left = best.filter("forward").select(F.col("p").alias("profile_id_l"), F.col("q").alias("profile_id_r"))
    right = best.filter("not forward").select(F.col("q").alias("profile_id_l"), F.col("p").alias("profile_id_r"))
    return rows.join(left, PAIR, "left_semi").join(right, PAIR, "left_semi")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(profile_id, component) of all nodes and linked ids: the smallest id reachable."""
    found = components(edges.select(F.col("profile_id_l").alias("a"), F.col("profile_id_r").alias("b")))
    linked = found.select(F.explode(F.array("id", "component")).alias("profile_id"))
    out = nodes.select("profile_id").unionByName(linked).distinct().join(found.withColumnRenamed("id", "profile_id"), "profile_id", "left")
    return out.withColumn("component", F.coalesce("component", "profile_id"))


def best_scores(scored: DataFrame) -> DataFrame:
    """Best score of all scored pairs that touch a profile."""
    ends = scored.select(F.explode(F.array(*PAIR)).alias("profile_id"), "score")
    return ends.groupBy("profile_id").agg(F.max("score").alias("best_match_score"))


def assign(packet: DataFrame, history: DataFrame, components: DataFrame, scored: DataFrame) -> DataFrame:
    """A decision for every packet profile: no known client in its component is new, one is a match, more are ambiguous."""
    known = history.select("profile_id", F.col("entity_id").alias("known_entity")).distinct()
    rows = components.join(known, "profile_id", "left")
    groups = rows.groupBy("component").agg(
        F.array_sort(F.collect_set("known_entity")).alias("entities"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("known_entity").isNotNull(), F.col("profile_id")))), "|").alias("matched_historical_profile_ids"),
        F.array_join(F.array_sort(F.collect_set("profile_id")), "|").alias("component_profile_ids"),
        F.countDistinct("profile_id").alias("n_component_profiles"),
    )
    decision = F.when(F.size("entities") == 0, "new_client").when(F.size("entities") == 1, "matched_existing").otherwise("ambiguous")
    out = packet.select("profile_id").distinct().join(components, "profile_id").join(groups, "component").join(best_scores(scored), "profile_id", "left")
    return out.select(
        "profile_id", decision.alias("decision"), F.nullif(F.array_join("entities", "|"), F.lit("")).alias("predicted_entity_id"),
        F.coalesce("best_match_score", F.lit(0.0)).alias("best_match_score"), "n_component_profiles", "matched_historical_profile_ids", "component_profile_ids",
    )


def component_sizes(components: DataFrame) -> DataFrame:
    n = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(
        F.count_if(F.col("n") >= 2).alias("merge_groups_total"), F.count_if(F.col("n") == 2).alias("merge_groups_size_2"),
        F.count_if(F.col("n") >= 3).alias("merge_groups_size_3_plus"), F.coalesce(F.max("n"), F.lit(0)).alias("max_group_size"),
    )


def extend_by_two_links(edges: DataFrame, components: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """Edges added to components of two: a profile outside all edges joins if it has strong links to both members of exactly one of them."""
    sized = components.join(components.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component")
    members = sized.filter("n = 2").select(F.col("profile_id").alias("member"), F.col("component").alias("grp"))
    linked = edges.select(F.explode(F.array(*PAIR)).alias("outsider")).distinct()
    strong = scored.filter(F.col("score") >= threshold).select(*PAIR)
    both = strong.select(F.col("profile_id_l").alias("member"), F.col("profile_id_r").alias("outsider"), *PAIR).unionByName(
        strong.select(F.col("profile_id_r").alias("member"), F.col("profile_id_l").alias("outsider"), *PAIR)
    )
    links = both.join(members, "member").join(linked, "outsider", "left_anti")
    offers = links.groupBy("outsider", "grp").agg(F.countDistinct("member").alias("k")).filter("k = 2")
    sole = offers.groupBy("outsider").agg(F.count(F.lit(1)).alias("c"), F.max("grp").alias("grp")).filter("c = 1")
    return links.join(sole, ["outsider", "grp"]).select(*PAIR).distinct()


def merge_groups(components: DataFrame, edges: DataFrame, threshold: float, top: int = 50) -> DataFrame:
    """Groups of two and more with their best score: merged from max(0.98, threshold) on, else for review."""
    best = edges.join(components.withColumnRenamed("profile_id", "profile_id_l"), "profile_id_l").groupBy("component").agg(F.max("score").alias("max_score"))
    groups = components.groupBy("component").agg(F.count(F.lit(1)).alias("n_profiles")).filter("n_profiles >= 2").join(best, "component")
    action = F.when(F.col("max_score") >= max(0.98, threshold), "merge").otherwise("review")
    return groups.withColumn("action", action).orderBy(F.desc("max_score"), F.desc("n_profiles"), "component").limit(top)
