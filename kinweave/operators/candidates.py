"""Candidate generation: pairs inside blocks, packet against history, caps, two hops, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators import blocking
from kinweave.operators import rules as R

EVENT = ["profile_id_l", "profile_id_r", "block_family", "block_rule", "block_value", "block_size", "block_weight"]
#: Parts a core that blocks are dealt to before their pairs are listed.
SPREAD = 8
#: Hits that one row gives at most, or those of one member: Spark keeps in memory all that a row gives before it passes any on.
LISTED = 4096


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    key = ["block_rule", "block_value"]
    a = left.select(*key, "block_family", F.col("profile_id").alias("profile_id_l"), "block_size", "block_weight")
    return a.join(right.select(*key, F.col("profile_id").alias("profile_id_r")), key)


def internal_pairs(index: DataFrame, scope: str = "packet") -> DataFrame:
    """Unordered pairs l < r that share a block: an equi-join on the block with the order as residual condition."""
    return _sides(index, index).filter("profile_id_l < profile_id_r").select(*EVENT, F.lit(scope).alias("match_scope"))


def history_pairs(packet: DataFrame, history: DataFrame) -> DataFrame:
    """Packet profiles against history profiles in the same block; size and weight are the history block's."""
    known = history.join(packet.select("profile_id").distinct(), "profile_id", "left_anti")
    key = ["block_rule", "block_value"]
    a = packet.select(*key, F.col("profile_id").alias("profile_id_l"))
    b = known.select(*key, "block_family", F.col("profile_id").alias("profile_id_r"), "block_size", "block_weight")
    return a.join(b, key).filter("profile_id_l <> profile_id_r").select(*EVENT, F.lit("history").alias("match_scope"))


def _dealt(values: DataFrame, rules: list[R.Rule], **members) -> DataFrame:
    """One row a block with its rule, value and a list of profiles for each of ``members``, each a condition; rules travel as numbers."""
    rows = blocking.block_rows(values, [R.Rule(str(i), "", r.parts) for i, r in enumerate(rules)])
    lists = [F.collect_list(F.when(c, F.col("profile_id"))).alias(k) for k, c in members.items()]
    return rows.groupBy(F.col("block_rule").cast("int").alias("rule"), F.col("block_value")).agg(*lists)


def _spread(blocks: DataFrame, rules: list[R.Rule], size: str) -> DataFrame:
    """Blocks with rule, family, size and weight, dealt evenly: what they give is far more than what they are."""
    named = lambda names: F.array(*map(F.lit, names))[F.col("rule")]
    out = blocks.repartition(SPREAD * blocks.sparkSession.sparkContext.defaultParallelism)
    out = out.withColumns({"block_rule": named([r.name for r in rules]), "block_family": named([r.family for r in rules])}).drop("rule")
    return out.withColumn("block_size", F.size(size).cast("long")).withColumn("block_weight", 1 / F.log1p(F.col("block_size").cast("double")))


def _pieces(blocks: DataFrame, members: str, last: Column, others: str) -> DataFrame:
    """Rows of blocks with ``some`` of the first ``last`` members, from place ``i`` on, so few that they and ``others`` give LISTED hits at most.

    transform is never compiled, so it ends the compiled stage: the explodes after it begin anew with every piece.
    """
    step = F.greatest(F.lit(1), F.floor(LISTED / F.size(others)).cast("int"))
    rows = blocks.withColumns({"last": last, "step": step}).select("*", F.explode(F.sequence(F.lit(1), "last", "step")).alias("i"))
    some = F.slice(members, F.col("i"), F.least("step", F.col("last") - F.col("i") + 1))
    return rows.withColumn("some", F.transform(some, lambda x: x)).drop("last", "step")


def internal_hits(values: DataFrame, rules: list[R.Rule], scope: str = "packet") -> DataFrame:
    """internal_pairs of the blocking index of ``rules``, listed from one row a block: no join meets a row per hit."""
    fits = F.size("m").between(blocking.LEAST_BLOCK, blocking.LARGEST_BLOCK)
    blocks = _spread(_dealt(values, rules, m=F.lit(True)).filter(fits), rules, "m").withColumn("m", F.sort_array("m"))
    rows = _pieces(blocks, "m", F.size("m") - 1, "m").withColumn("rest", F.slice("m", F.col("i") + 1, F.size("m"))).drop("m")
    rows = rows.select("*", F.posexplode("some").alias("at", "profile_id_l"))
    after = F.slice("rest", F.col("at") + 1, F.size("rest"))
    return rows.select("*", F.explode(after).alias("profile_id_r")).select(*EVENT, F.lit(scope).alias("match_scope"))


def history_hits(values: DataFrame, rules: list[R.Rule], packet) -> DataFrame:
    """history_pairs of the rules' blocks, listed from one row a block; packet members, whose number has no limit, go in slices."""
    most = blocking.LARGEST_BLOCK
    blocks = _dealt(values, rules, mine=packet, h=~packet).filter(F.size("h").between(blocking.LEAST_BLOCK, most) & (F.size("mine") > 0))
    begins = F.sequence(F.lit(1), F.size("mine"), F.lit(most))
    blocks = blocks.select("rule", "block_value", "h", F.explode(F.transform(begins, lambda b: F.slice("mine", b, most))).alias("mine"))
    rows = _pieces(_spread(blocks, rules, "h"), "mine", F.size("mine"), "h").drop("mine").select("*", F.explode("some").alias("profile_id_l"))
    return rows.select("*", F.explode("h").alias("profile_id_r")).select(*EVENT, F.lit("history").alias("match_scope"))


def _ranking(events: DataFrame, strong: tuple[str, ...]) -> DataFrame:
    return events.groupBy("profile_id_l", "profile_id_r").agg(
        F.min("block_size").alias("min_size"), F.round(F.sum("block_weight"), 9).alias("weight"), F.countDistinct("block_rule").alias("n_rules"),
        F.max(F.col("block_family").isin(*strong).cast("int")).alias("strong"),
    )


PREFERENCE = [("strong", False), ("min_size", True), ("n_rules", False), ("weight", False), ("profile_id_r", True)]


def limit_history(events: DataFrame, strong: tuple[str, ...], per_profile: int | None = 300, overall: int | None = None) -> DataFrame:
    """All events of the pairs kept: the best ``per_profile`` of each packet profile, then the first ``overall`` of all."""
    order = [F.col(c) if up else F.col(c).desc() for c, up in PREFERENCE]
    kept = _ranking(events, strong)
    if per_profile is not None:
        kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy("profile_id_l").orderBy(*order))).filter(F.col("_r") <= per_profile)
    if overall is not None:
        kept = kept.orderBy("profile_id_l", *order).limit(overall)
    return events.join(kept.select("profile_id_l", "profile_id_r"), ["profile_id_l", "profile_id_r"], "left_semi")


def two_hop_pairs(values: DataFrame, features: list[tuple[str, str]], largest: int = 200) -> DataFrame:
    """Distinct pairs of profiles that share an attribute value held by 2 to ``largest`` profiles."""
    held = values.filter(F.concat_ws("__", "source", "feature").isin(*[f"{s}__{f}" for s, f in features]))
    key = ["source", "feature", "value_norm"]
    sizes = held.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, largest))
    fine = held.join(sizes, key)
    a, b = fine.select(*key, F.col("profile_id").alias("profile_id_l")), fine.select(*key, F.col("profile_id").alias("profile_id_r"))
    return a.join(b, key).filter("profile_id_l < profile_id_r").select("profile_id_l", "profile_id_r").distinct()


def all_pairs(ids: DataFrame, column: str, most: int | None = 5000) -> DataFrame:
    """Every pair l < r of a universe; refuses more than ``most`` ids, none if it is None."""
    if most is not None and ids.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} ids: all pairs are for exhaustive evaluation of small universes")
    a, b = ids.select(F.col(column).alias("profile_id_l")), ids.select(F.col(column).alias("profile_id_r"))
    return a.join(b, F.col("profile_id_l") < F.col("profile_id_r"))


def one_against_all(ids: DataFrame, column: str, one) -> DataFrame:
    return ids.filter(F.col(column) != F.lit(one)).select(F.lit(one).alias("profile_id_l"), F.col(column).alias("profile_id_r"))


def candidate_union(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("profile_id_l", "profile_id_r")
    for p in parts[1:]:
        out = out.unionByName(p.select("profile_id_l", "profile_id_r"))
    return out.distinct()


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, t: s + t)


def nearest(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of highest cosine for each of a stated, small query set; a row is never its own neighbour, ties go to the smaller id."""
    norm = lambda c: F.sqrt(dot(c, c))
    q = queries.select(F.col(key).alias("q"), F.col(vector).alias("qv")).withColumn("qn", norm("qv"))
    r = rows.select(F.col(key).alias("r"), F.col(vector).alias("rv")).withColumn("rn", norm("rv"))
    near = r.join(q, F.col("q") != F.col("r")).select("q", "r", F.round(dot("qv", "rv") / (F.col("qn") * F.col("rn") + 1e-12), 6).alias("cosine"))
    best = Window.partitionBy("q").orderBy(F.desc("cosine"), "r")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
