"""Training sets: splits without entity leakage, positive pairs, deterministic negatives, packets, and a grid of tree models."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators import evaluate
from kinweave.operators.evaluate import with_labels as labelled
from kinweave.operators.prefix import numbered
from kinweave.operators.scoring import TreeScorer


def md5_split(entity: str = "entity_id", train: int = 70, valid: int = 15) -> F.Column:
    """train, valid or test by the first 32 bits of the MD5 of the entity modulo 100."""
    bucket = F.conv(F.substring(F.md5(F.col(entity).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < train, "train").when(bucket < train + valid, "valid").otherwise("test")


def scoped(df: DataFrame, core: DataFrame, scope: str) -> DataFrame:
    """Rows of the profiles of a split; the test split is not for training."""
    if scope == "test":
        raise ValueError("the test split is kept for evaluation")
    ids = core.withColumn("split", md5_split()).filter(F.col("split") == scope).select("profile_id")
    return df.join(ids, "profile_id", "left_semi")


def hash_split(df: DataFrame, entity: str, stratum: str, parts: dict[str, float], seed: int = 42) -> DataFrame:
    """Named random parts by a hash of the entity, alike in every stratum; an entity is never divided."""
    u = F.pmod(F.xxhash64(F.lit(seed), entity, stratum), F.lit(1 << 30)) / float(1 << 30)
    out, upto = None, 0.0
    for name, share in list(parts.items())[:-1]:
        upto += share
        out = (F.when if out is None else out.when)(u < upto, name)
    last = list(parts)[-1]
    return df.withColumn("split", F.lit(last) if out is None else out.otherwise(last))


def hash_order(seed: int) -> list:
    text = F.concat_ws("|", F.lit(str(seed)), "profile_id_l", "profile_id_r")
    return [F.crc32(text.cast("binary")), F.col("profile_id_l"), F.col("profile_id_r")]


def select_training_pairs(rows: DataFrame, negatives: int, seed: int = 42) -> DataFrame:
    """All positive pairs and the ``negatives`` others with the smallest hash: a reproducible sample that any partitioning agrees on."""
    others = rows.filter("label = 0").orderBy(*hash_order(seed)).limit(negatives)
    return rows.filter("label = 1").unionByName(others)


def down_sample(rows: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    positives = rows.filter("label = 1").count()
    return select_training_pairs(rows, int(positives * ratio), seed)


def test_packet(core: DataFrame, n: int, new_share: float, seed: int = 42) -> DataFrame:
    """A packet of n profiles: singles of the corpus as new ones, and all but one profile of larger entities as existing ones."""
    order = F.xxhash64(F.lit(seed), "profile_id")
    first = F.row_number().over(Window.partitionBy("entity_id").orderBy(order, "profile_id"))
    rows = core.select("profile_id", "entity_id", "entity_size").withColumn("_r", first)
    kind = F.when(F.col("entity_size") == 1, "new").when(F.col("_r") > 1, "existing")
    rows = rows.withColumn("kind", kind).filter("kind is not null")
    have = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(have.values()) < n:
        raise ValueError(f"{n} profiles asked for, {sum(have.values())} are there")
    existing = min(round(n * (1 - new_share)), have.get("existing", 0))
    new = min(n - existing, have.get("new", 0))
    existing = n - new
    pick = lambda k, m: rows.filter(F.col("kind") == k).orderBy(order, "profile_id").limit(m)
    return pick("existing", existing).unionByName(pick("new", new)).select("profile_id", "entity_id", "kind")


def sampled_per_block(pairs: DataFrame, per_block: int = 2000, per_family: int = 50_000, seed: int = 42) -> DataFrame:
    """At most so many pairs per block and family, those with the smallest hash: a sampling operator for error analysis."""
    order = hash_order(seed)
    in_block = F.row_number().over(Window.partitionBy("block_rule", "block_value").orderBy(*order))
    in_family = F.row_number().over(Window.partitionBy("block_family").orderBy(*order, "block_rule", "block_value"))
    some = pairs.withColumn("_r", in_block).filter(F.col("_r") <= per_block).drop("_r")
    return some.withColumn("_r", in_family).filter(F.col("_r") <= per_family).drop("_r")


# Fixed values: (trees, depth, rate, rows sampled, features sampled, least rows of a leaf) and the multiples of the class balance.
TREES = ((300, 3, 0.04, 0.90, 0.90, 1), (450, 3, 0.025, 0.95, 0.95, 1), (350, 4, 0.03, 0.85, 0.85, 1), (500, 4, 0.02, 0.90, 0.85, 2),
         (650, 4, 0.015, 0.90, 0.90, 2), (350, 5, 0.03, 0.85, 0.75, 3), (500, 5, 0.02, 0.85, 0.80, 3), (450, 6, 0.02, 0.80, 0.75, 5))
MULTIPLES = (0.50, 0.75, 1.00, 1.25)


def tree_settings(trees=TREES) -> list[dict]:
    """The grid in the terms of the ML library."""
    names = ("maxIter", "maxDepth", "stepSize", "subsamplingRate", "featureSubsetStrategy", "minInstancesPerNode")
    return [dict(zip(names, (n, d, r, s, str(f), m))) for n, d, r, s, f, m in trees]


def fit_with_holdout(pairs: DataFrame, features, share: float = 0.2, fill: float = -999.0, seed: int = 42, **params) -> TreeScorer:
    """Trees that stop adding when a held-out share of the pairs, alike for both labels, gains no more: 500 of depth 6 at rate 0.05."""
    hold = F.pmod(F.crc32(F.concat_ws("|", F.lit(str(seed)), "profile_id_l", "profile_id_r").cast("binary")), F.lit(1000)) < int(share * 1000)
    settings = {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "validationIndicatorCol": "_held_out"} | params
    return TreeScorer(features, fill).fit(pairs.withColumn("_held_out", hold), **settings)


def grid_search(train: DataFrame, valid: DataFrame, features, settings: list[dict] | None = None, weights=MULTIPLES) -> tuple[TreeScorer, list[dict]]:
    """The tree model with the best average precision on the validation pairs, and the whole table of results; 32 points unless told otherwise."""
    counts = train.agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")).first()
    balance = counts["n"] / max(counts["p"], 1)
    results, best = [], None
    for point, w in product(settings or tree_settings(), weights):
        scorer = TreeScorer(features).fit(train, positive_weight=balance * w, **point)
        ap = evaluate.average_precision(scorer.score(valid)).first()[0] or 0.0
        results.append({**point, "weight": w, "average_precision": ap})
        if best is None or ap > best[0]:
            best = ap, scorer
    return best[1], results


def permutation_importance(scorer, rows: DataFrame, features, seed: int = 42) -> list[dict]:
    """Loss of average precision when one feature is replaced by that of another row, chosen by hash order."""
    whole = evaluate.average_precision(scorer.score(rows)).first()[0] or 0.0
    out = []
    n = rows.count()
    base = numbered(rows.withColumn("_h", hash_order(seed)[0]), ["_h", "profile_id_l", "profile_id_r"], "_i").drop("_h")
    for f in features:
        other = base.select(((F.col("_i") + 1) % n).alias("_i"), F.col(f).alias("_other"))
        mixed = base.join(other, "_i").withColumn(f, F.col("_other")).drop("_other", "_i")
        out.append({"feature": f, "importance": whole - (evaluate.average_precision(scorer.score(mixed)).first()[0] or 0.0)})
    return sorted(out, key=lambda r: (-r["importance"], r["feature"]))
