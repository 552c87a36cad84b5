"""Statistics over rules, events and values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import paircount
from kinweave.operators.prefix import running_sums
from kinweave.operators.rules import Rule


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null share and distinct count of columns, in one pass over the table."""
    n = F.count(F.lit(1))
    one = df.agg(n.alias("n"), *[F.count(c).alias(f"{c}_n") for c in columns], *[F.countDistinct(c).alias(f"{c}_d") for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"{c}_n").alias("k"), F.col(f"{c}_d").alias("d")) for c in columns])).alias("x")
    return one.select("n", rows).select(F.col("x.c").alias("column_name"), F.round(1 - F.col("x.k") / F.col("n"), 6).alias("null_share"), F.col("x.d").alias("n_unique"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Statistic and degrees of freedom of independence of two columns; two by two cells are corrected for continuity."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("cb"))
    n = cells.agg(F.sum("o").alias("n"))
    full = rows.join(cols).join(n).join(cells, ["a", "b"], "left").withColumn("e", F.col("ra") * F.col("cb") / F.col("n"))
    gap = F.abs(F.coalesce("o", F.lit(0)) - F.col("e"))
    near = F.greatest(gap - 0.5, F.lit(0.0))
    out = full.agg(
        F.sum(gap * gap / F.col("e")).alias("plain"), F.sum(near * near / F.col("e")).alias("corrected"),
        ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).alias("dof"),
    )
    return out.select(F.round(F.when(F.col("dof") == 1, F.col("corrected")).otherwise(F.col("plain")), 6).alias("chi2"), "dof")


def chi_square_tail(x: float, dof: int) -> float:
    """P(X >= x) of a chi-square distribution with a whole number of degrees of freedom, by its finite sum."""
    if dof < 1:
        return float("nan")
    half = max(x, 0.0) / 2
    if half == 0:
        return 1.0
    first, total = (1.0, 0.0) if dof % 2 == 0 else (1.5, math.erfc(math.sqrt(half)))
    for j in range(dof // 2):
        k = first + j - 1 if dof % 2 else j
        total += math.exp(k * math.log(half) - half - math.lgamma(k + 1))
    return min(1.0, total)


def chi_square_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi_square with its p value; the one row of the result passes through the driver."""
    row = chi_square(df, a, b).first()
    p = None if row["chi2"] is None else round(chi_square_tail(row["chi2"], row["dof"]), 6)
    return df.sparkSession.createDataFrame([(row["chi2"], row["dof"], p)], "chi2 double, dof long, p_value double")


def ks_two_sample(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """Largest gap between the two groups' cumulative distributions, over distinct values."""
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isin(first, second)).groupBy(value).agg(
        F.count_if(F.col(group) == F.lit(first)).alias("x"), F.count_if(F.col(group) == F.lit(second)).alias("y")
    )
    total = rows.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    gaps = running_sums(rows, [value], ["x", "y"]).join(total)
    return gaps.agg(F.round(F.max(F.abs(F.col("x_upto") / F.col("nx") - F.col("y_upto") / F.col("ny"))), 6).alias("ks"), F.max("nx").alias("n_first"), F.max("ny").alias("n_second"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial distribution, summed in logarithms."""
    if k <= 0:
        return 1.0
    if p <= 0 or k > n:
        return 0.0
    if p >= 1:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    terms = []
    for i in range(k, n + 1):
        terms.append(log(i))
        if i > n * p and terms[-1] < terms[0] - 60:
            break
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def rule_lift(values: DataFrame, rules: list[Rule], core: DataFrame) -> DataFrame:
    """Per rule: distinct pairs offered, true pairs among them, lift over a random pair, and the 95th percentile of block size."""
    counts = paircount.rule_pairs(values, rules, core.select("profile_id", "entity_id"))
    n = core.count()
    true = core.groupBy("entity_id").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0))).first()[0]
    base = true / max(n * (n - 1) // 2, 1)
    rate = F.col("positive_pairs") / F.col("candidate_pairs")
    return counts.withColumns({
        "observed_rate": F.round(rate, 6), "lift": F.round(rate / F.lit(base) if base else F.lit(None).cast("double"), 4), "random_rate": F.lit(base),
    })


def rule_verdict(lift: DataFrame, alpha: float = 0.01, least_lift: float = 50, most_p95: float = 100) -> list[dict]:
    """Significance and usefulness of each rule; one small row per rule is collected."""
    out = []
    for r in lift.collect():
        p = binomial_tail(r["positive_pairs"], r["candidate_pairs"], r["random_rate"])
        use = p < alpha and (r["lift"] or 0) >= least_lift and r["p95_block_size"] <= most_p95
        out.append({**r.asDict(), "p_value": p, "verdict": "use" if use else "reject"})
    return out


def shared_feature_lift(pairs: DataFrame, values: DataFrame, label: str = "label") -> DataFrame:
    """Share of true and of other pairs with an equal value, per feature, and their ratio."""
    rows = values.select("profile_id", F.concat_ws("__", "source", "feature").alias("feature_key"), "value_norm")
    left = pairs.join(rows.withColumnRenamed("profile_id", "profile_id_l"), "profile_id_l")
    met = left.join(rows.withColumnRenamed("profile_id", "profile_id_r"), ["profile_id_r", "feature_key", "value_norm"])
    met = met.select("profile_id_l", "profile_id_r", label, "feature_key").distinct()
    counts = met.groupBy("feature_key").agg(F.sum(label).alias("n_true"), F.sum(1 - F.col(label)).alias("n_other"))
    totals = pairs.agg(F.sum(label).alias("t"), F.sum(1 - F.col(label)).alias("o"))
    out = counts.join(totals)
    a, b = F.col("n_true") / F.greatest("t", F.lit(1)), F.col("n_other") / F.greatest("o", F.lit(1))
    return out.select("feature_key", "n_true", "n_other", F.round(a, 6).alias("share_true"), F.round(b, 6).alias("share_other"), F.round(F.when(b > 0, a / b), 4).alias("lift"))


def capture_buckets(true: DataFrame, by_rules: DataFrame, clusters: DataFrame) -> DataFrame:
    """How many true pairs rules, clusters, both or neither capture."""
    pair = ["profile_id_l", "profile_id_r"]
    c = clusters.select("profile_id", "cluster_id")
    rows = true.select(*pair).join(by_rules.select(*pair).distinct().withColumn("r", F.lit(True)), pair, "left")
    rows = rows.join(c.toDF("profile_id_l", "cl"), "profile_id_l", "left").join(c.toDF("profile_id_r", "cr"), "profile_id_r", "left")
    rule, cluster = F.col("r").isNotNull(), F.coalesce(F.col("cl") == F.col("cr"), F.lit(False))
    bucket = F.when(rule & cluster, "both").when(rule, "rules_only").when(cluster, "cluster_only").otherwise("missed")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_pairs"))
