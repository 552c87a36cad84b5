"""Mixing sources to target weights by Poisson replication.

A source with ``n`` of ``N`` rows and target weight ``w`` is repeated
``rate = w * size / n`` times on average. Each row draws its number of copies by
inverting the Poisson distribution of that rate at a uniform number hashed from
(seed, id), is exploded by it, and the copies are ordered by a second hash: a
global shuffle that does not depend on the partitioning.

Without weights a source weighs ``n ** alpha``, which flattens the mix towards small
sources. With weights, sources that they do not name weigh ``rest``, and a weight of
0 drops a source. A null source is a source of its own, named by the key None. Rows
that repeat an id draw alike. A null id draws as the text ``null``. An empty table
gives no rows. Texts are carried, not read. Where the table has a column called
copy_no, n_copies, rate or shuffle_key, the added one is called ``mix_`` and that name.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import free_names

#: A rate above this is drawn as the sum of several equal Poisson parts.
PART_RATE = 16.0
#: Steps of one inversion; the chance of more at ``PART_RATE`` is below 1e-40.
PART_STEPS = 110
#: Up to so many sources the rates are broadcast, beyond it they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def _hash(seed: int, salt: str, *parts, digits: int):
    text = F.concat_ws("|", F.lit(f"{seed}{salt}"), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def rates(
    df: DataFrame, source: str, weights: Mapping[str | None, float] | None, alpha: float, growth: float, rest: float = 0.0
) -> DataFrame:
    """(_kw_source, _kw_rate) of every source: the target share of ``growth * N`` rows over the rows there are."""
    sizes = df.groupBy(F.col(source).alias("_kw_source")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        weighed = sizes.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(float(alpha))))
    else:
        pairs = [x for k, v in weights.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
        given = F.create_map(*pairs)[F.col("_kw_source")] if pairs else F.lit(None).cast("double")
        given = F.when(F.col("_kw_source").isNull(), F.lit(float(weights.get(None, rest)))).otherwise(given)
        weighed = sizes.withColumn("_w", F.coalesce(given, F.lit(float(rest))))
    total = weighed.agg(F.sum("_n").alias("n"), F.sum("_w").alias("w"), F.count(F.lit(1)).alias("k")).first()
    scale = growth * (total["n"] or 0) / (total["w"] or 1.0)
    out = weighed.select("_kw_source", (F.col("_w") * F.lit(scale) / F.col("_n")).alias("_kw_rate"))
    return F.broadcast(out) if total["k"] <= BROADCAST_SOURCES else out


def poisson_law(rate):
    """Cumulative Poisson probabilities of 0, 1, 2, ... copies, as far as a uniform number can lie above them."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def step(at, k):
        p = at["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(at["c"], F.array(F.element_at(at["c"], -1) + p)).alias("c"))

    law = F.aggregate(F.sequence(F.lit(1), F.lit(PART_STEPS - 1)), start, step, lambda at: at["c"])
    return F.filter(law, lambda c: c < 1.0)


def draw(
    df: DataFrame, source: str, key: str, weights: Mapping[str | None, float] | None, alpha: float, growth: float, seed: int, rest: float
) -> DataFrame:
    """Every copy drawn, in the shuffled order, with columns _kw_copy, _kw_copies, _kw_rate and _kw_place added."""
    laws = rates(df, source, weights, alpha, growth, rest)
    parts = F.greatest(F.lit(1), F.ceil(F.col("_kw_rate") / PART_RATE)).cast("int")
    laws = laws.withColumn("_kw_parts", parts).withColumn("_kw_law", poisson_law(F.col("_kw_rate") / F.col("_kw_parts")))
    drawn = df.join(laws, F.col(source).eqNullSafe(F.col("_kw_source"))).drop("_kw_source")
    uniform = lambda j: (_hash(seed, "u", F.col(key), j, digits=13) + F.lit(0.5)) / F.lit(float(1 << 52))
    # The smallest number of copies whose cumulative probability reaches the uniform number: how many lie below it.
    counts = F.transform(
        F.transform(F.sequence(F.lit(1), F.col("_kw_parts")), uniform), lambda u: F.size(F.filter("_kw_law", lambda c: c < u))
    )
    drawn = drawn.withColumn("_kw_copies", F.aggregate(counts, F.lit(0), lambda a, x: a + x)).drop("_kw_parts", "_kw_law")
    copies = drawn.filter("_kw_copies > 0").withColumn("_kw_copy", F.explode(F.sequence(F.lit(1), F.col("_kw_copies"))))
    placed = copies.withColumn("_kw_place", _hash(seed, "s", F.col(key), F.col("_kw_copy"), digits=15))
    return placed.orderBy("_kw_place", key, "_kw_copy")


def mix(
    df: DataFrame,
    source: str = "source",
    key: str = "doc_id",
    weights: Mapping[str | None, float] | None = None,
    alpha: float = 0.5,
    growth: float = 1.0,
    seed: int = 7,
    rest: float = 0.0,
) -> DataFrame:
    """Every copy drawn, in the shuffled order, with columns rate, n_copies, copy_no and shuffle_key added."""
    name = free_names(df, "mix_", "rate", "n_copies", "copy_no", "shuffle_key")
    own = dict(zip(name, ("_kw_rate", "_kw_copies", "_kw_copy", "_kw_place"), strict=True))
    drawn = draw(df, source, key, weights, alpha, growth, seed, rest)
    return drawn.select(*df.columns, *[F.col(own[c]).alias(name[c]) for c in name])


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """The copies drawn, in the shuffled order, with the columns of ``documents`` alone."""
    return mix(documents, **options).select(*documents.columns)


def mix_query(documents: DataFrame) -> DataFrame:
    return mix(documents.select("doc_id", "source")).select(
        "doc_id", "source", "copy_no", "n_copies", F.round("rate", 6).alias("rate"), "shuffle_key"
    )


MIX_SQL = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, sqrt(n::DOUBLE) * ((SELECT sum(n) FROM sizes) / (SELECT sum(sqrt(n::DOUBLE)) FROM sizes)) / n AS rate FROM sizes),
parts AS (SELECT source, rate, greatest(1, ceil(rate / 16.0))::BIGINT AS parts, rate / greatest(1, ceil(rate / 16.0)) AS part_rate FROM rates),
law(source, k, p, c) AS (
  SELECT source, 0::BIGINT, exp(-part_rate), exp(-part_rate) FROM parts
  UNION ALL
  SELECT law.source, k + 1, p * part_rate / (k + 1), c + p * part_rate / (k + 1)
  FROM law JOIN parts ON law.source IS NOT DISTINCT FROM parts.source WHERE k < 110),
draws AS (
  SELECT doc_id, d.source, rate, j, (('0x' || substr(md5('7u|' || coalesce(doc_id::VARCHAR, 'null') || '|' || j), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN parts ON d.source IS NOT DISTINCT FROM parts.source, unnest(range(1, parts + 1)) AS t(j)),
counted AS (
  SELECT doc_id, draws.source, any_value(rate) AS rate, count(law.k) AS n_copies
  FROM draws LEFT JOIN law ON draws.source IS NOT DISTINCT FROM law.source AND law.c < u AND law.k < 110
  GROUP BY doc_id, draws.source)
SELECT doc_id, source, copy_no::INTEGER AS copy_no, n_copies::INTEGER AS n_copies, round(rate, 6) AS rate,
  ('0x' || substr(md5('7s|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy_no), 1, 15))::BIGINT AS shuffle_key
FROM counted, unnest(range(1, n_copies + 1)) AS t(copy_no)
"""
