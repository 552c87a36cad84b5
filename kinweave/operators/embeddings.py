"""Graph schema, heterogeneous edges, neighbourhood averages, and learned profile vectors and clusters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The attribute types of the graph.
ATTRIBUTES = (("derived", "email_domain"), ("identity", "phone"), ("np", "device"), ("np", "geoname_id"), ("np", "subdivision_1_iso_code"))


def attribute_vocabulary(values: DataFrame, attributes=ATTRIBUTES, most: int = 3000) -> DataFrame:
    """Attribute values held by at most ``most`` profiles, with log frequency as a z-score over their type."""
    kept = values.filter(F.concat_ws("__", "source", "feature").isin(*[f"{s}__{f}" for s, f in attributes]))
    freq = kept.groupBy(F.concat_ws("__", "source", "feature").alias("attr_type"), F.col("value_norm").alias("attr_value")).agg(F.countDistinct("profile_id").alias("freq"))
    freq = freq.filter(F.col("freq") <= most).withColumn("log_freq", F.log1p(F.col("freq").cast("double")))
    stats = freq.groupBy("attr_type").agg(F.avg("log_freq").alias("m"), F.stddev_pop("log_freq").alias("s"))
    return freq.join(F.broadcast(stats), "attr_type").withColumn("log_freq_z", (F.col("log_freq") - F.col("m")) / (F.col("s") + 1e-9)).drop("m", "s")


def hetero_edges(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Edges between profiles and the attribute values in the vocabulary."""
    rows = values.select("profile_id", F.concat_ws("__", "source", "feature").alias("attr_type"), F.col("value_norm").alias("attr_value"))
    return rows.join(vocabulary.select("attr_type", "attr_value"), ["attr_type", "attr_value"]).distinct()


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = df.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns])
    out = df.join(F.broadcast(stats))
    return out.withColumns({f"{c}_z": (F.col(c) - F.col(f"{c}_m")) / (F.col(f"{c}_s") + 1e-9) for c in columns}).select(*df.columns, *[f"{c}_z" for c in columns])


def neighbour_mean(edges: DataFrame, attribute_features: DataFrame, columns: list[str]) -> DataFrame:
    """One message-passing step: mean over neighbours per attribute type, summed across types."""
    met = edges.join(attribute_features, ["attr_type", "attr_value"])
    per_type = met.groupBy("profile_id", "attr_type").agg(*[F.avg(c).alias(c) for c in columns])
    return per_type.groupBy("profile_id").agg(*[F.sum(c).alias(f"h_{c}") for c in columns])


def profile_vectors(edges: DataFrame, rank: int = 32, seed: int = 42) -> DataFrame:
    """Profile vectors by implicit factorisation of the profile-attribute graph, in place of a trained neighbourhood encoder."""
    number = lambda df, cols, name: df.select(*cols).distinct().withColumn(name, F.row_number().over(Window.orderBy(*cols)).cast("int"))
    p, a = number(edges, ["profile_id"], "u"), number(edges, ["attr_type", "attr_value"], "i")
    rows = edges.join(p, "profile_id").join(a, ["attr_type", "attr_value"]).select("u", "i", F.lit(1.0).alias("r"))
    model = ALS(rank=rank, implicitPrefs=True, userCol="u", itemCol="i", ratingCol="r", seed=seed, maxIter=5).fit(rows)
    return model.userFactors.join(p, F.col("id") == F.col("u")).select("profile_id", F.col("features").alias("embedding"))


def value_clusters(values: DataFrame, k: int | None = None, dims: int = 16, seed: int = 42) -> DataFrame:
    """Profiles clustered by TF-IDF of their values, reduced by a singular value decomposition."""
    token = F.concat_ws("=", F.concat_ws("__", "source", "feature"), "value_norm")
    docs = values.groupBy("profile_id").agg(F.sort_array(F.collect_set(token)).alias("tokens"))
    counts = CountVectorizer(inputCol="tokens", outputCol="tf", minDF=2.0, maxDF=0.5, vocabSize=20_000).fit(docs).transform(docs)
    tfidf = Normalizer(inputCol="x", outputCol="v").transform(IDF(inputCol="tf", outputCol="x").fit(counts).transform(counts)).select("profile_id", "v")
    tfidf = tfidf.withColumn("a", vector_to_array("v"))
    n = tfidf.count()
    width = len(tfidf.first()["a"])
    matrix = RowMatrix(tfidf.select("a").rdd.map(lambda r: Vectors.dense(r[0])))
    axes = matrix.computeSVD(min(dims, width)).V.toArray()
    reduced = F.array(*[F.aggregate(F.zip_with("a", F.lit([float(x) for x in axes[:, j]]), lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t) for j in range(axes.shape[1])])
    rows = tfidf.select("profile_id", array_to_vector(reduced).alias("features"))
    k = k or min(max(round(2 * n**0.5), 2), 500, n)
    return KMeans(k=k, seed=seed, maxIter=10).fit(rows).transform(rows).select("profile_id", F.col("prediction").alias("cluster_id"))
