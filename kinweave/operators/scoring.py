"""Pair scorers. A scorer turns feature columns into a score column and nothing else."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import finite_or


class Scorer(Protocol):
    def score(self, df: DataFrame) -> DataFrame: ...


def prepared(df: DataFrame, features, fill: float = 0.0) -> DataFrame:
    """All features as finite doubles; missing columns, nulls and infinities become ``fill``."""
    have = set(df.columns)
    return df.withColumns({c: finite_or(F.col(c).cast("double"), fill) if c in have else F.lit(fill) for c in features})


class LogisticScorer:
    """Fixed weights: transparent, SQL-expressible, and deterministic."""

    WEIGHTS = {
        "n_block_rules": 0.35, "n_block_families": 0.25, "n_small_blocks_le2": 0.5, "n_small_blocks_le5": 0.3, "has_strong_family": 0.8,
        "has_registration_time_window": 0.6, "only_weak_families": -1.2, "fs_total_jaccard": 2.0, "geo_total_jaccard": 1.0, "identity_strong_match": 4.0,
    }
    BIAS = -5.0

    def __init__(self, weights: dict[str, float] | None = None, bias: float | None = None):
        self.weights, self.bias = weights or self.WEIGHTS, self.BIAS if bias is None else bias

    def score(self, df: DataFrame) -> DataFrame:
        total = F.lit(self.bias)
        for name, weight in self.weights.items():
            total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * weight
        return df.withColumn("score", self.probability(total))

    @staticmethod
    def probability(total):
        return F.round(1 / (1 + F.exp(-total)), 9)

    def totals(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        """What ``score`` sums up, by the same operations in the same order, so bit for bit."""
        total = np.float64(self.bias)
        for name, weight in self.weights.items():
            total = total + columns[name].astype(np.float64) * weight
        return total


class TreeScorer:
    """Gradient-boosted trees, trained and applied by the ML library."""

    def __init__(self, features, fill: float = 0.0):
        self.features, self.fill, self.model = list(features), fill, None

    def _vectors(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="_features").transform(prepared(df, self.features, self.fill))

    def fit(self, df: DataFrame, label: str = "label", positive_weight: float = 1.0, **params) -> TreeScorer:
        rows = self._vectors(df).withColumn("_weight", F.when(F.col(label) == 1, positive_weight).otherwise(1.0))
        settings = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "seed": 42} | params
        self.model = GBTClassifier(labelCol=label, featuresCol="_features", weightCol="_weight", **settings).fit(rows)
        return self

    def score(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self._vectors(df)).withColumn("score", vector_to_array("probability")[1])
        return out.drop("_features", "rawPrediction", "probability", "prediction")
