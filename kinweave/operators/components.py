"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations and two joins on narrow rows; nothing is gathered
on the driver but a row count and a checksum, and every round is written to the
shared folder, so lineage stays short and lost executors cost one round at most.
Map-side minima make hubs cheap; the joins back are plain, so that adaptive
execution can split a hub's rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 60


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table in the cluster's shared folder."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kinweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("_m"))
    moved = edges.join(least, "a").filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.unionByName(least.select("a", F.col("_m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b) that is not the smallest of its component.

    ``component`` is the smallest id reachable. Ids that no row names, and the
    smallest ids themselves, are their own component. Null ends link nothing.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now)
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        now = written(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))


def label(rows: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """``rows`` with component_id: the smallest id reachable by ``edges``, itself where nothing links."""
    found = components(edges).withColumnRenamed("id", "_id")
    out = rows.join(found, rows[key] == F.col("_id"), "left").withColumn("component_id", F.coalesce("component", key))
    return out.drop("_id", "component")
