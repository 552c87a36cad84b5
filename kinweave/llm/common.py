"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``), or one of our own where none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kinweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kinweave-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, prefix: str, *wanted: str) -> dict[str, str]:
    """Names for columns to be added: the wanted one, or with the prefix (as often as needed) where ``df`` has it already."""
    out, have = {}, {c.lower() for c in df.columns}
    for name in wanted:
        out[name] = name
        while out[name].lower() in have:
            out[name] = prefix + out[name]
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text):
    """Lower-cases A-Z only. Pure ASCII takes the fast built-in path, which is the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def number_rows(df: DataFrame, *order: str, name: str = "_row") -> tuple[DataFrame, int]:
    """Gapless global row numbers in the given order, and the number of rows.

    Range partitions are sorted and written once with their place inside the
    partition; the only thing gathered is one count per partition, so the offset
    table that is broadcast has as many rows as there are partitions.
    """
    spark = df.sparkSession
    placed = materialise(
        df.repartitionByRange(shuffle_width(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("_kw_part", F.spark_partition_id())
        .withColumn("_kw_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered",
    )
    sizes = placed.groupBy("_kw_part").agg(F.count(F.lit(1)).alias("_kw_n"))
    before = Window.orderBy("_kw_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_kw_part", F.coalesce(F.sum("_kw_n").over(before), F.lit(0)).alias("_kw_before"))
    total = sizes.agg(F.sum("_kw_n")).first()[0] or 0
    out = placed.join(F.broadcast(offsets), "_kw_part").withColumn(name, F.col("_kw_before") + F.col("_kw_at"))
    return out.drop("_kw_part", "_kw_at", "_kw_before"), total
