"""Running sums over a whole table without a window that puts all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.components import written


def running_sums(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Adds ``{c}_upto``, the sum of c over all rows up to and with this one in the order of ``order``.

    Rows are dealt by ranges of the order and written, so that every later step
    sees the same ranges; each range is summed alone, and the sum of the ranges
    before it is added. The broadcast side has one row a shuffle partition.
    """
    rows = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = rows.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}_all") for c in columns])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_{c}_all").over(before), F.lit(0)).alias(f"_{c}_before") for c in columns])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(offsets), "_range")
    out = out.withColumns({f"{c}_upto": F.sum(c).over(inside) + F.col(f"_{c}_before") for c in columns})
    return out.drop("_range", *[f"_{c}_before" for c in columns])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the row's number from 0 in the order of ``order``, which must be unique."""
    rows = running_sums(df.withColumn("_one", F.lit(1).cast("long")), order, ["_one"])
    return rows.withColumn(name, F.col("_one_upto") - 1).drop("_one", "_one_upto")
