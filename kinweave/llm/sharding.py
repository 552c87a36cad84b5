"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Row ``g`` of the global order moves to place ``p(g)``, a permutation of
``[0, N)``; its shard is ``p mod shards`` and its slot ``p div shards``, so shard
sizes differ by one at most and slots have no gaps. The permutation is a keyed
function of (seed, N): anyone can compute where a row went, or with
:func:`locate` which row sits at a shard and slot, without the data.

The law is ``rows``: counts are at most one apart. Equal texts are not kept
together. Null ids sort first; a null text counts as empty; rows that are equal
in every column of the order are interchangeable, repeated ids included. An empty
table gives no rows. Where a table given to :func:`shard_rows` has a column called
row_number, shard or slot, the added one is called ``shard_`` and that name.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import free_names, number_rows

ROUNDS = 8


def domain(n: int) -> tuple[int, int]:
    """Sides (a, b) of the rectangle that holds the ``n`` row numbers: a * b < n + 2 * sqrt(n) + 2."""
    a = max(1, isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def feistel(at: Column, n: int, seed: int, backward: bool = False) -> Column:
    """One application of the permutation of ``[0, a*b)``: the halves take turns to be shifted by a hash of the other."""
    a, b = domain(n)
    side_a, side_b = F.lit(a).cast("long"), F.lit(b).cast("long")

    def step(halves: Column, r: Column) -> Column:
        left, right = halves["left"], halves["right"]

        def moved(part: Column, other: Column, side: Column) -> Column:
            shift = F.pmod(F.xxhash64(F.lit(seed).cast("long"), r, other), side)
            return F.pmod(part - shift if backward else part + shift, side)

        even = F.struct(moved(left, right, side_a).alias("left"), right.alias("right"))
        odd = F.struct(left.alias("left"), moved(right, left, side_b).alias("right"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    right = at % side_b
    start = F.struct(((at - right) / side_b).cast("long").alias("left"), right.alias("right"))
    if n >= 1 << 52:  # a double no longer holds the quotient
        start = F.struct(F.call_function("div", at, side_b).alias("left"), right.alias("right"))
    return F.aggregate(
        F.reverse(turns) if backward else turns, start, step, lambda h: h["left"] * side_b + h["right"]
    )


def walks_needed(spark: SparkSession, n: int, seed: int, backward: bool = False) -> int:
    """Longest walk outside ``[0, n)``, so that walking that often brings every row inside.

    Only the fewer than ``2 * sqrt(n) + 2`` numbers outside are followed, and each
    step leaves about one in sqrt(n) of them, so this ends after a step or two.
    What no longer shrinks are cycles that lie outside as a whole: no row enters them.
    """
    a, b = domain(n)
    outside, steps, left = spark.range(n, a * b), 0, a * b - n
    while left:
        outside = outside.select(feistel(F.col("id"), n, seed, backward).alias("id")).filter(F.col("id") >= n)
        before, left = left, outside.count()
        if left == before:
            break
        steps += 1
    return steps


def permute(df: DataFrame, col: str, n: int, seed: int, backward: bool = False) -> DataFrame:
    """Applies the permutation of ``[0, n)``: whatever falls outside walks on along its cycle."""
    walks = walks_needed(df.sparkSession, n, seed, backward)
    walk = lambda at, i: F.when((i == 0) | (at >= n), feistel(at, n, seed, backward)).otherwise(at)
    return df.withColumn(col, F.aggregate(F.sequence(F.lit(0), F.lit(walks)), F.col(col).cast("long"), walk))


def locate(places: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    """Row numbers that (shard, slot) hold: the inverse permutation."""
    at = places.withColumn("row_number", F.col("slot") * F.lit(shards) + F.col("shard"))
    return permute(at.filter(F.col("row_number") < n), "row_number", n, seed, backward=True)


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int = 20240117) -> DataFrame:
    """Adds row_number, shard and slot to every row of ``df``; ``order`` makes the global order."""
    name = free_names(df, "shard_", "row_number", "shard", "slot")
    numbered, n = number_rows(df, *order, name=name["row_number"])
    placed = permute(numbered.withColumn("_kw_place", F.col(name["row_number"])), "_kw_place", n, seed)
    return placed.withColumns(
        {name["shard"]: (F.col("_kw_place") % F.lit(shards)).cast("int"), name["slot"]: F.expr(f"_kw_place div {shards}L")}
    ).drop("_kw_place")


def shard_documents(documents: DataFrame, shards: int = 24, seed: int = 20240117) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = shard_rows(rows, ["doc_id", "text_crc32", "size"], shards, seed)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
