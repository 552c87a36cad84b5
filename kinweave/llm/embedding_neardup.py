"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are turned onto their principal axes, most variance first, and cut
into stripes along the first axis. Every pair of stripes that can hold a link is
one task; inside it, tiles are compared a few axes at a time: the dot product of
the leading axes plus the product of the two suffix norms bounds the cosine, and
a pair whose bound falls below the threshold is dropped. What reaches the end is
decided by the cosine of the given vectors in double precision.

A task returns, per vector, its number of links and the smallest id it is joined
to inside the task, never the pairs themselves. Vectors that are null, zero or
hold null or non-finite components link with nothing; vectors of different
length do not link, and neither do rows whose id is null. Rows that repeat an id
are compared as vectors of their own, and share one component and the larger count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import materialise, number_rows
from kinweave.llm.components import components

STRIPE_ROWS = 8192
LEAST_STRIPES = 6
TILE = 2048
STEP = 16
#: Room for single-precision sums in the bounds; the decision itself is in double.
SLACK = 1e-4


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v) that can link, in double precision and divided by a power of two, which changes no cosine.

    The largest component ends between 1 and 2, so that squares neither vanish nor overflow.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(fine & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("most", F.array_max(F.transform("v", F.abs)))
    rows = rows.withColumn("scale", F.pow(F.lit(2.0), F.floor(F.log2("most"))))
    return rows.select("vec_id", F.transform("v", lambda x: x / F.col("scale")).alias("v"))


def principal_axes(rows: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the second moments of the unit vectors, largest first; one dim*dim sum per partition is gathered."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column(0), dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            total += x.T @ x
        yield pa.record_batch({"k": pa.array(np.arange(dim * dim)), "s": pa.array(total.ravel())})

    parts = rows.select("v").mapInArrow(moments, "k long, s double")
    total = np.zeros(dim * dim)
    for r in parts.groupBy("k").agg(F.sum("s").alias("s")).toLocalIterator():
        total[r["k"]] = r["s"]
    values, axes = np.linalg.eigh(total.reshape(dim, dim))
    return np.ascontiguousarray(axes[:, ::-1])


def tile_links(x, y, u, v, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with cosine >= threshold between tiles; x, y unit in double, u, v on the axes in single precision."""
    dim = u.shape[1]
    alive, i, j = None, None, None
    part = None
    for lo in range(0, dim, STEP):
        hi = min(dim, lo + STEP)
        if i is None:
            step = u[:, lo:hi] @ v[:, lo:hi].T
            part = step if part is None else part + step
            ru = np.sqrt(np.maximum(0, (u[:, hi:] ** 2).sum(1)))
            rv = np.sqrt(np.maximum(0, (v[:, hi:] ** 2).sum(1)))
            alive = part >= threshold - SLACK - np.outer(ru, rv)
            count = int(alive.sum())
            if count * 8 < alive.size:  # few are left: go on pair by pair
                i, j = np.nonzero(alive)
                part = part[i, j]
        else:
            part = part + np.einsum("ij,ij->i", u[i, lo:hi], v[j, lo:hi])
            ru = np.sqrt(np.maximum(0, (u[:, hi:] ** 2).sum(1)))
            rv = np.sqrt(np.maximum(0, (v[:, hi:] ** 2).sum(1)))
            keep = part >= threshold - SLACK - ru[i] * rv[j]
            i, j, part = i[keep], j[keep], part[keep]
        if i is not None and not len(i):
            return i, j
    if i is None:  # many are left: the whole tile in double
        return np.nonzero(x @ y.T >= threshold)
    out = [np.einsum("ij,ij->i", x[i[a : a + 65536]], y[j[a : a + 65536]]) for a in range(0, len(i), 65536)]
    keep = np.concatenate(out) >= threshold
    return i[keep], j[keep]


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Smallest ``name`` that each of n nodes reaches by the edges (i, j)."""
    label = name.copy()
    while len(i):
        least = np.minimum(label[i], label[j])
        if (label[i] == least).all() and (label[j] == least).all():
            break
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
    return label


def compare_stripes(table: pa.Table, axes: np.ndarray, threshold: float) -> pa.Table:
    """All links between two stripes, or inside one: (row, n_links, joined) of the rows that have any."""
    dim = axes.shape[0]
    one, two = table["one"][0].as_py(), table["two"][0].as_py()
    stripe, row = table["stripe"].to_numpy(), table["row"].to_numpy()
    x = _matrix(table["v"], dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(row, kind="stable")
    x, row, stripe = x[order], row[order], stripe[order]
    u = (x @ axes).astype(np.float32)
    left, right = np.flatnonzero(stripe == one), np.flatnonzero(stripe == two)
    links = np.zeros(len(row), np.int64)
    own = np.arange(len(row))
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    for a in range(0, len(left), TILE):
        p = left[a : a + TILE]
        for b in range(a if one == two else 0, len(right), TILE):
            q = right[b : b + TILE]
            if u[q, 0].min() - u[p, 0].max() > reach or u[p, 0].min() - u[q, 0].max() > reach:
                continue
            i, j = tile_links(x[p], x[q], u[p], u[q], threshold)
            i, j = p[i], q[j]
            if one == two:
                i, j = i[i < j], j[i < j]
            if len(i):
                links += np.bincount(i, minlength=len(row)) + np.bincount(j, minlength=len(row))
                label = smallest_reachable(len(row), i, j, own)
                moved = np.flatnonzero(label != own)
                ends.append((moved, label[moved]))
    if ends:
        own = smallest_reachable(len(row), *(np.concatenate(e) for e in zip(*ends, strict=True)), own)
    has = links > 0
    return pa.table({"row": row[has], "n_links": links[has], "joined": row[own[has]]})


def stripe_partners(placed: DataFrame, reach: float) -> DataFrame:
    """(stripe, from, to): the first and last stripe that lie within reach on the first axis.

    One row per ``STRIPE_ROWS`` vectors or more passes the driver: 2 MB for a billion vectors.
    """
    ranges = placed.groupBy("stripe").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).orderBy("stripe").toArrow()
    stripe, lo, hi = (ranges[c].to_numpy() for c in ("stripe", "lo", "hi"))
    begin, end = np.searchsorted(hi, lo - reach), np.searchsorted(lo, hi + reach, side="right") - 1
    table = pa.table({"stripe": stripe, "from": stripe[begin], "to": stripe[end]})
    return placed.sparkSession.createDataFrame(table)


def stripe_task(axes: np.ndarray, threshold: float):
    return lambda table: compare_stripes(table, axes, threshold)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    good = materialise(usable(vectors), "vectors")
    found = []
    for (dim,) in good.groupBy(F.size("v")).count().select("size(v)").toLocalIterator():
        rows = good.filter(F.size("v") == dim)
        axes = principal_axes(rows, dim)
        first = F.aggregate(
            F.zip_with("v", F.lit([float(c) for c in axes[:, 0]]), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t
        ) / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, t: s + t * t))
        numbered, n = number_rows(rows.withColumn("first", first), "first", "vec_id", name="row")
        stripes = max(LEAST_STRIPES, -(-n // STRIPE_ROWS))
        placed = numbered.withColumn("stripe", F.floor(F.col("row") * stripes / F.lit(n)).cast("int"))
        partners = stripe_partners(placed, (2 - 2 * threshold) ** 0.5 + SLACK)
        span = placed.join(F.broadcast(partners), "stripe")
        dealt = span.withColumn("_t", F.explode(F.sequence("from", "to"))).select(
            F.least("stripe", "_t").alias("one"), F.greatest("stripe", "_t").alias("two"), "stripe", "row", "v"
        )
        linked = dealt.groupBy("one", "two").applyInArrow(stripe_task(axes, threshold), "row long, n_links long, joined long")
        linked = materialise(linked, "links")
        names = placed.select("row", "vec_id")
        counts = linked.groupBy("row").agg(F.sum("n_links").alias("n_links")).join(names, "row").select("vec_id", "n_links")
        ends = linked.filter("row <> joined").select("row", "joined").distinct()
        ends = ends.join(names.withColumnRenamed("vec_id", "a"), "row")
        ends = ends.join(names.select(F.col("row").alias("joined"), F.col("vec_id").alias("b")), "joined").select("a", "b")
        found.append((counts, ends))
    ids = vectors.select("vec_id")
    if not found:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts, edges = found[0]
    for c, e in found[1:]:
        counts, edges = counts.unionByName(c), edges.unionByName(e)
    counts = counts.groupBy(F.col("vec_id").alias("_c")).agg(F.max("n_links").alias("n_links"))
    comp = components(edges).withColumnRenamed("id", "_i")
    out = ids.join(counts, ids["vec_id"] == F.col("_c"), "left").join(comp, ids["vec_id"] == F.col("_i"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
