"""Sinks and small reports. Only rows of a bounded report ever reach the driver."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import percent, thousands


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_json(values: dict, path: str) -> None:
    Path(path).write_text(json.dumps(values, ensure_ascii=False, indent=2, sort_keys=True, default=str), encoding="utf-8")


def read_through(spark, path: str, columns: tuple[str, ...], build) -> DataFrame:
    """The cached table at ``path`` if it is there with all columns, else built and written."""
    try:
        have = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        have = None
    if have is None or not set(columns) <= set(have.columns):
        write_parquet(build(), path)
        have = spark.read.parquet(path)
    return have


def markdown(scored: DataFrame, top: int = 20) -> str:
    s = scored.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("hi"), F.avg("score").alias("mean"), F.min("score").alias("lo")).first()
    lines = [f"Pairs: {thousands(s['n'])}", f"Score: max {s['hi']}, mean {s['mean']}, min {s['lo']}", "", "| left | right | score |", "|-|-|-|"]
    best = scored.orderBy(F.desc("score"), "profile_id_l", "profile_id_r").limit(top).collect()
    return "\n".join([*lines, *(f"| {r['profile_id_l']} | {r['profile_id_r']} | {percent(r['score'])} |" for r in best)])


def html_table(df: DataFrame, title: str, top: int = 50) -> str:
    rows = df.limit(top).collect()
    cell = lambda v, tag: f"<{tag}>{html.escape(str(v))}</{tag}>"
    head = "".join(cell(c, "th") for c in df.columns)
    body = "".join("<tr>" + "".join(cell(v, "td") for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"
