"""Readers for the contract tables and the adapter that turns events into raw customer records."""

from __future__ import annotations

import io
import json
from pathlib import Path

import pyarrow.parquet as pq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Select list of the adapter; ``{array}`` is the engine's array constructor.
RAW_COLUMNS = [
    "event_id",
    "concat('P', cast(user_id AS string), '_', cast(event_id % 3 AS string)) AS profile_id",
    "concat('E', cast(user_id AS string)) AS entity_id",
    "ts AS created_at",
    "concat('u', cast(user_id AS string), 'x', cast(event_id % 3 AS string), '@',"
    " CASE user_id % 3 WHEN 0 THEN 'mail.example' WHEN 1 THEN 'box.example' ELSE 'post.example' END) AS email",
    "CASE WHEN event_id % 11 = 0 THEN concat('+7 (9', lpad(cast(user_id AS string), 2, '0'), ') ',"
    " lpad(cast(user_id * 7919 % 10000000 AS string), 7, '0')) END AS phone",
    "CASE user_id % 2 WHEN 0 THEN 'male' ELSE 'female' END AS sex",
    "{array}(concat('geoname_id:', cast(1000 + user_id % 40 AS string)),"
    " concat('subdivision_1_iso_code:R', cast(user_id % 9 AS string)),"
    " concat('device:', CASE WHEN user_id % 5 < 3 THEN 'smartphone' ELSE 'pc' END),"
    " concat('osfamily:', CASE user_id % 4 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' WHEN 2 THEN 'windows' ELSE 'linux' END),"
    " concat('browser:', CASE event_id % 3 WHEN 0 THEN 'chrome' WHEN 1 THEN 'firefox' ELSE 'safari' END)) AS non_processing_features",
    "concat('{\"geoid\": ', cast(1000 + user_id % 40 AS string), ', \"local_hour\": ', cast(extract(hour FROM ts) AS string),"
    " ', \"day\": ', cast(user_id % 7 AS string), ', \"k\": ', regexp_extract(props, '([0-9]+)', 1), '}') AS realtime_features",
    "{array}(concat('source_site_365:', cast(user_id * 7 % 53 AS string)),"
    " concat('has_click_365:', regexp_extract(props, '([0-9]+)', 1)), concat('visited_30:', event_type),"
    " CASE WHEN user_id % 2 = 0 THEN 'is_man' ELSE 'is_woman' END) AS fs_features",
]

#: A richer adapter, in which every blocking rule finds values: names, national phones, repeated keys, mixed-up profiles.
RICH_COLUMNS = [
    *[c for c in RAW_COLUMNS if c.rpartition(" AS ")[2] not in ("entity_id", "phone", "non_processing_features", "realtime_features", "fs_features")],
    "concat('E', cast(user_id + CASE WHEN event_id % 501 = 0 THEN 1 ELSE 0 END AS string)) AS entity_id",
    "CASE WHEN event_id % 11 = 0 THEN concat(CASE WHEN event_id % 2 = 0 THEN '8' ELSE '+7' END, ' (9', lpad(cast(user_id % 100 AS string), 2, '0'), ') ',"
    " lpad(cast(user_id * 7919 % 10000000 AS string), 7, '0')) END AS phone",
    "CASE WHEN user_id % 4 <> 0 THEN concat('  Name', cast(user_id % 60 AS string)) END AS first_name",
    "CASE WHEN user_id % 40 = 1 THEN concat('Last', cast(user_id AS string)) WHEN user_id % 40 = 2 THEN 'None' END AS last_name",
    "CASE WHEN user_id % 50 = 3 THEN concat('19', cast(50 + user_id % 50 AS string), '-02-03') END AS birthday",
    "{array}(concat('geoname_id:', cast(1000 + user_id % 40 AS string)),"
    " concat('subdivision_1_iso_code:R', cast(user_id % 9 AS string)), concat('is_not_russia:', CASE WHEN user_id % 6 = 0 THEN 'yes' ELSE 'no' END),"
    " concat('device:', CASE WHEN user_id % 5 < 3 THEN 'smartphone' ELSE 'pc' END),"
    " concat('osfamily:', CASE user_id % 4 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' WHEN 2 THEN 'windows' ELSE 'linux' END),"
    " concat('browser:', CASE event_id % 3 WHEN 0 THEN 'chrome' WHEN 1 THEN 'firefox' ELSE 'safari' END)) AS non_processing_features",
    "concat('{\"geoid\": ', cast(1000 + user_id % 40 AS string), ', \"geoname\": \"City', cast(user_id % 40 AS string), '\", \"local_hour\": ', cast(extract(hour FROM ts) AS string),"
    " ', \"day\": ', cast(user_id % 7 AS string), ', \"visit_count\": ', cast(event_id % 13 AS string), ', \"population\": ', cast(1000 * (1 + user_id % 40) AS string), '}') AS realtime_features",
    "{array}(" + ", ".join([
        *[f"concat('{name}:', cast(user_id * {step} % {mod} AS string))" for name, step, mod in (
            ("source_site_365", 7, 53), ("source_site_30", 11, 59), ("visited_365", 3, 17), ("visited_365", 5, 61), ("has_account", 1, 2), ("has_accept_365", 13, 37),
            ("has_accept_30", 17, 41), ("has_click_30", 19, 43), ("has_order_365", 23, 47), ("has_order_30", 29, 31), ("has_view_90", 31, 29),
            ("postman_campaign_90", 3, 31), ("postman_action_90", 1, 5), ("postman_response_90", 1, 3),
            ("postman_campaign_30", 5, 29), ("postman_action_30", 1, 7), ("postman_response_30", 1, 4))],
        "concat('has_click_365:', regexp_extract(props, '([0-9]+)', 1))", "concat('visited_30:', event_type)",
        "CASE WHEN event_id % 2 = 0 THEN 'is_phone' END", "CASE WHEN user_id % 3 = 0 THEN 'is_gmail' ELSE 'is_yandex' END",
        "CASE WHEN user_id % 2 = 0 THEN 'is_man' ELSE 'is_woman' END",
    ]) + ") AS fs_features",
]


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan, optionally of some columns only (pruned in the scan)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as raw customer records: identity scalars, token arrays and a JSON object per row."""
    return table(spark, sf_dir, "events").selectExpr(*[c.replace("{array}", "array") for c in RAW_COLUMNS])


def rich_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as raw customer records with every feature that a rule or a profile row knows."""
    return table(spark, sf_dir, "events").selectExpr(*[c.replace("{array}", "array") for c in RICH_COLUMNS])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def read_batches(spark: SparkSession, folder: str, pattern: str = "batch_*.parquet") -> DataFrame:
    """All batch files of a folder as one table."""
    return spark.read.option("pathGlobFilter", pattern).parquet(folder)


def read_bytes(spark: SparkSession, data: bytes) -> DataFrame:
    """A Parquet file that a request brought along, as a table; it is as large as the request, so the driver may hold it."""
    return spark.createDataFrame(pq.read_table(io.BytesIO(data)))


def load_json(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def artefact_status(paths: dict[str, str], spark: SparkSession | None = None) -> dict[str, bool]:
    """Which named artefacts exist, on the local file system or wherever Spark's paths lead."""
    if spark is None:
        return {k: Path(v).exists() for k, v in paths.items()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = {k: jvm.org.apache.hadoop.fs.Path(v) for k, v in paths.items()}
    return {k: bool(p.getFileSystem(conf).exists(p)) for k, p in at.items()}


def head_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First n rows in an explicit order: files have none of their own."""
    return df.orderBy(*order).limit(n)


def packet_profiles(df: DataFrame) -> DataFrame:
    """Fixture split: profiles ending in _0 are the packet, all others history."""
    return df.withColumn("is_packet", F.col("profile_id").endswith("_0"))
