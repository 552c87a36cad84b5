"""Exact deduplication by a stateful stream whose keyed state lives on disk.

Every row becomes a digest record: digest of the normalised text, its length,
the stable identifier, and the content locator (file and row in it). A stream
over these records keeps, per digest and without expiry, the record that stays
and the number of rows, in a RocksDB state store. Digests seen more than once are
hits: their texts are fetched by locator and compared in full. Should texts of
one digest differ, these are grouped anew by the text itself.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of
equal texts the row with the largest id stays (a null id is the smallest; among
repeated ids the one at the largest locator). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import ascii_lower, materialise, shared_path

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: without this each one claims megabytes of disk before it holds anything
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def with_locator(df: DataFrame, written: bool = False) -> DataFrame:
    """Adds _kw_file and _kw_at; a table that no files stand behind is written first."""
    try:
        place = df.metadataColumn("_metadata")
        return df.withColumns({"_kw_file": place["file_path"], "_kw_at": place["row_index"]})
    except AnalysisException:
        if written:
            raise
        return with_locator(materialise(df, "located"), written=True)


def normalised(text: str = "text"):
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def digest_records(located: DataFrame, key_digits: int) -> DataFrame:
    text = located.select("doc_id", "_kw_file", "_kw_at", normalised().alias("_norm"))
    sha = text.withColumn("sha", F.sha2(F.col("_norm").cast("binary"), 256)).withColumn("n_bytes", F.octet_length("_norm"))
    return sha.withColumn("key", F.substring("sha", 1, key_digits)).drop("_norm")


def stream_state(records: DataFrame, files_per_batch: int) -> DataFrame:
    """Runs the stream over all records there are; returns key, n_bytes, keep and n of every digest.

    Each micro-batch writes the state of the digests it touched. State only
    grows (largest record, count), so the largest of those is the final one.
    """
    spark = records.sparkSession
    source = records.inputFiles()
    updates, checkpoint = shared_path(spark, "updates"), shared_path(spark, "state")
    before = {k: spark.conf.get(k, None) for k in STATE}
    schema = records.schema
    grouped = lambda df: df.groupBy("key", "n_bytes").agg(
        F.max(F.struct("doc_id", "_kw_file", "_kw_at")).alias("keep"), F.count(F.lit(1)).alias("n")
    )
    empty = grouped(records).schema
    if source:
        folder = source[0].rsplit("/", 1)[0]
        try:
            for k, v in STATE.items():
                spark.conf.set(k, v)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
            query = (
                grouped(stream)
                .writeStream.outputMode("update")
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True)
                .foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{updates}/batch={i}"))
                .start()
            )
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    else:
        spark.createDataFrame([], empty).write.parquet(f"{updates}/batch=0")
    seen = spark.read.schema(empty).parquet(updates)
    return seen.groupBy("key", "n_bytes").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))


def deduplicate(documents: DataFrame, key_digits: int = 64, files_per_batch: int = 1024) -> DataFrame:
    """One row per input row: doc_id, _kw_file, _kw_at, text_sha256, keep_id, group_size, kept."""
    return deduplicate_located(with_locator(documents), key_digits, files_per_batch)


def deduplicate_located(located: DataFrame, key_digits: int = 64, files_per_batch: int = 1024) -> DataFrame:
    records = materialise(digest_records(located, key_digits), "digests")
    state = materialise(stream_state(records, files_per_batch), "groups")
    known = records.join(state, ["key", "n_bytes"])
    # The full bytes of every hit, fetched by locator; equal exactly if the smallest is the largest.
    hits = known.filter("n > 1").select("key", "n_bytes", "doc_id", F.col("_kw_file").alias("_f"), F.col("_kw_at").alias("_a"))
    texts = located.select("_kw_file", "_kw_at", normalised().alias("_norm"))
    fetched = texts.join(hits, (F.col("_kw_file") == F.col("_f")) & (F.col("_kw_at") == F.col("_a"))).drop("_f", "_a")
    spread = fetched.groupBy("key", "n_bytes").agg(F.min("_norm").alias("lo"), F.max("_norm").alias("hi"))
    broken = materialise(spread.filter("lo <> hi").select("key", "n_bytes"), "collisions")
    if broken.limit(1).count():
        apart = fetched.join(broken, ["key", "n_bytes"], "left_semi")
        groups = apart.groupBy("key", "n_bytes", "_norm").agg(
            F.max(F.struct("doc_id", "_kw_file", "_kw_at")).alias("keep"), F.count(F.lit(1)).alias("n")
        )
        split = apart.join(groups, ["key", "n_bytes", "_norm"]).select("_kw_file", "_kw_at", "keep", "n")
        whole = known.join(broken, ["key", "n_bytes"], "left_anti")
        redone = known.drop("keep", "n").join(split, ["_kw_file", "_kw_at"])
        known = whole.unionByName(redone)
    kept = (F.col("keep._kw_file") == F.col("_kw_file")) & (F.col("keep._kw_at") == F.col("_kw_at"))
    return known.select(
        "doc_id", "_kw_file", "_kw_at", F.col("sha").alias("text_sha256"), F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"), kept.alias("kept"),
    )


def dedup_query(documents: DataFrame) -> DataFrame:
    return deduplicate(documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_documents(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay, with their columns."""
    located = with_locator(documents)
    stay = deduplicate_located(located).filter("kept").select("_kw_file", "_kw_at")
    return located.join(stay, ["_kw_file", "_kw_at"], "left_semi").select(*documents.columns)


DEDUP_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g ON t.norm = g.norm
"""
