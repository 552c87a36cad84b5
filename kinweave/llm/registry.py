"""Queries of the training-data operators, and their SQL oracles."""

from __future__ import annotations

from kinweave.llm import (
    chat_format,
    embedding_neardup,
    exact_dedup,
    language_id,
    mixing,
    ngram_join,
    ppm,
    sentencepiece_codec,
    sharding,
    suffix_dedup,
)
from kinweave.llm.common import read_table


def op1_ppm(spark, sf_dir):
    return ppm.score_query(read_table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op3_embedding_neardup(spark, sf_dir):
    return embedding_neardup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op4_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode_query(read_table(spark, sf_dir, "documents"))


def op5_ngram_join(spark, sf_dir):
    return ngram_join.join(read_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup_query(read_table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    return mixing.mix_query(read_table(spark, sf_dir, "documents"))


def op8_chat_format(spark, sf_dir):
    return chat_format.format_chats(read_table(spark, sf_dir, "conversations"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_query(read_table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=24)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    operators = (
        op1_ppm,
        op2_language_id,
        op3_embedding_neardup,
        op4_sentencepiece,
        op5_ngram_join,
        op6_exact_dedup,
        op7_mixing,
        op8_chat_format,
        op9_suffix_dedup,
        op10_sharding,
        pipeline,
    )
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict:
    return {"op6_exact_dedup": exact_dedup.DEDUP_SQL, "op7_mixing": mixing.MIX_SQL}
