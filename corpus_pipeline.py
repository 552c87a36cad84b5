"""A corpus pipeline over ``documents``: every stage is written as Parquet and read again by the next.

1. language: rows whose language cannot be told are left out;
2. exact: of equal texts the row with the largest id stays;
3. near: of near-duplicate texts the row with the smallest id stays;
4. mix: rows are repeated to the target weights of their sources and shuffled;
5. tokens: texts become SentencePiece tokens, in the order of the mix.

Of exact copies the largest id stays, of near copies the smallest: each stage keeps
what its operator defines. Null and empty texts have no language and go first; rows
without id stay as rows of their own; rows that repeat an id are judged by their
texts; other columns, whatever their names, are carried to the mix. An empty table
gives an empty one in every stage.

The last stage returns doc_id, lang, source, n_tokens and ids. An id whose rate
draws several copies comes that often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import exact_dedup, language_id, mixing, ngram_join, sentencepiece_codec
from kinweave.llm.common import materialise, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs, ["doc_id", "lang", "source"])


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

#: SQL cannot express the language model, the walk over prefix trees or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
