"""The corpus pipeline: language, exact and near copies, source mix, packing.

Every stage works on all rows that the one before kept, as a table written and read again; all but
the last return the columns of ``documents``.

* ``language_id`` drops documents without a language: null texts, texts without letters, and those
  with less than 0.4 of their letters in spans of known languages; a text may mix several. Its model
  learns from all labelled rows.
* ``exact_dedup`` keeps one document of each group of equal texts.
* ``near_dedup`` keeps the least doc_id of each group of near-duplicates.
* ``source_mix`` takes documents towards their source's target; one may be taken twice, as two rows.
* ``packing`` returns the pieces of the training sequences, with their ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cairn.llm import exactdup, langid, mixing, neardup, packing
from cairn.plans.shared import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.train(docs), least=0.4)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdup.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.near_dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", pack)]

#: Language models and retrieval have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
