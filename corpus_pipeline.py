"""A corpus pipeline of the operators in tidewater.llm: STAGES in order, and run() over the table documents.

Each stage takes (spark, docs, sf_dir) and returns documents with their columns; the last
returns packed pieces. Between stages rows are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from tidewater.llm.common import stored, table

#: Words whose ids a worker keeps for the last stage: it outlives the stage, beside what the others hold.
REMEMBER = 60_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, or no letter in them) go; the model's label and score don't filter."""
    return language_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the mix."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), remember=REMEMBER)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixed", mixed), ("packed", packed)]

#: Language identification has no SQL form; tests hold the pipeline against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
