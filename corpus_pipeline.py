"""Cleans and packs a corpus: five stages, each on all that the one before kept.

Documents that the quality rules reject go; then repeated lines, all but one document of each near-duplicate class,
and repeated passages; what is left is packed into sequences. Every stage but the last returns the columns of documents.

Nulls: a null or empty text has no words, so the first stage drops it; a null doc_id comes after all numbers. Of equal
rows near-dedup keeps one. Ties go to the smaller doc_id, then to the smaller hash of the text. Texts of any length are
read whole. Columns whose names the operators use as well stay as they are. An empty table gives no sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirameki.cluster import ship
from hirameki.llm import linededup, near, packing, quality, substrings
from hirameki.llm.common import written


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs).where("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _with_length(linededup.drop_duplicate_lines(docs)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near.near_duplicates(docs).where("kept").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _with_length(substrings.remove_repeats(docs)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
