"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing to target weights, packing.

Every stage is one operator of zonecraft.llm with its production parameters, over all rows that the
stage before it kept.  The first four return the columns of `documents`; the last returns the
pieces of the packed sequences with their token ids.

ORACLE_SQL is None: the ids of the last stage come from a tokenizer file, which SQL cannot apply.
tests/llm/test_brute.py holds every stage against a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecraft.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from zonecraft.llm.plans import tokenizer_path
from zonecraft.session import store, tune


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the limits of their language and source."""
    tune(spark)
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate in their source, and their new lengths."""
    tune(spark)
    length = F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))
    return line_dedup.without_boilerplate(docs).withColumn("n_chars", length).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    tune(spark)
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    tune(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids, each a sequence."""
    tune(spark)
    return packing.packed(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
