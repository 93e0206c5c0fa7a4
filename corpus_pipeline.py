"""A training-corpus pipeline over `documents`: quality rules, SimHash near-dedup, benchmark
decontamination, mixing, token output. Each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from footfall.llm.common import stored, table
from footfall.llm.decontamination import keep_clean
from footfall.llm.mixing import mix
from footfall.llm.quality_rules import keep_good
from footfall.llm.simhash import keep_one
from footfall.llm.token_output import token_output


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base check and the learned decision list."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: a row for each copy, none for those left out."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each mixed document in the written token files."""
    return token_output(docs)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("decontamination", decontaminate),
          ("mixing", mixed), ("token_output", tokens)]

#: The learned rules, fingerprints and tokenizer have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
