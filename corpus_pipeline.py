"""The corpus pipeline: five operators, each stage written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import decontaminate, minhash, mixing, quality_rules, sharding
from marketloom.llm.common import stored, table
from marketloom.session import ship_package


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the fixed rules or a proven cutoff reject go."""
    ship_package(spark)
    return quality_rules.rejected_removed(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id: five words, a similarity of 0.8."""
    ship_package(spark)
    return minhash.copies_removed(docs, width=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    ship_package(spark)
    return decontaminate.leaks_removed(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    ship_package(spark)
    return mixing.mixed(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard and their place in it."""
    return sharding.sharded(docs)


STAGES = [("quality_rules", drop_low_quality), ("minhash_dedup", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_sources), ("sharding", deal_shards)]

#: Learnt cutoffs, random rounding and the shuffle have no SQL form; tests/llm holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
