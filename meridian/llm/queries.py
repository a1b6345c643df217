"""Queries of the operators over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridian.llm import fingerprints, mixing
from meridian.llm.chat import format_chats
from meridian.llm.decontaminate import contamination
from meridian.llm.fingerprints import paragraph_changes
from meridian.llm.mixing import mix
from meridian.llm.near_dedup import near_classes
from meridian.llm.quality import quality
from meridian.llm.secrets import scan
from meridian.llm.sharding import shard_ids
from meridian.llm.token_counts import token_counts
from meridian.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_changes(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_ids(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_near_dedup, op2_quality, op3_fingerprints, op4_decontaminate, op5_mixing, op6_toxicity, op7_secrets, op8_chat, op9_token_counts, op10_sharding)
    return {query.__name__: query for query in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_fingerprints": fingerprints.ORACLE_SQL, "op5_mixing": mixing.ORACLE_SQL}
