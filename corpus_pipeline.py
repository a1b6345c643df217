"""From documents to balanced shards, one stage after the other.

Each stage takes (spark, docs, sf_dir), docs with the columns of the documents
table and any others, and works on all rows that the stage before kept.  What it
makes of nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing names is what the operator that it calls says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm.decontaminate import decontaminate
from meridian.llm.mixing import mix_rows
from meridian.llm.near_dedup import near_dedup
from meridian.llm.sharding import shard_rows
from meridian.llm.toxicity import drop_toxic
from meridian.plans.materialize import discard, settled


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the nearest labelled examples call toxic; null and empty texts stay."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies; null ids, and texts without words, stay."""
    return near_dedup(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold half or more of a benchmark item in a window of its length; null and empty texts stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or sampled by their source's epochs; a null source is one of its own."""
    return mix_rows(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with a shard; rows of one text, null ones too, share it."""
    return shard_rows(docs)


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: SQL can't express the nearest-neighbour search, MinHash or differencing; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: the columns of documents and the shard.

    A stage's own tables are deleted when its rows are written, and its rows when
    the next stage has read them.  An empty documents table gives no rows.
    """
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs, path = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        discard(spark, read)
        read = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
