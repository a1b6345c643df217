"""Paired embedding spaces derived from the one space of the ``embeddings`` table, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import vec

DIMS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, x)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x"))


def _signed(x: Column, j: Column) -> Column:
    return F.when(j % 2 == 0, 1.0).otherwise(-1.0) * F.get(x, (j * 27 + 5) % DIMS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, x, y, m, t): y is a signed permutation of x with noise, m its exact part, t the unit y."""
    i, places = F.col("id"), F.sequence(F.lit(0), F.lit(DIMS - 1))
    noise = lambda j: F.lit(0.15) * ((i * 1103515245 + j * 12345 + i * j * 2654435) % 2048 / F.lit(1024.0) - 1)
    both = embeddings(spark, sf_dir).withColumn("y", F.transform(places, lambda j: _signed(F.col("x"), j) + noise(j.cast("long")))).withColumn("m", F.transform(places, lambda j: _signed(F.col("x"), j)))
    return both.select("id", "label", "x", "y", vec.l2_normalize(F.col("m")).alias("m"), vec.l2_normalize(F.col("y")).alias("t"))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and corpus: each row whose id is divisible by 100, against all rows."""
    return df.where("id % 100 = 0"), df


def fixed_map(spark: SparkSession) -> DataFrame:
    """The signed permutation as (i, j, w): its inverse is its transpose."""
    return spark.range(DIMS).select(((F.col("id") * 27 + 5) % DIMS).cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0).alias("w"))


_UNIT = "list_transform({0}, lambda e: e / greatest(sqrt(list_dot_product({0}, {0})), 1e-12::DOUBLE))"
EMB = "emb as (select vec_id as id, label, embedding::DOUBLE[] as x from embeddings)"
PAIR = f"""{EMB}, raw as (
  select id, label, x,
    list_transform(range({DIMS}), lambda j: (case when j % 2 = 0 then 1 else -1 end)::DOUBLE * x[(27 * j + 5) % {DIMS} + 1]
      + 0.15::DOUBLE * (((id * 1103515245 + j * 12345 + id * j * 2654435) % 2048) / 1024.0::DOUBLE - 1)) as y,
    list_transform(range({DIMS}), lambda j: (case when j % 2 = 0 then 1 else -1 end)::DOUBLE * x[(27 * j + 5) % {DIMS} + 1]) as m0
  from emb
), pair as (select id, label, x, y, {_UNIT.format('m0')} as m, {_UNIT.format('y')} as t from raw)"""


def sims_sql(name: str, a: str, b: str, queries: str = "is not null", corpus: str = "is not null") -> str:
    """A CTE of rounded similarities (q, d, sim, rank)."""
    return f"""{name} as (select q, d, sim, row_number() over (partition by q order by sim desc, d) as rank from (
  select a.id as q, b.id as d, round(list_dot_product(a.{a}, b.{b}), 9) as sim from pair a, pair b where a.id {queries} and b.id {corpus}))"""


QUERY, CORPUS = "% 100 = 0", "is not null"
