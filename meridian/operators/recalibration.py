"""Isotonic recalibration of scores, and the report on it."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions import vec
from meridian.operators.knn import topk
from meridian.plans.numbering import numbered

LEAST_PAIRS = 10
THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)


def fit_isotonic(scores: DataFrame, x: str = "mapped", y: str = "ceiling") -> tuple[list[float], list[float]]:
    """Breakpoints of the non-decreasing fit of y on x; ten pairs at least."""
    rows = scores.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(1.0).alias("w")).where("x is not null and y is not null")
    if rows.limit(LEAST_PAIRS).count() < LEAST_PAIRS:
        raise ValueError(f"recalibration needs {LEAST_PAIRS} pairs at least")
    model = IsotonicRegression(featuresCol="f", labelCol="y", weightCol="w").fit(VectorAssembler(inputCols=["x"], outputCol="f").transform(rows))
    return [float(b) for b in model.boundaries], [float(p) for p in model.predictions]


def recalibrated(score: Column, points: tuple[list[float], list[float]] | None) -> Column:
    """Linear between breakpoints, constant outside; unchanged without a fit."""
    return vec.interpolate(score, *points) if points else score


def score_pairs(pairs: DataFrame, mapped: str, target: str, n_random: int | None = None, per_query: int = 20, seed: int = 0, id_col: str = "id") -> DataFrame:
    """(q, d, mapped, ceiling): hash-drawn random pairs, and each query's top candidates in the mapped space; duplicates stay.

    By default min(50,000, n * n) pairs are drawn of n rows.
    """
    keyed = pairs.select(F.col(id_col).alias("id"), F.col(mapped).cast("array<double>").alias("m"), F.col(target).cast("array<double>").alias("t"))
    n = keyed.count()
    n_random = min(50_000, n * n) if n_random is None else n_random
    listed = numbered(keyed, "id", name="k")
    draw = lambda s: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{s}:"), F.col("r").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(max(1, n)))
    random = pairs.sparkSession.range(n_random).select(F.col("id").alias("r")).select(draw("q").alias("kq"), draw("d").alias("kd"))
    a, b = listed.alias("a"), listed.alias("b")
    near = topk(keyed.select("id", F.col("m").alias("vec")), keyed.select("id", F.col("t").alias("vec")), per_query).select(F.col("query_id").alias("q"), F.col("id").alias("d"))
    chosen = random.join(a, F.col("kq") == F.col("a.k")).join(b, F.col("kd") == F.col("b.k")).select(F.col("a.id").alias("q"), F.col("b.id").alias("d")).unionByName(near)
    x, y = keyed.alias("x"), keyed.alias("y")
    both = chosen.join(x, F.col("q") == F.col("x.id")).join(y, F.col("d") == F.col("y.id"))
    return both.select("q", "d", vec.cosine(F.col("x.m"), F.col("y.t")).alias("mapped"), vec.cosine(F.col("x.t"), F.col("y.t")).alias("ceiling"))


def threshold_agreement(scores: DataFrame, a: Column, b: Column, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, agreement): how often two scores fall on the same side."""
    tau = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    return scores.select(a.alias("a"), b.alias("b"), tau).groupBy("threshold").agg(F.avg(((F.col("a") >= F.col("threshold")) == (F.col("b") >= F.col("threshold"))).cast("double")).alias("agreement"))


def top_gap(scores: DataFrame, score: Column, n: int = 20) -> DataFrame:
    """(gap): the mean difference of neighbours among the n highest scores, which telescopes to their range."""
    top = scores.select(score.alias("s")).orderBy(F.desc("s")).limit(n)
    return top.agg(F.coalesce((F.max("s") - F.min("s")) / F.nullif(F.count("*") - 1, F.lit(0)), F.lit(0.0)).alias("gap"))


def report(scores: DataFrame, points: tuple[list[float], list[float]], x: str = "mapped", y: str = "ceiling") -> DataFrame:
    """One row: means before and after, their shift, margins of the top 20, their ratio, and agreement by threshold before and after."""
    after = recalibrated(F.col(x), points)
    means = scores.agg(F.avg(x).alias("mean_before"), F.avg(after).alias("mean_after"), F.avg(y).alias("mean_ceiling"))
    gaps = top_gap(scores, F.col(x)).withColumnRenamed("gap", "margin_before").crossJoin(top_gap(scores, after).withColumnRenamed("gap", "margin_after"))
    agree = [threshold_agreement(scores, c, F.col(y)).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("threshold").cast("string"), "agreement")))).alias(n)) for c, n in ((F.col(x), "agreement_before"), (after, "agreement_after"))]
    out = means.crossJoin(gaps).crossJoin(agree[0]).crossJoin(agree[1])
    return out.withColumn("shift", F.col("mean_after") - F.col("mean_before")).withColumn("margin_ratio", F.when(F.col("margin_before") <= 1e-12, 1.0).otherwise(F.col("margin_after") / F.col("margin_before")))
