"""Studies of maps and of benchmark runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions import vec
from meridian.operators.linalg import gram
from meridian.operators.mapping import ALPHAS, Blocks, Mapping
from meridian.operators.recalibration import fit_isotonic
from meridian.plans.materialize import materialize


def residual_spectrum(pairs: DataFrame, mapping: Mapping, x: str = "x", y: str = "y", id_col: str = "id") -> DataFrame:
    """(k, sigma, explained, cumulative, effective_rank, signal_norm, residual_norm) of the residuals, by their Gram matrix."""
    spark = pairs.sparkSession
    mapped = mapping.transform(pairs.select(id_col, F.col(x).alias("v"), F.col(y).cast("array<double>").alias("t")), "v")
    target = vec.l2_normalize(F.col("t")) if mapping.normalize_output else F.col("t")
    g, _ = gram(mapped.select(F.zip_with(target, F.col("v"), lambda a, b: a - b).alias("r")), ["r"])
    s, _ = gram(mapped.select(target.alias("t")), ["t"])
    sigma = np.sqrt(np.maximum(np.linalg.eigvalsh(g)[::-1], 0))
    power = sigma**2 / max((sigma**2).sum(), 1e-300)
    share = sigma / max(sigma.sum(), 1e-300)
    effective = float(np.exp(-(share * np.log(np.maximum(share, 1e-300))).sum()))
    rows = [(k, float(v), float(power[k]), float(power[: k + 1].sum()), effective, float(np.sqrt(np.trace(s))), float(np.sqrt(np.trace(g)))) for k, v in enumerate(sigma)]
    return spark.createDataFrame(rows, "k int, sigma double, explained double, cumulative double, effective_rank double, signal_norm double, residual_norm double")


def alpha_curve(pairs: DataFrame, x: str = "x", y: str = "y", alphas: np.ndarray = ALPHAS) -> DataFrame:
    """(alpha, mse, within_5pct, n_best_dims): in-sample error in closed form from the Gram blocks, without another scan."""
    b = Blocks.of(pairs, x, y, False)
    values, vectors = np.linalg.eigh(b.xx)
    p = vectors.T @ b.xy
    errors = []
    for alpha in alphas:
        w = p / (np.maximum(values, 0) + alpha)[:, None]
        errors.append((np.diag(b.yy) - 2 * (w * p).sum(axis=0) + (w * w * values[:, None]).sum(axis=0)) / b.n)
    errors = np.array(errors)
    mse, best = errors.mean(axis=1), errors.argmin(axis=0)
    rows = [(float(a), float(m), bool(m <= 1.05 * mse.min()), int((best == k).sum())) for k, (a, m) in enumerate(zip(alphas, mse))]
    return pairs.sparkSession.createDataFrame(rows, "alpha double, mse double, within_5pct boolean, n_best_dims int")


def run_groups(runs: DataFrame, by: list[str], value: str = "retention") -> DataFrame:
    """(by..., n, mean, std_sample, std_population)."""
    return runs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std_sample"), F.stddev_pop(value).alias("std_population"))


def k_sweep(runs: DataFrame, value: str = "retention") -> DataFrame:
    """(adapter, k, n, mean, std): by adapter, and by adapter and k, in one pass of grouping sets."""
    adapter, k = F.col("adapter"), F.col("k")
    return runs.groupingSets([[adapter], [adapter, k]], adapter, k).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def config_diff(a: DataFrame, b: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, left, right) where two configurations (key, value) differ, missing keys included."""
    both = a.select(key, F.col(value).alias("left")).join(b.select(key, F.col(value).alias("right")), key, "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def pair_key(*columns: str) -> Column:
    return F.concat_ws("::", *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in columns])


def leave_one_out(runs: DataFrame, pair: str = "pair", x: str = "top1", y: str = "retention") -> DataFrame:
    """(pair, x, y, predicted, residual): each pair's runs predicted by an isotonic fit on the others'."""
    from meridian.operators.recalibration import recalibrated

    out = None
    complete = runs.dropna(subset=[pair, x, y])
    for r in complete.select(pair).distinct().orderBy(pair).collect():  # pairs of models, a handful
        points = fit_isotonic(complete.where(F.col(pair) != r[0]), x, y)
        part = complete.where(F.col(pair) == r[0]).select(F.col(pair).alias("pair"), F.col(x).alias("x"), F.col(y).alias("y"), recalibrated(F.col(x).cast("double"), points).alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("residual", F.col("y") - F.col("predicted"))


def residual_summary(residuals: DataFrame) -> DataFrame:
    """(n, mae, rmse, half_width_80, mean_residual, std_residual): the half-width is the int(0.8 n)-th absolute residual."""
    rank = F.row_number().over(Window.orderBy(F.abs("residual"))) - 1
    ranked = residuals.withColumn("r", rank).crossJoin(residuals.agg(F.count("*").alias("total")))
    return ranked.agg(F.count("*").alias("n"), F.avg(F.abs("residual")).alias("mae"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"), F.max(F.when(F.col("r") == F.least(F.floor(0.8 * F.col("total")), F.col("total") - 1), F.abs("residual"))).alias("half_width_80"), F.avg("residual").alias("mean_residual"), F.stddev_pop("residual").alias("std_residual"))


def pair_errors(residuals: DataFrame) -> DataFrame:
    """(pair, mae, is_best, is_worst)."""
    per = residuals.groupBy("pair").agg(F.avg(F.abs("residual")).alias("mae"))
    ends = per.agg(F.min_by("pair", F.struct("mae", "pair")).alias("b"), F.max_by("pair", F.struct("mae", "pair")).alias("w"))
    return per.crossJoin(ends).select("pair", "mae", (F.col("pair") == F.col("b")).alias("is_best"), (F.col("pair") == F.col("w")).alias("is_worst"))


def train_gate(runs: DataFrame, pair: str = "pair", x: str = "top1", y: str = "retention"):
    """The gate model of benchmark runs: isotonic over all, half-width from leaving out one pair at a time."""
    from meridian.operators.gate import GateModel

    summary = residual_summary(leave_one_out(runs, pair, x, y)).first()
    xs, ys = fit_isotonic(runs.dropna(subset=[x, y]), x, y)
    return GateModel(xs, ys, float(summary["half_width_80"]))


def tiered_cost(plans: DataFrame, high: float = 0.12, low: float = 0.02) -> DataFrame:
    """``plans`` (texts, avg_tokens, high_share) with usd_always_high, usd_tiered and savings."""
    millions = F.col("texts") * F.col("avg_tokens") / 1e6
    tiered = millions * F.col("high_share") * high + millions * (1 - F.col("high_share")) * low
    return plans.select("*", (millions * high).alias("usd_always_high"), tiered.alias("usd_tiered"), (millions * high - tiered).alias("savings"))


def trial_retention(pairs: DataFrame, samplers: dict, trials: int = 5, kind: str = "ridge", x: str = "x", y: str = "y", id_col: str = "id", **options) -> dict[str, list[float]]:
    """Top-1 retention by strategy and trial: ``samplers`` give a calibration sample for (pairs, seed), on the rest of which its map is measured."""
    from meridian.operators.mapping import fit
    from meridian.operators.metrics import topk_retention

    out: dict[str, list[float]] = {}
    for name, sampler in samplers.items():
        for seed in range(trials):
            chosen = materialize(sampler(pairs, seed).select(id_col, x, y), "trial")
            fitted = fit(kind, chosen, x=x, y=y, **options)
            rest = fitted.transform(pairs.join(chosen.select(id_col), id_col, "left_anti").select(id_col, F.col(x).alias("v"), vec.l2_normalize(vec.doubles(y)).alias("t")), "v")
            out.setdefault(name, []).append(topk_retention(rest, "v", "t", 1, id_col).first()["retention"])
    return out


def sampling_trials(trials: dict[str, list[float]], spark: SparkSession) -> DataFrame:
    """(strategy, mean, delta) of repeated trials against the first strategy."""
    rows = [(n, k, float(v)) for n, values in trials.items() for k, v in enumerate(values)]
    means = spark.createDataFrame(rows, "strategy string, trial int, value double").groupBy("strategy").agg(F.avg("value").alias("mean"))
    base = means.where(F.col("strategy") == next(iter(trials))).select(F.col("mean").alias("base"))
    return means.crossJoin(base).select("strategy", "mean", (F.col("mean") - F.col("base")).alias("delta"))
