"""Gate, recalibration and studies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.operators import analysis, gate, migrate, recalibration, reports


def pairs(spark, noise, scale=None, n=200, d=16, seed=0):
    rng = np.random.default_rng(seed)
    t = rng.normal(size=(n, d)) if scale is None else rng.normal(size=(n, 1)) * scale + 0.001 * rng.normal(size=(n, d))
    m = t + noise * rng.normal(size=(n, d))
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(m, t))], "id long, m array<double>, t array<double>")


@pytest.mark.parametrize(("low", "high", "want"), [(0.75, 0.9, "PASS"), (0.6, 0.7, "WARN"), (0.3, 0.54, "FAIL"), (0.74999, 1.0, "WARN"), (0.5, 0.55, "WARN")])
def test_verdict_bounds(spark, low, high, want):
    assert spark.range(1).select(gate.verdict(F.lit(low), F.lit(high)).alias("v")).first()["v"] == want


def test_prediction_widens_with_compression_and_stays_in_range(spark):
    grid = spark.createDataFrame([(a / 20, b / 10) for a in range(21) for b in range(12)], "top1 double, mc double")
    p, lo, hi = gate.predict(F.col("top1"), F.col("mc"))
    rows = grid.select("top1", "mc", p.alias("p"), lo.alias("lo"), hi.alias("hi")).collect()
    assert all(0 <= r["lo"] <= r["p"] <= r["hi"] <= 1 for r in rows)
    width = {r["mc"]: r["hi"] - r["lo"] for r in rows if r["top1"] == 0.9}
    assert width[0.0] > width[0.5] > width[0.9]


def test_without_a_model_the_interval_is_a_tenth(spark):
    p, lo, hi = gate.predict(F.lit(0.97), F.lit(0.1), None)
    r = spark.range(1).select(p.alias("p"), lo.alias("lo"), hi.alias("hi")).first()
    assert (r["p"], r["lo"], r["hi"]) == (0.97, pytest.approx(0.87), pytest.approx(1.07))


def test_good_pairs_pass_or_warn_and_report_everything(spark):
    row = gate.evaluate(pairs(spark, 0.01), "m", "t", holdout_top1=0.9).first()
    assert row["verdict"] in ("PASS", "WARN") and row["raw_verdict"] == "PASS"
    assert row["top1"] == 1.0 and row["optimism_gap"] == pytest.approx(-0.1) and not row["optimism_exceeded"]
    assert row["thresholds"]["pass_retention"] == 0.75


def test_noise_lowers_the_verdict(spark):
    assert gate.evaluate(pairs(spark, 6.0), "m", "t").first()["raw_verdict"] == "FAIL"


def test_thresholds_can_be_overridden(spark):
    row = gate.evaluate(pairs(spark, 0.01), "m", "t", thresholds={"pass_retention": 0.01}).first()
    assert row["verdict"] == "PASS" and row["thresholds"]["pass_retention"] == 0.01


def test_compression_is_null_without_reference_variance(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0], [1.0, 0.0]) for i in range(5)], "id long, m array<double>, t array<double>")
    assert gate.margin_compression(df, "m", "t").first()["compression"] is None


def test_compression_draws_a_reference_pair_for_each_row(spark):
    df = pairs(spark, 0.3, n=2500)
    got = [gate.margin_compression(df, "m", "t", *n).first()["compression"] for n in ((), (2500,), (2000,))]
    assert got[0] == got[1] != got[2]


@pytest.mark.parametrize(("n", "want"), [(60, 3600), (240, 50_000)])
def test_score_pairs_draws_as_many_as_the_reference(spark, n, want):
    assert recalibration.score_pairs(pairs(spark, 0.3, n=n), "m", "t").count() == want + 20 * n


def test_overlap_is_sampled_from_every_tenth_batch_and_the_last(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(450, 8))
    b = np.where(np.arange(450)[:, None] >= 440, rng.normal(size=(450, 8)), a)
    table = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = migrate.sampled_overlap(table(a), table(b), n=12, k=3, size=20).first()["overlap"]
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for at in (180, 380, 440):
        near = [np.argsort(-unit(x[at : min(at + 12, 450)]) @ unit(x[at : min(at + 12, 450)]).T, axis=1)[:, :3] for x in (a, b)]
        want += [len(set(p) & set(q)) / 3 for p, q in zip(*near)]
    assert got == pytest.approx(np.mean(want)) and got < 1


def test_bootstrap_brackets_the_measure(spark):
    ranks = spark.createDataFrame([(i, 1 if i % 4 else 20) for i in range(200)], "id long, rank long")
    got = {r["metric"]: (r["low"], r["high"]) for r in gate.bootstrap(ranks, 100).collect()}
    assert got["recall_1"][0] <= 0.75 <= got["recall_1"][1] and got["recall_1"] == got["recall_10"]


def scores(spark, n=500):
    rng = np.random.default_rng(1)
    y = rng.uniform(0, 1, n)
    return spark.createDataFrame([(float(0.7 * c + 0.1 + 0.05 * e), float(c)) for c, e in zip(y, rng.normal(size=n))], "mapped double, ceiling double")


def test_isotonic_is_monotone_and_helps(spark):
    s = scores(spark)
    xs, ys = recalibration.fit_isotonic(s)
    assert xs == sorted(xs) and ys == sorted(ys)
    after = recalibration.recalibrated(F.col("mapped"), (xs, ys))
    r = s.agg(F.avg(F.abs(F.col("mapped") - F.col("ceiling"))).alias("a"), F.avg(F.abs(after - F.col("ceiling"))).alias("b")).first()
    assert r["b"] < r["a"]


def test_recalibration_clips(spark):
    points = ([0.0, 1.0], [0.2, 0.8])
    got = spark.createDataFrame([(-9.0,), (0.5,), (9.0,), (None,)], "x double").select(recalibration.recalibrated(F.col("x"), points).alias("y")).collect()
    assert [r["y"] for r in got] == [0.2, 0.5, 0.8, None]


def test_few_scores_are_refused(spark):
    with pytest.raises(ValueError, match="10"):
        recalibration.fit_isotonic(scores(spark, 5))


def test_report_fields(spark):
    s = scores(spark)
    r = recalibration.report(s, recalibration.fit_isotonic(s)).first()
    assert set(r["agreement_after"]) == {"0.5", "0.6", "0.7", "0.8", "0.9"}
    assert r["agreement_after"]["0.7"] >= r["agreement_before"]["0.7"]
    assert r["shift"] == pytest.approx(r["mean_after"] - r["mean_before"])


def test_leave_one_out_and_summary(spark):
    rows = [(p, 0.8 + 0.01 * i, 0.6 + 0.015 * i + 0.01 * k) for k, p in enumerate("abc") for i in range(12)]
    runs = spark.createDataFrame(rows, "pair string, top1 double, retention double")
    r = analysis.residual_summary(analysis.leave_one_out(runs)).first()
    assert r["n"] == 36 and 0 < r["mae"] <= r["rmse"] and r["mae"] < 0.1


def test_config_diff_takes_null_for_missing(spark):
    a = spark.createDataFrame([("x", "1"), ("n", None)], "key string, value string")
    b = spark.createDataFrame([("x", "2")], "key string, value string")
    assert [tuple(r) for r in analysis.config_diff(a, b).collect()] == [("x", "1", "2")]


def test_reports(spark):
    row = spark.createDataFrame([("PASS", 0.5, "<b>")], "verdict string, low double, note string")
    first = row.first()
    assert "| low | 0.5000 |" in reports.markdown(first)
    assert "&lt;b&gt;" in reports.page(first) and reports.exit_code(first) == 0
    assert reports.from_json(reports.to_json(row), "verdict string, low double, note string").first() == first
    assert reports.between_markers("a [x] old [y] b", "[x]", "[y]", "new") == "a [x]\nnew\n[y] b"
    with pytest.raises(ValueError):
        reports.between_markers("a", "[x]", "[y]", "new")


def test_many_breakpoints_are_searched(spark):
    from meridian.functions import vec

    rng = np.random.default_rng(2)
    xs = sorted([float(v) for v in rng.integers(0, 40, 90) / 40.0])
    ys = sorted([float(v) for v in rng.random(90)])
    points = [None, -1.0, 0.0, 2.0, float("nan"), *xs, *[float(v) for v in rng.random(200)]]
    df = spark.createDataFrame([(v,) for v in points], "v double")
    few = vec.MOST_CASES
    try:
        vec.MOST_CASES = 1000
        want = [r[0] for r in df.select(vec.interpolate(df.v, xs, ys)).collect()]
    finally:
        vec.MOST_CASES = few
    searched = vec.interpolate(df.v, xs, ys)
    assert "CASE WHEN (v <" not in str(searched)
    assert [r[0] for r in df.select(searched).collect()] == want
    assert np.isclose(df.agg(F.sum(searched)).first()[0], sum(v for v in want if v is not None))


def test_a_band_does_not_depend_on_the_order_of_a_sum(spark):
    from meridian.operators import monitor

    assert sum([0.7] * 3) / 3 < 0.7
    df = spark.createDataFrame([(1, 2, 0.7)] * 3, "agent long, partner long, quality double").coalesce(1)
    assert monitor.pair_quality(df).first()["band"] == "acceptable"


def test_a_value_used_in_a_lambda_is_computed_once(spark):
    from meridian.functions import vec

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    twice = vec.l2_normalize(vec.l2_normalize(vec.l2_normalize(df.v)))
    rows = df.select(twice.alias("v"), vec.cosine(twice, df.v).alias("c")).collect()
    assert np.allclose(rows[0]["v"], [0.6, 0.8]) and rows[0]["c"] == pytest.approx(1.0)
    assert rows[1]["v"] == [0.0, 0.0] and rows[1]["c"] == 0.0 and rows[2]["v"] is None and rows[2]["c"] is None
    plan = df.select(twice.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sqrt") + plan.count("SQRT") == 3  # one norm for each time
