"""Fits against closed forms on seeded Gaussian pairs, and what maps refuse."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.operators import analysis, linalg, mapping
from meridian.sources import models


def gaussian(n, d_src, d_tgt, noise=0.01, seed=0, orthogonal=False):
    rng = np.random.default_rng(seed)
    x, w = rng.normal(size=(n, d_src)), rng.normal(size=(d_src, d_tgt))
    if orthogonal:
        w = np.linalg.qr(w)[0]
    return x, x @ w + noise * rng.normal(size=(n, d_tgt)), w


def frame(spark, x, y):
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, y array<double>").repartition(3)


@pytest.fixture(scope="module")
def rectangular(spark):
    x, y, _ = gaussian(300, 16, 24)
    return x, y, frame(spark, x, y).cache()


@pytest.fixture(scope="module")
def square(spark):
    x, y, w = gaussian(300, 16, 16, orthogonal=True)
    return x, y, w, frame(spark, x, y).cache()


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_gram_equals_numpy(rectangular):
    x, y, df = rectangular
    g, n = linalg.gram(df, ["x", "y"], bias=True)
    full = np.hstack([x, y, np.ones((len(x), 1))])
    assert n == len(x) and np.allclose(g, full.T @ full)


def test_ridge_equals_normal_equations(rectangular):
    x, y, df = rectangular
    m = mapping.fit_ridge(df, alpha=0.5, bias=True)
    a = np.hstack([x, np.ones((len(x), 1))])
    assert np.allclose(m.weights, np.linalg.solve(a.T @ a + 0.5 * np.eye(17), a.T @ y), atol=1e-8)
    b = np.hstack([y, np.ones((len(y), 1))])
    assert np.allclose(m.inverse, np.linalg.solve(b.T @ b + 0.5 * np.eye(25), b.T @ x), atol=1e-8)


def test_automatic_alpha_minimises_the_leave_one_out_error(spark):
    x, y, _ = gaussian(60, 6, 4, noise=2.0)
    m = mapping.fit_ridge(frame(spark, x, y), bias=False)

    def loo(alpha):
        h = x @ np.linalg.solve(x.T @ x + alpha * np.eye(6), x.T)
        return (((y - h @ y) / (1 - np.diag(h))[:, None]) ** 2).mean()

    assert np.isclose(m.alpha, min(mapping.ALPHAS, key=loo))


def test_procrustes_is_orthogonal_and_recovers(square):
    x, y, w, df = square
    m = mapping.fit_procrustes(df)
    assert np.allclose(m.weights.T @ m.weights, np.eye(16), atol=1e-9)
    assert np.allclose(m.weights, w, atol=0.05)
    assert np.allclose(m.inverse, m.weights.T)


def test_procrustes_diag_inverse_is_an_inverse(spark, square):
    x, _, w, _ = square
    df = frame(spark, x, x @ w * np.linspace(0.5, 2, 16))
    m = mapping.fit_procrustes_diag(df)
    assert np.allclose(m.weights @ m.inverse, np.eye(16), atol=1e-6)


def test_square_maps_refuse_rectangles(rectangular):
    with pytest.raises(mapping.MappingError):
        mapping.fit_procrustes(rectangular[2])


def test_full_rank_lowrank_equals_ridge(rectangular):
    df = rectangular[2]
    a, b = mapping.fit_lowrank(df, alpha=0.5), mapping.fit_ridge(df, alpha=0.5)
    assert np.allclose(a.weights, b.weights, atol=1e-4)


def test_lowrank_has_its_rank(rectangular):
    m = mapping.fit_lowrank(rectangular[2], rank=3, alpha=0.5)
    assert np.linalg.matrix_rank(m.weights) == 3 and np.linalg.matrix_rank(m.inverse) == 3


def test_protocol_fit_recovers(rectangular):
    x, y, df = rectangular
    m = mapping.fit_protocol(df)
    assert np.allclose(x @ m.weights, y, atol=0.1)


def test_mlp_learns(spark):
    x, y, _ = gaussian(200, 8, 8, orthogonal=True)
    m = mapping.fit_mlp(frame(spark, x, y), hidden=16, epochs=300, rate=1e-2)
    got = m.apply(x)
    assert (unit(got) * unit(y)).sum(axis=1).mean() > 0.8


def test_mlp_counts_every_pair(spark):
    """More than 20,000 pairs: the last ones, of another map, move the network."""
    x, y, _ = gaussian(24_000, 4, 4, orthogonal=True)
    df = frame(spark, x, y)
    rows = df.select(F.md5(F.concat(F.lit("0:"), F.col("id").cast("string"))).alias("h"), "id").orderBy("h").collect()
    late = np.array([r["id"] for r in rows[20_000:]])
    z = y.copy()
    z[late] = -y[late]
    a, b = (mapping.fit_mlp(d, hidden=4, epochs=5, rate=1e-2).layers["forward"] for d in (df, frame(spark, x, z)))
    assert not np.allclose(a[3], b[3]) and not np.allclose(a[2], b[2])


@pytest.mark.parametrize(("p", "q"), [(6, 6), (7, 3)])
def test_mlp_on_the_executors_equals_that_on_the_driver(spark, monkeypatch, p, q):
    x, y, _ = gaussian(300, p, q, orthogonal=p == q)
    df = frame(spark, x, y).repartition(5)
    local = mapping.fit_mlp(df, hidden=8, epochs=4, rate=1e-2)
    monkeypatch.setattr(mapping, "MLP_BYTES", 0)
    spread = mapping.fit_mlp(df, hidden=8, epochs=4, rate=1e-2)
    for way in ("forward", "inverse"):
        assert all(np.allclose(u, v, atol=1e-9) for u, v in zip(local.layers[way], spread.layers[way]))


def test_transform_equals_apply_and_is_unit(rectangular):
    x, _, df = rectangular
    m = mapping.fit_ridge(df, alpha=0.5)
    rows = m.transform(df.select("id", "x"), "x", "out").orderBy("id").collect()
    out = np.array([r["out"] for r in rows])
    assert np.allclose(out, m.apply(x)) and np.allclose(np.linalg.norm(out, axis=1), 1)


def test_fit_is_deterministic_over_partitionings(rectangular):
    df = rectangular[2]
    a, b = mapping.fit_ridge(df, alpha=0.5), mapping.fit_ridge(df.repartition(7), alpha=0.5)
    assert np.allclose(a.weights, b.weights, atol=1e-12)


def test_round_trip_recovers_direction(square):
    x, _, _, df = square
    m = mapping.fit_procrustes(df)
    back = m.apply(m.apply(x), inverse=True)
    assert (unit(back) * unit(x)).sum(axis=1).mean() > 0.99


@pytest.mark.parametrize("bad", [[float("nan")] * 8, [float("inf")] * 8, [1.0] * 7, None])
def test_bad_vectors_are_refused(spark, bad):
    x, y, _ = gaussian(20, 8, 8)
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    rows[3] = (3, bad, rows[3][2])
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<double>")
    with pytest.raises(ValueError):
        mapping.fit_ridge(df, alpha=1.0)


def test_few_pairs_warn(spark):
    x, y, _ = gaussian(20, 16, 16)
    with pytest.warns(UserWarning):
        mapping.fit_ridge(frame(spark, x, y), alpha=1.0)


def test_unknown_kind_is_an_error(rectangular):
    with pytest.raises((KeyError, ValueError)):
        mapping.fit("nothing", rectangular[2])


def test_wrong_dimension_fails_on_apply(rectangular):
    m = mapping.fit_ridge(rectangular[2], alpha=1.0)
    with pytest.raises(ValueError):
        m.apply(np.ones((2, 5)))


@pytest.mark.parametrize("kind", ["ridge", "mlp"])
def test_persistence_keeps_everything(spark, tmp_path, square, kind):
    x, _, _, df = square
    m = mapping.fit_ridge(df, alpha=0.5) if kind == "ridge" else mapping.fit_mlp(df, hidden=8, epochs=3)
    m.recalibrator = ([0.0, 1.0], [0.2, 0.9])
    m = m.with_metadata(note="kept")
    models.save(spark, m, f"{tmp_path}/model")
    for again in (models.load(spark, f"{tmp_path}/model"), models.from_bytes(models.to_bytes(m))):
        assert again.kind == m.kind and again.alpha == m.alpha and again.inverse_alpha == m.inverse_alpha
        assert again.metadata == {"note": "kept"} and [list(p) for p in again.recalibrator] == [[0.0, 1.0], [0.2, 0.9]]
        assert np.allclose(again.apply(x), m.apply(x)) and again.checksum == m.checksum
    assert models.inspect(spark, f"{tmp_path}/model")["d_tgt"] == m.d_tgt
    assert models.header_of(models.to_bytes(m))[0]["kind"] == m.kind


def test_other_files_are_no_models():
    with pytest.raises(mapping.MappingError):
        models.from_bytes(b"nothing of the kind")


def test_alpha_curve_has_its_minimum_at_the_least_alpha(rectangular):
    rows = analysis.alpha_curve(rectangular[2]).orderBy("alpha").collect()
    assert [r["mse"] for r in rows] == sorted(r["mse"] for r in rows)


def test_residual_spectrum_equals_svd(rectangular):
    x, y, df = rectangular
    m = mapping.fit_ridge(df, alpha=0.5)
    s = np.linalg.svd(unit(y) - m.apply(x), compute_uv=False)
    got = [r["sigma"] for r in analysis.residual_spectrum(df, m).orderBy("k").collect()]
    assert np.allclose(got, s, atol=1e-6)
