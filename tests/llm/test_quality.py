"""Quality: the distributed fit against a direct one, and held-out accuracy."""

import numpy as np
import pytest
from llm_fixtures import CLASHING, prose

from meridian.llm import quality as ql


def text(i, good):
    return ". ".join(prose(i * 7 + k, 12).capitalize() for k in range(5)) + "." if good else " | ".join([prose(i % 5, 2)] * 20)


@pytest.fixture(scope="module")
def tables(spark, docs_of):
    rows = [(i, text(i, i % 3 != 0)) for i in range(300)]
    return rows, docs_of(rows), spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(150)], "doc_id long, quality int")


def test_fit_equals_a_direct_solution(tables):
    rows, df, labels = tables
    stats = ql.features(df)
    model = ql.fit(stats, labels)
    x = np.array([ql.statistics(t) for _, t in rows[:150]])
    y = np.array([i % 3 != 0 for i in range(150)], float)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.spread[x.std(axis=0) > 1e-9], x.std(axis=0)[x.std(axis=0) > 1e-9])
    z = model.lift(x)
    want = np.linalg.solve(z.T @ z + ql.RIDGE * 150 * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model.raw(x), z @ want, atol=1e-6)
    assert (np.diff(model.points[1]) >= 0).all()


def plain_isotonic(x, y):
    """Fitted values by the max-min formula over exact scores."""
    levels = sorted(set(x.tolist()))
    mean = lambda low, high: y[(x >= low) & (x <= high)].mean()
    return {v: max(min(mean(a, b) for b in levels if b >= v) for a in levels if a <= v) for v in levels}


def test_scores_and_keeps_by_brute_force(spark, docs_of):
    """Folds, cross-fitted scores, isotonic calibration and cut-off, recomputed directly; labels are noisy."""
    rows = [(i, text(i, i % 3 != 0)) for i in range(140)]
    marks = {i: int(i % 3 != 0) if i % 7 else int(i % 2) for i in range(120)}
    df, labels = docs_of(rows), spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    fold = {r["doc_id"]: r["f"] for r in df.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {ql.FOLDS}) f").collect()}
    x, y = np.array([ql.statistics(t) for _, t in rows]), np.array([marks[i] for i in range(120)], float)
    model = ql.Model(x[:120].mean(axis=0), x[:120].std(axis=0), 1)
    z, f = model.lift(x), np.array([fold[i] for i in range(120)])
    solve = lambda a, b: np.linalg.solve(a.T @ a + ql.RIDGE * len(a) * np.eye(a.shape[1]), a.T @ b)
    out = np.array([z[i] @ solve(z[:120][f != f[i]], y[f != f[i]]) for i in range(120)])
    fitted = plain_isotonic(out, y)
    points = sorted(fitted)
    want = np.interp(z @ solve(z[:120], y), points, [fitted[p] for p in points])
    got = {r["doc_id"]: r for r in ql.quality(df, labels).collect()}
    assert np.allclose([got[i]["score"] for i in range(140)], want, atol=1e-4)
    assert all(got[i]["keep"] == (got[i]["score"] >= ql.CUTOFF) for i in got) and 10 < sum(got[i]["keep"] for i in got) < 130


def test_pools_of_parts_are_those_of_all():
    g = np.random.default_rng(3)
    x = np.sort(g.integers(0, 60, 400) / 7)
    y = (g.random(400) < x / 9).astype(float)
    level, at, n = np.unique(x, return_inverse=True, return_counts=True)
    rows = (level, level, np.bincount(at, y) / n, n)
    whole = ql.pooled(*rows)
    cut = [p for low, high in ((0, 3), (3, 6), (6, 99)) for p in ql.pooled(*(v[(level >= low) & (level < high)] for v in rows))]
    assert np.allclose(ql.pooled(*np.array(cut).T), whole)
    want = plain_isotonic(x, y)
    assert all(abs(np.interp(v, [e for p in whole for e in p[:2]], [p[2] for p in whole for _ in "ab"]) - w) < 1e-9 for v, w in want.items())


def test_ids_of_any_type(docs_of, tables):
    from pyspark.sql import functions as F

    name = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = {r["doc_id"]: r["keep"] for r in ql.quality(name(tables[1]), name(tables[2])).collect()}
    assert sum(got[f"d{i}"] == (i % 3 != 0) for i in range(150, 300)) >= 147


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 16))
    errors = []
    for seed in range(8):
        z = ql.Model(np.zeros(16), np.ones(16), seed).lift(x)[:, :-1]
        want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * ql.WIDTH**2))
        errors.append(z @ z.T - want)
    assert np.abs(np.mean(errors, axis=0)).max() < 0.12 and np.mean(errors) == pytest.approx(0, abs=0.02)


def test_held_out_accuracy(tables):
    got = {r["doc_id"]: r["keep"] for r in ql.quality(tables[1], tables[2]).collect()}
    assert len(got) == 300 and sum(got[i] == (i % 3 != 0) for i in range(150, 300)) >= 147


def test_given_labels_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    marks = labels.dropDuplicates(["doc_id"])
    got = ql.quality(docs, marks.where("doc_id % 2 = 0")).join(marks.where("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").toPandas()
    assert (got.keep == (got.quality == 1)).mean() >= 0.9


def test_awkward_rows(spark, docs_of, awkward, tables):
    df = docs_of([*tables[0][:150], *[(None if i is None else 1000 + i, t) for i, t in awkward]], **CLASHING)
    labels = tables[2].union(spark.createDataFrame([(None, 1), (1002, 1), (5, None), (6, 9), (7, 1), (7, 0)], "doc_id long, quality int"))
    rows = ql.quality(df, labels).collect()
    assert len(rows) == 150 + len(awkward)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["score"] == 0 and not by[i]["keep"] for i in (1001, 1002, 1003))
    assert len({r["score"] for r in rows if r["doc_id"] == 1005}) == 1
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_without_labels_or_documents(docs_of, tables):
    none = tables[2].where("false")
    assert [tuple(r) for r in ql.quality(docs_of([(1, "a b c")]), none).collect()] == [(1, 0.0, False)]
    assert ql.quality(tables[1].where("false"), tables[2]).count() == 0
