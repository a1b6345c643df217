"""k-NN, ranks and metrics against brute force, and properties that hold for any input."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from meridian.functions import vec
from meridian.operators import knn, metrics
from meridian.operators.blocks import normalized


def table(spark, m, name="vec", first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(m)], f"id long, {name} array<double>")


def brute(q, c, k):
    sims = np.round(normalized(q) @ normalized(c).T, 9)
    return [[(int(j), float(s[j])) for j in np.lexsort((np.arange(s.size), -s))[:k]] for s in sims]


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_topk_equals_brute_force_both_ways(spark, limit, k):
    rng = np.random.default_rng(3)
    q, c = rng.integers(-2, 3, (23, 5)).astype(float), rng.integers(-2, 3, (301, 5)).astype(float)
    rows = knn.topk(table(spark, q), table(spark, c).repartition(3), k, broadcast_bytes=limit).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["id"], r["sim"]))
    want = brute(q, c, k)
    for i, expected in enumerate(want):
        assert [j for j, _ in got[i]] == [j for j, _ in expected]
        assert np.allclose([s for _, s in got[i]], [s for _, s in expected])


def test_topk_of_empty_tables(spark):
    some, none = table(spark, np.ones((2, 3))), table(spark, np.ones((1, 3))).where("false")
    assert knn.topk(some, none, 3).count() == 0 and knn.topk(none, some, 3).count() == 0


def test_exclude_self(spark):
    t = table(spark, np.eye(4))
    assert knn.topk(t, t, 4, exclude_self=True).where("query_id = id").count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_self_ranks_equal_brute_force(spark, limit):
    rng = np.random.default_rng(5)
    m, t = rng.integers(-2, 3, (60, 4)) + 0.0, rng.integers(-2, 3, (60, 4)) + 0.0
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(m, t))], "id long, m array<double>, t array<double>")
    sims = np.round(normalized(m) @ normalized(t).T, 9)
    want = {i: 1 + sum((s[j] > s[i]) or (s[j] == s[i] and j < i) for j in range(60) if j != i) for i, s in enumerate(sims)}
    got = {r["id"]: r["rank"] for r in knn.self_ranks(df, "m", "t", broadcast_bytes=limit).collect()}
    assert got == want


def test_csls_penalises_hubs(spark):
    q, c = np.array([[1.0, 0.1], [1.0, -0.1], [0.9, 0.2]]), np.array([[1.0, 0.0], [0.3, 1.0], [1.0, 0.2]])
    rows = knn.csls(table(spark, q), table(spark, c), k=2, top=3).collect()
    sims = normalized(q) @ normalized(c).T
    pen = np.sort(sims, axis=0)[-2:].mean(axis=0)
    for r in rows:
        assert r["score"] == pytest.approx(2 * sims[r["query_id"], r["id"]] - pen[r["id"]], abs=1e-6)
    assert len(rows) == 9


def test_merge_keeps_the_best_and_floors(spark):
    shape = "query_id long, id long, score double"
    a, b = spark.createDataFrame([(1, 1, 0.9), (1, 2, -0.5), (1, 3, 0.2)], shape), spark.createDataFrame([(1, 1, 0.5), (1, 4, 0.8)], shape)
    got = [(r["id"], r["score"]) for r in knn.merge_hits(a, b, 1.0, 2.0).orderBy("rank").collect()]
    assert got == [(4, 1.6), (1, 1.0), (3, 0.2), (2, 0.0)]
    gone = spark.createDataFrame([(3,)], "id long")
    assert {r["id"] for r in knn.merge_hits(a, b, migrated=gone).collect()} == {1, 2, 4}


def test_ranking_metrics_by_hand(spark):
    ranking = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 11, 0.8), (1, 3, 12, 0.7), (2, 1, 10, 0.5)], "query_id long, rank int, id long, sim double")
    qrels = spark.createDataFrame([(1, 11), (1, 99), (1, 11), (2, 7)], "query_id long, doc_id long")
    rows = {r["query_id"]: r for r in metrics.ranking_metrics(ranking, qrels).collect()}
    ideal = 1 + 1 / np.log2(3)
    assert rows[1]["ndcg_10"] == pytest.approx(1 / np.log2(3) / ideal) and rows[1]["recall_10"] == 0.5 and rows[1]["n_rel"] == 2
    assert rows[2]["ndcg_10"] == 0 and rows[2]["recall_100"] == 0


def test_margin_of_a_single_candidate_is_zero(spark):
    ranking = spark.createDataFrame([(1, 1, 10, 0.9)], "query_id long, rank int, id long, sim double")
    assert metrics.margins(ranking).first()["margin"] == 0
    assert metrics.confidence_summary(metrics.confidence(ranking.where("false"))).first()["n"] == 0


def test_few_queries_get_fixed_confidence_bounds(spark):
    rows = [(q, r, r, s) for q, gap in ((1, 0.1), (2, 0.01), (3, 0.001)) for r, s in ((1, 0.9), (2, 0.9 - gap))]
    ranking = spark.createDataFrame(rows, "query_id long, rank int, id long, sim double")
    assert {r["query_id"]: r["confidence"] for r in metrics.confidence(ranking).collect()} == {1: "high", 2: "medium", 3: "low"}


def test_floor_of_other_dimensions_is_zero(spark):
    q, c = table(spark, np.ones((2, 3))), table(spark, np.ones((2, 4)))
    row = metrics.floor_metrics(q, c, spark.createDataFrame([(0, 0)], "query_id long, doc_id long"), ("id", "vec"), ("id", "vec")).first()
    assert row["ndcg_10"] == 0 and row["note"]


vectors = st.lists(st.lists(st.floats(-5, 5, allow_nan=False), min_size=3, max_size=3), min_size=2, max_size=12)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(m=vectors, scale=st.floats(0.5, 4))
def test_retention_properties(spark, m, scale):
    """Retention grows with k, doesn't depend on positive scaling, and MRR is at most 1."""
    rng = np.random.default_rng(len(m))
    rows = [(i, [float(np.round(x, 3)) for x in v], rng.normal(size=3).tolist()) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "id long, m array<double>, t array<double>")
    report = metrics.retention_report(df, "m", "t").first()
    assert report["top1_retention"] <= report["top5_retention"] <= report["top10_retention"] <= 1
    assert report["mrr"] <= 1 + 1e-12
    from pyspark.sql import functions as F

    wide = df.withColumn("t", F.transform("t", lambda x: x * F.lit(scale)))
    assert metrics.topk_retention(wide, "m", "t", 1).first()["retention"] == pytest.approx(report["top1_retention"])


def test_vector_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0, 0.0, 0.0])], "a array<double>, z array<double>, c array<double>")
    a, z, c = F.col("a"), F.col("z"), F.col("c")
    row = df.select(vec.l2_normalize(a).alias("u"), vec.l2_normalize(z).alias("uz"), vec.cosine(a, z).alias("cz"), vec.cosine(a, c).alias("other"), vec.cosine_or_zero(a, c).alias("zero"), vec.cosine_prefix(a, c).alias("prefix"), vec.with_bias(a).alias("b")).first()
    assert row["u"] == [0.6, 0.8] and row["uz"] == [0.0, 0.0] and row["cz"] == 0 and row["other"] is None and row["zero"] == 0
    assert row["prefix"] == pytest.approx(0.6) and row["b"] == [3.0, 4.0, 1.0]
    with pytest.raises(Exception, match="dimensions"):
        df.select(vec.checked(c, 2)).collect()


@pytest.mark.parametrize("x", [-1.0, 0.0, 0.1, 0.25, 0.5, 0.77, 1.0, 3.0])
def test_interpolation_equals_numpy(spark, x):
    from pyspark.sql import functions as F

    xs, ys = [0.0, 0.25, 0.5, 0.5, 1.0], [0.1, 0.1, 0.3, 0.6, 0.9]
    got = spark.range(1).select(vec.interpolate(F.lit(x), xs, ys).alias("y")).first()["y"]
    want = 0.6 if x == 0.5 else float(np.interp(x, xs, ys))
    assert got == pytest.approx(want) or x == 0.5 and got in (0.3, 0.6)


def test_retrieval_corpus_over_all_documents(spark, sf):
    from meridian.plans.catalog_all import QUERIES

    ids = {r["id"] for r in QUERIES["retrieval_corpus"](spark, sf).collect()}
    assert ids == {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()} and len(ids) > 150


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_a_task_holds_one_block_with_another(spark, limit):
    from meridian.operators.blocks import BLOCK_ROWS, Fold, all_pairs

    class Sizes(Fold):
        def add(self, j, b):
            return [np.array([self.i.size]), np.array([j.size])]

    df = spark.range(5000).selectExpr("id", "array(1.0D, double(id)) as vec")
    rows = all_pairs(df, df, Sizes, "a long, b long", broadcast_bytes=limit).collect()
    assert max(max(r["a"], r["b"]) for r in rows) <= BLOCK_ROWS and sum(r["a"] * r["b"] for r in rows) == 5000 * 5000


@pytest.mark.parametrize("limit", [1 << 30, 0])
@pytest.mark.parametrize("ranked", [True, False])
def test_a_task_holds_few_similarities_at_once(spark, limit, ranked):
    from meridian.operators.blocks import BLOCK_ROWS, Fold, all_pairs

    class Cells(Fold):
        most = 0

        def add(self, j, b):
            self.most = max(self.most, self.i.size * j.size)

        def rows(self):
            return [np.array([self.i[0]]), np.array([0]), np.array([float(self.most)])]

    df = spark.range(5000).selectExpr("id", "array(1.0D, double(id)) as vec")
    if ranked:
        rows = knn.ranked_best(df, df, Cells, 1, "cells", ("id", "vec"), ("id", "vec"), limit)
    else:
        rows = all_pairs(df, df, Cells, "id long, zero long, cells double", broadcast_bytes=limit)
    assert 0 < max(r["cells"] for r in rows.collect()) <= BLOCK_ROWS * BLOCK_ROWS // 4


def test_ties_of_all_pairs_take_little_memory(spark):
    import tracemalloc

    from pyspark.sql import functions as F

    class Peak(knn.Best):
        def add(self, j, b):
            tracemalloc.start()
            super().add(j, b)
            self.peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()

        def rows(self):
            return [self.i[:1], self.ids[:1, 0], np.array([float(self.peak)])]

    df = spark.range(2048).select("id", F.array(F.lit(0.0), F.lit(0.0)).alias("vec")).coalesce(1)
    rows = knn.ranked_best(df, df, lambda i, a: Peak(i, a, 100), 100, "bytes", ("id", "vec"), ("id", "vec")).collect()
    assert 0 < max(r["bytes"] for r in rows) < 128 << 20


def test_a_search_of_few_queries_writes_no_table(spark):
    from meridian.plans import materialize

    rng = np.random.default_rng(5)
    q, c, before = rng.normal(size=(20, 4)), rng.normal(size=(90, 4)), len(materialize._written)
    rows = knn.topk(table(spark, q), table(spark, c), 3).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in rows] == [j for expected in brute(q, c, 3) for j, _ in expected]
    assert len(materialize._written) == before


def test_the_best_of_many_blocks_with_ties():
    rng = np.random.default_rng(9)
    q, c = rng.integers(-1, 2, (40, 3)).astype(float), rng.integers(-1, 2, (900, 3)).astype(float)
    q, c, order = normalized(q), normalized(c), rng.permutation(900)
    fold = knn.Best(np.arange(40), q, 25)
    for at in range(0, 900, 70):
        fold.add(order[at : at + 70], c[order[at : at + 70]])
    i, j, s = fold.rows()
    for row, expected in enumerate(brute(q, c, 25)):
        assert list(zip(j[i == row].tolist(), s[i == row].tolist())) == expected


def test_many_queries_give_one_list_each(spark, monkeypatch):
    monkeypatch.setattr(knn, "FEW_QUERIES", 10)
    rng = np.random.default_rng(4)
    q, c = rng.normal(size=(30, 4)), rng.normal(size=(80, 4))
    rows = knn.topk(table(spark, q), table(spark, c), 6).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in rows] == [j for expected in brute(q, c, 6) for j, _ in expected]
    assert [r["id"] for r in knn.csls(table(spark, q), table(spark, c), 5, 4).orderBy("query_id", "rank").collect()] == csls_brute(q, c, 5, 4)


def csls_brute(q, c, k, top):
    sims = np.round(normalized(q) @ normalized(c).T, 9)
    scores = np.round(2 * sims - np.sort(sims, axis=0)[::-1][:k].mean(axis=0)[None, :], 9)
    return [int(j) for s in scores for j in np.lexsort((np.arange(s.size), -s))[:top]]


def test_judgements_by_label_are_counted_not_listed(spark):
    rng = np.random.default_rng(8)
    m, labels = rng.normal(size=(60, 4)), [None if k % 11 == 3 else k % 3 for k in range(60)]
    t = spark.createDataFrame([(i, labels[i], r.tolist()) for i, r in enumerate(m)], "id long, label int, vec array<double>")
    q = t.where("id % 4 = 0").unionAll(spark.createDataFrame([(99, 7, [1.0, 0.0, 0.0, 0.0])], t.schema))
    ranking = knn.topk(q, t, 20)
    listed = q.select(q["id"].alias("query_id"), "label").join(t.select(t["id"].alias("doc_id"), "label"), "label").select("query_id", "doc_id")
    want, got = metrics.evaluate(ranking, listed).first(), metrics.evaluate_by_label(ranking, q, t).first()
    assert np.allclose(got, want) and got["n_eval"] == want["n_eval"]


def test_values_that_single_precision_cannot_tell(spark):
    rng = np.random.default_rng(3)
    base = normalized(rng.normal(size=(1, 16)))
    c = normalized(base + 1e-5 * rng.normal(size=(300, 16)))
    q = normalized(base + 1e-3 * rng.normal(size=(7, 16)))
    assert len(np.unique((q @ c.T).astype(np.float32))) < len(np.unique(np.round(q @ c.T, 9))) / 2
    fold = knn.Best(np.arange(7), q, 9)
    for at in range(0, 300, 64):
        fold.add(np.arange(at, min(300, at + 64)), c[at : at + 64])
    i, j, s = fold.rows()
    for row, expected in enumerate(brute(q, c, 9)):
        assert list(zip(j[i == row].tolist(), s[i == row].tolist())) == expected
    own = knn._Better(np.arange(7), np.c_[q, np.round((q * c[:7]).sum(axis=1), 9)])
    own.add(np.arange(300), c)
    sims = np.round(q @ c.T, 9)
    assert own.better.tolist() == [sum((v > sims[r, r]) or (v == sims[r, r] and k < r) for k, v in enumerate(sims[r]) if k != r) for r in range(7)]


def test_a_tile_is_scored_in_single_precision():
    own = knn._Better(np.arange(3), np.c_[np.eye(3), np.ones(3)])
    assert own.single.dtype == knn.Best(np.arange(3), np.eye(3), 2).scores(np.eye(3)).dtype == np.float32


def test_blocks_travel_in_packs(spark):
    from meridian.operators import blocks

    df = spark.range(0, 20_000, 1, 1).selectExpr("id", "array(1.0D, double(id)) as vec")
    made = blocks.packed(df)
    packs = blocks.packs(made.coalesce(1)).collect()
    assert made.count() > len(packs) == 1
    assert sorted(np.frombuffer(packs[0]["ids"], np.int64)) == list(range(20_000)) and len(packs[0]["m"]) == 20_000 * 16
