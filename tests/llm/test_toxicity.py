"""Toxicity: exact neighbours against a dense product, and held-out accuracy."""

import random

import numpy as np
import pytest
from llm_fixtures import CLASHING, prose

from meridian.llm import toxicity as tx

BAD = ["vileword", "nastyword", "foulword", "grimword", "meanword"]


def text(i, bad):
    rng, found = random.Random(i), prose(i, 60).split()
    for _ in range(6 if bad else 0):
        found[rng.randrange(60)] = rng.choice(BAD)
    return " ".join(found)


@pytest.fixture(scope="module")
def tables(spark, docs_of):
    rows = [(i, text(i, i % 4 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    return rows, docs_of(rows), labels


@pytest.fixture(scope="module")
def index(tables):
    return tx.fit(tables[1], tables[2])


def test_held_out_documents(tables):
    got = {r["doc_id"]: r["toxic"] for r in tx.toxicity(tables[1], tables[2]).collect()}
    assert len(got) == 400
    held = [i for i in range(200, 400)]
    assert sum(got[i] == (i % 4 == 0) for i in held) >= 198
    kept = {r["doc_id"] for r in tx.drop_toxic(tables[1], tables[2]).collect()}
    assert kept == {i for i, t in got.items() if not t}


def dense(rows, labels, documents, k=9):
    """(similarity of the k nearest, ids that are surely among them) of each row, by a dense TF-IDF product over all words."""
    from collections import Counter

    from meridian.llm.text import words

    marks = {}
    for i, y in labels:
        marks[i] = max(y, marks.get(i, 0))
    examples = [(i, t, marks[i]) for i, t in rows if i in marks]
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, t, _ in examples for w in words(t)}))}
    tf = lambda t: np.bincount([vocabulary[w] for w in words(t) if w in vocabulary], minlength=len(vocabulary)).astype(float)
    bags, y = np.array([tf(t) for _, t, _ in examples]), np.array([y for *_, y in examples])
    df = Counter(w for t in documents for w in set(words(t)))
    idf = np.log((1 + len(documents)) / (1 + np.array([df[w] for w in vocabulary]))) + 1
    worth = idf * np.log2(2 + (bags[y == 1] > 0).sum(axis=0) / np.maximum(1, (bags[y == 0] > 0).sum(axis=0))) ** 2

    def unit(m):
        m = np.where(m > 0, 1 + np.log(np.maximum(m, 1)), 0) * worth
        return m / np.maximum(np.sqrt((m * m).sum(axis=-1, keepdims=True)), 1e-300)

    sims = np.array([unit(tf(t)) for _, t in rows]) @ unit(bags).T
    ids, out = np.array([i for i, *_ in examples]), {}
    for (i, _), s in zip(rows, sims):
        s = np.where(ids == i, 0, s)
        top = np.sort(s)[::-1][:k]
        weight = top[top > 1e-9] ** 2
        sure = set(ids[s > top[-1] + 1e-8].tolist())
        order = np.lexsort((ids, y, -np.round(s, 9)))[: weight.size]
        out[i] = (top[top > 1e-9], sure, (s[order] ** 2 * y[order]).sum() / max(1e-300, (s[order] ** 2).sum()))
    return out


def check(index, rows, want):
    known, own = index.known(), np.array([index.place.get(i, -1) for i, _ in rows])
    best, value = index.nearest([index.vector(t, known) for _, t in rows], own, 9)
    votes = index.votes(best, value)
    for (i, _), b, v, vote in zip(rows, best, value, votes):
        top, sure, share = want[i]
        assert np.allclose(v[: top.size], top, atol=3e-9) and not v[top.size :].any()
        assert sure <= {index.ids[x] for x in b if x >= 0} and i not in {index.ids[x] for x in b if x >= 0}
        assert abs(vote - share) < 1e-6


def test_neighbours_equal_a_dense_product(tables, index):
    rows = tables[0]
    check(index, rows, dense(rows, [(i, int(i % 4 == 0)) for i in range(200)], [t for _, t in rows]))


@pytest.mark.parametrize("block,first,long", [(5, 1, 0.0), (1, 3, 0.3), (1000, 2, 1.0), (7, 1, 0.1)])
def test_blocks_don_t_change_the_neighbours(tables, index, monkeypatch, block, first, long):
    monkeypatch.setattr(tx, "BLOCK", block)
    monkeypatch.setattr(tx, "FIRST", first)
    monkeypatch.setattr(tx, "LONG", long)
    monkeypatch.setattr(tx, "WORK", 500)
    other, known = tx.fit(tables[1], tables[2]), index.known()
    queries, own = [index.vector(t, known) for _, t in tables[0]], np.array([index.place.get(i, -1) for i, _ in tables[0]])
    assert other.blocks == -(-200 // block)
    monkeypatch.undo()
    want = index.nearest(queries, own, 9)
    monkeypatch.setattr(tx, "BLOCK", block)
    monkeypatch.setattr(tx, "FIRST", first)
    for a, b in zip(want, other.nearest(queries, own, 9)):
        assert np.allclose(a, b, atol=2e-9)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_given_tables_equal_a_dense_product(spark, scale):
    """Whole texts, the whole vocabulary, each document."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{scale}/{t}.parquet") for t in ("documents", "labels"))
    index = tx.fit(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    marks = [(r["doc_id"], r["toxic"]) for r in labels.collect() if r["toxic"] is not None]
    check(index, rows, dense(rows, marks, [t for _, t in rows]))


def test_held_out_labels(spark):
    """Fitted on half of the given labels and judged on the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = tx.toxicity(known, half).join(labels.where("doc_id % 2 = 1").select("doc_id", labels["toxic"].alias("label")), "doc_id").toPandas()
    assert got[got.label == 1].toxic.mean() >= 0.85 and got[got.label == 0].toxic.mean() <= 0.02


def test_scores_are_calibrated_on_the_labels(index):
    assert (np.diff(index.points[1]) >= 0).all() and index.score(np.array([0.0]))[0] < 0.1 < 0.9 < index.score(np.array([1.0]))[0]


def test_isotonic_is_the_least_squares_fit():
    x, y, w = np.array([1.0, 2, 2, 3, 4]), np.array([1.0, 0, 2, 0, 3]), np.ones(5)
    xs, ys = tx.isotonic(x, y, w)
    assert np.allclose(np.interp([1, 2, 3, 4], xs, ys), [0.75, 0.75, 0.75, 3])


def test_a_tie_is_one_level_whatever_comes_first_in_it():
    """A clean example among many toxic ones of the same vote doesn't pool them with the rest."""
    x, y = np.r_[np.zeros(50), 0.5, np.ones(60)], np.r_[np.zeros(53), np.ones(58)]
    xs, ys = tx.isotonic(x, y, np.ones(111))
    assert np.interp(0.0, xs, ys) == 0 and np.interp(1.0, xs, ys) == pytest.approx(58 / 60)


def test_planted_toxic_documents_of_the_check_tables(spark):
    """On tables with groups of thousands of copies: fitted on half of the labels, judged on the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/check_s/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = tx.toxicity(some, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").select("doc_id", labels["toxic"].alias("label")), "doc_id").toPandas()
    assert got[got.label == 1].toxic.mean() >= 0.97 and got[got.label == 0].toxic.mean() <= 0.005


def test_awkward_rows(spark, docs_of, awkward, tables):
    df = docs_of([*tables[0][:200], *[(None if i is None else 1000 + i, t) for i, t in awkward], (2000, text(4, True) * 300)], **CLASHING)
    labels = tables[2].union(spark.createDataFrame([(None, 1, 1), (7, None, None), (8, 0, 7), (9, 1, 1), (9, 1, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int"))
    rows = tx.toxicity(df, labels).collect()
    assert len(rows) == 200 + len(awkward) + 1
    by = {r["doc_id"]: r for r in rows}
    for i in (1001, 1002, 1003):
        assert by[i]["score"] == 0 and by[i]["evidence"] == [] and not by[i]["toxic"]
    assert by[2000]["toxic"] and not by[1004]["toxic"] and sum(r["doc_id"] is None for r in rows) == 2
    assert all(r["doc_id"] not in r["evidence"] for r in rows)
    kept = tx.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(not r["toxic"] for r in rows)


def test_without_labels_or_documents(docs_of, tables):
    none = tables[2].where("false")
    assert [tuple(r)[1:3] for r in tx.toxicity(docs_of([(1, "a b")]), none).collect()] == [(0.0, False)]
    assert tx.toxicity(docs_of([(1, "a")]).where("false"), tables[2]).count() == 0
    assert tx.drop_toxic(docs_of([(1, "a b")]), none).count() == 1


def test_ids_of_any_type(spark, docs_of, tables):
    from pyspark.sql import functions as F

    name = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    want = {f"d{r['doc_id']}": (round(r["score"], 9), [round(x, 8) for x in r["similarity"]]) for r in tx.toxicity(tables[1], tables[2]).collect()}
    got = tx.toxicity(name(tables[1]), name(tables[2])).collect()
    assert {r["doc_id"]: (round(r["score"], 9), [round(x, 8) for x in r["similarity"]]) for r in got} == want
    assert all(isinstance(x, str) for x in got[0]["evidence"])
