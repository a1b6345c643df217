"""MinHash near-dedup against all pairs of signatures."""

import math
from itertools import combinations

import numpy as np
import pytest

from meridian.llm import near_dedup as nd
from meridian.llm.text import WordHashes, shingles, words
from llm_fixtures import CLASHING, edited, prose


def signature(text):
    found = words(text)
    return nd.minhash(shingles(WordHashes().of(found), nd.NGRAM), *nd.coefficients(1)) if found else None


def documents(rows):
    """Signatures by (id, text) of the rows that can have copies."""
    return {(i, t): signature(t) for i, t in rows if i is not None and signature(t) is not None}


def brute(rows, threshold=nd.THRESHOLD):
    """All pairs of documents whose signatures agree often enough."""
    need, sigs = math.ceil(threshold * nd.COORDS - 1e-9), documents(rows)
    return {(a, b): n for a, b in combinations(sorted(sigs), 2) if (n := int((sigs[a] == sigs[b]).sum())) >= need}


def brute_classes(rows, threshold=nd.THRESHOLD):
    """(id, class, links) of each row, from all pairs."""
    pairs = brute(rows, threshold)
    root = groups(pairs)
    links = {}
    for pair in pairs:
        for x in pair:
            links[x] = links.get(x, 0) + 1
    return sorted(str((i, root.get((i, t), (i,))[0], links.get((i, t), 0))) for i, t in rows)


def classes(df, **options):
    return sorted(str(tuple(r)) for r in nd.near_classes(df, **options).collect())


def corpus():
    rows = [(i, prose(i, 30 + i)) for i in range(40)]
    for k in range(40, 100):
        rows.append((k, edited(prose(k % 20, 30 + k % 20), k, k % 6)))
    return rows + [(200 + k, prose(3, 33)) for k in range(5)]


def groups(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in root}


def test_classes_are_those_of_all_pairs(docs_of):
    rows = corpus()
    assert classes(docs_of(rows)) == brute_classes(rows)


def test_pairs_of_classes_are_all_pairs(docs_of):
    """Every pair of different signatures is listed under the least ids of both."""
    rows = corpus()
    least = {}
    for (i, _), s in sorted(documents(rows).items()):
        least.setdefault(s.tobytes(), i)
    sigs = documents(rows)
    want = {tuple(sorted((least[sigs[a].tobytes()], least[sigs[b].tobytes()]))): n for (a, b), n in brute(rows).items() if n < nd.COORDS}
    assert {(r["doc_id_a"], r["doc_id_b"]): r["matches"] for r in nd.near_pairs(docs_of(rows)).collect()} == want


@pytest.mark.parametrize(("hot", "sample", "frequent"), [(nd.HOT, nd.SAMPLE, nd.FREQUENT), (nd.HOT, 1, 2), (5, 2, 3)])
def test_one_hot_list_is_cut_into_chunks(docs_of, monkeypatch, hot, sample, frequent):
    """Counts are right whether or not an element's count is broadcast."""
    monkeypatch.setattr(nd, "CHUNK", 4)
    for name, value in (("HOT", hot), ("SAMPLE", sample), ("FREQUENT", frequent)):
        monkeypatch.setattr(nd, name, value)
    rows = [(i, edited(prose(1, 80), i, 1)) for i in range(40)] + [(50 + i, prose(1, 80)) for i in range(3)]
    got = classes(docs_of(rows))
    assert got == brute_classes(rows) and str((40 - 1, 0, 42)) in got


@pytest.mark.parametrize("threshold", [0.02, 0.5, 0.9, 1.0])
def test_thresholds(docs_of, threshold):
    rows = [(i, edited(prose(i % 3, 40), i, i % 7)) for i in range(25)]
    assert classes(docs_of(rows), threshold=threshold) == brute_classes(rows, threshold)


def test_ids_of_any_type(docs_of):
    from pyspark.sql import functions as F

    rows = corpus()
    named = docs_of(rows).withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 4, "0")))
    want = brute_classes([(f"d{i:04}", t) for i, t in rows])
    assert classes(named) == want
    assert sorted(r["doc_id"] for r in nd.near_dedup(named).collect()) == sorted({w.split("'")[3] for w in want})


def test_bad_threshold(docs_of):
    with pytest.raises(ValueError):
        nd.near_pairs(docs_of([(1, "a b c")]), threshold=0).collect()


def test_dedup_keeps_the_least_id_of_each_group(docs_of):
    rows = corpus()
    root = groups(brute(rows))
    kept = {r["doc_id"] for r in nd.near_dedup(docs_of(rows)).collect()}
    assert kept == {i for i, t in rows if root.get((i, t), (i, t)) == (i, t)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in nd.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_components_of_no_edges(spark):
    assert nd.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(docs_of, awkward):
    df = docs_of(awkward, **CLASHING)
    assert classes(df) == brute_classes(awkward)
    assert nd.near_pairs(df).count() == 0
    kept = nd.near_dedup(df)
    assert kept.columns == df.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    ids = [i for i, _ in rows]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 6, 7, 8, 9] and ids.count(None) == 2
    assert all(r["key"] == 1 and r["gone"] == "x" for r in kept.select("key", "gone").collect())


def test_empty_table(docs_of):
    df = docs_of([(1, "a")]).where("false")
    assert nd.near_classes(df).count() == 0 and nd.near_dedup(df).count() == 0


def test_planted_copies_are_found(docs_of):
    """Copies with one word in forty changed are found, documents that share a third of their text aren't."""
    base = [(i, prose(1000 + i, 120)) for i in range(60)]
    near = [(100 + i, edited(t, i, 3)) for i, t in base]
    other = [(200 + i, " ".join(t.split()[:40]) + " " + prose(5000 + i, 80)) for i, t in base]
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in nd.near_pairs(docs_of(base + near + other)).collect()}
    assert sum((i, 100 + i) in got for i, _ in base) >= 57
    assert not any(a >= 200 or b >= 200 for a, b in got)


def test_minhash_estimates_jaccard():
    a, b = words(prose(1, 400)), words(edited(prose(1, 400), 2, 40))
    x, y = (set(shingles(WordHashes().of(w), 3).tolist()) for w in (a, b))
    want = len(x & y) / len(x | y)
    odd, add = nd.coefficients(1)
    got = np.mean([(nd.minhash(np.array(list(x), np.uint64), *nd.coefficients(s)) == nd.minhash(np.array(list(y), np.uint64), *nd.coefficients(s))).mean() for s in range(30)])
    assert abs(got - want) < 0.03
