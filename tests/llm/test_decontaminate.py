"""Decontamination against every window of every document, by the broadcast and by the joins."""

import random

import pytest
from llm_fixtures import CLASHING, prose

from meridian.llm import decontaminate as dc
from meridian.llm.text import words


def grams(found):
    return [tuple(found[i : i + dc.NGRAM]) for i in range(len(found) - dc.NGRAM + 1)]


def brute(docs, items, containment=dc.CONTAINMENT):
    """(doc, item) to containment, first word, words: the best window of all."""
    out = {}
    for d, text in docs:
        own = grams(words(text))
        for i, item in items:
            w = words(item)
            target = set(grams(w))
            if i is None or not target:
                continue
            need, width = dc.needed(len(target), containment), len(w) - dc.NGRAM + 1
            best, start = 0, None
            for at in range(len(own)):
                n = len(target & set(own[at : at + width])) if own[at] in target else 0
                if n > best:
                    best, start = n, at
            if best >= need and (best / len(target), -start) > out.get((d, i), (0, 0))[:2]:
                out[d, i] = (best / len(target), -start, len(w))
    return {k: (c, -s, n) for k, (c, s, n) in out.items()}


def tables(spark, docs_of):
    rng = random.Random(4)
    items = [(i, prose(500 + i, rng.choice([3, 5, 12, 40]))) for i in range(12)] + [(20, prose(500, 40) + " " + prose(501, 5)), (21, "too short"), (22, None), (None, prose(7, 20)), (23, "ba ba ba ba ba ba")]
    docs = []
    for k in range(60):
        text = prose(k, rng.randrange(5, 120)).split()
        if k % 2:
            item = rng.choice(items[:12])[1].split()
            cut = item[: max(1, int(len(item) * rng.choice([0.3, 0.5, 0.6, 1.0])))]
            at = rng.randrange(len(text))
            text[at:at] = cut if k % 3 else cut[: len(cut) // 2] + ["between"] * rng.randrange(4) + cut[len(cut) // 2 :]
        docs.append((k, " ".join(text)))
    docs += [(100, "ba " * 30)]
    return docs, items, docs_of(docs), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [dc.BROADCAST_SHINGLES, 0])
@pytest.mark.parametrize("containment", [0.5, 1.0, 0.2])
def test_equals_all_windows(spark, docs_of, limit, containment):
    docs, items, d, b = tables(spark, docs_of)
    got = {(r["doc_id"], r["item_id"]): (r["containment"], r["first_word"], r["n_words"]) for r in dc.contamination(d, b, containment=containment, broadcast_shingles=limit).collect()}
    want = brute(docs, items, containment)
    assert set(got) == set(want) and len(got) > 3
    assert all(got[k][0] == pytest.approx(want[k][0]) and got[k][2] == want[k][2] for k in want)
    assert all(got[k][1] == want[k][1] for k in want)


@pytest.mark.parametrize("limit", [dc.BROADCAST_SHINGLES, 0])
def test_stage_drops_just_the_contaminated(spark, docs_of, limit):
    docs, items, d, b = tables(spark, docs_of)
    gone = {k[0] for k in brute(docs, items)}
    kept = [r["doc_id"] for r in dc.decontaminate(d, b, broadcast_shingles=limit).collect()]
    assert sorted(kept) == [i for i, _ in docs if i not in gone]


@pytest.mark.parametrize("limit", [dc.BROADCAST_SHINGLES, 0])
def test_awkward_rows(spark, docs_of, awkward, limit):
    df = docs_of(awkward, **CLASHING)
    passage = " ".join(prose(99, 30_000).split()[29_000:29_040])
    b = spark.createDataFrame([(1, passage, 5), (1, passage, 5), (1, "other text of that id", 5), (2, prose(6, 60), 5)], "item_id long, text string, key int")
    got = sorted((r["doc_id"], r["item_id"], r["containment"], r["first_word"]) for r in dc.contamination(df, b, broadcast_shingles=limit).collect())
    assert got == [(4, 1, 1.0, 29_000), (6, 2, 1.0, 0), (11, 1, 1.0, 29_000)]
    kept = dc.decontaminate(df, b, broadcast_shingles=limit)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(awkward) - 3 and ids.count(6) == 1 and ids.count(None) == 2


def test_null_ids_are_reported(spark, docs_of):
    b = spark.createDataFrame([(1, prose(1, 40))], "item_id long, text string")
    for limit in (dc.BROADCAST_SHINGLES, 0):
        assert [tuple(r)[:2] for r in dc.contamination(docs_of([(None, prose(1, 40))]), b, broadcast_shingles=limit).collect()] == [(None, 1)]


@pytest.mark.parametrize("limit", [dc.BROADCAST_SHINGLES, 0])
def test_empty_tables(spark, docs_of, limit):
    d, b = docs_of([(1, prose(1, 40))]), spark.createDataFrame([(1, prose(1, 40))], "item_id long, text string")
    assert dc.contamination(d.where("false"), b, broadcast_shingles=limit).count() == 0
    assert dc.contamination(d, b.where("false"), broadcast_shingles=limit).count() == 0
    assert dc.decontaminate(d, b.where("false"), broadcast_shingles=limit).count() == 1


@pytest.mark.parametrize("limit", [dc.BROADCAST_SHINGLES, 0])
def test_ids_of_any_type(spark, docs_of, limit):
    from pyspark.sql import functions as F

    b = spark.createDataFrame([("q1", prose(1, 40)), ("q2", prose(2, 40))], "item_id string, text string")
    d = docs_of([(1, prose(9, 20) + " " + prose(1, 40)), (2, prose(2, 40)), (3, prose(3, 40))]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert sorted(tuple(r)[:2] for r in dc.contamination(d, b, broadcast_shingles=limit).collect()) == [("d1", "q1"), ("d2", "q2")]
    assert [r["doc_id"] for r in dc.decontaminate(d, b, broadcast_shingles=limit).collect()] == ["d3"]
