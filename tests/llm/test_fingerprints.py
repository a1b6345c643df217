"""Sketches: exact recovery of set differences, and retries."""

import random

import pytest
from llm_fixtures import CLASHING, prose

from meridian.llm import fingerprints as fp


def brute(rows):
    """(id, previous id, added, removed) by set difference from the predecessor that most paragraphs name."""
    import hashlib

    order = lambda i, t: (i is not None, i or 0, int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16))
    versions = sorted({order(i, t): (i, set(fp.paragraphs(t))) for i, t in rows}.items())
    last, found = {}, {}
    for key, (i, d) in versions:
        named = {}
        for x in d:
            if x in last:
                named[last[x]] = named.get(last[x], 0) + 1
            last[x] = key
        best = max(named, key=lambda k: (named[k], k), default=None)
        found[key] = best if best is not None and named[best] >= fp.OVERLAP * len(d) else None
    text, of, out = lambda s: ",".join(map(str, sorted(s))), dict(versions), []
    for i, t in rows:
        d, previous = set(fp.paragraphs(t)), found[order(i, t)]
        p, q = of[previous] if previous else (None, set())
        out.append((i, p, text(d - q), text(q - d)))
    return sorted(map(str, out))


def collected(df):
    return sorted(str((r["doc_id"], r["previous_id"], r["added"], r["removed"])) for r in df.collect())


@pytest.mark.parametrize("cells", [3, 6, fp.CELLS])
def test_changes_equal_set_differences(docs_of, cells):
    """With few cells most pairs need a retry, and still come out exact."""
    rng, rows = random.Random(1), []
    for chain in range(12):
        lines = [prose(1000 * chain + k, 4) for k in range(rng.choice([1, 3, 40]))]
        for version in range(4):
            rows.append((100 * version + chain, "\n".join(lines)))
            for _ in range(rng.choice([0, 1, 30])):
                lines.insert(rng.randrange(1, len(lines)) if len(lines) > 1 else 0, prose(rng.randrange(10**6), 3)) if len(lines) > 1 else None
            if len(lines) > 5:
                del lines[2]
                lines[rng.choice([0, -1])] = prose(rng.randrange(10**6), 3)  # edits at either end too
                lines.append("shared by very many")
    rows += [(5000 + k, f"shared by very many\n{prose(k, 3)}") for k in range(40)] + [rows[0]] * 3
    assert collected(fp.paragraph_changes(docs_of(rows), cells=cells)) == brute(rows)


def test_sketch_peels_both_sides():
    a, b = fp.sketch_sets([[1, 2, 3, 50, 60]], 24), fp.sketch_sets([[2, 3, 7, 50, 60]], 24)
    a.subtract(b)
    rows, keys, signs, done = a.peel()
    assert done.all() and dict(zip(keys.tolist(), signs.tolist())) == {1: 1, 7: -1} and set(rows.tolist()) == {0}


def test_overfull_sketch_says_so():
    a = fp.sketch_sets([list(range(500))], 12)
    assert not a.peel()[3].any()


def test_rows_round_trip():
    a = fp.sketch_sets([[5, 6], [], [9]], 6)
    b = fp.Sketches.from_rows(a.to_rows(), 6)
    assert (a.count == b.count).all() and (a.key == b.key).all() and (a.check == b.check).all()
    assert not fp.Sketches.from_rows([None], 6).count.any()


def test_awkward_rows(docs_of, awkward, monkeypatch):
    monkeypatch.setattr(fp, "REPEATED", 2)
    rows = [*awkward, (20, "a\nb\na\n\nc"), (21, "a\nb\nx\nc"), (22, "\n\n"), *[(23, "z\ny")] * 7, (None, "z\ny\nw")]
    got = fp.paragraph_changes(docs_of(rows, **CLASHING))
    assert collected(got) == brute(rows)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[21]["previous_id"] == 20 and by[11]["previous_id"] == 4 and by[11]["added"] == "" and by[23]["previous_id"] is None and by[23]["removed"] != ""


def test_very_long_texts_that_differ_much(docs_of):
    """Many pairs that need large sketches, held a few at a time."""
    base = [f"line {k}" for k in range(6000)]
    rows = [(i, "\n".join(base + [f"{i} {k}" for k in range(5000)])) for i in range(12)]
    assert collected(fp.paragraph_changes(docs_of(rows))) == brute(rows)


def test_ids_of_any_type(docs_of):
    from pyspark.sql import functions as F

    df = docs_of([(1, "a\nb\nc"), (2, "a\nb\nd")]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r["doc_id"]: r["previous_id"] for r in fp.paragraph_changes(df).collect()} == {"d1": None, "d2": "d1"}


def test_empty_table_and_bad_cells(docs_of):
    df = docs_of([(1, "a")])
    assert fp.paragraph_changes(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        fp.paragraph_changes(df, cells=4)
