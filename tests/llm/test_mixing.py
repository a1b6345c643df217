"""Capped water-filling against a loop, and the sample against its epochs."""

import hashlib
import random

import pytest
from llm_fixtures import CLASHING

from meridian.llm import mixing as mx


def brute(sizes, weights, cap, budget):
    """Epochs by clamping what exceeds the cap and sharing out the rest again."""
    left, room, out = {s for s in sizes if sizes[s] and weights.get(s)}, budget, {s: 0.0 for s in sizes}
    while left:
        level = max(0.0, room / sum(weights[s] for s in left))
        full = {s for s in left if level * weights[s] >= cap * sizes[s]}
        if not full:
            out |= {s: level * weights[s] / sizes[s] for s in left}
            break
        out |= {s: float(cap) for s in full}
        room -= sum(cap * sizes[s] for s in full)
        left -= full
    return {s: 1.0 if not sizes[s] else e for s, e in out.items()}


@pytest.mark.parametrize("case", range(8))
def test_epochs_equal_the_loop(docs_of, case):
    rng = random.Random(case)
    sizes = {f"s{k}": rng.choice([0, 1, 7, 100, 1000, 5000]) for k in range(rng.randrange(1, 9))}
    weights = {s: rng.choice([0, 1, 5, 50]) for s in sizes}
    budget = rng.choice([0, 50, sum(sizes.values()), 3 * sum(sizes.values()), 10**6])
    df = docs_of([(i, "x" * n, s) for i, (s, n) in enumerate(sizes.items())])
    got = {r["source"]: r["epochs"] for r in mx.source_epochs(df, weights=weights, budget=budget).collect()}
    want = brute(sizes, weights, mx.MAX_EPOCHS, budget)
    assert got == pytest.approx(want)


def test_copies_follow_the_epochs(docs_of):
    rows = [(i, "x" * 10, "big") for i in range(3000)] + [(5000 + i, "x" * 10, "small") for i in range(300)]
    df = docs_of(rows)
    epochs = {r["source"]: r["epochs"] for r in mx.source_epochs(df).collect()}
    counted = mx.mix(df).groupBy("source").count().collect()
    for r in counted:
        n = 3000 if r["source"] == "big" else 300
        assert abs(r["count"] / n - epochs[r["source"]]) < 0.06
    one = {(r["doc_id"], r["copy"]) for r in mx.mix(df).collect()}
    assert one == {(r["doc_id"], r["copy"]) for r in mx.mix(df.repartition(7)).collect()}
    assert one != {(r["doc_id"], r["copy"]) for r in mx.mix(df, seed=5).collect()}
    for i, _, s in rows[::97]:
        u = int(hashlib.md5(f"{mx.SEED}:{i}".encode()).hexdigest()[:8], 16) / 2**32
        assert sum(d == i for d, _ in one) == int(epochs[s]) + (u < epochs[s] % 1)


def test_fractional_weights_are_exact_shares(docs_of):
    df = docs_of([(i, "x" * 10, "web" if i < 700 else "code") for i in range(1000)])
    shares = lambda w: {r["source"]: r["epochs"] for r in mx.source_epochs(df, weights=w).collect()}
    assert shares({"web": 0.7, "code": 0.3}) == shares({"web": 7, "code": 3}) == shares({"web": 7e-9, "code": 3e-9}) == {"web": 1.0, "code": 1.0}
    assert shares({"web": 0.5, "code": 0.5}) == pytest.approx({"web": 500 / 700, "code": 500 / 300})
    assert mx.mix(df, weights={"web": 0.7, "code": 0.3}).count() == 1000
    third = mx.whole_weights({"a": 1 / 3, "b": 0.25, None: 0})
    assert third["a"] / third["b"] == pytest.approx(4 / 3, rel=1e-11) and third[None] == 0
    assert mx.whole_weights({"a": 0.1, "b": 0.2, "c": 3}) == {"a": 1, "b": 2, "c": 30} and mx.whole_weights({}) == {} and mx.whole_weights({"a": 0.0}) == {"a": 0}
    for bad in (-1, float("nan"), float("inf")):
        with pytest.raises((ValueError, OverflowError)):
            mx.whole_weights({"a": bad})


def test_columns_of_any_name_stay(docs_of):
    df = docs_of([(1, "a", "web")], **{"copy of a row": "1", "_source": "2", "Times": "3"})
    assert mx.mix_rows(df).columns == df.columns and mx.mix_rows(df).first()["copy of a row"] == 1


@pytest.mark.parametrize("limit", [mx.BROADCAST_SOURCES, 0])
def test_awkward_rows(docs_of, awkward, monkeypatch, limit):
    monkeypatch.setattr(mx, "BROADCAST_SOURCES", limit)
    rows = [(i, t, None if k % 3 == 0 else "a") for k, (i, t) in enumerate(awkward)] + [(50, None, "empty"), (51, "", "empty")]
    df = docs_of(rows, **CLASHING)
    mixed = mx.mix_rows(df)
    assert mixed.columns == df.columns
    got = mx.mix(df).collect()
    assert mixed.count() == len(got) and {r["source"] for r in got} <= {None, "a", "empty"}
    assert sorted(r["doc_id"] for r in got if r["source"] == "empty") == [50, 51]
    key = lambda rs: sorted(map(str, rs))
    assert key(r["doc_id"] for r in mixed.select("doc_id").collect()) == key(r["doc_id"] for r in got)


def test_empty_table(docs_of):
    df = docs_of([(1, "a")]).where("false")
    assert mx.mix(df).count() == 0 and mx.mix_rows(df).count() == 0
