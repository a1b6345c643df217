"""Karmarkar-Karp differencing: valid assignments, tight balance."""

import heapq
import random
from itertools import product

import numpy as np
import pytest
from llm_fixtures import CLASHING, prose

from meridian.llm import sharding as sh


def spread(sizes, slots, n):
    sums = np.bincount(slots, sizes, n)
    return sums.max() - sums.min()


def place(sizes, n):
    """The shard of each group, all of them partial partitions of one slot."""
    return sh.difference(np.arange(len(sizes)), np.array(sizes, np.int64), n)


def plain(parts, n):
    """The sums that differencing ends with, by a heap of tuples with all n slots."""
    heap = [(min(p) - max(p), k, tuple(p)) for k, p in enumerate(tuple(p) + (0,) * (n - len(p)) for p in parts)]
    heapq.heapify(heap)
    k = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = tuple(x + y for x, y in zip(sorted(a, reverse=True), sorted(b)))
        heapq.heappush(heap, (min(both) - max(both), k, both))
        k += 1
    return sorted(heap[0][2])


def test_two_way_differencing_by_hand():
    """8, 7, 6, 5, 4 differ to 2 by hand: 8-7=1, 6-5=1, 4-1=3, 3-1=2."""
    sizes = [8, 7, 6, 5, 4]
    assert spread(sizes, place(sizes, 2), 2) == 2


@pytest.mark.parametrize("seed", range(12))
def test_sums_equal_a_heap_of_tuples(seed):
    """Partial partitions of one or several slots, fewer and more than the shards."""
    rng = random.Random(seed)
    n = rng.choice([1, 2, 3, 5, 8, 40])
    parts = [[rng.randrange(1, 10**9) for _ in range(rng.randint(1, n if seed % 2 else 1))] for _ in range(rng.randint(1, 60))]
    owner, size = np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.array([x for p in parts for x in p])
    to = sh.difference(owner, size, n)
    assert sorted(np.bincount(to, size, n).astype(int).tolist()) == plain(parts, n)
    for k in range(len(parts)):
        own = to[owner == k].tolist()
        assert len(set(own)) == len(own) and all(0 <= x < n for x in own)


def test_ten_thousand_shards_take_little_memory():
    import tracemalloc

    sizes = np.random.default_rng(1).integers(1, 10**6, sh.NODE_GROUPS)
    tracemalloc.start()
    to = place(sizes, 10_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20
    sums = np.bincount(to, sizes, 10_000)
    assert sums.max() <= max(sizes.max(), 1.05 * sums.mean() + sizes.max() / 2)


def test_nothing_to_difference():
    assert sh.difference(np.zeros(0, int), np.zeros(0, int), 3).size == 0


@pytest.mark.parametrize("seed", range(5))
def test_balance_beats_greedy_and_is_near_the_best(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 1000) for _ in range(200)]
    greedy = [0] * 4
    for s in sorted(sizes, reverse=True):
        heapq.heapreplace(greedy, greedy[0] + s)
    assert spread(sizes, place(sizes, 4), 4) <= max(greedy) - min(greedy)
    few = sizes[:9]
    best = min(spread(few, list(p), 2) for p in product(range(2), repeat=9))
    assert spread(few, place(few, 2), 2) <= best + 0.05 * sum(few)


@pytest.mark.parametrize(("node", "fan"), [(sh.NODE_GROUPS, sh.FAN_IN), (20, 3)])
def test_shards_are_balanced_over_nodes_and_levels(docs_of, monkeypatch, node, fan):
    monkeypatch.setattr(sh, "NODE_GROUPS", node)
    monkeypatch.setattr(sh, "FAN_IN", fan)
    monkeypatch.setattr(sh, "CELLS", sh.CELLS if fan > 3 else 8)
    rng = random.Random(2)
    rows = [(i, prose(i, rng.randrange(1, 60))) for i in range(400)] + [(2000 + i, prose(7, 3)) for i in range(9)] + [(1000 + i, prose(i, 5)) for i in range(20) for _ in range(2)]
    got = sh.shard_ids(docs_of(rows), shards=4).collect()
    assert len(got) == len(rows)
    total = np.bincount([r["shard"] for r in got], [r["bytes"] for r in got], 4)
    assert total.max() - total.min() <= 0.01 * total.sum()
    text = dict(rows)
    by_text = {}
    for r in got:
        assert by_text.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"] and r["bytes"] == len(text[r["doc_id"]])


@pytest.mark.parametrize(("shards", "node"), [(4, 60), (32, 300)])
def test_many_nodes_lose_little_balance(docs_of, monkeypatch, shards, node):
    """Sizes with a long tail over dozens of nodes: within a hundredth of the mean, as by one node or greedily."""
    monkeypatch.setattr(sh, "NODE_GROUPS", node)
    monkeypatch.setattr(sh, "FAN_IN", 8)
    rng = np.random.default_rng(4)
    sizes = np.minimum(rng.lognormal(4, 1.2, 3000), 4000).astype(int) + 1
    rows = [(i, f"{i:05}" + "x" * int(n)) for i, n in enumerate(sizes)]
    got = sh.shard_ids(docs_of(rows), shards=shards).collect()
    total = np.bincount([r["shard"] for r in got], [r["bytes"] for r in got], shards)
    assert len(got) == 3000 and total.max() - total.min() <= 0.01 * total.mean()


def test_awkward_rows(docs_of, awkward):
    df = docs_of(awkward, **CLASHING, shard="'old'")
    out = sh.shard_rows(df, shards=3)
    assert out.columns == df.columns and out.schema["shard"].dataType.simpleString() == "int"
    rows = out.collect()
    assert len(rows) == len(awkward) and {r["shard"] for r in rows} <= {0, 1, 2}
    by = {}
    for r in rows:
        assert by.setdefault(r["text"], r["shard"]) == r["shard"]
    assert sh.shard_ids(df).count() == len(awkward)


def test_one_shard_and_none(docs_of):
    df = docs_of([(1, "a"), (2, "b")])
    assert {r["shard"] for r in sh.shard_ids(df, shards=1).collect()} == {0}
    with pytest.raises(ValueError):
        sh.shard_ids(df, shards=0)
    assert sh.shard_ids(df.where("false")).count() == 0
