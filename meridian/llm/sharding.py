"""Sharding by Karmarkar-Karp differencing over indivisible groups.

A partial partition holds the bytes of those of the n shards that it uses, in
descending order.  The two partial partitions of the largest spread are combined,
one in descending and one in ascending order, until one is left.  Groups of equal
content are indivisible.

Groups are spread over nodes by hash and differenced within each node; the
nodes' results are partial partitions again and are differenced with each other,
as many at a time as ``CELLS`` bytes of shards allow.  Two kinds of groups are kept
for the last step, where they meet the few partial partitions that are left: the
largest, which would leave a node unbalanced, and a share of the small ones, which
fill what differences remain.  So no worker holds more than a bounded number of
groups, and the driver holds none.  Slots that are combined become one by a
pointer, so a node needs memory for its groups and one partial partition, not for
groups times shards.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.plans.materialize import materialize

SHARDS = 16
#: Groups that one node differences; as many of the largest, and of the others, are kept for the last step.
NODE_GROUPS = 20_000
#: Partial partitions that one node of the upper levels combines, at most, and the used shards that they may have together.
FAN_IN, CELLS = 256, 2_000_000


def difference(owner: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """The shard, of n, that each slot comes to, when the partial partitions are differenced.

    owner tells to which partial partition a slot belongs, size its bytes; a
    partial partition has n slots at most, and those it has not are empty.
    """
    order = np.lexsort((-size, owner))
    starts = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0]) if order.size else np.zeros(0, int)
    parts = {k: (size[i], i) for k, i in enumerate(np.split(order, starts[1:]))} if order.size else {}
    spread = lambda v: int(v[0] - (v[-1] if v.size == n else 0))
    heap = [(-spread(v), k) for k, (v, _) in parts.items()]
    heapq.heapify(heap)
    into, fresh = np.arange(size.size), len(parts)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (down, slots), (up, others) = parts.pop(a), parts.pop(b)
        up, others = up[::-1], others[::-1]
        both = max(0, down.size + up.size - n)  # the smallest of one meet the smallest of the other, in turn
        alone = down.size - both
        into[others[:both]] = slots[alone:]
        sums = np.concatenate([down[:alone], down[alone:] + up[:both], up[both:]])
        slots = np.concatenate([slots, others[both:]])
        ranked = np.argsort(-sums, kind="stable")
        parts[fresh] = (sums[ranked], slots[ranked])
        heapq.heappush(heap, (-spread(sums[ranked]), fresh))
        fresh += 1
    while not np.array_equal(up := into[into], into):
        into = up
    shard = np.zeros(size.size, np.int32)
    for _, slots in parts.values():
        shard[slots] = np.arange(slots.size)
    return shard[into]


def _combine(n: int):
    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["child", "slot"])
        to = difference(rows["child"].to_numpy(), rows["bytes"].to_numpy(np.int64), n)
        return pd.DataFrame({"parent": rows["parent"], "child": rows["child"], "slot": rows["slot"], "to": to, "bytes": rows["bytes"]})

    return combine


def _finish(n: int):
    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        """Partial partitions (child, slot) and groups (content, without a child) together."""
        rows = rows.sort_values(["child", "slot", "bytes", "content"], ascending=[True, True, False, True])
        child = rows["child"].to_numpy()
        owner = np.where(child >= 0, child, child.max(initial=0) + 1 + np.arange(len(rows)))
        return rows.assign(to=difference(owner, rows["bytes"].to_numpy(np.int64), n))[["child", "slot", "content", "to"]]

    return finish


def _place(n: int):
    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "content"], ascending=[False, True])
        return pd.DataFrame({"node": rows["node"], "content": rows["content"], "slot": difference(np.arange(len(rows)), rows["bytes"].to_numpy(np.int64), n), "bytes": rows["bytes"]})

    return place


def content_shards(docs: DataFrame, text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(content, shard, rows) for each distinct content, a hash of the text, and how many rows have it."""
    if shards < 1:
        raise ValueError("shards must be positive")
    sized = docs.select(F.xxhash64(text_col).alias("content"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("b"))
    groups = materialize(sized.groupBy("content").agg(F.sum("b").alias("bytes"), F.count("*").alias("rows")), "contents")
    level = F.floor(F.log2(F.col("bytes") + 1) * 8).cast("int")
    sizes = sorted(((r["level"], r["n"]) for r in groups.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)  # a few hundred at most
    total, large, least = sum(n for _, n in sizes), 0, 1 << 20
    for at, n in sizes:
        if large + n > NODE_GROUPS:
            break
        large, least = large + n, at
    few = total <= 2 * NODE_GROUPS
    share = 1_000_000 if few else -(-NODE_GROUPS * 1_000_000 // (total - large))
    kept = (level >= least) | (F.pmod(F.xxhash64("content", F.lit(7)), F.lit(1_000_000)) < share)
    nodes = 0 if few else max(1, math.ceil((total - large) / NODE_GROUPS))
    last = groups.where(kept).select(F.lit(-1).alias("child"), F.lit(0).alias("slot"), "content", "bytes")
    way, parts = None, last
    if nodes:
        spread = groups.where(~kept).withColumn("node", F.pmod(F.xxhash64("content"), F.lit(nodes)).cast("int"))
        placed = materialize(spread.groupBy("node").applyInPandas(_place(shards), "node int, content long, slot int, bytes long"), "placed")
        way = placed.select("content", F.col("node").alias("at"), F.col("slot").alias("in_slot"))
        sums, fan = placed.groupBy(F.col("node").alias("child"), "slot").agg(F.sum("bytes").alias("bytes")), max(2, min(FAN_IN, CELLS // shards))
        while nodes > fan:
            step = materialize(sums.withColumn("parent", F.expr(f"child div {fan}").cast("int")).groupBy("parent").applyInPandas(_combine(shards), "parent int, child int, slot int, to int, bytes long"), "level")
            way = way.join(step, (F.col("at") == F.col("child")) & (F.col("in_slot") == F.col("slot"))).select("content", F.col("parent").alias("at"), F.col("to").alias("in_slot"))
            sums = step.groupBy(F.col("parent").alias("child"), F.col("to").alias("slot")).agg(F.sum("bytes").alias("bytes"))
            nodes = math.ceil(nodes / fan)
        parts = last.unionByName(sums.select("child", "slot", F.lit(0).cast("long").alias("content"), "bytes"))  # a null would make doubles of the hashes in pandas
    done = materialize(parts.groupBy(F.lit(0).alias("all")).applyInPandas(_finish(shards), "child int, slot int, content long, to int"), "finished")
    out = done.where("child < 0").select("content", F.col("to").alias("shard"))
    if way is not None:
        ends = done.where("child >= 0").select("child", "slot", "to")
        out = out.unionByName(way.join(ends, (F.col("at") == F.col("child")) & (F.col("in_slot") == F.col("slot"))).select("content", F.col("to").alias("shard")))
    return materialize(out.join(groups.select("content", "rows"), "content"), "shards")


def _assigned(rows: DataFrame, content, shards: DataFrame, columns: list) -> DataFrame:
    """``columns`` of the rows and the shard of their content; contents that more than a thousandth of all rows have are broadcast."""
    many = shards.agg(F.sum("rows")).first()[0] or 0

    def joined(left: DataFrame, some: DataFrame, hot: bool) -> DataFrame:
        named = some.select(F.col("content").alias("of"), F.col("shard").alias("to"))
        return left.join(F.broadcast(named) if hot else named, content == named["of"]).select(*columns, named["to"].alias("shard"))

    hot = shards.where(F.col("rows") * 1000 > many)
    rest = shards.where(F.col("rows") * 1000 <= many)
    if not hot.take(1):
        return joined(rows, rest, False)
    keys = hot.select(F.col("content").alias("hot_content"))
    return joined(rows, hot, True).union(joined(rows.join(F.broadcast(keys), content == keys["hot_content"], "left_anti"), rest, False))


def shard_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, shard, bytes), one row for each row of ``docs``; shards count from 0.

    Rows of equal text go to one shard.  Nulls: null texts are one group of size
    0; null ids are kept.  Empty texts are a group of size 0; very long ones
    are whole.  Groups of equal size go by their hash.  Repeated rows share a
    shard.  An empty table gives no rows.  Other columns are not read.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("own"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    return _assigned(named, named["own"], content_shards(docs, text_col, shards), [named["doc_id"], named["bytes"]]).select("doc_id", "shard", "bytes")


def shard_rows(docs: DataFrame, text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """``docs`` with a column ``shard``; a column of that name is replaced, all others are kept.

    Nulls, empty and very long texts, ties, repeated rows and the empty table:
    as in shard_ids().
    """
    rest = docs.drop("shard")
    return _assigned(rest, F.xxhash64(rest[f"`{text_col}`"]), content_shards(docs, text_col, shards), [rest[f"`{c}`"] for c in rest.columns])
