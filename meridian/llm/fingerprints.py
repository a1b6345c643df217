"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A document is the set of its paragraphs' 60-bit digests; its sketch has a fixed
number of cells, whatever its length, each with a count, the XOR of the digests
and the XOR of their checks.  A digest lies in one cell of each third.  Two
versions' sketches subtract cell by cell, what they share cancels out, and
peeling cells that hold a single digest recovers the differing ones.  If cells
remain, the pair is tried again with four times as many.

A document's predecessor is found by its paragraphs: each names the last document
before it, in the order of ids, that has this paragraph too, and the document
named most often is the predecessor if at least half of the paragraphs name it.
All postings of paragraphs are sorted over range partitions, so that a paragraph
that very many share is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.text import texts_of, type_of
from meridian.plans.materialize import materialize

CELLS = 24
GROWTH = 4
#: Share of a document's paragraphs that must name its predecessor.
OVERLAP = 0.5
#: Cells that a worker holds at once.
HELD = 400_000
#: Rows of one version that come from one task.
REPEATED = 10_000
#: Tasks over which they are spread.
SPREAD = 200
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    x = (keys ^ _SALTS[salt]) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def paragraphs(text: str | None) -> list[int]:
    """Digests of a text's non-empty lines, in order: the upper 60 bits of their MD5."""
    return [int.from_bytes(hashlib.md5(line.encode("utf-8", "replace"), usedforsecurity=False).digest()[:8], "big") >> 4 for line in (text or "").split("\n") if line]


class Sketches:
    """Sketches of n sets, of m cells each (a multiple of 3), as flat arrays."""

    def __init__(self, n: int, m: int):
        self.n, self.m = n, m
        self.count, self.key, self.check = np.zeros(n * m, np.int32), np.zeros(n * m, np.uint64), np.zeros(n * m, np.uint64)

    def add(self, rows: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        third, check = self.m // 3, _mixed(keys, 3)
        for part in range(3):
            at = rows * self.m + part * third + (_mixed(keys, part) % np.uint64(third)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def subtract(self, other: Sketches) -> None:
        self.count -= other.count
        self.key ^= other.key
        self.check ^= other.check

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, keys, signs) of the recovered elements, and whether each row is empty now."""
        found = []
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[self.check[pure] == _mixed(self.key[pure], 3)]
            if not pure.size:
                break
            rows, keys, signs = pure // self.m, self.key[pure], self.count[pure]
            first = np.lexsort((keys, rows))
            rows, keys, signs = rows[first], keys[first], signs[first]
            new = np.r_[True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])]
            rows, keys, signs = rows[new], keys[new], signs[new]
            found.append((rows, keys, signs))
            self.add(rows, keys, -signs)
        done = ~((self.count != 0) | (self.key != 0) | (self.check != 0)).reshape(self.n, self.m).any(axis=1)
        rows, keys, signs = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))
        return rows, keys, signs, done

    def to_rows(self) -> list[bytes]:
        parts = [x.reshape(self.n, self.m).view(np.uint8).reshape(self.n, -1) for x in (self.count, self.key, self.check)]
        return [r.tobytes() for r in np.hstack(parts)]

    @staticmethod
    def from_rows(rows: list[bytes | None], m: int) -> Sketches:
        """None is the empty set."""
        flat = np.frombuffer(b"".join(r or bytes(20 * m) for r in rows), np.uint8).reshape(len(rows), 20 * m)
        out = Sketches(len(rows), m)
        out.count = flat[:, : 4 * m].copy().view(np.int32).ravel()
        out.key = flat[:, 4 * m : 12 * m].copy().view(np.uint64).ravel()
        out.check = flat[:, 12 * m :].copy().view(np.uint64).ravel()
        return out


def sketch_sets(sets: list[list[int]], m: int) -> Sketches:
    out = Sketches(len(sets), m)
    sizes = [len(s) for s in sets]
    out.add(np.repeat(np.arange(len(sets)), sizes), np.fromiter((k for s in sets for k in s), np.uint64, sum(sizes)))
    return out


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, digests, n): the distinct documents, digests distinct and sorted, and how many rows each has."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, found = [], []
            for text in texts_of(batch.column(1)):
                hashes.append(int.from_bytes(hashlib.md5((text or "").encode("utf-8", "replace"), usedforsecurity=False).digest()[:8], "big") >> 4)
                found.append(sorted(set(paragraphs(text))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_hash", "digests"])

    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = named.mapInArrow(digest, f"doc_id {type_of(docs, id_col)}, text_hash long, digests array<long>")
    return rows.groupBy("doc_id", "text_hash").agg(F.first("digests").alias("digests"), F.count("*").alias("n"))


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted postings, each with the one before it of the same digest; place 0 is a task's first posting, 1 a copy of its last."""
    part, last, names = TaskContext.get().partitionId(), None, ["digest", "doc_id", "text_hash", "previous_id", "previous_hash", "part", "place"]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        both = pa.Table.from_batches([b for b in (last, batch) if b is not None]).combine_chunks()
        digest = both.column("digest").to_numpy()
        k = both.num_rows - n
        at = np.arange(k, k + n) - 1
        same = (at >= 0) & (digest[np.maximum(at, 0)] == digest[k:])
        older = [both.column(c).take(pa.array(np.maximum(at, 0), mask=~same)).combine_chunks() for c in ("doc_id", "text_hash")]
        head = pa.array(np.zeros(n, np.int32), mask=(np.arange(n) > 0) | (last is not None))
        yield pa.RecordBatch.from_arrays([*batch.columns, *older, pa.array(np.full(n, part, np.int32)), head], names)
        last = batch.slice(n - 1, 1)
    if last is not None:
        yield pa.RecordBatch.from_arrays([*last.columns, pa.nulls(1, last.schema.field("doc_id").type), pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([1], pa.int32())], names)


def _predecessors(versions: DataFrame, overlap: float) -> DataFrame:
    """(doc_id, text_hash, previous_id, previous_hash) of the versions that have a predecessor."""
    kind = type_of(versions, "doc_id")
    posts = versions.select(F.explode("digests").alias("digest"), "doc_id", "text_hash")
    order = [F.col("digest"), F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    shape = f"digest long, doc_id {kind}, text_hash long, previous_id {kind}, previous_hash long, part int, place int"
    named = materialize(posts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_before, shape), "named")
    # two rows of a partition: a first posting's predecessor is the last posting of the partition before
    ends = named.where("place is not null").sort("part", "place").collect()
    heads = [(b["digest"], b["doc_id"], b["text_hash"], a["doc_id"], a["text_hash"]) for a, b in zip(ends, ends[1:]) if b["place"] == 0 and a["digest"] == b["digest"]]
    columns = ["doc_id", "text_hash", "previous_id", "previous_hash"]
    others = named.where("coalesce(place, 0) = 0 and previous_hash is not null").select(*columns)
    if heads:
        others = others.unionByName(named.sparkSession.createDataFrame(heads, f"digest long, doc_id {kind}, text_hash long, previous_id {kind}, previous_hash long").select(*columns))
    best = others.groupBy(*columns).count().groupBy("doc_id", "text_hash").agg(F.max(F.struct("count", "previous_id", "previous_hash")).alias("b"))
    own = versions.select("doc_id", "text_hash", F.size("digests").alias("size"))
    both = best.alias("a").join(own.alias("v"), _same("a", "v"))
    return both.where(F.col("b.count") >= F.lit(overlap) * F.col("size")).select("a.doc_id", "a.text_hash", "b.previous_id", "b.previous_hash")


def _same(a: str, b: str, i: str = "doc_id", h: str = "text_hash"):
    """Whether two aliased tables mean one version."""
    return F.col(f"{a}.{i}").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.{h}") == F.col(f"{b}.text_hash"))


def _sketched(rows: DataFrame, m: int) -> DataFrame:
    """The rows with sketches of m cells in place of their last column, the digests."""
    step = max(1, HELD // m)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sketch_sets(part.columns[-1].to_pylist(), m).to_rows(), pa.binary())], [*part.schema.names[:-1], "sketch"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(sketch, f"{kinds}, sketch binary")


def _peeled(pairs: DataFrame, m: int) -> DataFrame:
    """pairs: four columns of identity, sketch, previous sketch."""
    step = max(1, HELD // m)

    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                own = Sketches.from_rows(part.column(4).to_pylist(), m)
                own.subtract(Sketches.from_rows(part.column(5).to_pylist(), m))
                rows, keys, signs, done = own.peel()
                sides = []
                for sign in (1, -1):
                    side = [[] for _ in range(part.num_rows)]
                    some = signs == sign
                    for r, k in zip(rows[some].tolist(), keys[some].tolist()):
                        side[r].append(k)
                    sides.append(pa.array([sorted(s) for s in side], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(done), *sides], ["doc_id", "text_hash", "previous_id", "previous_hash", "done", "added", "removed"])

    kind = type_of(pairs, "doc_id")
    return pairs.mapInArrow(peel, f"doc_id {kind}, text_hash long, previous_id {kind}, previous_hash long, done boolean, added array<long>, removed array<long>")


def paragraph_changes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, previous_id, added, removed), one row for each row of ``docs``.

    added and removed are the digests of the paragraphs that only the document
    or only its predecessor has, ascending, joined by commas; without a
    predecessor all paragraphs are added.

    Ids can be of any type with an order.  Nulls: a null or empty text has no
    paragraphs and no predecessor; null ids come first in the order, and are
    kept.  Very long texts are digested whole.  A paragraph repeated within a
    text counts once.  Ties: of documents named equally often the one with the
    highest id, then text hash, is the predecessor.  Rows with one id and
    different texts are versions in the order of their text's hash; repeated
    rows are one version, with a row each.  An empty table gives no rows.  Other
    columns are not read.
    """
    if cells < 3 or cells % 3:
        raise ValueError("cells must be a multiple of 3")
    versions = materialize(_versions(docs, id_col, text_col), "versions")
    identity = ["doc_id", "text_hash", "previous_id", "previous_hash"]
    linked = materialize(_predecessors(versions, overlap), "linked")
    some, m, results, table = linked, cells, [], versions.select("doc_id", "text_hash", "digests")
    while True:
        larger = materialize(_sketched(table, m), "sketches")
        own = some.alias("n").join(larger.alias("s"), _same("n", "s")).select(*[f"n.{c}" for c in identity], "s.sketch")
        pairs = own.alias("n").join(larger.alias("p"), _same("n", "p", "previous_id", "previous_hash")).select("n.*", F.col("p.sketch").alias("previous"))
        level = materialize(_peeled(pairs, m), "peeled")
        results.append(level.where("done").select(*identity[:3], "added", "removed"))
        some = level.where("not done").select(*identity)
        if not some.take(1):
            break
        m *= GROWTH
        needed = some.select("doc_id", "text_hash").union(some.select("previous_id", "previous_hash")).distinct()
        table = versions.alias("t").join(needed.alias("i"), _same("t", "i"), "left_semi").select("doc_id", "text_hash", "digests")
    found = results[0]
    for result in results[1:]:
        found = found.union(result)
    whole = versions.alias("v").join(found.alias("f"), _same("v", "f"), "left")
    rows = whole.select("v.doc_id", "f.previous_id", "n", F.coalesce("added", "digests").alias("added"), F.coalesce("removed", F.array().cast("array<long>")).alias("removed"))
    rows = rows.select("doc_id", "previous_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("added", "removed")], "n")
    # a version of very many rows is spread over tasks before it comes once for each
    pieces = rows.where("n > 1").withColumn("n", F.explode(F.expr(f"transform(sequence(0L, (n - 1) div {REPEATED}), k -> least({REPEATED}L, n - k * {REPEATED}))")))
    return rows.where("n = 1").drop("n").union(pieces.repartition(SPREAD).withColumn("n", F.explode(F.expr("sequence(1L, n)"))).drop("n"))


#: The same by set difference, in DuckDB SQL.
ORACLE_SQL = f"""
with lines as (
  select doc_id, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as text_hash,
    list_sort(list_distinct(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: l <> ''), lambda l: ('0x' || substr(md5(l), 1, 15))::bigint))) as d
  from documents
), versions as (
  select distinct on (doc_id, text_hash) doc_id, text_hash, d from lines
), posts as (
  select doc_id, text_hash, unnest(d) as digest from versions
), named as (
  select doc_id, text_hash, lag(doc_id) over w as previous_id, lag(text_hash) over w as previous_hash
  from posts window w as (partition by digest order by doc_id nulls first, text_hash)
), counted as (
  select doc_id, text_hash, previous_id, previous_hash, count(*) as n from named where previous_hash is not null group by all
), best as (
  select * from counted qualify row_number() over (partition by doc_id, text_hash order by n desc, previous_id desc nulls last, previous_hash desc) = 1
), paired as (
  select l.doc_id, l.d, p.doc_id as previous_id, coalesce(p.d, []) as p from lines l
  left join best b on b.doc_id is not distinct from l.doc_id and b.text_hash = l.text_hash and b.n >= {OVERLAP} * len(l.d)
  left join versions p on p.doc_id is not distinct from b.previous_id and p.text_hash = b.previous_hash
)
select doc_id, previous_id,
  coalesce(array_to_string(list_filter(d, lambda x: not list_contains(p, x)), ','), '') as added,
  coalesce(array_to_string(list_filter(p, lambda x: not list_contains(d, x)), ','), '') as removed
from paired
"""
