"""MinHash near-duplicates by a signature-coordinate inverted join.

A document is a set of 64 elements (coordinate, minimum).  Two documents are
near copies if at least ``need`` = ceil(threshold * 64) elements are common.
The join is exact for that rule, with no cap on partners:

1. documents with equal signatures are one class, with one representative;
2. every element of every representative is posted and its postings counted;
   elements posted once are dropped, and so are representatives left with fewer
   than ``need`` elements, since they can't have a partner;
3. a representative's elements are ordered by rarity; two with ``need`` common
   elements have one in common among all but the last ``need - 1`` of either, so
   only that prefix is joined;
4. within a posting list, collisions are counted over half of the coordinates,
   pairs that can't reach ``need`` any more are skipped, and the rest are
   counted in full.  Each pair counts at the lowest coordinate that both
   prefixes share, hence once.

A list of more than ``CHUNK`` postings is cut into chunks, and each pair of
chunks is a unit of work of its own, so one hot list doesn't become one task.  A
unit sends on how many documents each of its members is linked to, and one edge
to each group of linked members: as many rows as members, not as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.text import WordHashes, shingles, texts_of, type_of, words
from meridian.plans.materialize import materialize, settled

COORDS = 64
THRESHOLD = 0.55
NGRAM = 3
#: Postings of a list that one unit of work compares with each other.
CHUNK = 4096
#: Elements whose counts are sent to every executor, at most: those of FREQUENT postings or more in one of SAMPLE parts of the representatives.
HOT, SAMPLE, FREQUENT = 100_000, 64, 32


def minhash(hashes: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The signature of a non-empty array of shingle hashes: 64 minima, upper 32 bits."""
    best = np.full(odd.size, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, hashes.size, 2048):
        np.minimum(best, (hashes[None, start : start + 2048] * odd[:, None] + add[:, None]).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def coefficients(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 2**64, COORDS, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, seed: int = 1) -> DataFrame:
    """(doc_id, text_hash, key1, key2, sig), one row for each of ``docs``: 64 minima over the n-word shingles of the whole text.

    key1 and key2 are a 128-bit hash of sig.  All three are null for a text without words.
    """
    odd, add = coefficients(seed)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sigs = []
            for text in texts_of(batch.column(2)):
                found = words(text)
                sigs.append(minhash(shingles(known.of(found), ngram), odd, add).tobytes() if found else None)
            keys = np.frombuffer(b"".join(bytes(16) if s is None else xxhash.xxh3_128_digest(s) for s in sigs), "<i8").reshape(-1, 2)
            without = np.array([s is None for s in sigs], bool)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(keys[:, k], mask=without) for k in (0, 1)), pa.array(sigs, pa.binary())], ["doc_id", "text_hash", "key1", "key2", "sig"])

    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return named.mapInArrow(sign, f"doc_id {type_of(docs, id_col)}, text_hash long, key1 long, key2 long, sig binary")


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = np.arange(COORDS, dtype=np.int64) << 32
    for batch in batches:
        n = batch.num_rows
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(n, COORDS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), COORDS)), pa.array((values | place).ravel())], ["node", "element"])


def matches(a: np.ndarray, b: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b (n x 64) with at least need equal columns, and their counts; the second half is skipped where it can't help."""
    half = COORDS // 2
    count = (a[:, :half] == b[:, :half]).sum(axis=1)
    rows = np.flatnonzero(count >= need - half)
    count = count[rows] + (a[rows, half:] == b[rows, half:]).sum(axis=1)
    enough = count >= need
    return rows[enough], count[enough]


def list_pairs(group: np.ndarray, cell: np.ndarray, chunk: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs to compare of rows sorted by group, a bounded number at a time.

    cell: whether the group compares one chunk with itself (else two with each other).
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, group.size])
    size = np.repeat(sizes, sizes)
    small = size <= 24
    for step in range(1, int(size[small].max(initial=1))):
        i = np.flatnonzero((group[:-step] == group[step:]) & small[:-step])
        i = i[cell[i] | (chunk[i] != chunk[i + step])]
        for at in range(0, i.size, 20_000):
            yield i[at : at + 20_000], i[at : at + 20_000] + step
    for start, n in zip(starts[sizes > 24], sizes[sizes > 24]):
        rows = np.arange(start, start + n)
        block = max(1, 20_000 // n)
        for at in range(0, n, block):
            i, j = np.meshgrid(rows[at : at + block], rows[at:], indexing="ij")
            ok = (i < j) & (cell[i] | (chunk[i] != chunk[j]))
            yield i[ok], j[ok]


class Links:
    """Of the rows of some units: how many documents each is linked to, and the groups that the links make."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.count, self.root = weight, np.zeros(weight.size, np.int64), np.arange(weight.size)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count, i, self.weight[j])
        np.add.at(self.count, j, self.weight[i])
        while True:  # the lower root wins, until both ends of each link have one
            a, b = self.root[i], self.root[j]
            differ = a != b
            if not differ.any():
                return
            np.minimum.at(self.root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _verifier(need: int, pairs: bool):
    """Compare the rows of each unit: the pairs (a, b, matches), or the members' links (node, root, links)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.arange(COORDS, dtype=np.uint64)
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                new = {c: batch.column(c).to_numpy() for c in ("element", "ca", "cb", "c", "node", "n", "mask")}
                new["sig"] = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(-1, COORDS)
                held = new if held is None else {k: np.concatenate([held[k], new[k]]) for k in new}
                last = (held["element"] == held["element"][-1]) & (held["ca"] == held["ca"][-1]) & (held["cb"] == held["cb"][-1])
                cut = int(np.argmax(last))
                if not cut:
                    continue
                rows, held = {k: v[:cut] for k, v in held.items()}, {k: v[cut:] for k, v in held.items()}
            elif held is None:
                return
            else:
                rows = held
            change = (np.diff(rows["element"]) != 0) | (np.diff(rows["ca"]) != 0) | (np.diff(rows["cb"]) != 0)
            group = np.r_[0, np.cumsum(change)]
            links = Links(rows["n"])
            for i, j in list_pairs(group, rows["ca"] == rows["cb"], rows["c"]):
                at, count = matches(rows["sig"][i], rows["sig"][j], need)
                i, j = i[at], j[at]
                both = (rows["mask"][i] & rows["mask"][j]).view(np.uint64)
                shared = (rows["sig"][i] == rows["sig"][j]) & ((both[:, None] >> bits) & np.uint64(1)).astype(bool)
                first = shared.argmax(axis=1) == (rows["element"][i] >> 32)
                i, j, count = i[first], j[first], count[first]
                if pairs:
                    a, b = rows["node"][i], rows["node"][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(count.astype(np.int32))], ["a", "b", "matches"])
                else:
                    links.add(i, j)
            some = np.flatnonzero(links.count)
            if some.size:
                yield pa.RecordBatch.from_arrays([pa.array(rows["node"][some]), pa.array(rows["node"][links.root[some]]), pa.array(links.count[some])], ["node", "root", "links"])

    return verify


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def representatives(sigs: DataFrame) -> DataFrame:
    """(node, key1, key2, sig, n, least) of each class of equal signatures: a number, how many documents it has, the least of them."""
    found = sigs.where("key1 is not null and doc_id is not null").groupBy("key1", "key2")
    classes = found.agg(F.count_distinct("doc_id", "text_hash").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("sig").alias("sig"))
    return materialize(classes.select(F.monotonically_increasing_id().alias("node"), "key1", "key2", "sig", "n", "least"), "representatives")


def _units(reps: DataFrame, need: int) -> DataFrame:
    """The postings of all prefixes, sorted into the units that are compared."""
    post = lambda some: some.select("node", "sig").mapInArrow(_post, "node long, element long")
    posts = post(reps)
    # what is frequent in a sample is counted apart, so that no task counts a hot element; a count never depends on the sample
    sampled = post(reps.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0)).groupBy("element").count().where(F.col("count") >= FREQUENT)
    listed = materialize(sampled.orderBy(F.desc("count"), "element").limit(HOT).select("element"), "frequent")
    hot = materialize(posts.join(F.broadcast(listed), "element").groupBy("element").agg(F.count("*").alias("n")), "hot")
    often = posts.join(F.broadcast(hot), "element").select("node", "element", "n")
    others = posts.join(F.broadcast(listed), "element", "left_anti").select("node", "element", F.count("*").over(Window.partitionBy("element")).alias("n"))
    counted = often.union(others).where("n > 1")
    prefixes = (
        counted.groupBy("node")
        .agg(F.sort_array(F.collect_set(F.struct("n", "element"))).alias("e"))
        .where(F.size("e") >= need)
        .select("node", F.expr(f"slice(e, 1, size(e) - {need - 1})").alias("e"))
    )
    chunks = F.expr(f"cast(ceil(p.n / {CHUNK}) as int)")
    return (
        reps.select("node", "n", "sig")
        .join(prefixes, "node")
        .withColumn("mask", F.expr("aggregate(e, 0L, (m, x) -> m | shiftleft(1L, cast(shiftright(x.element, 32) as int)))"))
        .select("node", "n", "sig", "mask", F.explode("e").alias("p"))
        .select("node", "n", "sig", "mask", F.col("p.element").alias("element"), F.pmod(F.xxhash64("node"), chunks).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("x"))
        .select("element", F.least("c", "x").alias("ca"), F.greatest("c", "x").alias("cb"), "c", "node", "n", "mask", "sig")
        .repartition("element", "ca", "cb")
        .sortWithinPartitions("element", "ca", "cb")
    )


def _need(threshold: float) -> int:
    need = math.ceil(threshold * COORDS - 1e-9)
    if not 1 <= need <= COORDS:
        raise ValueError("threshold must be above 0 and at most 1")
    return need


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, ngram: int = NGRAM, seed: int = 1) -> DataFrame:
    """All pairs of classes of equal signatures that are near copies: (doc_id_a < doc_id_b, matches of 64 coordinates).

    A class goes by its least id; near_classes() has the membership.  Of a text
    that many share there may be very many pairs; near_classes() has a row for
    each document instead.  Nulls, empty and long texts, ties, repeated rows,
    empty tables and other columns: as in near_classes().
    """
    need = _need(threshold)
    reps = representatives(materialize(signatures(docs, id_col, text_col, ngram, seed), "signatures"))
    found = _units(reps, need).mapInArrow(_verifier(need, True), "a long, b long, matches int")
    least = reps.select("node", F.col("least.doc_id").alias("doc_id"))
    both = found.join(least.withColumnsRenamed({"node": "a", "doc_id": "x"}), "a").join(least.withColumnsRenamed({"node": "b", "doc_id": "y"}), "b")
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "matches")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of (a, b) edges, the least node of its connected component.

    Alternates large-star and small-star steps; each round is a written table.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        linked = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(linked, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        mark = seen


def _judged(docs: DataFrame, id_col: str, text_col: str, threshold: float, ngram: int, seed: int) -> DataFrame:
    """(doc_id, text_hash, key1, first, links), one row for each of ``docs``; first is the least (doc_id, text_hash) of its group."""
    need = _need(threshold)
    sigs = materialize(signatures(docs, id_col, text_col, ngram, seed), "signatures")
    reps = representatives(sigs)
    linked = materialize(_units(reps, need).mapInArrow(_verifier(need, False), "node long, root long, links long"), "links")
    groups = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    known = reps.select("node", "key1", "key2", "n", "least").join(links, "node", "left").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = known.groupBy("root").agg(F.min("least").alias("first"))
    classes = materialize(known.join(firsts, "root").select("key1", "key2", "n", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "classes")
    rows = sigs.select("doc_id", "text_hash", "key1", "key2")
    worded = rows.where("key1 is not null and doc_id is not null")
    # the classes that hold more than a thousandth of all rows are few
    many = classes.agg(F.sum("n")).first()[0] or 0
    hot, cold = classes.where(F.col("n") * 1000 > many), classes.where(F.col("n") * 1000 <= many)
    names = ["doc_id", "text_hash", "key1", "first", "links"]
    common = worded.join(F.broadcast(hot), ["key1", "key2"]).select(*names)
    others = worded.join(F.broadcast(hot.select("key1", "key2")), ["key1", "key2"], "left_anti").join(cold, ["key1", "key2"]).select(*names)
    alone = rows.where("key1 is null or doc_id is null").select("doc_id", "text_hash", "key1", F.struct("doc_id", "text_hash").alias("first"), F.lit(0).cast("long").alias("links"))
    return common.union(others).union(alone)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, ngram: int = NGRAM, seed: int = 1) -> DataFrame:
    """(doc_id, class_id, links), one row for each row of ``docs``.

    links is the number of other documents that are near copies of it, all of
    them; class_id the least id of its group, which is a connected component of
    these links.  A document without near copies is its own class.

    Ids can be of any type with an order.  Nulls: a row with a null id or a null
    text has no links, and its own id as class.  Empty texts and texts without
    words have no links either.  Very long texts are signed whole.  Ties:
    documents of equal signatures are linked, of whatever texts.  Repeated rows
    are one document, with a row each; rows of one id with different texts are
    documents of their own.  An empty table gives no rows.  Other columns are
    not read.
    """
    return _judged(docs, id_col, text_col, threshold, ngram, seed).select("doc_id", F.col("first.doc_id").alias("class_id"), "links")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, ngram: int = NGRAM, seed: int = 1) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the least id.

    Groups are those of near_classes(), exact copies among them.  All columns
    are kept, whatever their names.  Rows with a null id, and rows without words
    (null and empty texts among them), have no copies and stay.  Very long texts
    are signed whole.  Of several rows with words, one id and one text, one
    stays, any; of rows with one id and near texts, the one with the least text
    hash.  An empty table stays empty.
    """
    worded = lambda: _judged(docs, id_col, text_col, threshold, ngram, seed).where("key1 is not null and doc_id is not null")
    # signatures and all else are deleted before the documents are joined
    judged, _ = settled(lambda: worded().select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "first"), "judged")
    same = F.struct("own_id", "own_hash") == F.struct("first.doc_id", "first.text_hash")
    gone = judged.where(~same).select("own_id", "own_hash").distinct()
    repeated = materialize(judged.where(same).groupBy("own_id", "own_hash").count().where("count > 1").select("own_id", "own_hash"), "repeated")
    key = lambda other: (docs[f"`{id_col}`"] == other["own_id"]) & (F.xxhash64(docs[f"`{text_col}`"]) == other["own_hash"])
    kept = docs.join(gone, key(gone), "left_anti")
    if not repeated.take(1):
        return kept
    return kept.join(repeated, key(repeated), "left_anti").union(kept.join(repeated, key(repeated), "left_semi").dropDuplicates([id_col, text_col]))
