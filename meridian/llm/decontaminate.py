"""Benchmark decontamination by a prefix-filtered set join.

A document is contaminated by an item if some window of it, as many words long
as the item, holds at least ``containment`` of the item's distinct shingles.

The corpus is read twice.  The first pass counts in how many documents each
shingle of the benchmark occurs.  An item's shingles are then ordered by rarity;
a window that holds ``need`` of its S shingles must hold one of the S - need + 1
rarest, so the second pass looks up only those.  A document that has one is
verified: enough distinct shingles of the item at all (length bound), and then
the best window that takes in a prefix shingle (positional bound), exactly.

The benchmark's shingles are sent to the executors only if their number is
within ``broadcast_shingles``; beyond it the same steps run as shuffled joins.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meridian.llm.text import WordHashes, shingles, texts_of, type_of, words
from meridian.plans.materialize import materialize

NGRAM = 3
CONTAINMENT = 0.5
#: Most shingles of a benchmark that are sent to every executor (16 MB of hashes).
BROADCAST_SHINGLES = 2_000_000
_BITS = 22


def needed(distinct: int, containment: float) -> int:
    return max(1, math.ceil(containment * distinct - 1e-9))


def best_window(pos: np.ndarray, ids: np.ndarray, width: int, prefix: set[int] | None = None) -> tuple[int, int]:
    """(most distinct ids in a window of width positions, its first position), of windows that hold a prefix id.

    pos ascends.  A best window can be moved to start at an occurrence.
    """
    best, start, low, rare, held = 0, -1, 0, 0, Counter()
    pos, ids = pos.tolist(), ids.tolist()
    for high, (p, i) in enumerate(zip(pos, ids)):
        held[i] += 1
        rare += prefix is None or i in prefix
        while pos[low] <= p - width:
            held[ids[low]] -= 1
            rare -= prefix is None or ids[low] in prefix
            if not held[ids[low]]:
                del held[ids[low]]
            low += 1
        if rare and len(held) > best:
            best, start = len(held), pos[low]
    return best, start


class Items:
    """A benchmark's shingles as sorted arrays, for look-ups inside workers."""

    def __init__(self, rows: list[tuple], ngram: int, containment: float):
        known, items = WordHashes(), {}
        for item, text in rows:
            found = words(text)
            if item is not None and len(found) >= ngram:
                items[item, text] = (len(found), np.unique(shingles(known.of(found), ngram)))
        self.ngram, self.ids = ngram, [item for item, _ in items]
        self.width = [n - ngram + 1 for n, _ in items.values()]
        self.words = [n for n, _ in items.values()]
        self.hashes = np.unique(np.concatenate([s for _, s in items.values()] or [np.zeros(0, np.uint64)]))
        self.sets = [np.searchsorted(self.hashes, s) for _, s in items.values()]
        self.need = [needed(s.size, containment) for s in self.sets]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.hashes >> np.uint64(64 - _BITS)] = True

    def set_counts(self, counts: np.ndarray) -> None:
        """Choose the prefixes, given in how many documents each shingle occurs."""
        self.prefix, self.of = [], {}
        for k, (ids, need) in enumerate(zip(self.sets, self.need)):
            rare = ids[np.lexsort((ids, counts[ids]))][: ids.size - need + 1].tolist()
            self.prefix.append(set(rare))
            for i in rare:
                self.of.setdefault(i, []).append(k)
        self.rare = np.zeros(self.hashes.size, bool)
        self.rare[list(self.of)] = True

    def hits(self, text: str | None, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
        """Positions and ids of the text's shingles that the benchmark has."""
        found = words(text)
        if len(found) < self.ngram or not self.hashes.size:
            return np.zeros(0, int), np.zeros(0, int)
        s = shingles(known.of(found), self.ngram)
        pos = np.flatnonzero(self.bits[s >> np.uint64(64 - _BITS)])
        ids = np.minimum(np.searchsorted(self.hashes, s[pos]), self.hashes.size - 1)
        real = self.hashes[ids] == s[pos]
        return pos[real], ids[real]

    def matches(self, text: str | None, known: WordHashes) -> Iterator[tuple[int, float, int, int]]:
        """(item id, containment, first word, words) for each item that contaminates the text."""
        pos, ids = self.hits(text, known)
        if not ids.size:
            return
        distinct = np.unique(ids)
        for k in sorted({k for i in distinct[self.rare[distinct]].tolist() for k in self.of[i]}):
            own = self.sets[k]
            if np.intersect1d(distinct, own, assume_unique=True).size < self.need[k]:
                continue
            at = np.isin(ids, own)
            most, start = best_window(pos[at], ids[at], self.width[k], self.prefix[k])
            if most >= self.need[k]:
                yield self.ids[k], most / own.size, start, self.words[k]


def _found(docs: DataFrame, benchmark: DataFrame) -> str:
    return f"doc_id {type_of(docs, 'doc_id')}, item_id {type_of(benchmark, 'item_id')}, containment double, first_word int, n_words int"


def _count(docs: DataFrame, items) -> np.ndarray:
    """In how many rows each shingle of the benchmark occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = items.value, WordHashes()
        total = np.zeros(own.hashes.size, np.int64)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                total[np.unique(own.hits(text, known)[1])] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    rows = docs.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(items.value.hashes.size, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


def _prepared(docs: DataFrame, benchmark: DataFrame, text_col: str, ngram: int, containment: float, broadcast_shingles: int):
    """A broadcast of Items with prefixes, or None if the benchmark is too large for one."""
    # a word and what parts it from the next take two bytes at least, in any script
    size = benchmark.agg(F.sum(F.ceil(F.octet_length("text") / 2))).first()[0] or 0
    if size > broadcast_shingles:
        return None
    context = docs.sparkSession.sparkContext
    items = Items([tuple(r) for r in benchmark.collect()], ngram, containment)
    counts = _count(docs.select(F.col(text_col).alias("text")).where("length(text) > 0"), context.broadcast(items))
    items.set_counts(counts)
    return context.broadcast(items)


def _key(text_col: str) -> list:
    """128 bits of a text, as two numbers."""
    return [F.xxhash64(text_col).alias("key"), F.xxhash64(F.lit(1), text_col).alias("key2")]


def _joined(docs: DataFrame, benchmark: DataFrame, ngram: int, containment: float) -> DataFrame:
    """The same result as shuffled joins: (key, key2, doc_id, item_id, containment, first_word, n_words); docs: (key, key2, doc_id, text)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                for k, (key, key2, i, text) in enumerate(zip(*(c.to_pylist() for c in part.columns))):
                    found = words(text)
                    if len(found) >= ngram:
                        s = shingles(known.of(found), ngram)
                        id_column = part.column(2).take(pa.array(np.full(s.size, k)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, key)), pa.array(np.full(s.size, key2)), id_column, pa.array(s.view(np.int64)), pa.array(np.arange(s.size, dtype=np.int32)), pa.array(np.full(s.size, len(found), np.int32))], ["key", "key2", "id", "shingle", "pos", "n_words"])

    shape = "key long, key2 long, id {}, shingle long, pos int, n_words int"
    items = benchmark.where("item_id is not null").distinct().select(F.xxhash64("item_id", "text").alias("key"), F.lit(0).cast("long").alias("key2"), F.col("item_id").alias("id"), "text").mapInArrow(explode, shape.format(type_of(benchmark, "item_id")))
    items = items.groupBy(F.col("key").alias("item"), F.col("id").alias("item_id"), "shingle").agg(F.max("n_words").alias("item_words"))
    items = materialize(items.withColumn("distinct", F.count("*").over(Window.partitionBy("item"))), "items")
    occur = materialize(docs.mapInArrow(explode, shape.format(type_of(docs, "doc_id"))).drop("n_words").join(items.select("shingle").distinct(), "shingle", "left_semi"), "occurrences")
    counts = occur.groupBy("shingle").agg(F.count_distinct("key", "key2").alias("n"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("n", F.lit(0)), "shingle"))
    need = F.greatest(F.lit(1), F.ceil(F.lit(containment) * F.col("distinct") - 1e-9))
    prefix = items.join(counts, "shingle", "left").withColumn("rank", rank).where(F.col("rank") <= F.col("distinct") - need + 1).select("item", "shingle")
    candidates = occur.join(prefix, "shingle").select("key", "key2", "item").distinct()
    least = materialize(occur.join(items, "shingle"), "hits").join(candidates, ["key", "key2", "item"], "left_semi")
    grouped = least.groupBy("key", "key2", "id", "item", "item_id", "item_words", "distinct").agg(F.sort_array(F.collect_set(F.struct("pos", "shingle"))).alias("at"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, out = [], []
            for k, (words_of, distinct, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("item_words", "distinct", "at")))):
                pos, ids = (np.array([x[c] for x in at]) for c in ("pos", "shingle"))
                most, start = best_window(pos, ids, words_of - ngram + 1)
                if most >= needed(distinct, containment):
                    kept.append(k)
                    out.append((most / distinct, start, words_of))
            own = batch.take(pa.array(kept, pa.int64()))
            numbers = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.float64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("key", "key2", "id", "item_id")), *numbers], ["key", "key2", "doc_id", "item_id", "containment", "first_word", "n_words"])

    return grouped.mapInArrow(verify, "key long, key2 long, " + _found(docs, benchmark))


def _benchmark(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ngram: int = NGRAM, containment: float = CONTAINMENT, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """Contaminated documents: (doc_id, item_id, containment, first_word, n_words), one row for each pair.

    first_word and n_words give the best window, the first of equally good ones.

    Ids can be of any type.  Nulls: a null or empty text, or one of fewer than ``ngram`` words, matches
    nothing; nor does such an item, nor one with a null id.  A document with a
    null id is reported with a null doc_id.  Very long texts are searched whole.
    Repeated rows, and rows or items that share an id, are reported once for
    each id pair, with the highest containment.  Empty tables give no rows.
    Other columns are not read.
    """
    items = _benchmark(benchmark, item_col, item_text_col)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = _prepared(docs, items, text_col, ngram, containment, broadcast_shingles)
    if own is None:
        found = _joined(named.select(*_key("text"), "doc_id", "text"), items, ngram, containment).drop("key", "key2")
    else:

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for batch in batches:
                rows = [(i, *m) for i, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))) for m in own.value.matches(text, known)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "containment", "first_word", "n_words"])

        kinds = [to_arrow_type(f.dataType) for f in (named.schema["doc_id"], items.schema["item_id"])] + [pa.float64(), pa.int32(), pa.int32()]
        found = named.mapInArrow(search, _found(named, items))
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("f"), "n_words")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.containment", (-F.col("b.f")).alias("first_word"), "b.n_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ngram: int = NGRAM, containment: float = CONTAINMENT, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """``docs`` without its contaminated rows; each row is judged by its own text, whatever its id.

    All columns are kept, whatever their names.  Rows that contamination() can't
    match (null, empty or short texts) stay.  Very long texts are searched whole;
    repeated rows all go or all stay; ties don't matter.  An empty table stays
    empty, and without a benchmark all rows stay.
    """
    items = _benchmark(benchmark, item_col, item_text_col)
    own = _prepared(docs, items, text_col, ngram, containment, broadcast_shingles)
    if own is None:
        keyed = docs.select(*_key(text_col), F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        gone = _joined(keyed, items, ngram, containment).select("key", "key2").distinct()
        text = docs[f"`{text_col}`"]
        return docs.join(gone, (F.xxhash64(text) == gone["key"]) & (F.xxhash64(F.lit(1), text) == gone["key2"]), "left_anti")
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            yield batch.filter(pa.array([next(own.value.matches(text, known), None) is None for text in texts_of(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
