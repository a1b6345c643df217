"""Exact cosine retrieval: top-k, self-ranks, CSLS, merging of hit lists.

Equal similarities, to nine digits, go by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import vec
from meridian.operators.blocks import BLOCK_ROWS, BROADCAST_BYTES, TILE_ROWS, Fold, all_pairs, collected, in_blocks, matrix, tiles, unit_rows


#: Pairs whose exact values are computed at once, from gathered rows.
GATHERED = 1 << 14


def slack(d: int) -> float:
    """More than single precision, and rounding to nine digits, can move the dot product of two unit rows."""
    return (d + 8) * 2.0**-24 + 1e-8


def cells(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true cells: np.nonzero of a matrix takes several times as long."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def dots(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact dot products of pairs of rows, by one product of the matrices if that is less work than gathering them."""
    if rows.size > len(a) * len(b) // 32:
        return (a @ b.T)[rows, cols]
    out = np.empty(rows.size)
    for at in range(0, rows.size, GATHERED):
        out[at : at + GATHERED] = np.einsum("ij,ij->i", a[rows[at : at + GATHERED]], b[cols[at : at + GATHERED]])
    return out


class Best(Fold):
    """(row id, column id, value): each row's k highest values, to nine digits, ties by column id; -inf counts for none.

    A tile is scored in single precision, and a value is computed exactly only
    if it can be among them: most of a tile are passed over by one comparison
    with the k-th value so far.
    """

    #: Of a row's score per unit of its cosine.
    SCALE = 1

    def __init__(self, i: np.ndarray, a: np.ndarray, k: int, exclude_self: bool = False):
        super().__init__(i, a)
        self.k, self.exclude_self = k, exclude_self
        self.single = a.astype(np.float32)
        self.values, self.ids = np.full((i.size, k), -np.inf), np.full((i.size, k), np.iinfo(np.int64).max)

    def scores(self, b: np.ndarray) -> np.ndarray:
        """Of all rows with a block, in single precision."""
        return self.single @ b.astype(np.float32).T

    def exact(self, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return np.round(dots(self.a, b, rows, cols), 9)

    def add(self, j: np.ndarray, b: np.ndarray) -> None:
        if not (self.i.size and j.size):
            return
        scores = self.scores(b)
        if self.exclude_self:
            scores[self.i[:, None] == j[None, :]] = -np.inf
        bound = self.values[:, -1]
        if self.k < j.size and (bound == -np.inf).any():  # not yet k of them: those of this tile alone are a bound
            bound = np.maximum(bound, np.partition(scores, j.size - self.k, axis=1)[:, j.size - self.k])
        least = (bound - 2 * self.SCALE * slack(self.a.shape[1])).astype(np.float32)
        rows, cols = cells(scores >= least[:, None])
        if self.exclude_self:
            other = self.i[rows] != j[cols]
            rows, cols = rows[other], cols[other]
        values, ids = self.exact(b, rows, cols), j[cols]
        last = self.values[rows, -1]
        kept = (values > last) | ((values == last) & (ids < self.ids[rows, -1]))
        if not kept.any():
            return
        rows, ids, values = rows[kept], ids[kept], values[kept]
        touched, at = np.unique(rows, return_inverse=True)
        place = np.r_[np.repeat(np.arange(touched.size), self.k), at]
        ids, values = np.r_[self.ids[touched].ravel(), ids], np.r_[self.values[touched].ravel(), values]
        ranked = np.lexsort((ids, -values, place))
        first = np.searchsorted(place[ranked], np.arange(touched.size))
        chosen = ranked[first[:, None] + np.arange(self.k)[None, :]]
        self.ids[touched], self.values[touched] = ids[chosen], values[chosen]

    def rows(self) -> list[np.ndarray]:
        rows, cols = np.nonzero(self.values > -np.inf)
        return [self.i[rows], self.ids[rows, cols], self.values[rows, cols]]


#: Queries that go to the corpus, if the corpus is larger; more of them are met by the corpus's blocks.
FEW_QUERIES = 8192


def topk(queries: DataFrame, corpus: DataFrame, k: int = 100, query_cols: tuple[str, str] = ("id", "vec"), corpus_cols: tuple[str, str] = ("id", "vec"), exclude_self: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, rank, id, sim): the k nearest of the corpus to every query, rank from 1.

    A few queries go to the corpus, each task of which keeps k rows a query.  Of
    many, a block of queries keeps its k rows while the corpus passes.  Partial
    lists are merged by one window.
    """
    return ranked_best(queries, corpus, lambda i, a: Best(i, a, k, exclude_self), k, "sim", query_cols, corpus_cols, broadcast_bytes)


def ranked_best(queries: DataFrame, corpus: DataFrame, fold: Callable[[np.ndarray, np.ndarray], Best], k: int, value: str, query_cols: tuple[str, str], corpus_cols: tuple[str, str], broadcast_bytes: int = BROADCAST_BYTES, unit: tuple[bool, bool] = (True, True)) -> DataFrame:
    """(query_id, rank, id, value): each query's k best, by a fold of queries over the corpus."""
    schema = f"query_id long, id long, {value} double"
    side = queries.select(F.size(query_cols[1]).alias("d")).limit(FEW_QUERIES + 1).agg(F.count("*").alias("n"), F.coalesce(8 * F.sum("d"), F.lit(0)).alias("bytes")).first()
    if side["n"] <= FEW_QUERIES and broadcast_bytes and side["bytes"] <= broadcast_bytes:
        sent, rows_of = queries.sparkSession.sparkContext.broadcast(collected(in_blocks(queries, query_cols, unit[0]))), unit_rows if unit[1] else matrix

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [fold(i, a) for i, a in tiles(*sent.value, TILE_ROWS)]
            for batch in batches:
                for at in range(0, batch.num_rows if own else 0, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    j, b = part.column(0).to_numpy(), rows_of(part.column(1))
                    for f in own:
                        f.add(j, b)
            for f in own:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in f.rows()], ["query_id", "id", value])

        parts = corpus.select(F.col(corpus_cols[0]).cast("long").alias("id"), F.col(corpus_cols[1]).cast("array<double>").alias("v")).mapInArrow(run, schema)
    else:
        parts = all_pairs(queries, corpus, fold, schema, query_cols, corpus_cols, broadcast_bytes, unit)
    order = Window.partitionBy("query_id").orderBy(F.desc(value), "id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", value)


class _Pairs(Fold):
    """(q, d, sa, sb): all pairs of a block of the corpus with the queries, or those with q < d."""

    def __init__(self, i: np.ndarray, a: np.ndarray, upper: bool, spaces: int):
        super().__init__(i, a)
        self.upper, self.spaces = upper, spaces

    def parts(self, m: np.ndarray) -> list[np.ndarray]:
        if self.spaces == 1:
            return [m]
        n = 1 + int(m[0, 0])
        return [m[:, 1:n], m[:, n:]]

    def add(self, j: np.ndarray, b: np.ndarray) -> list[np.ndarray] | None:
        if not (self.i.size and j.size):
            return None
        sims = [np.round(x @ y.T, 9) for x, y in zip(self.parts(self.a), self.parts(b))]
        rows, cols = np.nonzero(j[None, :] < self.i[:, None] if self.upper else np.ones_like(sims[0], bool))
        return [j[cols], self.i[rows], *[s[rows, cols] for s in sims]]


def similarities(queries: DataFrame, corpus: DataFrame, query_cols: tuple[str, str] = ("id", "vec"), corpus_cols: tuple[str, str] = ("id", "vec"), upper: bool = False) -> DataFrame:
    """(q, d, sim) of all pairs, or of those with q < d: for bounded samples."""
    return all_pairs(corpus, queries, lambda i, a: _Pairs(i, a, upper, 1), "q long, d long, sim double", corpus_cols, query_cols)


def two_similarities(queries: DataFrame, corpus: DataFrame, query_cols: tuple[str, str], corpus_cols: tuple[str, str], id_col: str = "id", upper: bool = False) -> DataFrame:
    """(q, d, sa, sb): cosines of all pairs, or of those with q < d, in two spaces at once; for a bounded number of queries.

    The vectors of both spaces travel as one, whose first value is the size of the first space.
    """
    joined = lambda df, cols: df.select(F.col(id_col).alias("id"), F.concat(F.array(F.size(cols[0]).cast("double")), *[vec.l2_normalize(vec.doubles(c)) for c in cols]).alias("vec"))
    return all_pairs(joined(corpus, corpus_cols), joined(queries, query_cols), lambda i, a: _Pairs(i, a, upper, 2), "q long, d long, sa double, sb double", unit=(False, False))


class _Better(Fold):
    """(id, better): how many rows are nearer to each than its own, whose similarity is the last value of its vector.

    Single precision decides all pairs but those so near that exact values, rounding and ids do.
    """

    def __init__(self, i: np.ndarray, a: np.ndarray):
        super().__init__(i, np.ascontiguousarray(a[:, :-1]))
        self.single, near = self.a.astype(np.float32), slack(a.shape[1])
        self.own, self.better = np.round(a[:, -1], 9), np.zeros(i.size, np.int64)
        self.low, self.high = (self.own - near).astype(np.float32), (self.own + near).astype(np.float32)

    def add(self, j: np.ndarray, b: np.ndarray) -> None:
        if not (self.i.size and j.size):
            return
        sims = self.single @ b.astype(np.float32).T
        some = np.flatnonzero(sims.max(axis=1) >= self.low)
        if not some.size:
            return
        sims = sims[some] if some.size < self.i.size else sims
        sure = sims > self.high[some, None]
        self.better[some] += np.count_nonzero(sure, axis=1)
        rows, cols = cells((sims >= self.low[some, None]) & ~sure)
        rows = some[rows]
        value, own, i, j = np.round(dots(self.a, b, rows, cols), 9), self.own[rows], self.i[rows], j[cols]
        self.better += np.bincount(rows[((value > own) | ((value == own) & (j < i))) & (i != j)], minlength=self.i.size)

    def rows(self) -> list[np.ndarray]:
        return [self.i, self.better]


def self_ranks(pairs: DataFrame, query_col: str, corpus_col: str, id_col: str = "id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, rank) of each row's own vector among all: one more than the number of better ones, so nothing is sorted."""

    q, c = vec.l2_normalize(vec.doubles(query_col)), vec.l2_normalize(vec.doubles(corpus_col))
    queries = pairs.select(F.col(id_col).alias("id"), F.concat(q, F.array(F.round(vec.dot(q, c), 9))).alias("vec"))
    counted = all_pairs(queries, pairs, _Better, "id long, better long", ("id", "vec"), (id_col, corpus_col), broadcast_bytes, (False, True))
    return counted.groupBy("id").agg((F.sum("better") + 1).alias("rank"))


class _Csls(Best):
    """The corpus's rows carry their penalty as their last value."""

    SCALE = 2

    def scores(self, b: np.ndarray) -> np.ndarray:
        return 2 * super().scores(b[:, :-1]) - b[:, -1].astype(np.float32)[None, :]

    def exact(self, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return np.round(2 * super().exact(b[:, :-1], rows, cols) - b[cols, -1], 9)


def csls(queries: DataFrame, corpus: DataFrame, k: int = 10, top: int = 10, symmetric: bool = False, query_cols: tuple[str, str] = ("id", "vec"), corpus_cols: tuple[str, str] = ("id", "vec")) -> DataFrame:
    """(query_id, rank, id, score): 2 cos less each candidate's mean cosine to its k nearest queries.

    The penalty travels with the candidate's vector, so only ``top`` rows a
    query and block leave the workers.  symmetric also subtracts the query's
    mean to its k nearest candidates, which doesn't change a query's order.
    """
    near = topk(corpus, queries, k, corpus_cols, query_cols).groupBy(F.col("query_id").alias("id")).agg(F.avg("sim").alias("penalty"))
    own_id, own_vec = corpus_cols
    unit = vec.l2_normalize(vec.doubles(own_vec))
    carried = corpus.select(F.col(own_id).cast("long").alias("id"), unit.alias("unit")).join(near, "id").select("id", F.concat("unit", F.array("penalty")).alias("vec"))
    best = ranked_best(queries, carried, lambda i, a: _Csls(i, a, top), top, "score", query_cols, ("id", "vec"), unit=(True, False))
    if not symmetric:
        return best
    own = topk(queries, corpus, k, query_cols, corpus_cols).groupBy("query_id").agg(F.avg("sim").alias("own"))
    return best.join(own, "query_id").select("query_id", "rank", "id", F.round(F.col("score") - F.col("own"), 9).alias("score"))


def merge_hits(legacy: DataFrame, native: DataFrame, legacy_weight: float = 1.0, native_weight: float = 1.0, k: int | None = None, migrated: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score) of two hit lists (query_id, id, score): the higher weighted score of an id, at least 0.

    migrated (id): legacy hits of these are left out.
    """
    if migrated is not None:
        legacy = legacy.join(migrated.select("id").distinct(), "id", "left_anti")
    both = legacy.select("query_id", "id", (F.col("score") * legacy_weight).alias("score")).unionAll(native.select("query_id", "id", (F.col("score") * native_weight).alias("score")))
    best = both.groupBy("query_id", "id").agg(F.greatest(F.lit(0.0), F.max("score")).alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("query_id", "rank", "id", "score")


def rerank(hits: DataFrame, scorer: Column, k: int | None = None) -> DataFrame:
    """Hits ordered by a pair scorer (a column, such as a pandas UDF of query and text), kept as rerank_score."""
    scored = hits.withColumn("rerank_score", scorer)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)
