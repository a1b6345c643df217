"""Gram blocks by one distributed pass, and the small dense algebra on the driver.

The driver holds matrices of the vectors' dimension only, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.operators.blocks import matrix


def gram(df: DataFrame, columns: list[str], bias: bool = False) -> tuple[np.ndarray, int]:
    """(Gram matrix of the concatenated columns, number of rows); bias adds a column of ones at the end.

    Partitions sum their part; the parts' rows are added on the executors.
    """
    vectors = F.concat(*[F.col(c).cast("array<double>") for c in columns], *([F.array(F.lit(1.0))] if bias else []))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column(0))
                total = m.T @ m if total is None else total + m.T @ m
                n += len(m)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([r.tobytes() for r in total], pa.binary()), pa.array(np.full(len(total), n))], ["i", "row", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, tuple] = {}
        for batch in batches:
            for i, row, n in zip(*(c.to_pylist() for c in batch.columns)):
                old, m = rows.get(i, (0, 0))
                rows[i] = (old + np.frombuffer(row), m + n)
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([r.tobytes() for r, _ in rows.values()], pa.binary()), pa.array([n for _, n in rows.values()], pa.int64())], ["i", "row", "n"])

    shape = "i long, row binary, n long"
    rows = {r["i"]: (np.frombuffer(r["row"]), r["n"]) for r in df.select(vectors.alias("v")).mapInArrow(partial, shape).repartition("i").mapInArrow(added, shape).collect()}
    if not rows:
        raise ValueError("no rows to fit")
    return np.stack([rows[i][0] for i in range(len(rows))]), rows[0][1]


class NotUsable(ValueError):
    """Pairs that no map can be fitted to."""


def pair_gram(pairs: DataFrame, x: str, y: str) -> tuple[np.ndarray, int, int, int]:
    """(Gram matrix of [x, y, 1], rows, d_src, d_tgt) by one pass that checks the pairs too.

    A partition with a missing or non-finite value, or with vectors of several
    sizes, reports that instead of its sums.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, p, q, bad = None, 0, 0, 0, 0
        for batch in batches:
            if not batch.num_rows or bad:
                continue
            sides = []
            for column in batch.columns:
                sizes = column.value_lengths().to_numpy(zero_copy_only=False)
                flat = column.flatten()
                if column.null_count or flat.null_count:
                    bad = 1
                elif (sizes != sizes[0]).any() or not sizes[0]:
                    bad = 2
                else:
                    sides.append(flat.to_numpy().reshape(batch.num_rows, -1))
            if not bad and not (np.isfinite(sides[0]).all() and np.isfinite(sides[1]).all()):
                bad = 1
            if not bad and n and (p, q) != (sides[0].shape[1], sides[1].shape[1]):
                bad = 2
            if not bad:
                p, q = sides[0].shape[1], sides[1].shape[1]
                m = np.c_[sides[0], sides[1], np.ones(batch.num_rows)]
                total = m.T @ m if total is None else total + m.T @ m
                n += batch.num_rows
        rows = [(-1, None, 0, 0, 0, bad)] if bad else [(i, r.tobytes(), n, p, q, 0) for i, r in enumerate(total)] if n else []
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["i", "row", "n", "p", "q", "bad"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        for batch in batches:
            for i, row, n, p, q, bad in zip(*(c.to_pylist() for c in batch.columns)):
                old = rows.setdefault(i, [0, 0, p, q, 0])
                differ = 2 if (old[2], old[3]) != (p, q) else 0
                old[4] = old[4] or bad or differ
                if not old[4]:
                    old[0], old[1] = old[0] + np.frombuffer(row), old[1] + n
        kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        columns = [pa.array([r[k].tobytes() if k == 0 and not r[4] else None if k == 0 else r[k] for r in rows.values()], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), *columns], ["i", "row", "n", "p", "q", "bad"])

    shape = "i long, row binary, n long, p int, q int, bad int"
    both = pairs.select(F.col(x).cast("array<double>").alias("a"), F.col(y).cast("array<double>").alias("b"))
    rows = both.mapInArrow(partial, shape).repartition("i").mapInArrow(added, shape).collect()
    if not rows:
        raise NotUsable("no pairs")
    bad = {r["bad"] for r in rows} - {0}
    if 1 in bad:
        raise NotUsable("pairs have missing values, or values that aren't finite")
    if bad or len({(r["n"], r["p"], r["q"]) for r in rows}) > 1:
        raise NotUsable("vectors of one side differ in their dimension")
    by = {r["i"]: np.frombuffer(r["row"]) for r in rows}
    return np.stack([by[i] for i in range(len(by))]), rows[0]["n"], rows[0]["p"], rows[0]["q"]


def gram_sql(df: DataFrame, column: str) -> DataFrame:
    """(i, j, value) over all dimensions by declarative aggregation: squares of the dimension in rows, so a check of ``gram`` and not its rival.

    Products are summed before the shuffle; a null vector adds nothing, an empty table has no cells.
    """
    v = df.select(F.col(column).cast("array<double>").alias("v"))
    cells = v.select("v", F.posexplode("v").alias("i", "a")).select("i", "a", F.posexplode("v").alias("j", "b"))
    return cells.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def truncated(w: np.ndarray, rank: int | None) -> np.ndarray:
    """The best approximation of that rank."""
    if rank is None or rank >= min(w.shape):
        return w
    u, s, vt = np.linalg.svd(w, full_matrices=False)
    return (u[:, :rank] * s[:rank]) @ vt[:rank]


def factors(w: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Two thin matrices whose product is truncated(w, rank): applying them costs rank * (d_src + d_tgt) a row."""
    u, s, vt = np.linalg.svd(w, full_matrices=False)
    return u[:, :rank] * s[:rank], vt[:rank]


def protocol_solve(xtx: np.ndarray, xty: np.ndarray, n: int) -> np.ndarray:
    """Normal equations with a ridge of 1e-4 n / 1000, at least 1e-10, raised tenfold below 1 while singular."""
    ridge = max(1e-4 * n / 1000, 1e-10)
    while True:
        system = xtx + ridge * np.eye(len(xtx))
        if np.abs(np.linalg.eigvalsh(system)).min() > 1e-10 or ridge >= 1:
            return np.linalg.solve(system, xty)
        ridge *= 10


def least_squares(xtx: np.ndarray, xty: np.ndarray) -> np.ndarray:
    """Minimum-norm least squares without a ridge."""
    return np.linalg.pinv(xtx, hermitian=True, rcond=1e-12) @ xty
