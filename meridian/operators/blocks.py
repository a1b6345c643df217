"""All pairs of two vector tables, a block of each at a time.

Both sides are packed into blocks of rows and written once.  The right side goes
to every executor as one matrix only if what was written is within
``BROADCAST_BYTES``; beyond it the left blocks meet parts of the right side of
``PART_BYTES`` each, and a few left blocks with a part are the unit of work, so
neither side has to fit anywhere; there blocks travel in packs of ``PACK_BYTES``,
since each pack of the left is sent along with each of the right.  Either way a
task holds the similarities of ``TILE_ROWS`` rows with one block, never of a block
with a whole side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.plans.materialize import materialize

#: Largest matrix that is sent to every executor.
BROADCAST_BYTES = 64 << 20
#: Bytes of the right side that a task goes through, where it isn't sent to all.
PART_BYTES = 128 << 20
#: Rows of a packed block.
BLOCK_ROWS = 2048
#: Left rows that are compared with a block at once: if all pairs tie, each takes some hundred bytes.
TILE_ROWS = 512
#: Bytes of blocks that travel together where neither side is sent to all.
PACK_BYTES = 4 << 20


class Fold:
    """What becomes of a left block (its ids, its matrix) as the blocks of the right side are added to it.

    ``add`` may give rows at once; ``rows`` gives those that are due after the
    last block, or after the last of a part: there the left block's rows come
    once for each part, to be merged by the caller.  Rows are one array for each
    column of the schema.
    """

    def __init__(self, i: np.ndarray, a: np.ndarray):
        self.i, self.a = i, a

    def add(self, j: np.ndarray, b: np.ndarray) -> list | None:
        raise NotImplementedError

    def rows(self) -> list | None:
        return None


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equally long vectors as a float64 matrix."""
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if flat.size % n or column.null_count:
        raise ValueError("vectors differ in their dimension, or are null")
    out = flat.reshape(n, -1)
    if not np.isfinite(out).all():
        raise ValueError("vectors have values that aren't finite")
    return out


def normalized(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def _packer(rows: Callable[[pa.Array], np.ndarray]):
    """Blocks of ids and of what ``rows`` makes of the vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([rows(part.column(1)).tobytes()], pa.binary())], ["ids", "m"])

    return pack


def unit_rows(column: pa.Array) -> np.ndarray:
    return normalized(matrix(column))


def in_blocks(df: DataFrame, cols: tuple[str, str] = ("id", "vec"), unit: bool = True) -> DataFrame:
    """packed(), not written: for a side that is collected at once."""
    return _vectors(df, *cols).mapInArrow(_packer(unit_rows if unit else matrix), "ids binary, m binary")


def packed(df: DataFrame, cols: tuple[str, str] = ("id", "vec"), unit: bool = True) -> DataFrame:
    """(ids, m): blocks of rows, written once; unit rows, or the vectors as they are if not ``unit``."""
    return materialize(in_blocks(df, cols, unit), "blocks")


def block_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum(F.length("m"))).first()[0] or 0


def collected(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of all blocks, on the driver: for a side that is within a bound."""
    parts = [(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["m"])) for r in blocks.collect()]
    ids = np.concatenate([i for i, _ in parts] or [np.zeros(0, np.int64)])
    return ids, np.concatenate([m.reshape(i.size, -1) for i, m in parts]) if parts else np.zeros((0, 0))


def tiles(ids: np.ndarray, m: np.ndarray, rows: int = BLOCK_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, ids.size, rows):
        yield ids[at : at + rows], m[at : at + rows]


def _batch(rows: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Rows of binary columns, one at a time and without copies: (ids, bytes, ids, bytes...) as arrays."""
    for batch in batches:
        for row in range(batch.num_rows):
            cells = [np.frombuffer(c[row].as_buffer(), np.int64 if k % 2 == 0 else np.float64) for k, c in enumerate(batch.columns)]
            yield [c if k % 2 == 0 else c.reshape(cells[k - 1].size, -1) for k, c in enumerate(cells)]


def spread(blocks: DataFrame, most: int | None = None) -> DataFrame:
    """Blocks dealt out to tasks, a few for each core: they are few rows of much work each."""
    n = blocks.count()
    tasks = 4 * blocks.sparkSession.sparkContext.defaultParallelism if most is None else most
    return blocks.repartition(max(1, min(n, tasks)))


def packs(blocks: DataFrame) -> DataFrame:
    """Blocks of a partition put together, as many as are within ``PACK_BYTES``; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                cells = [c[row].as_py() for c in batch.columns]
                if held and size + len(cells[1]) > PACK_BYTES:
                    yield _batch([[b"".join(x)] for x in zip(*held)], ["ids", "m"])
                    held, size = [], 0
                held.append(cells)
                size += len(cells[1])
        if held:
            yield _batch([[b"".join(x)] for x in zip(*held)], ["ids", "m"])

    return materialize(blocks.mapInArrow(run, "ids binary, m binary"), "packs")


def all_pairs(left: DataFrame, right: DataFrame, fold: Callable[[np.ndarray, np.ndarray], Fold], schema: str, left_cols: tuple[str, str] = ("id", "vec"), right_cols: tuple[str, str] = ("id", "vec"), broadcast_bytes: int = BROADCAST_BYTES, unit: tuple[bool, bool] = (True, True)) -> DataFrame:
    """Rows that ``fold(left ids, left matrix)`` gives as it is shown the blocks of the right side.

    Matrices hold unit rows, or a side's vectors as they are if not ``unit``.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    blocks, mine = packed(right, right_cols, unit[1]), packed(left, left_cols, unit[0])
    size = block_bytes(blocks)
    if size <= broadcast_bytes:
        sent = left.sparkSession.sparkContext.broadcast(collected(blocks))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for i, a in _opened(batches):
                for x, y in tiles(i, a, TILE_ROWS):
                    own = fold(x, y)
                    for j, b in tiles(*sent.value):
                        rows = own.add(j, b)
                        if rows is not None:
                            yield _batch(rows, names)
                    rows = own.rows()
                    if rows is not None:
                        yield _batch(rows, names)

        return spread(mine).mapInArrow(run, schema)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids = [], None
        for i, a, j, b in _opened(batches):
            if ids is None or not np.array_equal(ids, i):
                for f in own:
                    if (rows := f.rows()) is not None:
                        yield _batch(rows, names)
                ids = i.copy()
                own = [fold(x, y) for x, y in tiles(ids, a.copy(), TILE_ROWS)]
            for f in own:
                for x, y in tiles(j, b):
                    if (rows := f.add(x, y)) is not None:
                        yield _batch(rows, names)
        for f in own:
            if (rows := f.rows()) is not None:
                yield _batch(rows, names)

    blocks, mine = packs(blocks), packs(mine)
    parts = spread(blocks, -(-size // PART_BYTES)).withColumnsRenamed({"ids": "ids2", "m": "m2"})
    return spread(mine).crossJoin(parts).mapInArrow(cross, schema)
