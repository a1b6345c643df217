"""Positions of rows in a total order, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.plans.materialize import materialize

#: Tables of up to so many rows are numbered in one task.
SINGLE_TASK_ROWS = 100_000


def numbered(df: DataFrame, *order: Column | str, name: str = "position", single_task_rows: int = SINGLE_TASK_ROWS, rows: int | None = None) -> DataFrame:
    """``df`` with its rows' positions from 0 in an order that leaves no ties.

    A larger table is range-partitioned and written once; then each partition
    numbers its own rows from where those before it end.  What is broadcast is
    one row for each partition.  rows: how many there are, if that is known.
    """
    if (df.limit(single_task_rows + 1).count() if rows is None else rows) <= single_task_rows:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    part = "_part_" + max(df.columns, key=len)
    ranged = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select(F.col(part).alias("p"), F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    placed = ranged.withColumn(name, own)
    return placed.join(F.broadcast(before), placed[part] == before["p"]).select(*[placed[f"`{c}`"] for c in df.columns], (placed[name] + before["before"]).alias(name))
