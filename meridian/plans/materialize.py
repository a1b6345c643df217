"""Cut lineage with tables written to a folder that all executors share.

The folder is the one named by ``spark.checkpoint.dir``.  Only in a local session
where that is unset (tests, a bench) is a temporary one made; on a cluster that
would be another folder on each machine, so it is an error there.  A lost
executor loses nothing of such a table, and unlike a checkpointed RDD it is
columnar, so later reads prune columns.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="meridian-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return "file://" + _local[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder; a reader of it, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it."""
    return stored(df, name)[0]


def settled(make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """stored() of what ``make()`` gives; the tables that were written on the way are deleted."""
    before = {path for _, path in _written}
    out, path = stored(make(), name)
    discard(out.sparkSession, [p for _, p in _written if p not in before and p != path])
    return out, path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables whose readers are done."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    gone = set(paths)
    _written[:] = [w for w in _written if w[1] not in gone]


def release(spark: SparkSession) -> int:
    """Delete the tables this process wrote for ``spark``; call when their readers are done.

    Returns how many were deleted.
    """
    own = [path for session, path in _written if session is spark]
    discard(spark, own)
    return len(own)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed but read from a folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
