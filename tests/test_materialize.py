"""Tables in the shared folder, and numbering without one task that sorts all."""

import os

import pytest
from pyspark.sql import functions as F

from meridian.plans import materialize as mt
from meridian.plans.numbering import numbered


class Elsewhere:
    """A session on a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda name, default: default)

    class sparkContext:
        master = "spark://host:7077"

        class getConf:
            get = staticmethod(lambda name, default: default)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(monkeypatch, master):
    monkeypatch.setattr(Elsewhere.sparkContext, "master", master)
    with pytest.raises(RuntimeError):
        mt.shared_dir(Elsewhere)


def test_the_folder_is_read_from_the_session(monkeypatch):
    monkeypatch.setattr(Elsewhere.conf, "get", staticmethod(lambda name, default: "hdfs://x/shared/" if name == "spark.checkpoint.dir" else default))
    assert mt.shared_dir(Elsewhere) == "hdfs://x/shared"


def test_settled_deletes_what_was_written_on_the_way(spark):
    inner = []

    def make():
        df, path = mt.stored(spark.range(5).toDF("n"), "inner")
        inner.append(path)
        return df.where("n > 1")

    out, path = mt.settled(make, "outer")
    exists = lambda p: os.path.exists(p.removeprefix("file://"))
    assert out.count() == 3 and exists(path) and not exists(inner[0])
    mt.discard(spark, [path])
    assert not exists(path)


@pytest.mark.parametrize("single", [10**6, 0, 7])
def test_positions_are_those_of_the_order(spark, single):
    """Both ways of numbering, with nulls and a key that half of the rows have."""
    df = spark.range(500).select(F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("key"))
    got = numbered(df.repartition(6), F.col("key").asc_nulls_first(), "n", single_task_rows=single).orderBy("position").collect()
    want = sorted(df.collect(), key=lambda r: (r["key"] is not None, r["key"] or "", r["n"]))
    assert [(r["n"], r["position"]) for r in got] == [(r["n"], k) for k, r in enumerate(want)]


def test_an_empty_table_has_no_positions(spark):
    assert numbered(spark.range(3).where("id > 5"), "id", single_task_rows=0).count() == 0
