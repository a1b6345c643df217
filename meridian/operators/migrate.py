"""Migrating a store from one space to the other: batch, resumable, with a preflight gate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators import gate
from meridian.operators.blocks import matrix, normalized
from meridian.operators.mapping import Mapping
from meridian.plans.numbering import numbered


class MigrationError(RuntimeError):
    """A migration can't go ahead."""


def tagged(payload: Column, mapping_id: str, source: str) -> Column:
    """A payload map with the migration's tags; they win over older ones."""
    tags = {"mapping_id": mapping_id, "mapping_version": "1", "migrated_from": source}
    plain = F.map_filter(F.coalesce(payload, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*tags))
    return F.map_concat(plain, F.create_map(*[F.lit(x) for kv in tags.items() for x in kv]))


def migrated_before(df: DataFrame) -> bool:
    """Whether the first row carries a migration's tags."""
    row = df.select(F.map_contains_key(F.coalesce("payload", F.create_map().cast("map<string,string>")), "mapping_id").alias("b")).limit(1).collect()
    return bool(row and row[0]["b"])


def dry_run(df: DataFrame) -> DataFrame:
    """(n, dimension) without writing anything."""
    return df.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dimension"))


def transformed(df: DataFrame, mapping: Mapping, source: str, inverse: bool = False) -> DataFrame:
    """Rows of a store in the other space, tagged; the dimension is the map's, not the source's."""
    return mapping.transform(df, "vec", inverse=inverse).withColumn("payload", tagged(F.col("payload"), mapping.checksum, source))


def migrate(spark: SparkSession, source: DataFrame, target: str, mapping: Mapping, source_name: str = "source", resume: bool = True, preflight: DataFrame | None = None, thresholds: dict | None = None, overwrite_tags: bool = False) -> DataFrame:
    """Append what the Parquet target hasn't yet, by id, and return the report (n_before, n_written, n_total, verdict).

    Every append is atomic, so a run that died left whole appends or nothing; the
    next one resumes by id, whatever the batch sizes were.  preflight: a gate
    report that must not FAIL.
    """
    verdict = preflight.first()["verdict"] if preflight is not None else "NOT RUN"
    if verdict == "FAIL":
        raise MigrationError("the gate failed: not migrated")
    if migrated_before(source) and not overwrite_tags:
        raise MigrationError("the source was migrated before; pass overwrite_tags to go on")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    exists = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    before = 0
    pending = source
    if exists:
        if not resume:
            raise MigrationError(f"{target} exists")
        done = spark.read.parquet(target).select("id").distinct()
        before = done.count()
        pending = source.join(done, "id", "left_anti")
    transformed(pending, mapping, source_name).write.mode("append").parquet(target)
    total = spark.read.parquet(target).count()
    return spark.createDataFrame([(before, total - before, total, verdict)], "n_before long, n_written long, n_total long, verdict string")


def migrate_service(spark: SparkSession, source: dict, target: dict, mapping: Mapping, dry: bool = False, overwrite_tags: bool = False) -> DataFrame:
    """Move a collection of a vector service into another, and return the report (n_read, n_written, dimension, errors).

    source and target are options of sources.connectors.  What goes wrong is
    collected in errors instead of being raised.  dry only counts.
    """
    from meridian.sources import connectors

    n, written, dimension, errors = 0, 0, None, []
    try:
        rows = connectors.read(spark, **source)
        counted = dry_run(rows).first()
        n, dimension = counted["n"], counted["dimension"]
    except Exception as error:  # whatever a service's client raises
        errors.append(f"can't be read: {str(error).splitlines()[0]}")
    if not errors and not n:
        errors.append("no vectors in the source")
    if not errors and not dry:
        if migrated_before(rows) and not overwrite_tags:
            errors.append("the source was migrated before")
        else:
            try:
                connectors.write(transformed(rows, mapping, source.get("collection", "")), **target)
                written, dimension = connectors.open_service(target).count(), mapping.d_tgt
            except Exception as error:
                errors.append(f"can't be written: {str(error).splitlines()[0]}")
    return spark.createDataFrame([(n, written, dimension, errors)], "n_read long, n_written long, dimension int, errors array<string>")


def shadow(spark: SparkSession, source: DataFrame, root: str, mapping: Mapping, name: str = "shadow") -> str:
    """Write a new version beside the served one; readers follow current() after promote()."""
    target = f"{root.rstrip('/')}/{name}"
    transformed(source, mapping, root).write.mode("errorifexists").parquet(target)
    return target


_POINTER = "CURRENT"


def promote(spark: SparkSession, root: str, name: str, report: DataFrame | None = None) -> None:
    """Let readers follow ``name`` from now on, by one atomic rename; report: a gate report that must not FAIL."""
    if report is not None and report.first()["verdict"] == "FAIL":
        raise MigrationError("the gate failed: not promoted")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    target = fs.Path(f"{root.rstrip('/')}/{name}")
    if not target.getFileSystem(conf).exists(target):
        raise MigrationError(f"{name} isn't there")
    fresh, pointer = fs.Path(f"{root.rstrip('/')}/{_POINTER}.new"), fs.Path(f"{root.rstrip('/')}/{_POINTER}")
    out = fresh.getFileSystem(conf).create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    how = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE
    uri = pointer.getFileSystem(conf).makeQualified(pointer).toUri()
    fs.FileContext.getFileContext(uri, conf).rename(fresh, pointer, options)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that was promoted last."""
    rows = spark.read.text(f"{root.rstrip('/')}/{_POINTER}").collect()
    return spark.read.parquet(f"{root.rstrip('/')}/{rows[0]['value']}")


def integrity(df: DataFrame, size: int, id_col: str = "id") -> DataFrame:
    """(batch, n, hash): XOR of row hashes for each batch of ids in order; equal tables give equal hashes."""
    listed = numbered(df.select(id_col, "vec"), id_col).withColumn("batch", F.expr(f"position div {size}"))
    return listed.groupBy("batch").agg(F.count("*").alias("n"), F.hex(F.bit_xor(F.xxhash64(id_col, "vec"))).alias("hash"))


def sampled_overlap(source: DataFrame, target: DataFrame, n: int = 50, k: int = 10, size: int = 1000, every: int = 10) -> DataFrame:
    """(overlap): mean share of common neighbours, before and after, among the first n rows of every tenth batch of ids in order, and of the last."""
    listed = numbered(source.select("id", "vec"), "id")
    last = max(0, source.count() - 1) // size
    listed = listed.withColumn("batch", F.expr(f"position div {size}")).where(F.expr(f"position % {size} < {n}") & (F.expr(f"(batch + 1) % {every} = 0") | (F.col("batch") == last)))
    both = listed.join(target.select("id", F.col("vec").cast("array<double>").alias("after")), "id").select("batch", "position", F.col("vec").cast("array<double>").alias("vec"), "after")

    def shared(table: pa.Table) -> pa.Table:
        table = table.sort_by("position").combine_chunks()
        near = []
        for c in ("vec", "after"):
            m = normalized(matrix(table.column(c).combine_chunks()))
            near.append(np.argsort(-np.round(m @ m.T, 9), axis=1, kind="stable")[:, :k])
        common = [np.intersect1d(a, b).size / a.size for a, b in zip(*near)]
        return pa.table({"overlap": pa.array(common, pa.float64())})

    return both.groupBy("batch").applyInArrow(shared, "overlap double").agg(F.avg("overlap").alias("overlap"))


def preflight(pairs: DataFrame, mapped: str, target: str, **options) -> DataFrame:
    """The gate report to hand to migrate()."""
    return gate.evaluate(pairs, mapped, target, **options)
