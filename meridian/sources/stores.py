"""Vector stores: Parquet tables, numpy folders, and the registry of store kinds.

A store row is (id string, vec array<double>, text string, payload map<string,string>).
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions.providers import Registry
from meridian.plans.materialize import discard, materialize, shared_dir
from meridian.plans.numbering import numbered

SCHEMA = "id string, vec array<double>, text string, payload map<string,string>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_new(df: DataFrame, path: str) -> None:
    """Atomic, and never over an existing store."""
    df.write.mode("errorifexists").parquet(path)


def from_arrays(spark: SparkSession, vectors: np.ndarray, ids: list[str] | None = None, texts: list[str] | None = None) -> DataFrame:
    """A store of a matrix; ids default to row numbers."""
    n = len(vectors)
    if (ids is not None and len(ids) != n) or (texts is not None and len(texts) != n):
        raise ValueError("as many ids and texts as vectors")
    rows = [(str(i) if ids is None else str(ids[i]), [float(x) for x in vectors[i]], None if texts is None else texts[i], {}) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def upsert(target: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """The target with rows put in by id; the new ones win."""
    return target.join(rows.select(id_col), id_col, "left_anti").unionByName(rows)


def _array(content: pa.Buffer) -> np.ndarray:
    """The array of an .npy file's bytes, without a copy of them."""
    head = io.BytesIO(content.slice(0, min(content.size, 1 << 16)).to_pybytes())
    version = np.lib.format.read_magic(head)
    if version not in ((1, 0), (2, 0)):
        return np.load(io.BytesIO(content.to_pybytes()))
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if kind.hasobject:
        raise ValueError("an .npy file of objects isn't read")
    return np.frombuffer(content, kind, int(np.prod(shape)), head.tell()).reshape(shape, order="F" if fortran else "C")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, vec) of .npy matrices, decoded on the executors; a file is one value there, so it is within 2 GB."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns):
                m = _array(content.as_buffer())
                for at in range(0, len(m), 4096):
                    part = m[at : at + 4096].astype(float)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part)), pa.array(np.arange(at, at + len(part))), lists], ["file", "position", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "file string, position long, vec array<double>")


def read_npy_store(spark: SparkSession, folder: str) -> DataFrame:
    """A numpy folder (vectors.npy, meta.jsonl) as a store; metadata joins by position, a missing row's is empty.

    A line's position is its place in its split of the file, whose rows have
    consecutive ids, after the lines of the splits before.
    """
    vectors = read_npy(spark, f"{folder}/vectors.npy")
    meta_path = f"{folder}/meta.jsonl"
    if not exists(spark, meta_path):
        return vectors.select(F.col("position").cast("string").alias("id"), "vec", F.lit(None).cast("string").alias("text"), F.create_map().cast("map<string,string>").alias("payload"))
    lines = spark.read.option("lineSep", "\n").text(meta_path).select("value", F.col("_metadata.file_block_start").alias("start")).where(F.trim("value") != "")
    found = materialize(lines.select("start", F.monotonically_increasing_id().alias("at"), F.from_json("value", "id string, text string, payload map<string,string>").alias("m")), "lines")
    splits = found.groupBy("start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = splits.select("start", "first", F.coalesce(F.sum("n").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    meta = found.join(F.broadcast(before), "start").select((F.col("at") - F.col("first") + F.col("before")).alias("position"), "m")
    return vectors.join(meta, "position", "left").select(F.coalesce("m.id", F.col("position").cast("string")).alias("id"), "vec", "m.text", F.coalesce("m.payload", F.create_map().cast("map<string,string>")).alias("payload"))


#: Rows of an export that are one value.
EXPORT_ROWS = 1024


def _append(spark: SparkSession, chunks: DataFrame, column: str, out, size: int | None = None) -> None:
    """Append a column, in the order of chunks, to an open file: executors write it as text, whose files are copied from stream to stream.

    size: bytes of all values but the last, which then come without line breaks.
    """
    jvm = spark.sparkContext._jvm
    path = f"{shared_dir(spark)}/{column}-{uuid.uuid4().hex}"
    chunks.select("chunk", F.col(column).cast("string").alias("value")).repartitionByRange("chunk").sortWithinPartitions("chunk").select("value").write.option("compression", "none").option("lineSep", "\n").text(path)
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in sorted((x for x in fs.listStatus(root) if x.getPath().getName().startswith("part-")), key=lambda x: x.getPath().getName()):
        left, source = status.getLen(), fs.open(status.getPath())
        while left:
            take = left if size is None else min(size, left - 1)
            jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, take)
            left -= take
            if size is not None:
                source.read()
                left -= 1
        source.close()
    discard(spark, [path])


def write_npy_store(df: DataFrame, folder: str) -> int:
    """Export a store to a numpy folder, on any file system that Spark writes to; returns the number of rows.

    For hand-over to single-machine tools, which take one matrix: its parts are
    written by the executors, and one process copies them into one file by
    streams, so that no rows are sent to the driver.  Stores of a cluster stay
    Parquet.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    if fs.exists(root):
        raise FileExistsError(folder)
    listed = materialize(numbered(df.select("id", F.col("vec").cast("array<double>").alias("vec"), "text", "payload"), "id"), "export")
    shape = listed.agg(F.count("*").alias("n"), F.count("vec").alias("given"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("d"), F.max("id").alias("last")).first()
    n, dims = shape["n"], shape["d"] or 0
    if shape["given"] != n or shape["least"] != shape["d"]:
        raise ValueError("vectors differ in their dimension, or are null")

    def pack(table: pa.Table) -> pa.Table:
        part = table.sort_by("position").combine_chunks()
        cells = np.concatenate([c.flatten().to_numpy() for c in part.column("vec").chunks]).astype("<f8").tobytes()
        lines = [json.dumps({"id": i, "text": t, "payload": dict(p or {})}, ensure_ascii=False) for i, t, p in zip(*(part.column(c).to_pylist() for c in ("id", "text", "payload")))]
        return pa.table({"chunk": part.column("chunk").slice(0, 1), "cells": pa.array([cells], pa.binary()), "lines": pa.array(["\n".join(lines)])})

    chunks = materialize(listed.select(F.expr(f"cast(position div {EXPORT_ROWS} as long)").alias("chunk"), F.col("position").cast("long").alias("position"), "id", "vec", "text", "payload").groupBy("chunk").applyInArrow(pack, "chunk long, cells binary, lines string"), "chunks")
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": "<f8", "fortran_order": False, "shape": (n, dims)})
    vectors, meta = (fs.create(jvm.org.apache.hadoop.fs.Path(root, name)) for name in ("vectors.npy", "meta.jsonl"))
    vectors.write(head.getvalue())
    _append(spark, chunks, "cells", vectors, EXPORT_ROWS * dims * 8)
    _append(spark, chunks, "lines", meta)
    vectors.close()
    meta.close()
    manifest = fs.create(jvm.org.apache.hadoop.fs.Path(root, "manifest.json"))
    manifest.write(json.dumps({"count": n, "last_written_id": shape["last"]}).encode())
    manifest.close()
    return n


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text): trimmed lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> ''")


def read_retrieval(docs: DataFrame, queries: DataFrame, qrels: DataFrame, max_docs: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs (id, text), queries (id, text), qrels (query_id, doc_id)) of a retrieval benchmark.

    Title and text are joined; judgements above 0 count; queries without any are
    left out; a benchmark without judgements is an error.
    """
    judged = qrels.where("relevance > 0").select("query_id", "doc_id").distinct()
    if not judged.take(1):
        raise ValueError("no judgements, so nothing can be measured")
    text = F.trim(F.concat_ws(" ", "title", "text")) if "title" in docs.columns else F.trim("text")
    corpus = docs.select("id", text.alias("text"))
    corpus = corpus if max_docs is None else corpus.orderBy("id").limit(max_docs)
    return corpus, queries.join(judged.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi"), judged


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark result files of any vintage; what can't be parsed is skipped, missing fields are null."""
    found = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return found.drop("_corrupt_record")


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as columns of dotted names."""

    def leaves(schema, path: str) -> Iterator[tuple[str, Column]]:
        for f in schema.fields:
            name = f"{path}.{f.name}" if path else f.name
            if f.dataType.typeName() == "struct":
                yield from leaves(f.dataType, name)
            else:
                yield name, F.col(".".join(f"`{p}`" for p in name.split(".")))

    return df.select(*[c.alias(n) for n, c in leaves(df.schema, "")])


def benchmark_cache(root: str, source: str, target: str) -> str:
    """Where the embeddings of a pair of models lie: a folder by hash of both names."""
    return f"{root.rstrip('/')}/{hashlib.sha256(f'{source}|{target}'.encode()).hexdigest()[:10]}"


def write_benchmark(spark: SparkSession, root: str, source: str, target: str, vectors: DataFrame, prefix_version: int = 1) -> None:
    """Keep (kind, id, x, y) rows of a benchmark, kind document or query, with what they were made by."""
    made = [F.lit(v).alias(n) for n, v in (("source", source), ("target", target), ("prefix_version", prefix_version))]
    vectors.select("kind", "id", "x", "y", *made).write.mode("overwrite").partitionBy("kind").parquet(benchmark_cache(root, source, target))


def read_benchmark(spark: SparkSession, root: str, source: str, target: str, counts: dict[str, int], prefix_version: int = 1) -> DataFrame | None:
    """The kept rows, or None if there are none or they don't fit: other models, another prefix version, other counts."""
    path = benchmark_cache(root, source, target)
    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    fits = (F.col("source") == source) & (F.col("target") == target) & (F.col("prefix_version") == prefix_version)
    found = {r["kind"]: (r["n"], r["ok"]) for r in rows.groupBy("kind").agg(F.count("*").alias("n"), F.bool_and(fits).alias("ok")).collect()}
    return rows if found == {k: (n, True) for k, n in counts.items()} else None


def store_kind(name: Column) -> Column:
    """Which connector serves a store by its module or type name."""
    lower = F.lower(name)
    return F.when(F.contains(lower, F.lit("chroma")), "chroma").when(F.contains(lower, F.lit("qdrant")), "qdrant").when(F.contains(lower, F.lit("pinecone")), "pinecone").when(F.contains(lower, F.lit("numpy")), "numpy").otherwise("generic")


def target_metric(distance: str | None) -> str:
    """The metric of a prepared target: cosine stays, all else is Euclidean."""
    return "cosine" if (distance or "cosine").lower() == "cosine" else "euclid"


#: Store kind to (reader(spark, path), writer(df, path)); external databases are added by a deployment.
STORES = Registry()
STORES.register("parquet", lambda: (read_parquet, write_new))
STORES.register("numpy", lambda: (read_npy_store, write_npy_store))


def open_store(kind: str) -> tuple[Callable, Callable]:
    """Reader and writer of a kind; a kind without its client is an error that says so."""
    if not STORES.has(kind):
        raise LookupError(f"no connector for {kind} stores; register one with STORES.register")
    return STORES.create(kind)


def doctor(df: DataFrame, model: str | None = None, tag: str = "mapping_id") -> DataFrame:
    """(vector_count, dimension, n_dimensions, has_metadata, inferred_model, playbook) of a store."""
    name = F.lower(F.lit(model or "unknown"))
    play = F.when(F.contains(name, F.lit("ada")), "ada-002 to text-embedding-3-small").when(F.contains(name, F.lit("embed-v3")), "embed-v3 to embed-v4").when(F.contains(name, F.lit("voyage-2")), "voyage-2 to voyage-3")
    has = F.coalesce(F.bool_or(F.map_contains_key("payload", tag)), F.lit(False)) if "payload" in df.columns else F.lit(False)
    return df.agg(F.count("*").alias("vector_count"), F.max(F.size("vec")).alias("dimension"), F.count_distinct(F.size("vec")).alias("n_dimensions"), has.alias("has_metadata")).withColumn("inferred_model", F.lit(model or "unknown")).withColumn("playbook", play)
