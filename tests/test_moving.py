"""Stores, migration, streams, calibration samples, providers and the protocol."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions import providers
from meridian.operators import calibration, migrate, monitor, protocol
from meridian.operators.mapping import Mapping
from meridian.sources import stores
from meridian.streaming import pipelines


def rotation(d=4):
    w = np.roll(np.eye(d), 1, axis=1)
    return Mapping("procrustes", w, w.T)


@pytest.fixture()
def store(spark):
    return stores.from_arrays(spark, np.arange(1, 41, dtype=float).reshape(10, 4), texts=[f"t{i}" for i in range(10)])


def test_migrate_counts_tags_and_maps(spark, store, tmp_path):
    report = migrate.migrate(spark, store, f"{tmp_path}/t", rotation(), "old").first()
    assert (report["n_before"], report["n_written"], report["n_total"]) == (0, 10, 10)
    rows = {r["id"]: r for r in stores.read_parquet(spark, f"{tmp_path}/t").collect()}
    v = np.array([1.0, 2, 3, 4])
    assert np.allclose(rows["0"]["vec"], np.roll(v, 1) / np.linalg.norm(v))
    assert rows["3"]["payload"]["migrated_from"] == "old" and rows["3"]["text"] == "t3"


def test_migration_resumes_by_id(spark, store, tmp_path):
    target = f"{tmp_path}/t"
    migrate.migrate(spark, store.where("cast(id as int) < 4"), target, rotation())
    again = migrate.migrate(spark, store, target, rotation()).first()
    assert (again["n_before"], again["n_written"], again["n_total"]) == (4, 6, 10)
    assert spark.read.parquet(target).select("id").distinct().count() == 10
    assert migrate.migrate(spark, store, target, rotation()).first()["n_written"] == 0
    with pytest.raises(migrate.MigrationError):
        migrate.migrate(spark, store, target, rotation(), resume=False)


def test_double_migration_and_failed_gate_are_refused(spark, store, tmp_path):
    done = migrate.transformed(store, rotation(), "old")
    with pytest.raises(migrate.MigrationError, match="before"):
        migrate.migrate(spark, done, f"{tmp_path}/t", rotation())
    bad = spark.createDataFrame([("FAIL",)], "verdict string")
    with pytest.raises(migrate.MigrationError, match="gate"):
        migrate.migrate(spark, store, f"{tmp_path}/t", rotation(), preflight=bad)


def test_stream_equals_batch(spark, store, tmp_path):
    store.write.parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema(stores.SCHEMA).parquet(f"{tmp_path}/s")
    pipelines.migrate_stream(stream, rotation(), f"{tmp_path}/t", f"{tmp_path}/c", "old").awaitTermination()
    pipelines.migrate_stream(stream, rotation(), f"{tmp_path}/t", f"{tmp_path}/c", "old").awaitTermination()
    got = sorted((r["id"], tuple(r["vec"])) for r in spark.read.parquet(f"{tmp_path}/t").collect())
    assert got == sorted((r["id"], tuple(r["vec"])) for r in migrate.transformed(store, rotation(), "old").collect())


def test_numpy_folder_round_trip(spark, store, tmp_path):
    assert stores.write_npy_store(store, f"{tmp_path}/n") == 10
    assert json.loads((tmp_path / "n/manifest.json").read_text())["count"] == 10
    key = lambda df: sorted((r["id"], tuple(r["vec"]), r["text"]) for r in df.collect())
    assert key(stores.read_npy_store(spark, f"{tmp_path}/n")) == key(store)
    (tmp_path / "n/meta.jsonl").unlink()
    assert {r["id"] for r in stores.read_npy_store(spark, f"{tmp_path}/n").collect()} == {str(i) for i in range(10)}


def test_upsert_replaces_by_id(spark, store):
    new = stores.from_arrays(spark, np.zeros((2, 4)), ["9", "10"])
    got = {r["id"]: r["vec"] for r in stores.upsert(store, new).collect()}
    assert len(got) == 11 and got["9"] == [0.0] * 4 and got["0"] == [1.0, 2.0, 3.0, 4.0]


def test_sources(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a\n\n  b \n")
    assert sorted(r["text"] for r in stores.read_lines(spark, f"{tmp_path}/l.txt").collect()) == ["a", "b"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text('{"a": {"b": 1}, "c": 2}')
    (tmp_path / "r/b.json").write_text("not json")
    got = stores.flatten(stores.read_results(spark, f"{tmp_path}/r"))
    assert set(got.columns) == {"a.b", "c"} and got.count() == 1
    with pytest.raises(LookupError):
        stores.open_store("pinecone")
    docs = spark.createDataFrame([("1", " x ", "y")], "id string, title string, text string")
    q = spark.createDataFrame([("q", "t"), ("r", "t")], "id string, text string")
    rel = spark.createDataFrame([("q", "1", 1), ("r", "1", 0)], "query_id string, doc_id string, relevance int")
    _, queries, judged = stores.read_retrieval(docs, q, rel)
    assert [r["id"] for r in queries.collect()] == ["q"] and judged.count() == 1
    with pytest.raises(ValueError):
        stores.read_retrieval(docs, q, rel.where("relevance > 5"))


def test_samples(spark):
    df = spark.range(50)
    a = {r["id"] for r in calibration.sample(df, 20, 3).collect()}
    assert len(a) == 20 and a == {r["id"] for r in calibration.sample(df.repartition(5), 20, 3).collect()}
    assert a != {r["id"] for r in calibration.sample(df, 20, 4).collect()}
    assert calibration.sample(df, 120, 3).count() == 120
    with pytest.raises(ValueError):
        calibration.sample(df.where("false"), 3)
    assert calibration.holdout(df, 0.1, 1).where("is_holdout").count() == 5
    assert calibration.holdout(df.limit(11), 0.1, 1).where("is_holdout").count() == 2
    assert calibration.disjoint(df, calibration.sample(df, 20, 3)).count() == 30


def test_checksums_see_order_and_content(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    swapped = spark.createDataFrame([(1, "b"), (2, "a")], "id long, text string")
    one = lambda d: calibration.corpus_checksum(d).first()["checksum"]
    assert one(df) == one(df.repartition(3)) != one(swapped)
    table = lambda d: calibration.table_checksum(d, "id", "text").first()["checksum"]
    assert table(df) == table(df.repartition(3)) != table(swapped)


def test_embedder_batches_and_refuses_other_sizes(spark):
    e = providers.Embedder("own", 3, lambda ts: np.array([[len(t), 0, 1] for t in ts]), batch=2)
    df = spark.createDataFrame([("a",), ("bbb",), (None,)], "text string").coalesce(1)
    assert [r["v"] for r in df.select(e.column(F.col("text")).alias("v")).collect()] == [[1, 0, 1], [3, 0, 1], [0, 0, 1]]
    wrong = providers.Embedder("own", 4, lambda ts: np.zeros((len(ts), 3)))
    with pytest.raises(Exception, match="dimensions"):
        df.select(wrong.column(F.col("text")).alias("v")).collect()


def test_cache_embeds_each_text_once(spark):
    texts = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    embed = lambda t: providers.md5_mod(t, 4)
    first, new = providers.embed_cached(texts, None, embed, "m")
    assert new.count() == 2 and first.count() == 3
    s = providers.cache_stats(providers.embed_cached(texts.union(texts), new, embed, "m")[0]).first()
    assert (s["hits"], s["misses"]) == (6, 0)
    other = providers.cache_stats(providers.embed_cached(texts, new, embed, "other model")[0]).first()
    assert (other["hits"], other["misses"], other["distinct_misses"]) == (0, 3, 2)
    assert providers.cache_folder("/c", "a/b") != providers.cache_folder("/c", "a/c")


def test_mock_embedders_are_unit_or_padded(spark):
    df = spark.createDataFrame([("hello",), ("",)], "text string")
    rows = df.select(providers.sincode(F.col("text"), 8).alias("s"), providers.lcg(F.col("text"), 8).alias("l"), providers.charcode(F.col("text"), 8).alias("c")).collect()
    want = np.array([np.sin(ord(c) * i) for i, c in enumerate("hello")] + [0, 0, 0])
    assert np.allclose(rows[0]["s"], want / np.linalg.norm(want)) and rows[1]["s"] == [0.0] * 8
    assert np.linalg.norm(rows[0]["l"]) == pytest.approx(1) and rows[0]["c"][5:] == [0.0] * 3


def test_registry():
    r = providers.Registry()
    r.register("a", lambda: 1)
    with pytest.raises(ValueError):
        r.register("a", lambda: 2)
    r.register("a", lambda: 2, override=True)
    assert r.create("a") == 2 and r.list() == ["a"] and r.has("a")
    with pytest.raises(KeyError):
        r.get("b")
    assert r.unregister("a") and not r.unregister("a")


def test_breaker_opens_and_recovers():
    b = pipelines.Breaker()
    assert all(b.call(t, False) for t in range(5)) and b.state == "OPEN"
    assert not b.call(1000, True)
    assert b.call(70_000, True) and b.state == "CLOSED" and b.failures == 0
    for t in range(5):
        b.call(80_000 + t, False)
    assert b.call(200_000, False) and b.state == "OPEN" and not b.call(200_001, True)


def test_breaker_stream_equals_batch(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    rows = [(s, at + dt.timedelta(seconds=20 * k), bool((k + s) % 7 == 0), k) for s in range(3) for k in range(20)]
    calls = spark.createDataFrame(rows, "source long, ts timestamp, ok boolean, seq long")
    for part in range(2):
        calls.where(f"seq div 10 = {part}").coalesce(1).write.parquet(f"{tmp_path}/p{part}")
    batch = sorted(map(tuple, pipelines.breaker_states(calls).collect()))
    (tmp_path / "in").mkdir()
    out = []
    for part in range(2):
        for f in (tmp_path / f"p{part}").glob("*.parquet"):
            f.rename(tmp_path / f"in/{part}-{f.name}")
        stream = pipelines.breaker_stream(spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/in"))
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    out = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert out == batch


def test_windows_and_sessions_of_a_table(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [(1, at + dt.timedelta(minutes=m), "a", 1.0) for m in (0, 10, 70, 75, 200)]
    e = spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string, value double")
    assert sorted(r["n"] for r in pipelines.windowed_counts(e).collect()) == [1, 2, 2]
    assert sorted(r["n"] for r in pipelines.sessions(e, "user_id").collect()) == [1, 2, 2]


def test_telemetry_stream(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text('{"ts": 1.5, "event": "x", "wrapper": "w"}\n{"ts": 2, "event": "y"}\n')
    q = pipelines.telemetry_stream(spark, f"{tmp_path}/t").writeStream.format("memory").queryName("telemetry").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = {r["wrapper"]: r["n"] for r in monitor.telemetry_summary(spark.table("telemetry")).collect()}
    assert rows == {"w": 1, "unknown": 1, None: 2}


def test_transfer_falls_back_to_text(spark):
    models = spark.createDataFrame([("a", "b", dt.datetime(2030, 1, 1), 0.9, [[2.0, 0.0], [0.0, 3.0]]), ("a", "c", dt.datetime(2020, 1, 1), 0.9, [[1.0, 0.0], [0.0, 1.0]])], "source string, target string, valid_until timestamp, quality double, weights array<array<double>>")
    messages = spark.createDataFrame([("a", t, [1.0, 2.0]) for t in "bcd"], "source string, target string, vec array<double>")
    now = F.lit("2026-01-01").cast("timestamp")
    rows = {r["target"]: r for r in protocol.transfer(messages, models, now).collect()}
    assert rows["b"]["transferred"] == [2.0, 6.0] and rows["b"]["method"] == "vector"
    assert rows["c"]["error"] == "matrix expired" and rows["d"]["error"] == "not calibrated" and rows["d"]["method"] == "text"
    opened = models.where("target = 'b'").select("source", "target")
    assert {r["error"] for r in protocol.transfer(messages.where("target = 'b'"), models, now, opened).collect()} == {"circuit open"}


def test_poor_calibration_is_an_error(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist(), rng.normal(size=2).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<double>")
    with pytest.raises(protocol.CalibrationFailed):
        protocol.calibrate(spark, df, df, "a", "b", 0.95)


def test_retry_backs_off():
    waits, left = [], [3]

    def act():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError
        return "done"

    assert protocol.retry(act, jitter=False, sleep=waits.append) == "done" and waits == [1.0, 2.0, 4.0]
    with pytest.raises(ZeroDivisionError):
        protocol.retry(lambda: 1 / 0, retries=1, sleep=lambda _: None)


def test_durations(spark):
    df = spark.createDataFrame([(5_000,), (125_000,), (7_320_000,)], "ms long")
    assert [r["t"] for r in df.select(monitor.duration_text(F.col("ms")).alias("t")).collect()] == ["5s", "2m 5s", "2h 2m"]


def test_numpy_export_sends_no_rows_to_the_driver(spark, tmp_path, monkeypatch):
    """Bytes of all values, line breaks among them, come back in order over several chunks and splits; nothing is iterated on the driver."""
    from pyspark.sql import DataFrame

    def refused(*_, **__):
        raise AssertionError("rows sent to the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    monkeypatch.setattr(stores, "EXPORT_ROWS", 7)
    rows = [(f"{k:03d}", [float.fromhex("0x1.0a0a0a0a0a0a0p+3"), -k / 3, 2.0**-k], f"a\nb\r{k} ", {"k": str(k)}) for k in range(100)]
    store = spark.createDataFrame(rows, stores.SCHEMA).repartition(5)
    assert stores.write_npy_store(store, f"{tmp_path}/n") == 100
    assert np.load(f"{tmp_path}/n/vectors.npy").tolist() == [r[1] for r in rows]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = stores.read_npy_store(spark, f"{tmp_path}/n").orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["id"], r["vec"], r["text"], r["payload"]) for r in got] == rows


def test_numpy_files_of_either_order(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "f.npy", np.asfortranarray(m))
    assert [r["vec"] for r in stores.read_npy(spark, f"{tmp_path}/f.npy").orderBy("position").collect()] == m.tolist()
