"""Connectors, providers, shims, sending and records, by stand-ins."""

import asyncio
import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions import remote
from meridian.operators import analysis, calibration, gate, knn, linalg, mapping, migrate, monitor, protocol, serving
from meridian.sources import connectors, stores
from meridian.streaming import pipelines


def service(kind, root, collection="c", **more):
    return {"service": kind, "client": f"meridian.sources.fakes:{kind}", "root": str(root), "collection": collection, "batch": "7"} | more


@pytest.fixture(scope="module")
def rows(spark):
    data = [(str(k), [float(k), 1.0, -float(k % 3)], f"text {k}" if k % 4 else None, {"n": str(k)}) for k in range(60)]
    return spark.createDataFrame(data, stores.SCHEMA).repartition(5)


@pytest.mark.parametrize("kind", sorted(connectors.SERVICES))
def test_many_pages_are_read_in_parallel_and_upserts_repeat(spark, rows, tmp_path, kind):
    options = service(kind, tmp_path, pages="2")
    connectors.write(rows, **options)
    connectors.write(rows.where("cast(id as int) < 10"), **options)
    assert connectors.open_service(options).count() == 60
    back = connectors.read(spark, **options)
    assert back.rdd.getNumPartitions() > 1
    got = {r["id"]: (r["vec"], r["text"] or None, r["payload"]["n"]) for r in back.collect()}
    assert got == {str(k): ([float(k), 1.0, -float(k % 3)], f"text {k}" if k % 4 else None, str(k)) for k in range(60)}


def test_an_empty_collection_has_no_rows(spark, rows, tmp_path):
    options = service("chroma", tmp_path)
    connectors.write(rows, **options)
    none = service("chroma", tmp_path, "empty")
    connectors.open_service(none).ensure(3, "cosine")
    assert connectors.read(spark, **none).count() == 0


@pytest.mark.parametrize("options", [{"service": "other", "collection": "c"}, {"service": "qdrant"}, {"service": "qdrant", "collection": "c"}, {"service": "chroma", "collection": "c"}, {"service": "pinecone", "index": "i"}])
def test_what_cannot_be_opened_says_so(options):
    with pytest.raises(connectors.ServiceError):
        connectors.open_service(options)


def test_the_metric_and_name_of_a_target():
    assert [stores.target_metric(d) for d in ("cosine", "Cosine", None, "Dot", "Euclid")] == ["cosine", "cosine", "cosine", "euclid", "euclid"]
    assert connectors.migrated_name("docs") == "docs_migrated"


def test_promotion_needs_a_version_that_passed(spark, rows, tmp_path):
    m = mapping.Mapping("procrustes", np.eye(3), np.eye(3))
    root = str(tmp_path / "v")
    migrate.shadow(spark, rows, root, m, "a")
    with pytest.raises(migrate.MigrationError):
        migrate.promote(spark, root, "absent")
    with pytest.raises(migrate.MigrationError):
        migrate.promote(spark, root, "a", spark.createDataFrame([("FAIL",)], "verdict string"))
    migrate.promote(spark, root, "a", spark.createDataFrame([("PASS",)], "verdict string"))
    assert migrate.current(spark, root).count() == 60


# --- providers


class Fake:
    """Clients of all providers: v = [length of the text, place in its batch]."""

    def __init__(self):
        self.embeddings = self
        self.sizes = []

    def _rows(self, texts):
        self.sizes.append(len(texts))
        return [[float(len(t)), float(k)] for k, t in enumerate(texts)]

    def create(self, model, input, dimensions=None):  # noqa: A002
        return SimpleNamespace(data=[SimpleNamespace(index=k, embedding=v) for k, v in reversed(list(enumerate(self._rows(input))))], usage=SimpleNamespace(total_tokens=7), model=model)

    def embed(self, texts, model=None, input_type=None, embedding_types=None):
        rows = self._rows(texts)
        self.kind = input_type
        return SimpleNamespace(embeddings=SimpleNamespace(float=rows) if embedding_types else rows)

    def embed_content(self, model, content):
        return {"embedding": self._rows([content])[0]}

    def encode(self, texts, convert_to_numpy=True):
        return np.array(self._rows(texts))

    def feature_extraction(self, text, model):
        return self._rows([text])[0]


@pytest.mark.parametrize(("model", "batch"), [("openai:x", 128), ("cohere:y", 96), ("voyage:z", 128), ("gemini:g", 64), ("some/local-model", 1024), ("huggingface:h", 32)])
def test_each_provider_by_its_own_call(spark, model, batch):
    fake = Fake()
    own = remote.embedder(model, client=lambda: fake)
    assert (own.dims, own.batch) == (2, batch)
    assert own.embed(["a", "bbb"])[:, 0].tolist() == [1, 3] and own.embed([]).shape == (0, 0)
    if model.startswith("cohere"):
        assert fake.kind == "search_document"


def test_known_dimensions_are_not_asked_for():
    def never():
        raise AssertionError("no client is needed")

    assert [remote.embedder(m, client=never).dims for m in ("text-embedding-3-large", "openai:text-embedding-3-small", "embed-english-v3.0")] == [3072, 1536, 1024]


def test_without_library_or_key(monkeypatch):
    for model in ("openai:x", "cohere:x", "voyage:x", "gemini:x", "plain-model"):
        with pytest.raises(remote.ProviderError):
            remote.embedder(model)
    with pytest.raises(remote.ProviderError):
        remote.with_cache(remote.embedder("openai:x", client=Fake), None)


def test_routing_agrees_with_the_column(spark):
    from meridian.functions import providers

    ids = ["openai:a", "text-embedding-3-small", "Voyage-2", "my-cohere", "embed-v4", "models/x", "gemini:e", "intfloat/e5", "x-gemini"]
    got = spark.createDataFrame([(i,) for i in ids], "m string").select("m", providers.provider_of(F.col("m")).alias("p"), providers.model_name(F.col("m")).alias("n")).collect()
    assert {r["m"]: (r["p"], r["n"]) for r in got} == {i: remote.route(i) for i in ids}


def test_a_cache_is_wrapped_once(tmp_path):
    own = remote.create_embedder("openai:x", str(tmp_path), client=Fake, dims=2)
    assert remote.with_cache(own, str(tmp_path)) is own and not isinstance(remote.create_embedder("openai:x", cached=False, client=Fake, dims=2), remote.CachedEmbedder)


# --- shims


@pytest.fixture(scope="module")
def turned():
    w = np.linalg.qr(np.random.default_rng(0).normal(size=(2, 2)))[0]
    return mapping.Mapping("procrustes", w, w.T)


def test_responses_are_mapped_and_the_rest_passes_through(turned):
    fake = Fake()
    fake.models = "kept"
    for direction, w in (("new_to_old", turned.inverse), ("old_to_new", turned.weights)):
        shim = serving.ResponseShim(fake, turned, direction)
        r = shim.embeddings.create(input=["aa", "b"], model="m")
        want = np.array([[1.0, 1.0], [2.0, 0.0]]) @ w
        assert np.allclose([d.embedding for d in r.data], want / np.linalg.norm(want, axis=1, keepdims=True))
        assert r.usage.total_tokens == 7 and r.model == "m" and shim.models == "kept"
    with pytest.raises(ValueError):
        serving.ResponseShim(fake, turned, "sideways")


def test_directions_async_and_configuration(turned):
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    back, forth = serving.QueryEmbedder(embed, turned), serving.QueryEmbedder(embed, turned, True, "old_to_new")
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    assert np.allclose(back.embed_query("abc"), unit(np.array([3.0, 1.0]) @ turned.inverse)) and np.allclose(forth.embed_documents(["abc"])[0], unit(np.array([3.0, 1.0]) @ turned.weights))
    assert asyncio.run(back.aembed_query("abc")) == back.embed_query("abc") and asyncio.run(forth.aembed_documents(["a"])) == forth.embed_documents(["a"])
    with pytest.raises(mapping.MappingError):
        asyncio.run(back.aembed_documents(["a"]))
    again = serving.QueryEmbedder.from_config(forth.config(), embed, turned)
    assert again.config() == forth.config()
    with pytest.raises(mapping.MappingError):
        serving.QueryEmbedder.from_config(forth.config(), embed, mapping.Mapping("procrustes", np.eye(2), np.eye(2)))


# --- messages


@pytest.mark.parametrize("limit", [protocol.WEIGHT_BYTES, 0])
def test_transfers_are_products_either_way(spark, limit):
    rng = np.random.default_rng(1)
    weights = {("a", "b"): rng.normal(size=(3, 4)), ("a", "c"): rng.normal(size=(3, 2))}
    models = spark.createDataFrame([(s, t, "2099-01-01", 0.9, w.tolist()) for (s, t), w in weights.items()], "source string, target string, v string, quality double, weights array<array<double>>").select("source", "target", F.col("v").cast("timestamp").alias("valid_until"), "quality", "weights")
    data = [(k, "a", "bc"[k % 2] if k % 5 else "z", rng.normal(size=3).tolist()) for k in range(40)]
    out = protocol.transfer(spark.createDataFrame(data, "n int, source string, target string, vec array<double>"), models, weight_bytes=limit).collect()
    assert len(out) == 40
    for r in out:
        _, _, target, v = data[r["n"]]
        if target == "z":
            assert r["transferred"] is None and r["method"] == "text" and r["error"] == "not calibrated"
        else:
            assert np.allclose(r["transferred"], v @ weights["a", target]) and r["method"] == "vector"


def test_batches_keep_their_order(spark):
    agents = spark.createDataFrame([("a", True), ("b", True)], "agent string, supports boolean")
    models = spark.createDataFrame([("a", "b", "2099-01-01", 0.9, [[1.0]])], "source string, target string, v string, quality double, weights array<array<double>>").select("source", "target", F.col("v").cast("timestamp").alias("valid_until"), "quality", "weights")
    m = spark.createDataFrame([(k, "a", "b" if k % 2 else "x", f"t{k}", [float(k)]) for k in range(30)], "position int, source string, target string, text string, vec array<double>").repartition(4)
    got = protocol.batch_send(m, agents, models).collect()
    assert [r["position"] for r in got] == list(range(30))
    assert all((r["method"], r["language"]) == (("vector", None) if k % 2 else ("text", "en")) for k, r in enumerate(got))
    assert got[0]["reason"] == "agent 2 doesn't support vectors"


def test_agents_by_what_they_can_do(spark):
    class Thing:
        def embed(self, text):
            return [1.0]

    assert not protocol.is_agent(Thing())
    with pytest.raises(protocol.ProtocolError):
        protocol.enable_for(Thing(), transfer_to=lambda *a: None)
    assert protocol.is_agent(protocol.enable_for(Thing(), calibrate_with=lambda *a: None, transfer_to=lambda *a: None))
    models = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "a")], "source string, target string")
    assert protocol.capabilities(models, "a", 8, "m").first().asDict() == {"agent": "a", "model": "m", "dims": 8, "n_partners": 2, "partners": ["b", "c"]}


# --- records


def test_telemetry_is_opted_into_and_keeps_no_texts(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("MERIDIAN_TELEMETRY", raising=False)
    e = spark.createDataFrame([(1.0, "query", "shim")], "ts double, event string, wrapper string")
    folder = str(tmp_path / "t")
    assert not pipelines.append_telemetry(e, folder)
    monkeypatch.setenv("MERIDIAN_TELEMETRY", "1")
    assert pipelines.append_telemetry(e, folder) and pipelines.append_telemetry(e, folder)
    assert spark.read.json(folder).count() == 2
    with pytest.raises(ValueError):
        pipelines.append_telemetry(e.withColumn("text", F.lit("x")), folder)


def test_monitor_exports_one_document(spark, tmp_path):
    e = spark.createDataFrame([("transfer", "a", "b", 5.0, 0.9, 10, 0.1, 1), ("error", "a", None, None, None, None, None, 1)], "event_type string, agent string, partner string, duration_ms double, quality double, tokens long, cost double, batch_size int").withColumn("ts", F.current_timestamp())
    own = monitor.Monitor(spark, str(tmp_path / "m"), "standard")
    assert own.record(e)
    doc = json.loads(own.export().first()["json"])
    assert doc["stats"]["errors"] == 1 and {a["agent"] for a in doc["agents"]} == {"a", "b"} and doc["pairs"][0]["median"] == 0.9 and len(doc["recent"]) == 2
    own.disable()
    assert not own.record(e)


def test_upper_median_of_pairs(spark):
    rows = [("a", "b", q) for q in (0.1, 0.2, 0.7, 0.9)] + [("a", "c", q) for q in (0.5, 0.1, 0.3)]
    got = monitor.pair_quality(spark.createDataFrame(rows, "agent string, partner string, quality double")).collect()
    assert {r["partner"]: r["median"] for r in got} == {"b": 0.7, "c": 0.3}


def test_breakers_hold_one_batch_at_a_time(spark):
    """Long histories, cut over Arrow batches, go on where they stopped."""
    rng = np.random.default_rng(3)
    rows = [(int(s), int(k) * 7, bool(rng.random() < 0.5), k) for s in range(3) for k in range(400)]
    calls = spark.createDataFrame(rows, "source long, t long, ok boolean, seq int").select("source", F.timestamp_seconds("t").alias("ts"), "ok", "seq")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {(r["source"], r["ts"]): (r["allowed"], r["state"], r["failures"]) for r in pipelines.breaker_states(calls).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    times = {(r["source"], r["seq"]): r["ts"] for r in calls.collect()}
    for s in range(3):
        own = pipelines.Breaker()
        for source, t, ok, k in rows:
            if source == s:
                assert got[s, times[s, k]] == (own.call(t * 1000, ok), own.state, own.failures)


# --- models and thresholds


def test_gate_models_and_thresholds_from_files(tmp_path):
    model = gate.GateModel([0.1, 0.9], [0.2, 0.8], 0.05)
    model.save(str(tmp_path / "g.json"))
    assert gate.GateModel.load(str(tmp_path / "g.json")) == model and gate.GateModel.load(None) == gate.GateModel() == gate.GateModel.load(str(tmp_path / "none"))
    (tmp_path / "t.json").write_text(json.dumps({"pass_retention": 0.9}))
    assert gate.load_thresholds(str(tmp_path / "t.json"), warn_retention=0.5) == gate.THRESHOLDS | {"pass_retention": 0.9, "warn_retention": 0.5}
    with pytest.raises(ValueError):
        gate.load_thresholds(None, nonsense=1)


def test_training_the_gate_and_its_keys(spark):
    runs = spark.createDataFrame([(p, 0.8 + 0.02 * k, 0.6 + 0.02 * k + (0.01 if p == "a" else 0)) for p in "abc" for k in range(8)], "pair string, top1 double, retention double")
    model = analysis.train_gate(runs)
    assert all(np.diff(model.ys) >= 0) and 0 <= model.half_width < 0.05
    assert spark.createDataFrame([("r", None, 3)], "a string, b string, c int").select(analysis.pair_key("a", "b", "c").alias("k")).first()["k"] == "r::unknown::3"


def test_frozen_corpus_and_manifest(spark, tmp_path):
    import hashlib

    texts = [r["text"] for r in calibration.frozen(spark).orderBy("id").collect()]
    assert len(texts) == 20 == len(set(texts)) == calibration.builtin(spark).count()
    m = calibration.manifest(calibration.frozen(spark)).first()
    want = hashlib.sha256((calibration.FROZEN_ID + "\n" + "".join(t + "\0" for t in texts)).encode()).hexdigest()
    assert (m["corpus_id"], m["k"], m["checksum"]) == (calibration.FROZEN_ID, 20, want)
    (tmp_path / "c.json").write_text(json.dumps({"corpus_id": calibration.FROZEN_ID, "texts": ["a", "b"]}))
    assert calibration.frozen(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "d.json").write_text(json.dumps({"corpus_id": "other", "texts": []}))
    with pytest.raises(ValueError):
        calibration.frozen(spark, str(tmp_path / "d.json"))


def test_samples_without_replacement_are_capped(spark):
    assert calibration.sample(spark.range(5), 9, replace=False).count() == 5 and calibration.sample(spark.range(5), 9).count() == 9


def test_maps_by_options(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6))
    y = x @ rng.normal(size=(6, 4))
    df = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, y array<double>")
    m = mapping.fit_with_holdout("ridge", df, 0.2, 1, alpha=1e-9, normalize_output=False)
    assert m.validation["top1_retention"] == 1 and np.allclose(m.apply(x), y, atol=1e-4) and not m.normalize_output
    assert mapping.fitters_for(3, 3) == list(mapping.FITTERS) and not any(n.startswith("procrustes") for n in mapping.fitters_for(3, 4))
    a, b = linalg.factors(y.T @ y, 2)
    assert np.allclose(a @ b, linalg.truncated(y.T @ y, 2))
    assert np.allclose(linalg.least_squares(x.T @ x, x.T @ y), np.linalg.lstsq(x, y, rcond=None)[0])
    mapping.register_mapping("mine")(lambda pairs, **o: "fitted")
    try:
        assert mapping.FITTERS["mine"](df) == "fitted"
    finally:
        del mapping.FITTERS["mine"]


@pytest.mark.parametrize("bad", [[(0, [1.0, 2.0], [1.0]), (1, [1.0], [1.0])], [(0, [1.0, float("nan")], [1.0])], [(0, None, [1.0])], [(0, [1.0], [float("inf")])], [(0, [], [1.0])], []])
def test_pairs_that_cannot_be_fitted(spark, bad):
    df = spark.createDataFrame(bad, "id long, x array<double>, y array<double>")
    for kind in ("ridge", "procrustes", "protocol"):
        with pytest.raises(mapping.MappingError):
            mapping.fit(kind, df)


def test_reranked_hits(spark):
    hits = spark.createDataFrame([(1, k, k, 1.0 / k) for k in range(1, 6)], "query_id long, rank int, id long, sim double")
    got = knn.rerank(hits, F.when(F.col("id") == 4, 2.0).otherwise(F.col("sim")), 2).orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in got] == [(1, 4), (2, 1)]


def test_store_metadata_on_another_path(spark, tmp_path, rows):
    stores.write_npy_store(rows, f"file://{tmp_path}/n")
    got = {r["id"]: (r["text"], r["payload"]) for r in stores.read_npy_store(spark, f"file://{tmp_path}/n").collect()}
    assert got["7"] == ("text 7", {"n": "7"}) and len(got) == 60
    with pytest.raises(FileExistsError):
        stores.write_npy_store(rows, f"file://{tmp_path}/n")


@pytest.mark.parametrize("kind", sorted(connectors.SERVICES))
def test_a_page_of_a_stand_in_reads_no_other_rows(tmp_path, kind, monkeypatch):
    from meridian.sources import fakes

    own = connectors.open_service(service(kind, tmp_path))
    own.ensure(1, "cosine")
    own.upsert([{"id": f"a{k:04}", "vec": [float(k)], "text": "t", "payload": {}} for k in range(500)])
    decoded = []
    real = fakes.json.loads
    monkeypatch.setattr(fakes.json, "loads", lambda s: decoded.append(s) or real(s))
    starts = list(own.starts(50))
    assert own.count() == 500 and len(starts) == 10 and not decoded
    assert [r[1] for r in own.page(starts[3], 50)] == [[float(k)] for k in range(150, 200)] and len(decoded) <= 100
