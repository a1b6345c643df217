"""The query catalogue, fourth part: vector services, providers, messages, caches and records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions import providers, remote
from meridian.operators import analysis, calibration, knn, migrate, monitor, protocol
from meridian.plans.catalog import _fixed, _r, _text, _text_sql, query, r6
from meridian.plans.catalog_fits import _isotonic_sql
from meridian.plans.catalog_ops import _AGENTS, _EVENTS_SQL, _MIGRATED, _MSG, _RUNS_SQL, _events, _folder, _messages, _model_rows, _runs, _shown, _store
from meridian.plans.fixtures import PAIR, QUERY, pairs, sims_sql, split, table
from meridian.plans.materialize import materialize
from meridian.sources import connectors, stores

# --- vector services, by their stand-ins ---------------------------------------


def _service(kind: str, root: str, collection: str, batch: int = 256) -> dict[str, str]:
    return {"service": kind, "client": f"meridian.sources.fakes:{kind}", "root": root, "collection": collection, "batch": str(batch)}


def _kept(df: DataFrame) -> DataFrame:
    return df.select("id", _text(F.col("vec")).alias("vec"), "text", F.col("payload")["lang"].alias("lang"))


_KEPT = "select e.vec_id::VARCHAR as id, " + _text_sql("embedding::DOUBLE[]") + " as vec, {0} as text, coalesce(d.lang, '') as lang from embeddings e left join documents d on d.doc_id = e.vec_id"


def _service_queries(kind: str, text: str) -> None:
    @query(_KEPT.format(text), name=f"{kind}_roundtrip")
    def roundtrip(spark, sf):
        """A store written to a service and read back, page by page."""
        options = _service(kind, _folder(spark, kind), "source")
        connectors.write(_store(spark, sf), **options)
        return _kept(connectors.read(spark, **options))

    @query(_MIGRATED.replace("'embeddings' as migrated_from", "'source' as migrated_from"), name=f"{kind}_migrate")
    def moved(spark, sf):
        """From one collection to the next, through the map, tagged."""
        root = _folder(spark, kind)
        source, target = _service(kind, root, "source"), _service(kind, root, connectors.migrated_name("source"))
        connectors.write(_store(spark, sf), **source)
        report = migrate.migrate_service(spark, source, target, _fixed(spark)).first()
        if report["errors"]:
            raise RuntimeError("; ".join(report["errors"]))
        return _shown(connectors.read(spark, **target))


for _kind, _text_of in (("qdrant", "d.text"), ("chroma", "coalesce(d.text, '')"), ("pinecone", "d.text")):
    _service_queries(_kind, _text_of)


@query("select 'dry' as run, count(*) as n_read, 0::BIGINT as n_written, max(len(embedding))::INT as dimension, 0::INT as n_errors from embeddings union all select 'moved', count(*), count(*), max(len(embedding))::INT, 0 from embeddings union all select 'again', count(*), 0, max(len(embedding))::INT, 1 from embeddings union all select 'absent', 0, 0, null, 1")
def service_reports(spark, sf):
    """What a migration reports: a dry run, a run, a run from what was migrated already, and one from nowhere."""
    root = _folder(spark, "reports")
    source, target, third = (_service("qdrant", root, n) for n in ("source", "target", "third"))
    connectors.write(_store(spark, sf), **source)
    runs = [("dry", source, target, True), ("moved", source, target, False), ("again", target, third, False), ("absent", _service("qdrant", root, "nowhere"), third, False)]
    out = None
    for name, a, b, dry in runs:
        row = migrate.migrate_service(spark, a, b, _fixed(spark), dry).select(F.lit(name).alias("run"), "n_read", "n_written", "dimension", F.size("errors").alias("n_errors"))
        out = row if out is None else out.unionByName(row)
    return out


@query(_MIGRATED.replace("'embeddings' as migrated_from", "'new' as migrated_from"))
def shadow_promote(spark, sf):
    """Two versions beside each other; readers follow the one promoted last."""
    root = _folder(spark, "versions")
    store = _store(spark, sf)
    for name in ("first", "second"):
        migrate.shadow(spark, store if name == "second" else store.where("cast(id as long) % 2 = 0"), root, _fixed(spark), name)
        migrate.promote(spark, root, name)
    return _shown(migrate.current(spark, root)).withColumn("migrated_from", F.lit("new"))


# --- providers -----------------------------------------------------------------


class _Response:
    def __init__(self, vectors):
        self.data = [type("Item", (), {"index": k, "embedding": v})() for k, v in enumerate(vectors)][::-1]


class HashClient:
    """A client with the call of an API, whose vectors are those of providers.md5_mod()."""

    @property
    def embeddings(self):
        return self

    def create(self, model: str, input: list[str], dimensions: int = 8):  # noqa: A002 - the name that callers pass
        import hashlib

        return _Response([[(int(hashlib.md5(t.encode()).hexdigest(), 16) + i) % 1000 / 1000 for i in range(dimensions)] for t in input])


@query("with c as (select distinct text from documents where doc_id % 2 = 0) select d.doc_id, c.text is not null as cached, " + _text_sql("list_transform(range(8), lambda i: ((('0x' || substr(md5(d.text), 1, 8))::BIGINT % 1000 * 336 + ('0x' || substr(md5(d.text), 9, 8))::BIGINT % 1000 * 616 + ('0x' || substr(md5(d.text), 17, 8))::BIGINT % 1000 * 296 + ('0x' || substr(md5(d.text), 25, 8))::BIGINT % 1000 + i) % 1000) / 1000.0::DOUBLE)") + " as vec from documents d left join c on c.text = d.text")
def provider_cached(spark, sf):
    """A provider's embedder over a disk cache: half of the documents, then all."""
    own = remote.create_embedder("openai:trial-model", _folder(spark, "cache"), client=HashClient, dims=8)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    own.embed(docs.where("doc_id % 2 = 0"))
    return own.embed(docs).select("doc_id", "cached", _text(F.col("vec")).alias("vec"))


@query("select item_id, length(text) % 7 as bucket, count(*) over () as n from benchmark")
def provider_batches(spark, sf):
    """Batches of any size give each text its own vector."""
    own = providers.Embedder("sizes", 1, lambda texts: [[float(len(t) % 7)] for t in texts], batch=3)
    df = table(spark, sf, "benchmark").withColumn("vec", own.column(F.col("text")))
    return df.crossJoin(df.agg(F.count("*").alias("n"))).select("item_id", F.col("vec")[0].cast("int").alias("bucket"), "n")


# --- hits ------------------------------------------------------------------------


@query(f"with {PAIR}, {sims_sql('s', 'm', 't', QUERY)}, h as (select q, d, sim, {_r('sim * (1 + d % 5)')} as rerank_score from s where rank <= 20), k as (select *, row_number() over (partition by q order by sim * (1 + d % 5) desc, d) as rank from h) select q as query_id, rank::INT as rank, d as id, rerank_score from k where rank <= 10")
def rerank_top10(spark, sf):
    """The twenty nearest, ordered anew by a scorer of pairs."""
    q, c = split(pairs(spark, sf))
    hits = knn.topk(q, c, 20, ("id", "m"), ("id", "t"))
    out = knn.rerank(hits, F.col("sim") * (1 + F.col("id") % 5), 10)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "id", r6("rerank_score"))


# --- messages and records --------------------------------------------------------


@query(f"""with {_AGENTS}, {_MSG}, s as (select msg.*, m.source is not null and not m.expired as works, m.source as known, m.expired, msg.source <> 3 as s1, msg.target <> 3 as s2 from msg left join mod m on m.source = msg.source and m.target = msg.target)
select conv_id, turn, case when s1 and s2 and works then 'vector' else 'text' end as method, case when s1 and s2 and works then null when s1 and s2 and known is null then 'calibration error' when s1 and s2 and expired then 'calibration failed'
  when not s1 and not s2 then 'agent 1 and agent 2 don''t support vectors' when not s1 then 'agent 1 doesn''t support vectors' else 'agent 2 doesn''t support vectors' end as reason, case when not (s1 and s2 and works) then 'en' end as language from s""")
def negotiated_messages(spark, sf):
    """Each pair negotiates, then its messages go as vectors or as text; agent 3 takes text only."""
    agents = spark.range(5).select(F.col("id").alias("agent"), (F.col("id") != 3).alias("supports"))
    sent = protocol.send(_messages(spark, sf), agents, _model_rows(spark), now=F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return sent.select("conv_id", "turn", "method", "reason", "language")


@query("with n as (select (row_number() over (order by doc_id) - 1) // 100 as b from documents), g as (select b, count(*) as n from n group by b) select 'embed_batch' as event_type, 'writer' as agent, n::INT as batch_size, (n * 10)::BIGINT as tokens, " + _r("n * 10 * 0.02 / 1e6 * 1e6") + " as micro_usd, count(*) as events from g group by n")
def embed_events(spark, sf):
    """Embedding with the monitor's events and their cost."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    _, events = protocol.embed_with_events(docs, lambda t: providers.md5_mod(t, 4), "writer", "openai:text-embedding-3-small")
    return events.groupBy("event_type", "agent", "batch_size", "tokens").agg(r6(F.max("cost") * 1e6, "micro_usd"), F.count("*").alias("events"))


@query(f"with {_EVENTS_SQL} select concat_ws(' ', '[' || strftime(ts, '%H:%M:%S.%g') || ']', upper(event_type), 'agent=' || agent, 'partner=' || partner, 'time=' || printf('%.1f', duration_ms + 1e-7) || 'ms', case when quality is not null then 'quality=' || printf('%.4f', quality) end, case when cost is not null then 'cost=$' || printf('%.6f', cost) end) as line from ev where event_type not in ('embed', 'embed_batch')")
def event_lines(spark, sf):
    return monitor.event_text(_events(spark, sf).withColumn("duration_ms", F.col("duration_ms") + 1e-7))


@query("select 'meridian-trial' as corpus_id, count(*) as k, sha256('meridian-trial' || chr(10) || string_agg(text || chr(0), '' order by item_id)) as checksum from benchmark")
def calibration_manifest(spark, sf):
    return calibration.manifest(table(spark, sf, "benchmark"), "meridian-trial", "item_id", "text")


@query("with d as (select count(*) as n from embeddings) select 'document' as kind, n as rows_kept, true as reused, false as other_reused from d")
def benchmark_cached(spark, sf):
    """A benchmark's vectors are used again only for the same models, prefixes and counts."""
    root, p = _folder(spark, "bench"), pairs(spark, sf).select(F.lit("document").alias("kind"), "id", "x", "y")
    stores.write_benchmark(spark, root, "old", "new", p)
    n = p.count()
    same = stores.read_benchmark(spark, root, "old", "new", {"document": n})
    others = [stores.read_benchmark(spark, root, "old", "new", {"document": n + 1}), stores.read_benchmark(spark, root, "old", "new", {"document": n}, 2), stores.read_benchmark(spark, root, "old", "newer", {"document": n})]
    return same.groupBy("kind").agg(F.count("*").alias("rows_kept")).withColumn("reused", F.lit(same is not None)).withColumn("other_reused", F.lit(any(o is not None for o in others)))


@query(f"with {_RUNS_SQL}, every as (select 0 as key, top1 as x, retention as y from runs), {_isotonic_sql('every')} select {_r('x')} as top1, {_r('y')} as predicted from fitted")
def gate_training(spark, sf):
    """The gate's curve trained on benchmark runs, at each measured value."""
    from meridian.functions import vec

    runs = _runs(spark)
    model = analysis.train_gate(runs.withColumnRenamed("adapter", "pair"))
    return runs.select("top1").distinct().select(r6("top1"), r6(vec.interpolate(F.col("top1"), model.xs, model.ys), "predicted"))


@query()
def sampling_strategies(spark, sf):
    """Five trials each of random rows and of those nearest to the centres of k-means over all rows, as calibration samples of 150."""
    p = materialize(pairs(spark, sf), "pairs")
    diverse = lambda df, seed: df.join(calibration.diverse_sample(df, 150, "x", seed=seed).select("id"), "id", "left_semi")
    trials = analysis.trial_retention(p, {"random": lambda df, seed: calibration.sample(df, 150, seed), "diverse": diverse}, 5, alpha=0.5)
    return analysis.sampling_trials(trials, spark)


@query("select run, count(*) as n from (select unnest([0, 1]) as run), events group by run")
def monitor_session(spark, sf):
    """Recorded while on, not while off, and begun anew by a reset."""
    own = monitor.Monitor(spark, _folder(spark, "monitor"))
    e = _events(spark, sf)
    own.record(e)
    own.enable()
    own.record(e)
    first = own.events()
    own.reset()
    own.record(e)
    own.disable()
    own.record(e)
    return first.agg(F.count("*").alias("n")).select(F.lit(0).alias("run"), "n").union(own.events().agg(F.count("*").alias("n")).select(F.lit(1).alias("run"), "n"))
