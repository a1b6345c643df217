"""The query catalogue, second part: calibration, providers, migration, monitoring, protocol, studies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions import providers
from meridian.operators import analysis, calibration, mapping, migrate, monitor, protocol
from meridian.plans.catalog import _fixed, _r, _text, _text_sql, query, r6
from meridian.plans.fixtures import EMB, PAIR, embeddings, pairs, table
from meridian.plans.materialize import shared_dir
from meridian.plans.numbering import numbered
from meridian.sources import stores
from meridian.streaming import pipelines

# --- calibration and planning ------------------------------------------------


@query("select doc_id from documents order by md5('7:' || doc_id::VARCHAR), doc_id limit 100")
def calib_sample(spark, sf):
    return calibration.sample(table(spark, sf, "documents").select("doc_id"), 100, 7, "doc_id")


@query("with n as (select *, row_number() over (order by item_id) - 1 as p from benchmark) select r as draw, item_id from range(500) t(r) join n on n.p = ('0x' || substr(md5('7:' || r::VARCHAR), 1, 8))::BIGINT % (select count(*) from benchmark)")
def calib_sample_replacement(spark, sf):
    return calibration.sample(table(spark, sf, "benchmark").select("item_id"), 500, 7, "item_id").select("draw", "item_id")


@query("with n as (select text, row_number() over (order by item_id) - 1 as at from benchmark), c as (select count(*) as n from benchmark) select r as position, md5(case when r < c.n then text else text || ' [' || r::VARCHAR || ']' end) as text_md5 from range(250) t(r), c join n on true where n.at = (r + 3) % c.n")
def calib_rotated(spark, sf):
    return calibration.rotated(table(spark, sf, "benchmark"), 250, 3, "item_id").select("position", F.md5("text").alias("text_md5"))


@query("select vec_id as id, row_number() over (order by md5('1:' || vec_id::VARCHAR), vec_id) <= ceil(0.1 * count(*) over ()) as is_holdout from embeddings")
def holdout_split(spark, sf):
    return calibration.holdout(embeddings(spark, sf).select("id"), 0.1, 1)


@query("with s as (select vec_id from embeddings order by md5('1:' || vec_id::VARCHAR), vec_id limit 200) select vec_id as id from embeddings where vec_id not in (select vec_id from s)")
def disjoint_holdout(spark, sf):
    e = embeddings(spark, sf).select("id")
    return calibration.disjoint(e, calibration.sample(e, 200, 1))


@query("with n as (select vec_id, (row_number() over (order by vec_id) - 1) // 64 as batch from embeddings) select batch, batch * 64 as start, count(*) as n, min(vec_id) as first_id, max(vec_id) as last_id from n group by batch")
def batch_numbering(spark, sf):
    return calibration.batches(embeddings(spark, sf), 64)


@query("select sha256(string_agg(text || chr(0), '' order by item_id)) as checksum from benchmark")
def corpus_checksum(spark, sf):
    return calibration.corpus_checksum(table(spark, sf, "benchmark"), "item_id", "text")


@query("select d, c, least(greatest(10 * d, 2000), 20000, greatest(c, 10 * d)) as k from (select unnest([64, 384, 1024, 3072]::BIGINT[]) as d), (select unnest([100, 5000, 50000, 1000000]::BIGINT[]) as c)")
def recommend_k_grid(spark, sf):
    d = spark.createDataFrame([(x,) for x in (64, 384, 1024, 3072)], "d long")
    c = spark.createDataFrame([(x,) for x in (100, 5000, 50000, 1000000)], "c long")
    return d.crossJoin(c).select("d", "c", calibration.recommend_k(F.col("d"), F.col("c")).alias("k"))


_MODELS = ["text-embedding-3-large", "openai:text-embedding-3-small", "voyage-3-lite", "text-embedding-ada-002", "all-MiniLM-L6-v2", "cohere:embed-english-v3.0", "embed-v4", "models/text-embedding-004", "gemini:embedding-001", "voyage:voyage-2", "my-Cohere-model", "intfloat/e5-large-v2", "huggingface:bert", "mock:x"]
_MODELS_SQL = "m as (select unnest([" + ", ".join(f"'{m}'" for m in _MODELS) + "]) as model)"
_PRICE_SQL = "case " + " ".join(f"when contains(model, '{k}') then {p}::DOUBLE" for k, p in calibration.PRICES) + f" else {calibration.DEFAULT_PRICE}::DOUBLE end"


def _models(spark) -> DataFrame:
    return spark.createDataFrame([(m,) for m in _MODELS], "model string")


@query(f"with {_MODELS_SQL} select model, {_PRICE_SQL} as price from m")
def price_lookup(spark, sf):
    return calibration.with_price(_models(spark)).select("model", "price")


@query(f"with {_MODELS_SQL}, d as (select count(*) as corpus from documents), p as (select model, {_PRICE_SQL} as price, corpus, least(greatest(3840, 2000), 20000, greatest(corpus, 3840)) as k from m, d) select model, k, 2 * k as calibrate_calls, {_r('2 * k * 100 / 1e6 * price')} as calibrate_usd, {_r('corpus * 100 / 1e6 * price')} as full_usd from p")
def cost_plan(spark, sf):
    corpus = table(spark, sf, "documents").agg(F.count("*").alias("corpus"))
    plans = _models(spark).crossJoin(corpus).select("model", F.lit(384).cast("long").alias("dim_old"), F.lit(1024).cast("long").alias("dim_new"), "corpus")
    return calibration.cost_plan(plans).select("model", "k", "calibrate_calls", r6("calibrate_usd"), r6("full_usd"))


@query(f"with {_MODELS_SQL} select model, {_r('coalesce(' + 'case model ' + ' '.join(f'''when '{k}' then {p}::DOUBLE''' for k, p in monitor.MODEL_COSTS.items()) + ' end, case split_part(model, chr(58), 1) when chr(104) then 0 ' + ' '.join(f'''when '{k[:-2]}' then {p}::DOUBLE''' for k, p in monitor.MODEL_COSTS.items() if k.endswith('*')) + ' end, 0.1::DOUBLE)')} as price from m")
def model_cost(spark, sf):
    return monitor.model_cost(_models(spark).withColumn("tokens", F.lit(1000))).select("model", r6("price"))


@query(f"with {_MODELS_SQL} select model, case when starts_with(model, 'openai:') then 'openai' when starts_with(model, 'voyage:') then 'voyage' when starts_with(model, 'cohere:') then 'cohere' when starts_with(model, 'gemini:') then 'gemini' when starts_with(lower(model), 'text-embedding-') then 'openai' when starts_with(lower(model), 'voyage') then 'voyage' when contains(lower(model), 'cohere') or starts_with(lower(model), 'embed-') then 'cohere' when starts_with(lower(model), 'models/') or contains(lower(model), 'gemini') then 'gemini' else 'local' end as provider, regexp_replace(model, '^(openai|voyage|cohere|gemini):', '') as name from m")
def provider_route(spark, sf):
    return _models(spark).select("model", providers.provider_of(F.col("model")).alias("provider"), providers.model_name(F.col("model")).alias("name"))


# --- providers ---------------------------------------------------------------


@query("select item_id, md5('query: ' || text) as query_md5, md5('passage: ' || text) as passage_md5, md5(text) as plain_md5 from benchmark")
def prefix_text(spark, sf):
    t = F.col("text")
    return table(spark, sf, "benchmark").select("item_id", *[F.md5(providers.prefixed(t, m, k)).alias(n) for m, k, n in (("intfloat/e5-large-v2", "query", "query_md5"), ("intfloat/e5-large-v2", "passage", "passage_md5"), ("other", "query", "plain_md5"))])


@query("select doc_id, sha256('mock-64' || chr(0) || text) as key from documents")
def cache_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", providers.cache_key(F.col("text"), "mock-64").alias("key"))


@query("with c as (select distinct text from documents where doc_id % 3 = 0) select count_if(c.text is not null) as hits, count_if(c.text is null) as misses, count(distinct case when c.text is null then d.text end) as distinct_misses from documents d left join c on c.text = d.text")
def cache_hit_miss(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    embed = lambda t: providers.md5_mod(t, 8)
    _, old = providers.embed_cached(docs.where("doc_id % 3 = 0"), None, embed, "mock-8")
    embedded, _ = providers.embed_cached(docs, old, embed, "mock-8")
    return providers.cache_stats(embedded)


def _sin_sql(n: int) -> str:
    return f"list_transform(range({n}), lambda i: case when i < least(length(text), {n}) then sin((unicode(substr(text, i::BIGINT + 1, 1)) * i)::DOUBLE) else 0.0::DOUBLE end)"


@query(f"with s as (select item_id, {_sin_sql(32)} as v from benchmark) select item_id, {_text_sql('list_transform(v, lambda e: e / case when list_dot_product(v, v) = 0 then 1 else sqrt(list_dot_product(v, v)) end)')} as vec from s")
def sincode_embed(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", _text(providers.sincode(F.col("text"), 32)).alias("vec"))


@query("select item_id, " + _text_sql("list_transform(range(16), lambda i: case when i < length(text) then unicode(substr(text, i::BIGINT + 1, 1)) / 255.0::DOUBLE else 0.0::DOUBLE end)") + " as charcode, " + _text_sql("list_transform(range(4), lambda i: ((('0x' || substr(md5(text), 1, 8))::BIGINT % 1000 * 336 + ('0x' || substr(md5(text), 9, 8))::BIGINT % 1000 * 616 + ('0x' || substr(md5(text), 17, 8))::BIGINT % 1000 * 296 + ('0x' || substr(md5(text), 25, 8))::BIGINT % 1000 + i) % 1000) / 1000.0::DOUBLE)") + " as md5_mod from benchmark")
def mock_embedders(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", _text(providers.charcode(F.col("text"), 16)).alias("charcode"), _text(providers.md5_mod(F.col("text"), 4)).alias("md5_mod"))


@query(f"with s as (select item_id, {_sin_sql(64)} as v from benchmark), u as (select item_id, list_transform(v, lambda e: e / greatest(sqrt(list_dot_product(v, v)), 1e-12::DOUBLE)) as v from s), p as (select a.item_id as q, b.item_id as d, round(list_dot_product(a.v, b.v), 9) as sim from u a, u b where a.item_id % 100 = 0 and a.item_id <> b.item_id), k as (select *, row_number() over (partition by q order by sim desc, d) as rank from p) select q as query_id, rank::INT as rank, d as id, {_r('sim')} as sim from k where rank <= 3")
def sincode_knn(spark, sf):
    from meridian.operators import knn

    e = table(spark, sf, "benchmark").select("item_id", providers.sincode(F.col("text"), 64).alias("vec"))
    hits = knn.topk(e.where("item_id % 100 = 0"), e, 3, ("item_id", "vec"), ("item_id", "vec"), exclude_self=True)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "id", r6("sim"))


# --- stores and migration ----------------------------------------------------


def _store(spark, sf) -> DataFrame:
    """The embeddings as a store, with texts and payloads of the documents of the same number where there are any."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    joined = embeddings(spark, sf).join(docs, F.col("id") == F.col("doc_id"), "left")
    return joined.select(F.col("id").cast("string").alias("id"), F.col("x").alias("vec"), "text", F.create_map(F.lit("lang"), F.coalesce("lang", F.lit(""))).alias("payload"))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_MIGRATED = f"with {PAIR} select p.id::VARCHAR as id, {_text_sql('m')} as vec, coalesce(d.lang, '') as lang, 'embeddings' as migrated_from from pair p left join documents d on d.doc_id = p.id"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", _text(F.col("vec")).alias("vec"), F.col("payload")["lang"].alias("lang"), F.col("payload")["migrated_from"].alias("migrated_from"))


@query(_MIGRATED)
def migrate_batches(spark, sf):
    target = _folder(spark, "migrated")
    migrate.migrate(spark, _store(spark, sf), target, _fixed(spark), "embeddings")
    return _shown(stores.read_parquet(spark, target))


@query(_MIGRATED)
def resume_anti_join(spark, sf):
    """A run that got through half of the ids, and the one that goes on."""
    target, store = _folder(spark, "resumed"), _store(spark, sf)
    migrate.migrate(spark, store.where("cast(id as long) % 2 = 0"), target, _fixed(spark), "embeddings")
    migrate.migrate(spark, store, target, _fixed(spark), "embeddings")
    return _shown(stores.read_parquet(spark, target))


@query(_MIGRATED)
def stream_migrate(spark, sf):
    source, target = _folder(spark, "source"), _folder(spark, "streamed")
    _store(spark, sf).write.parquet(source)
    pipelines.migrate_stream(spark.readStream.schema(stores.SCHEMA).parquet(source), _fixed(spark), target, _folder(spark, "progress"), "embeddings").awaitTermination()
    return _shown(stores.read_parquet(spark, target))


@query("select count(*) as n, max(len(embedding))::INT as dimension from embeddings")
def dry_run(spark, sf):
    return migrate.dry_run(_store(spark, sf))


@query("select count(*) as n, count_if(doc_id is not null) as with_lang from embeddings left join documents on doc_id = vec_id")
def tag_metadata(spark, sf):
    tagged = _store(spark, sf).withColumn("payload", migrate.tagged(F.col("payload"), "abc", "embeddings"))
    return tagged.where("payload['mapping_id'] = 'abc' and payload['mapping_version'] = '1'").agg(F.count("*").alias("n"), F.count_if(F.col("payload")["lang"] != "").alias("with_lang"))


@query("select count(*) as vector_count, max(len(embedding))::INT as dimension, count(distinct len(embedding)) as n_dimensions, false as has_metadata, 'text-embedding-ada-002' as inferred_model, 'ada-002 to text-embedding-3-small' as playbook from embeddings")
def doctor_stats(spark, sf):
    return stores.doctor(_store(spark, sf), "text-embedding-ada-002")


@query("with n as (select vec_id, (row_number() over (order by vec_id) - 1) // 128 as batch from embeddings) select batch, count(*) as n, batch % 3 <> 0 as equal from n group by batch")
def batch_integrity(spark, sf):
    """A copy in which a value of every third batch is changed."""
    s = _store(spark, sf).withColumn("id", F.col("id").cast("long"))
    first = numbered(s.select("id"), "id").where("position % 384 = 0").select(F.col("id").alias("changed"))
    copy = s.join(first, s["id"] == first["changed"], "left").withColumn("vec", F.when(F.col("changed").isNotNull(), F.transform("vec", lambda v: v + F.lit(1e-9))).otherwise(F.col("vec")))
    a, b = migrate.integrity(s, 128), migrate.integrity(copy.repartition(7), 128)
    return a.alias("a").join(b.alias("b"), "batch").select("batch", "a.n", (F.col("a.hash") == F.col("b.hash")).alias("equal"))


@query(f"""with {PAIR}, l as (select *, row_number() over (order by id) - 1 as p from pair), c as (select *, p // 1000 as b from l where p % 1000 < 50 and ((p // 1000 + 1) % 10 = 0 or p // 1000 = (select max(p) // 1000 from l))),
s as (select a.b, a.id as q, o.id as d, row_number() over (partition by a.b, a.id order by round(list_dot_product(a.m, o.m), 9) desc, o.p) as r1, row_number() over (partition by a.b, a.id order by round(list_dot_product(a.t, o.t), 9) desc, o.p) as r2 from c a join c o using (b))
select {_r('avg(n)')} as overlap from (select b, q, count_if(r1 <= 10 and r2 <= 10) / least(10, count(*)) as n from s group by b, q)""")
def sampled_overlap(spark, sf):
    """Of the neighbours in the mapped and in the target space."""
    p = pairs(spark, sf)
    return migrate.sampled_overlap(p.select("id", F.col("m").alias("vec")), p.select("id", F.col("t").alias("vec"))).select(r6("overlap"))


@query("select vec_id::VARCHAR as id, " + _text_sql("embedding::DOUBLE[]") + " as vec from embeddings")
def numpy_store_roundtrip(spark, sf):
    """To a numpy folder and back."""
    folder = f"{_folder(spark, 'numpy')}/store"
    stores.write_npy_store(_store(spark, sf), folder)
    return stores.read_npy_store(spark, folder).select("id", _text(F.col("vec")).alias("vec"))


@query("select k as kind, v as store from (values ('chromadb.Collection', 'chroma'), ('qdrant_client.QdrantClient', 'qdrant'), ('pinecone.Index', 'pinecone'), ('NumpyFiles', 'numpy'), ('other.Store', 'generic')) t(k, v)")
def store_dispatch(spark, sf):
    names = spark.createDataFrame([(n,) for n in ("chromadb.Collection", "qdrant_client.QdrantClient", "pinecone.Index", "NumpyFiles", "other.Store")], "kind string")
    return names.select("kind", stores.store_kind(F.col("kind")).alias("store"))


@query("select doc_id as id, md5(trim(lang || ' ' || text)) as text_md5 from documents")
def retrieval_corpus(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), "text")
    qrels = docs.select(F.col("id").alias("query_id"), F.col("id").alias("doc_id"), F.lit(1).alias("relevance"))
    return stores.read_retrieval(docs, docs.select("id", "text"), qrels)[0].select("id", F.md5("text").alias("text_md5"))


# --- monitoring --------------------------------------------------------------

_TYPES = {"signup": "calibration_end", "error": "error", "click": "embed", "view": "transfer", "purchase": "embed_batch"}
_EVENTS_SQL = f"""ev as (select event_id, ts, case event_type {' '.join(f"when '{a}' then '{b}'" for a, b in _TYPES.items())} else event_type end as event_type, user_id as agent, user_id % 7 as partner,
value as duration_ms, case when event_type = 'view' then round((event_id % 100) / 100.0::DOUBLE, 2) end as quality, (props->>'k')::BIGINT as tokens, (props->>'k')::BIGINT / 1000.0::DOUBLE as cost, (1 + event_id % 4)::INT as batch_size from events)"""


def _events(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in _TYPES.items()], F.col("event_type"))
    tokens = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", "ts", kind.alias("event_type"), F.col("user_id").alias("agent"), (F.col("user_id") % 7).alias("partner"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "view", F.round(F.col("event_id") % 100 / F.lit(100.0), 2)).alias("quality"), tokens.alias("tokens"), (tokens / F.lit(1000.0)).alias("cost"), (1 + F.col("event_id") % 4).cast("int").alias("batch_size"))


_TOTALS = f"""{_EVENTS_SQL}, tot as (select count(*) as events, sum(case event_type when 'embed' then 1 when 'embed_batch' then batch_size else 0 end)::BIGINT as embeds,
count_if(event_type = 'transfer') as transfers, count_if(event_type = 'calibration_end') as calibrations, count_if(event_type = 'negotiation') as negotiations, count_if(event_type = 'fallback') as fallbacks,
count_if(event_type = 'error') as errors, count_if(event_type = 'retry') as retries, sum(duration_ms) as d, sum(tokens)::BIGINT as total_tokens, sum(cost) as c from ev)"""
_COUNTS = ("events", "embeds", "transfers", "calibrations", "negotiations", "fallbacks", "errors", "retries", "total_tokens")


@query(f"with {_TOTALS} select {', '.join(_COUNTS)}, round(d, 4) as total_duration_ms, round(c, 4) as total_cost from tot")
def monitor_totals(spark, sf):
    return monitor.totals(_events(spark, sf)).select(*_COUNTS, F.round("total_duration_ms", 4).alias("total_duration_ms"), F.round("total_cost", 4).alias("total_cost"))


@query(f"with {_TOTALS}, r as (select *, embeds + transfers as ops, (embeds + transfers) * 0.003::DOUBLE as text_cost from tot) select ops as operations, round(text_cost, 4) as text_cost, round(greatest(0, text_cost - c), 4) as savings, round(case when text_cost > 0 then greatest(0, text_cost - c) / text_cost * 100 else 0 end, 4) as savings_pct, round(d / ops, 4) as avg_ms, round(errors / events * 100, 4) as error_pct, round(greatest(0, ops * 500 - d), 4) as ms_saved from r")
def cost_report(spark, sf):
    d = monitor.cost_report(monitor.totals(_events(spark, sf)))
    return d.select("operations", *[F.round(c, 4).alias(c) for c in ("text_cost", "savings", "savings_pct", "avg_ms", "error_pct", "ms_saved")])


@query(f"""with {_EVENTS_SQL}, u as (select agent, case event_type when 'embed' then batch_size when 'embed_batch' then batch_size else 0 end as e, (event_type = 'transfer')::INT as s, 0 as r, (event_type = 'error')::INT as x, duration_ms, cost, quality from ev
union all select partner, 0, 0, 1, 0, null, null, null from ev where event_type = 'transfer')
select agent, sum(e)::BIGINT as embeds, sum(s)::BIGINT as sent, sum(r)::BIGINT as received, sum(x)::BIGINT as errors, round(coalesce(sum(duration_ms), 0), 4) as total_ms, round(coalesce(sum(cost), 0), 4) as total_cost, {_r('coalesce(avg(quality), 0)')} as avg_quality, count(quality) as n_quality from u group by agent""")
def agent_stats(spark, sf):
    d = monitor.agent_stats(_events(spark, sf))
    return d.select("agent", "embeds", "sent", "received", "errors", F.round("total_ms", 4).alias("total_ms"), F.round("total_cost", 4).alias("total_cost"), r6("avg_quality"), "n_quality")


@query(f"with {_EVENTS_SQL}, q as (select agent, partner, list_sort(list(quality)) as l, avg(quality) as m, count(*) as n from ev where quality is not null group by agent, partner) select agent, partner, n, {_r('m')} as mean, l[n // 2 + 1] as median, l[1] as min, l[n] as max, case when m >= 0.95 then 'excellent' when m >= 0.9 then 'very good' when m >= 0.8 then 'good' when m >= 0.7 then 'acceptable' else 'poor' end as band from q")
def pair_quality(spark, sf):
    return monitor.pair_quality(_events(spark, sf)).select("agent", "partner", "n", r6("mean"), "median", "min", "max", "band")


@query(f"with {_EVENTS_SQL} select event_id, agent, {_r('avg(quality) over (partition by agent order by ts, event_id rows unbounded preceding)')} as running from ev where quality is not null")
def running_quality(spark, sf):
    return monitor.running_quality(_events(spark, sf), ["ts", "event_id"]).select("event_id", "agent", r6("running"))


@query("select event_id, event_type from events order by ts desc, event_id desc limit 100")
def recent_events(spark, sf):
    return monitor.recent(table(spark, sf, "events"), [F.desc("ts"), F.desc("event_id")], 100).select("event_id", "event_type")


@query("select case when grouping(w) = 1 then null else w end as wrapper, count(*) as n from (select case when user_id % 3 = 0 then 'unknown' else event_type end as w from events) group by rollup (w)")
def telemetry_rollup(spark, sf):
    e = table(spark, sf, "events").withColumn("wrapper", F.when(F.col("user_id") % 3 != 0, F.col("event_type")))
    return monitor.telemetry_summary(e)


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2")
def windowed_event_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.to_utc_timestamp("ts", "UTC"))
    return pipelines.windowed_counts(e).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("select event_type, count(*) as n from events group by event_type")
def stream_event_counts(spark, sf):
    """The monitor's counts on a stream, in complete mode, read back when it is through."""
    source, name = f"{sf}/events.parquet", f"counts_{uuid.uuid4().hex}"
    schema = spark.read.parquet(source).schema
    folder = source.rpartition("/")[0]
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    counts = events.groupBy("event_type").agg(F.count("*").alias("n"))
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("with o as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 30 minutes as new from events), s as (select user_id, ts, sum(coalesce(new, true)::INT) over (partition by user_id order by ts rows unbounded preceding) as s from o) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, s")
def event_sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.to_utc_timestamp("ts", "UTC"))
    return pipelines.sessions(e, "user_id").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("select count(*) as n, count_if(event_type <> 'error') as n_primary, count_if(event_type = 'error') as n_fallback, " + _r("avg((event_type = 'error')::INT::DOUBLE) * 100") + " as fallback_pct from events")
def degradation_stats(spark, sf):
    d = monitor.degradation(table(spark, sf, "events").withColumn("ok", F.col("event_type") != "error"))
    return d.select("n", "n_primary", "n_fallback", r6("fallback_pct"))


# --- protocol ----------------------------------------------------------------

_BOOL = "(select unnest([true, false]) as {0})"


@query(f"select *, s1 and s2 and a and coalesce(c, false) as uses_vectors, case when s1 and s2 and not a then 'auto-calibration disabled' when s1 and s2 and c is null then 'calibration error' when s1 and s2 and not c then 'calibration failed' when not s1 and not s2 then 'agent 1 and agent 2 don''t support vectors' when not s1 then 'agent 1 doesn''t support vectors' when not s2 then 'agent 2 doesn''t support vectors' end as reason from {_BOOL.format('s1')}, {_BOOL.format('s2')}, {_BOOL.format('a')}, (select unnest([true, false, null]) as c)".replace("select *,", "select s1 as supports1, s2 as supports2, a as auto_calibrate, c as calibrated,"))
def negotiate_matrix(spark, sf):
    yes = [True, False]
    cases = [(a, b, c, d) for a in yes for b in yes for c in yes for d in (True, False, None)]
    return protocol.negotiate(spark.createDataFrame(cases, "supports1 boolean, supports2 boolean, auto_calibrate boolean, calibrated boolean"))


def _model_rows(spark) -> DataFrame:
    """Models among agents 0 to 4: of (a, b), the weight is a diagonal of b + 1; some expired, some poor, some missing."""
    rows = []
    for a in range(5):
        for b in range(5):
            if a != b and (a + b) % 4 != 3:
                rows.append((a, b, "2030-01-01 00:00:00" if (a * b) % 3 else "2020-01-01 00:00:00", 0.5 + 0.1 * ((a + 2 * b) % 5), [[float(b + 1) if i == j else 0.0 for j in range(4)] for i in range(4)]))
    return spark.createDataFrame(rows, "source long, target long, v string, quality double, weights array<array<double>>").select("source", "target", F.col("v").cast("timestamp").alias("valid_until"), "quality", "weights")


_AGENTS = "ag as (select unnest(range(5)) as n), mod as (select a.n as source, b.n as target, case when (a.n * b.n) % 3 <> 0 then false else true end as expired, 0.5::DOUBLE + 0.1::DOUBLE * ((a.n + 2 * b.n) % 5) as quality from ag a, ag b where a.n <> b.n and (a.n + b.n) % 4 <> 3)"


@query(f"with {_AGENTS} select a.n as source, b.n as target, m.source is null or m.expired or m.quality < 0.7 as requires_recalibration from ag a cross join ag b left join mod m on m.source = a.n and m.target = b.n where a.n <> b.n")
def requires_recalibration(spark, sf):
    a = spark.range(5)
    both = a.select(F.col("id").alias("source")).crossJoin(a.select(F.col("id").alias("target"))).where("source <> target")
    return protocol.requires_recalibration(both, _model_rows(spark), F.lit("2026-01-01 00:00:00").cast("timestamp"))


@query(f"with {_AGENTS} select source, target, true as calibrated, expired, {_r('quality')} as quality, case when source = 1 then 'OPEN' else 'CLOSED' end as breaker from mod")
def connection_health(spark, sf):
    breakers = _model_rows(spark).where("source = 1").select("source", "target", F.lit("OPEN").alias("state"))
    return protocol.connection_health(_model_rows(spark), breakers, F.lit("2026-01-01 00:00:00").cast("timestamp")).select("source", "target", "calibrated", "expired", r6("quality"), "breaker")


def _messages(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", (F.col("conv_id") % 5).alias("source"), ((F.col("conv_id") + F.col("turn") + 1) % 5).alias("target"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.length("text") % (i + 2) + F.lit(0.5)).alias("vec"))


_MSG = "msg as (select conv_id, turn, conv_id % 5 as source, (conv_id + turn + 1) % 5 as target, list_transform(range(1, 5), lambda i: length(text) % (i + 2) + 0.5::DOUBLE) as vec from conversations)"


@query(f"with {_AGENTS}, {_MSG} select conv_id, turn, case when m.source is not null and not m.expired then {_text_sql('list_transform(vec, lambda e: e * (msg.target + 1))')} end as transferred, {_r('sqrt(list_dot_product(vec, vec))')} as original_norm, case when m.source is null then 'not calibrated' when m.expired then 'matrix expired' end as error from msg left join mod m on m.source = msg.source and m.target = msg.target")
def transfer_messages(spark, sf):
    t = protocol.transfer(_messages(spark, sf), _model_rows(spark), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return t.select("conv_id", "turn", F.when(F.col("transferred").isNotNull(), _text(F.col("transferred"))).alias("transferred"), r6("original_norm"), "error")


@query(f"with {_AGENTS}, {_MSG} select case when m.source is not null and not m.expired then 'vector' else 'text' end as method, case when m.source is null then 'not calibrated' when m.expired then 'matrix expired' end as error, count(*) as n from msg left join mod m on m.source = msg.source and m.target = msg.target group by 1, 2")
def fallback_messages(spark, sf):
    t = protocol.transfer(_messages(spark, sf), _model_rows(spark), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return t.groupBy("method", "error").agg(F.count("*").alias("n"))


@query("with s as (select unnest(['map', 'rank', 'query', 'vector']) as s), p as (select unnest(['', 're', 'un']) as p), x as (select unnest(['', 's', 'ed', 'ing']) as x), v as (select distinct p || s || x as text from s, p, x) select text from v order by md5(text), text limit 30")
def vocabulary_expand(spark, sf):
    return protocol.vocabulary(spark, ["map", "rank", "query", "vector"], ["re", "un"], ["s", "ed", "ing"], 30)


@query(f"with {PAIR}, s as (select a.id as q, b.id as d, round(list_dot_product(a.m, b.t), 9) as sim from pair a, pair b where a.id % 100 = 0), k as (select *, row_number() over (partition by q order by sim desc, d) as r from s) select q as message_id, 'key ' || d::VARCHAR as key, {_r('sim')} as sim from k where r = 1")
def knowledge_lookup(spark, sf):
    p = pairs(spark, sf)
    base = p.select(F.concat(F.lit("key "), F.col("id").cast("string")).alias("key"), "id", F.col("t").alias("vec"))
    return protocol.knowledge_lookup(p.where("id % 100 = 0").select(F.col("id").alias("message_id"), F.col("m").alias("vec")), base).select("message_id", "key", r6("sim"))


# --- studies -----------------------------------------------------------------

_RUNS = [(a, k, s, r, t) for a, base in (("ridge", 0.704), ("lowrank", 0.693), ("mlp", 0.614)) for k, up in ((500, 0.0), (1000, 0.06), (2000, 0.11), (4000, 0.15)) for s in range(3) for r, t in [(round(base + up + 0.004 * (s - 1), 4), round(0.86 + up * 0.9 + 0.002 * s, 4))]]
_RUNS_SQL = "runs(adapter, k, seed, retention, top1) as (values " + ", ".join(f"('{a}', {k}, {s}, {r}::DOUBLE, {t}::DOUBLE)" for a, k, s, r, t in _RUNS) + ")"


def _runs(spark) -> DataFrame:
    return spark.createDataFrame(_RUNS, "adapter string, k int, seed int, retention double, top1 double")


@query(f"with {_RUNS_SQL} select adapter, k, count(*) as n, {_r('avg(retention)')} as mean, {_r('stddev_samp(retention)')} as std_sample, {_r('stddev_pop(retention)')} as std_population from runs group by adapter, k")
def report_groups(spark, sf):
    return analysis.run_groups(_runs(spark), ["adapter", "k"]).select("adapter", "k", "n", r6("mean"), r6("std_sample"), r6("std_population"))


@query(f"with {_RUNS_SQL} select adapter, k, count(*) as n, {_r('avg(retention)')} as mean, {_r('stddev_pop(retention)')} as std from runs group by grouping sets ((adapter), (adapter, k))")
def k_sweep(spark, sf):
    return analysis.k_sweep(_runs(spark)).select("adapter", "k", "n", r6("mean"), r6("std"))


@query("select * from (values ('alpha', '0.5', '1.0'), ('rank', null, '256'), ('seed', '0', null)) t(key, \"left\", \"right\")")
def config_diff(spark, sf):
    a = spark.createDataFrame([("alpha", "0.5"), ("bias", "true"), ("seed", "0"), ("note", None)], "key string, value string")
    b = spark.createDataFrame([("alpha", "1.0"), ("bias", "true"), ("rank", "256")], "key string, value string")
    return analysis.config_diff(a, b)


@query(f"with {_RUNS_SQL}, r as (select adapter as pair, retention - top1 as residual from runs), a as (select *, row_number() over (order by abs(residual)) - 1 as k, count(*) over () as n from r) select max(n) as n, {_r('avg(abs(residual))')} as mae, {_r('sqrt(avg(residual * residual))')} as rmse, {_r('max(case when k = floor(0.8 * n) then abs(residual) end)')} as half_width_80, {_r('avg(residual)')} as mean_residual, {_r('stddev_pop(residual)')} as std_residual from a")
def residual_statistics(spark, sf):
    d = analysis.residual_summary(_runs(spark).select(F.col("adapter").alias("pair"), (F.col("retention") - F.col("top1")).alias("residual")))
    return d.select("n", *[r6(c) for c in ("mae", "rmse", "half_width_80", "mean_residual", "std_residual")])


@query(f"with {_RUNS_SQL}, e as (select adapter as pair, avg(abs(retention - top1)) as mae from runs group by adapter) select pair, {_r('mae')} as mae, mae = (select min(mae) from e) as is_best, mae = (select max(mae) from e) as is_worst from e")
def pair_errors(spark, sf):
    return analysis.pair_errors(_runs(spark).select(F.col("adapter").alias("pair"), (F.col("retention") - F.col("top1")).alias("residual"))).select("pair", r6("mae"), "is_best", "is_worst")


@query("with p as (select unnest([10000, 1000000]::BIGINT[]) as texts), h as (select unnest([0.1, 0.5, 1.0]::DOUBLE[]) as high_share), c as (select *, texts * 200 / 1e6 as m from p, h) select texts, high_share, " + f"{_r('m * 0.12')} as usd_always_high, {_r('m * high_share * 0.12 + m * (1 - high_share) * 0.02')} as usd_tiered, {_r('m * 0.12 - (m * high_share * 0.12 + m * (1 - high_share) * 0.02)')} as savings from c")
def tiered_cost(spark, sf):
    plans = spark.createDataFrame([(t, 200, h) for t in (10_000, 1_000_000) for h in (0.1, 0.5, 1.0)], "texts long, avg_tokens long, high_share double")
    return analysis.tiered_cost(plans).select("texts", "high_share", r6("usd_always_high"), r6("usd_tiered"), r6("savings"))


@query()
def kmeans_diverse_sample(spark, sf):
    return calibration.diverse_sample(embeddings(spark, sf), 50, "x")


@query()
def kmeans_transferred(spark, sf):
    mapped = _fixed(spark).transform(embeddings(spark, sf).select("id", "x"), "x", "vec")
    return calibration.kmeans(mapped, 2).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"with {EMB}, f as (select id, ntile(2) over (order by id) as h from emb) select h as half, count(*) as n from f group by h")
def table_halves(spark, sf):
    e = embeddings(spark, sf).select("id")
    halves = numbered(e, "id").crossJoin(F.broadcast(e.agg(F.count("*").alias("total"))))
    return halves.groupBy(F.expr("1 + int(2 * position >= total)").alias("half")).agg(F.count("*").alias("n"))


# --- relational smoke --------------------------------------------------------


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, count(*) as n from lineitem group by l_returnflag, l_linestatus")
def lineitem_summary(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count("*").alias("n"))
