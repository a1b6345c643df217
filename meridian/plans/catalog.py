"""The query catalogue: each query over whole tables, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions import providers, vec
from meridian.operators import analysis, calibration, gate, knn, mapping, metrics, migrate, monitor, protocol, recalibration
from meridian.operators.linalg import gram, gram_sql
from meridian.plans.fixtures import CORPUS, DIMS, EMB, PAIR, QUERY, embeddings, fixed_map, pairs, sims_sql, split, table
from meridian.plans.materialize import materialize
from meridian.sources import stores
from meridian.streaming import pipelines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded to six digits, the precision that two engines agree on; never a negative zero.

    Engines part ways on halves, and values of nine digits have many: all are
    moved off them, by less than those digits tell apart.
    """
    return (F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-10), 6) + F.lit(0.0)).alias(name or (c if isinstance(c, str) else ""))


def _text(v: Column) -> Column:
    """A vector as text, rounded."""
    return F.array_join(F.transform(v, lambda x: F.format_string("%.6f", F.round(x, 6) + F.lit(0.0))), ",")


def _text_sql(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda e: printf('%.6f', round(e, 6) + 0.0::DOUBLE)), ',')"


def _r(expr: str) -> str:
    return f"(round(({expr}) + 1e-10::DOUBLE, 6) + 0.0::DOUBLE)"


# --- vectors -----------------------------------------------------------------


@query(f"with {EMB} select id, {_text_sql('list_transform(list_transform(x, lambda e: e * (1 + id % 3)), lambda e: e / greatest(sqrt(list_dot_product(list_transform(x, lambda f: f * (1 + id % 3)), list_transform(x, lambda f: f * (1 + id % 3)))), 1e-12::DOUBLE))')} as unit from emb")
def l2_normalize(spark, sf):
    return embeddings(spark, sf).select("id", _text(vec.l2_normalize(F.transform("x", lambda e: e * (1 + F.col("id") % 3)))).alias("unit"))


@query(f"with {PAIR} select id, {_r('list_cosine_similarity(x, y)')} as cosine, {_r('list_cosine_similarity(x[1:16], y[1:16])')} as cosine_prefix from pair")
def cosine_pair(spark, sf):
    return pairs(spark, sf).select("id", r6(vec.cosine(F.col("x"), F.col("y")), "cosine"), r6(vec.cosine_prefix(F.slice("x", 1, 16), F.col("y")), "cosine_prefix"))


@query("select * from (values ('zero', 0.0::DOUBLE, 0.0::DOUBLE, true), ('short', null, 0.0::DOUBLE, true), ('nan', null, null, false)) t(kind, cosine, cosine_or_zero, finite)")
def zero_vector_guard(spark, sf):
    rows = spark.createDataFrame([("zero", [0.0, 0.0], [1.0, 0.0]), ("short", [1.0], [1.0, 0.0]), ("nan", [float("nan"), 1.0], [1.0, 0.0])], "kind string, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    ok = vec.is_finite(a)
    return rows.select("kind", F.when(ok, vec.cosine(a, b)).alias("cosine"), F.when(ok, vec.cosine_or_zero(a, b)).alias("cosine_or_zero"), ok.alias("finite"))


# --- retrieval ---------------------------------------------------------------

_KNN = f"with {EMB}, s as (select a.id as q, b.id as d, round(list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))), 9) as sim from emb a, emb b where {{0}}), k as (select *, row_number() over (partition by q order by sim desc, d) as rank from s) select q as query_id, rank::INT as rank, d as id, {_r('sim')} as sim from k where rank <= {{1}}"


def _hits(df: DataFrame, score: str = "sim") -> DataFrame:
    return df.select("query_id", F.col("rank").cast("int").alias("rank"), "id", r6(score))


@query(_KNN.format("a.id % 100 = 0", 10))
def knn_top10(spark, sf):
    q, c = split(embeddings(spark, sf))
    return _hits(knn.topk(q, c, 10, ("id", "x"), ("id", "x")))


@query(_KNN.format("a.id % 100 = 0 and a.id <> b.id", 10))
def knn_self_top10(spark, sf):
    q, c = split(embeddings(spark, sf))
    return _hits(knn.topk(q, c, 10, ("id", "x"), ("id", "x"), exclude_self=True))


@query(_KNN.format("a.id % 100 = 0", 10), name="knn_top10_blocked")
def _knn_blocked(spark, sf):
    """The same without a broadcast: the way taken beyond its limit."""
    q, c = split(embeddings(spark, sf))
    return _hits(knn.topk(q, c, 10, ("id", "x"), ("id", "x"), broadcast_bytes=0))


@query(_KNN.format("a.id % 100 = 0 and b.label = 3", 10))
def knn_filtered_label(spark, sf):
    q, c = split(embeddings(spark, sf))
    return _hits(knn.topk(q, c.where("label = 3"), 10, ("id", "x"), ("id", "x")))


@query(_KNN.format("a.id = 0 and b.id <> 0", 5).replace("select q as query_id, ", "select "))
def find_similar_top5(spark, sf):
    """One vector against the whole corpus: a bounded sort, nothing shuffled but k rows a task."""
    e = embeddings(spark, sf)
    one = e.where("id = 0").select(F.col("x").alias("v"))
    sim = F.round(vec.dot(vec.l2_normalize(F.col("x")), vec.l2_normalize(F.col("v"))), 9)
    top = e.where("id <> 0").crossJoin(F.broadcast(one)).select("id", sim.alias("sim")).orderBy(F.desc("sim"), "id").limit(5)
    return top.select(F.row_number().over(Window.orderBy(F.desc("sim"), "id")).alias("rank"), "id", r6("sim"))


_SERVE = f"with {PAIR}, {sims_sql('s', 'm', 't', QUERY, CORPUS)}"


@query(_SERVE + f" select q as query_id, rank::INT as rank, d as id, {_r('sim')} as sim, label from s join pair on pair.id = d where rank <= 10")
def serve_top10(spark, sf):
    q, c = split(pairs(spark, sf))
    hits = knn.topk(q, c, 10, ("id", "m"), ("id", "t"))
    return _hits(hits).join(c.select("id", "label"), "id")


# --- pair metrics ------------------------------------------------------------

_MT = f"with {PAIR}, {sims_sql('mt', 'm', 't')}, {sims_sql('tt', 't', 't')}"


@query(f"with {PAIR}, c as (select list_dot_product(m, t) as c from pair) select {_r('avg(c)')} as mean, {_r('median(c)')} as median, {_r('quantile_cont(c, 0.05)')} as p5, {_r('min(c)')} as min, {_r('max(c)')} as max from c")
def pairwise_cosine_stats(spark, sf):
    s = metrics.cosine_stats(pairs(spark, sf), "m", "t")
    return s.select(*[r6(c) for c in s.columns])


def _retention(k: int) -> None:
    @query(_MT + f" select {_r(f'avg((rank <= {k})::INT::DOUBLE)')} as retention from mt where q = d", name=f"topk_retention_{k}")
    def run(spark, sf):
        return metrics.topk_retention(pairs(spark, sf), "m", "t", k).select(r6("retention"))


for _k in (1, 5, 10):
    _retention(_k)


@query(_MT + ", a as (select avg(1.0::DOUBLE / rank) as m from mt where q = d), b as (select avg(1.0::DOUBLE / rank) as t from tt where q = d)" + f" select {_r('m')} as mrr_mapped, {_r('t')} as mrr_true, {_r('m - t')} as mrr_delta from a, b")
def mrr_delta(spark, sf):
    d = metrics.mrr_delta(pairs(spark, sf), "m", "t")
    return d.select(*[r6(c) for c in d.columns])


@query(_MT + f", c as (select avg(c) as mean, median(c) as median, quantile_cont(c, 0.05) as p5, min(c) as min, max(c) as max from (select list_dot_product(m, t) as c from pair)), r as (select avg((rank <= 1)::INT::DOUBLE) as r1, avg((rank <= 5)::INT::DOUBLE) as r5, avg((rank <= 10)::INT::DOUBLE) as r10, avg(1.0::DOUBLE / rank) as mrr from mt where q = d) select {_r('mean')} as mean, {_r('median')} as median, {_r('p5')} as p5, {_r('min')} as min, {_r('max')} as max, {_r('r1')} as top1_retention, {_r('r5')} as top5_retention, {_r('r10')} as top10_retention, {_r('mrr')} as mrr from c, r")
def retention_report(spark, sf):
    d = metrics.retention_report(pairs(spark, sf), "m", "t")
    return d.select(*[r6(c) for c in d.columns])


def _ranked(spark, sf, qcol: str = "m", k: int = 100) -> DataFrame:
    q, c = split(pairs(spark, sf))
    return knn.topk(q, c, k, ("id", qcol), ("id", "t"))


def _teacher(spark, sf) -> DataFrame:
    return _ranked(spark, sf, "t", 5).select("query_id", F.col("id").alias("doc_id"))


_EVAL = f"""with {PAIR}, {sims_sql('mt', 'm', 't', QUERY, CORPUS)}, {sims_sql('tt', 't', 't', QUERY, CORPUS)}, {sims_sql('xt', 'x', 't', QUERY, CORPUS)},
qrels as (select q, d from tt where rank <= 5), nrel as (select q, count(*) as n_rel from qrels group by q),
ideal as (select q, n_rel, list_sum(list_transform(range(least(10, n_rel)), lambda i: 1 / log2(i + 2))) as ideal from nrel)"""


def _per(rank: str) -> str:
    return f"""select i.q, i.n_rel, coalesce(sum(case when r.rank <= 10 then 1 / log2(r.rank + 1) end), 0) / i.ideal as ndcg_10,
  coalesce(sum((r.rank <= 10)::INT), 0) / i.n_rel::DOUBLE as recall_10, coalesce(sum((r.rank <= 100)::INT), 0) / i.n_rel::DOUBLE as recall_100
  from ideal i left join qrels g on g.q = i.q left join {rank} r on r.q = i.q and r.d = g.d and r.rank <= 100 group by i.q, i.n_rel, i.ideal"""


def _ranking_query(name: str) -> None:
    @query(_EVAL + f" select q as query_id, {_r(name)} as {name} from ({_per('mt')})", name={"ndcg_10": "ndcg_at_10", "recall_10": "recall_at_10", "recall_100": "recall_at_100"}[name])
    def run(spark, sf):
        return metrics.ranking_metrics(_ranked(spark, sf), _teacher(spark, sf)).select("query_id", r6(name))


for _name in ("ndcg_10", "recall_10", "recall_100"):
    _ranking_query(_name)


@query(_EVAL + f" select {_r('avg(ndcg_10)')} as ndcg_10, {_r('avg(recall_10)')} as recall_10, {_r('avg(recall_100)')} as recall_100, count(*) as n_eval from ({_per('mt')})")
def evaluate_macro(spark, sf):
    e = metrics.evaluate(_ranked(spark, sf), _teacher(spark, sf))
    return e.select(r6("ndcg_10"), r6("recall_10"), r6("recall_100"), "n_eval")


@query(f"""with {PAIR}, {sims_sql('mt', 'm', 't', QUERY, CORPUS)}, qrels as (select a.id as q, b.id as d from pair a join pair b on a.label = b.label where a.id % 100 = 0),
hits as (select g.q, count(*) as n_rel, sum((coalesce(r.rank, 1000) <= 10)::INT) as found from qrels g left join mt r on r.q = g.q and r.d = g.d group by g.q)
select {_r('avg(found / n_rel::DOUBLE)')} as recall_10, count(*) as n_eval from hits""")
def evaluate_label_qrels(spark, sf):
    """Judgements by equal label: a check of the plumbing, at chance level."""
    q, c = split(pairs(spark, sf))
    return metrics.evaluate_by_label(_ranked(spark, sf), q, c).select(r6("recall_10"), "n_eval")


@query(_EVAL + f", a as (select avg(ndcg_10) as x from ({_per('mt')})), b as (select avg(ndcg_10) as y from ({_per('tt')})), c as (select avg(ndcg_10) as z from ({_per('xt')})) select {_r('x')} as mapped, {_r('y')} as ceiling, {_r('z')} as floor, {_r('case when y > 1e-12 then x / y end')} as retention from a, b, c")
def retention_ratio(spark, sf):
    qrels = materialize(_teacher(spark, sf), "qrels")
    q, c = split(pairs(spark, sf))
    one = lambda col, name: metrics.evaluate(_ranked(spark, sf, col), qrels).select(F.col("ndcg_10").alias(name))
    floor = metrics.floor_metrics(q, c, qrels, ("id", "x"), ("id", "t")).select(F.col("ndcg_10").alias("floor"))
    row = one("m", "mapped").crossJoin(one("t", "ceiling")).crossJoin(floor)
    return row.select(r6("mapped"), r6("ceiling"), r6("floor"), r6(metrics.retention_ratio(F.col("mapped"), F.col("ceiling")), "retention"))


@query(_EVAL + f" select {_r('avg(ndcg_10)')} as ndcg_10, {_r('avg(recall_10)')} as recall_10, {_r('avg(recall_100)')} as recall_100, count(*) as n_eval from ({_per('xt')})")
def floor_metrics(spark, sf):
    """Retrieval across the spaces without any map."""
    q, c = split(pairs(spark, sf))
    f = metrics.floor_metrics(q, c, _teacher(spark, sf), ("id", "x"), ("id", "t"))
    return f.select(r6("ndcg_10"), r6("recall_10"), r6("recall_100"), "n_eval")


@query(_EVAL + f", a as (select avg(ndcg_10) as x from ({_per('mt')})), sx as (select q, d, sim, row_number() over (partition by q order by sim desc, d) as rank from (select a.id as q, b.id as d, round(list_dot_product(list_transform(range(64), lambda i: (case when (19 * (i + 59)) % 64 % 2 = 0 then 1 else -1 end)::DOUBLE * a.t[(19 * (i + 59)) % 64 + 1]), b.x), 9) as sim from pair a, pair b)), b as (select avg(ndcg_10) as s from ({_per('sx')})) select {_r('s')} as serve, {_r('s / x')} as serve_ratio from a, b")
def serve_direction(spark, sf):
    """New-space queries taken back by the inverse map, against the old corpus: 27 * 19 = 1 mod 64."""
    q, c = split(pairs(spark, sf))
    back = lambda j: F.when((j + 59) * 19 % 64 % 2 == 0, 1.0).otherwise(-1.0) * F.get(F.col("t"), (j + 59) * 19 % 64)
    inverse = q.withColumn("b", F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), back))
    qrels = materialize(_teacher(spark, sf), "qrels")
    serve = metrics.evaluate(knn.topk(inverse, c, 100, ("id", "b"), ("id", "x")), qrels).select(F.col("ndcg_10").alias("s"))
    row = serve.crossJoin(metrics.evaluate(_ranked(spark, sf), qrels).select(F.col("ndcg_10").alias("x")))
    return row.select(r6("s", "serve"), r6(metrics.retention_ratio(F.col("s"), F.col("x")), "serve_ratio"))


_RHO = "coalesce(corr(ra::DOUBLE, rb::DOUBLE), 0)"


_SOME = "in (select id from pair order by md5('0:' || id::VARCHAR), id limit 50)"


@query(f"with {PAIR}, {sims_sql('mt', 'm', 't', _SOME)}, {sims_sql('tt', 't', 't', _SOME)}, r as (select q, row_number() over (partition by q order by a.sim, d) as ra, row_number() over (partition by q order by b.sim, d) as rb from mt a join tt b using (q, d)) select q, {_r(_RHO)} as rho from r group by q")
def spearman_per_query(spark, sf):
    """Of 50 queries, drawn from all rows, as the operator's sample is."""
    p = pairs(spark, sf)
    return metrics.rank_correlation(p, p, ("m", "t"), ("t", "t")).select("q", r6("rho"))


@query(f"with {PAIR}, few as (select * from pair order by md5(id::VARCHAR), id limit 200), s as (select a.id as q, b.id as d, round(list_dot_product(a.m, b.m), 9) as sa, round(list_dot_product(a.t, b.t), 9) as sb from few a join few b on a.id < b.id), r as (select row_number() over (order by sa, q, d) as ra, row_number() over (order by sb, q, d) as rb from s) select {_r(_RHO)} as rho from r")
def holdout_rank_corr(spark, sf):
    few = pairs(spark, sf).orderBy(F.md5(F.col("id").cast("string")), "id").limit(200)
    return metrics.holdout_rank_correlation(few, "m", "t").select(r6("rho"))


@query(f"with {PAIR}, {sims_sql('mt', 'm', 't', QUERY, CORPUS)}, pen as (select d, avg(sim) as p from (select *, row_number() over (partition by d order by sim desc, q) as r from mt) where r <= 10 group by d), s as (select q, d, round(2 * sim - p, 9) as score from mt join pen using (d)), k as (select *, row_number() over (partition by q order by score desc, d) as rank from s) select q as query_id, rank::INT as rank, d as id, {_r('score')} as score from k where rank <= 10")
def csls_top10(spark, sf):
    q, c = split(pairs(spark, sf))
    return _hits(knn.csls(q, c, 10, 10, query_cols=("id", "m"), corpus_cols=("id", "t")), "score")


_ODD, _EVEN = ("in (select id from pair where id % 2 = 1 or id % 5 = 0)", "in (select id from pair where id % 2 = 0 or id % 5 = 0)")


@query(f"with {PAIR}, {sims_sql('a', 'm', 't', QUERY, _ODD)}, {sims_sql('b', 't', 't', QUERY, _EVEN)}, u as (select q, d, 0.5::DOUBLE * sim as s from a where rank <= 10 union all select q, d, sim from b where rank <= 10), m as (select q, d, greatest(0.0::DOUBLE, max(s)) as score from u group by q, d), k as (select *, row_number() over (partition by q order by score desc, d) as rank from m) select q as query_id, rank::INT as rank, d as id, {_r('score')} as score from k where rank <= 10")
def merge_results(spark, sf):
    """Hits of a store half migrated: the old part, the new part, and a fifth in both."""
    p = pairs(spark, sf)
    q, _ = split(p)
    legacy = knn.topk(q, p.where("id % 2 = 1 or id % 5 = 0"), 10, ("id", "m"), ("id", "t"))
    native = knn.topk(q, p.where("id % 2 = 0 or id % 5 = 0"), 10, ("id", "t"), ("id", "t"))
    score = lambda df: df.withColumnRenamed("sim", "score")
    return _hits(knn.merge_hits(score(legacy), score(native), 0.5, 1.0, 10), "score")


@query(f"with {PAIR}, {sims_sql('mt', 'm', 't', QUERY, CORPUS)}, {sims_sql('tt', 't', 't', QUERY, CORPUS)} select a.q as query_id, {_r('count(b.d) / 10.0::DOUBLE')} as overlap from (select * from mt where rank <= 10) a left join (select * from tt where rank <= 10) b on a.q = b.q and a.d = b.d group by a.q")
def neighbor_overlap(spark, sf):
    return metrics.neighbor_overlap(_ranked(spark, sf, "m", 10), _ranked(spark, sf, "t", 10)).select("query_id", r6("overlap"))


@query(f"with {PAIR}, {sims_sql('mt', 'm', 't')}, n as (select id, (select count(*) from mt where d = id and rank <= 10) as n from pair) select {_r('avg(n)')} as n_mean, max(n) as n_max, {_r('stddev_pop(n)')} as n_std, count_if(n = 0) as n_zero, {_r('(avg(n::DOUBLE ** 3) - 3 * avg(n) * avg(n::DOUBLE ** 2) + 2 * avg(n) ** 3) / stddev_pop(n) ** 3')} as n_skew from n")
def hubness_profile(spark, sf):
    p = pairs(spark, sf)
    h = metrics.hubness(knn.topk(p, p, 10, ("id", "m"), ("id", "t")), p)
    return h.select(r6("n_mean"), "n_max", r6("n_std"), "n_zero", r6("n_skew"))


@query(f"with {PAIR}, {sims_sql('mt', 'm', 't')} select d as id, count(*) as n from mt where rank <= 10 group by d order by n desc, d limit 10")
def top_hubs(spark, sf):
    p = pairs(spark, sf)
    return metrics.hub_counts(knn.topk(p, p, 10, ("id", "m"), ("id", "t")), p).orderBy(F.desc("n"), "id").limit(10)


_MARGIN = f"with {PAIR}, {sims_sql('mt', 'm', 't', QUERY, CORPUS)}, {sims_sql('tt', 't', 't', QUERY, CORPUS)}, g as (select q, max(case when rank = 1 then sim end) as top1, coalesce(max(case when rank = 1 then sim end) - max(case when rank = 2 then sim end), 0) as margin, count(*) as n from mt where rank <= 100 group by q), h as (select q, max(case when rank = 1 then sim end) as top1, coalesce(max(case when rank = 1 then sim end) - max(case when rank = 2 then sim end), 0) as margin from tt where rank <= 100 group by q), f as (select g.*, case when margin >= (select case when count(*) > 10 then quantile_cont(margin, 0.67) else 0.025 end from g) then 'high' when margin <= (select case when count(*) > 10 then quantile_cont(margin, 0.33) else 0.005 end from g) then 'low' else 'medium' end as confidence from g)"


@query(_MARGIN + f" select q as query_id, {_r('top1')} as top1, {_r('margin')} as margin, n as n_candidates from g")
def margin_top2(spark, sf):
    return metrics.margins(_ranked(spark, sf)).select("query_id", r6("top1"), r6("margin"), "n_candidates")


@query(_MARGIN + f" select q as query_id, {_r('margin')} as margin, confidence from f")
def confidence_flags(spark, sf):
    return metrics.confidence(_ranked(spark, sf)).select("query_id", r6("margin"), "confidence")


@query(_MARGIN + f" select count(*) as n, count_if(confidence = 'high') as n_high, count_if(confidence = 'medium') as n_medium, count_if(confidence = 'low') as n_low, {_r('avg(margin)')} as mean_margin, {_r('avg(top1)')} as mean_top1 from f")
def confidence_summary(spark, sf):
    return metrics.confidence_summary(metrics.confidence(_ranked(spark, sf))).select("n", "n_high", "n_medium", "n_low", r6("mean_margin"), r6("mean_top1"))


@query(_MARGIN + f" select {_r('avg(g.top1)')} as mapped_mean_top1, {_r('stddev_pop(g.top1)')} as mapped_std_top1, {_r('avg(g.margin)')} as mapped_mean_margin, {_r('stddev_pop(g.margin)')} as mapped_std_margin, {_r('avg(h.top1)')} as ceiling_mean_top1, {_r('stddev_pop(h.top1)')} as ceiling_std_top1, {_r('avg(h.margin)')} as ceiling_mean_margin, {_r('stddev_pop(h.margin)')} as ceiling_std_margin, count_if(g.margin < h.margin) as n_compressed, count(*) as n from g join h using (q)")
def score_distribution(spark, sf):
    d = metrics.score_distribution(_ranked(spark, sf), _ranked(spark, sf, "t"))
    return d.select(*[c if c.startswith("n") else r6(c) for c in d.columns])


_DRAW = "(('0x' || substr(md5('0:{0}:' || r::VARCHAR), 1, 8))::BIGINT % (select count(*) from pair))"


@query(f"with {PAIR}, num as (select *, row_number() over (order by id) - 1 as k from pair), dr as (select {_DRAW.format('a')} as ka, {_DRAW.format('b')} as kb from (select unnest(range(count(*))) as r from pair)), c as (select list_dot_product(a.t, b.t) as c from dr join num a on a.k = ka join num b on b.k = kb), v as (select var_pop(list_dot_product(m, t)) as v from pair) select {_r('max(v.v) / var_pop(c.c)')} as compression from c, v")
def margin_compression(spark, sf):
    return gate.margin_compression(pairs(spark, sf), "m", "t").select(r6("compression"))


_DIAG = _EVAL + """, best as (select g.q, min(r.rank) - 1 as mapped_rank, max(r.sim) as best from qrels g left join mt r on r.q = g.q and r.d = g.d and r.rank <= 100 group by g.q),
ceil as (select g.q, min(r.rank) - 1 as ceiling_rank from qrels g left join tt r on r.q = g.q and r.d = g.d and r.rank <= 100 group by g.q),
other as (select r.q, max(r.sim) as other from mt r where rank <= 100 and not exists (select 1 from qrels g where g.q = r.q and g.d = r.d) group by r.q),
diag as (select q, mapped_rank::INT as mapped_rank, ceiling_rank::INT as ceiling_rank, best - other as margin, coalesce(mapped_rank >= 10, true) as failed, case when best > 0.9 then 'high' when best > 0.7 then 'medium' else 'low' end as band from best join ceil using (q) left join other using (q))"""


@query(_DIAG + f" select q as query_id, mapped_rank, ceiling_rank, {_r('margin')} as margin, failed, band from diag")
def failure_diagnosis(spark, sf):
    d = metrics.failure_diagnosis(_ranked(spark, sf), _ranked(spark, sf, "t"), _teacher(spark, sf))
    return d.select("query_id", F.col("mapped_rank").cast("int"), F.col("ceiling_rank").cast("int"), r6("margin"), "failed", "band")


@query(_DIAG + " select band, failed, count(*) as n from diag group by band, failed")
def failure_bands(spark, sf):
    return metrics.failure_diagnosis(_ranked(spark, sf), _ranked(spark, sf, "t"), _teacher(spark, sf)).groupBy("band", "failed").agg(F.count("*").alias("n"))


# --- maps --------------------------------------------------------------------

_FORWARD = f"list_transform(range({DIMS}), lambda j: (case when j % 2 = 0 then 1 else -1 end)::DOUBLE * x[(27 * j + 5) % {DIMS} + 1])"


@query(f"with {EMB} select id, {_text_sql(_FORWARD)} as mapped from emb")
def transform_fixed(spark, sf):
    return mapping.transform_sql(embeddings(spark, sf), "x", fixed_map(spark), DIMS).select("id", _text(F.col("mapped")).alias("mapped"))


def _fixed(spark) -> mapping.Mapping:
    import numpy as np

    w = np.zeros((DIMS, DIMS))
    for j in range(DIMS):
        w[(27 * j + 5) % DIMS, j] = 1 if j % 2 == 0 else -1
    return mapping.Mapping("procrustes", w, w.T)


@query(f"with {PAIR} select id, {_text_sql('m')} as mapped from pair")
def transform_arrow(spark, sf):
    """The same map as a block product in Arrow batches: the fast path, normalised."""
    return _fixed(spark).transform(embeddings(spark, sf).select("id", "x"), "x", "mapped").select("id", _text(F.col("mapped")).alias("mapped"))


@query(f"with {EMB}, w as (select i, j, ((i * 31 + j * 17) % 13 - 6) / 16.0::DOUBLE as w from range(64) a(i), range(8) b(j)), c as (select id, unnest(range(64)) as i, unnest(x) as v from emb) select id, j::INT as j, {_r('sum(v * w)')} as value from c join w using (i) group by id, j")
def transform_dense(spark, sf):
    w = spark.range(64).select(F.col("id").alias("i")).crossJoin(spark.range(8).select(F.col("id").alias("j"))).select("i", F.col("j").cast("int"), (((F.col("i") * 31 + F.col("j") * 17) % 13 - 6) / F.lit(16.0)).alias("w"))
    out = mapping.transform_sql(embeddings(spark, sf), "x", w, 8)
    return out.select("id", F.posexplode("mapped").alias("j", "v")).select("id", "j", r6("v", "value"))


@query(f"with {EMB} select id, {_text_sql('list_transform(x, lambda e: e / greatest(sqrt(list_dot_product(x, x)), 1e-12::DOUBLE))')} as vec from emb")
def inverse_fixed(spark, sf):
    m = _fixed(spark)
    there = m.transform(embeddings(spark, sf).select("id", "x"), "x", "there")
    return m.map_queries(there.select("id", "there"), "there").select("id", _text(F.col("there")).alias("vec"))


_THERE_AND_BACK = f"list_transform(range({DIMS}), lambda i: x[i + 1] * (1 + (19 * (i + 59)) % {DIMS} % 3) ** 2)"


@query(f"with {EMB}, c as (select list_cosine_similarity(x, {_THERE_AND_BACK}) as s from emb) select {_r('avg(s)')} as mean, {_r('median(s)')} as median, {_r('stddev_pop(s)')} as std, {_r('min(s)')} as min, {_r('max(s)')} as max, count(*) as n from c")
def round_trip_quality(spark, sf):
    """There by a permutation that stretches some dimensions, and back by its transpose, which stretches them again."""
    w = _fixed(spark).weights * [1 + j % 3 for j in range(DIMS)]
    s = protocol.similarity_summary(protocol.round_trip(embeddings(spark, sf), mapping.Mapping("protocol", w, w.T, normalize_output=False)))
    return s.select(*[r6(c) for c in ("mean", "median", "std", "min", "max")], "n")


@query("with a as (select i, j, ((i * 31 + j * 17) % 13 - 6) / 16.0::DOUBLE as w from range(16) a(i), range(16) b(j)) select x.i::INT as i, y.i::INT as j, " + _r("sum(x.w * y.w)") + " as w from a x join a y on x.j = y.j group by x.i, y.i")
def matrix_product(spark, sf):
    a = spark.range(16).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(16).select(F.col("id").cast("int").alias("j"))).select("i", "j", (((F.col("i") * 31 + F.col("j") * 17) % 13 - 6) / F.lit(16.0)).alias("w"))
    return protocol.matrix_multiply(a, protocol.transpose(a)).select("i", "j", r6("w"))


def _gram_sql(a: str, b: str, n: int) -> str:
    return f"with {PAIR}, c as (select id, unnest(range({n})) as i, unnest({a}[1:{n}]) as u from pair), e as (select id, unnest(range({n})) as j, unnest({b}[1:{n}]) as v from pair) select i::INT as i, j::INT as j, {_r('sum(u * v)')} as value from c join e using (id) group by i, j"


def _cells(spark, block) -> DataFrame:
    cells = [(i, j, float(v)) for i, row in enumerate(block) for j, v in enumerate(row)]
    return spark.createDataFrame(cells, "i int, j int, value double").select("i", "j", r6("value"))


@query(_gram_sql("x", "x", DIMS))
def gram_matrix(spark, sf):
    return _cells(spark, gram(pairs(spark, sf), ["x"])[0])


@query(_gram_sql("x", "y", DIMS))
def cross_gram(spark, sf):
    return _cells(spark, gram(pairs(spark, sf), ["x", "y"])[0][:DIMS, DIMS:])


@query(_gram_sql("x", "x", DIMS))
def gram_declared(spark, sf):
    """The Gram matrix by sums of products alone."""
    return gram_sql(pairs(spark, sf), "x").select("i", "j", r6("value"))


@query(f"with {EMB}, c as (select unnest(range({DIMS})) as j, unnest(x) as v from emb) select j::INT as j, {_r('avg(v)')} as mean, {_r('stddev_pop(v)')} as spread from c group by j")
def column_means(spark, sf):
    return embeddings(spark, sf).select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(r6(F.avg("v"), "mean"), r6(F.stddev_pop("v"), "spread"))


@query(f"with {EMB}, c as (select id, unnest(range({DIMS})) as j, unnest(x) as v from emb), s as (select j, avg(v) as m, stddev_pop(v) as s from c group by j) select id, j::INT as j, {_r('(v - m) / greatest(s, 1e-12)')} as value from c join s using (j)")
def whiten_center(spark, sf):
    w = mapping.standardize(embeddings(spark, sf), "x", DIMS, whiten=True)
    return w.select("id", F.posexplode("vec").alias("j", "v")).select("id", "j", r6("v", "value"))


# --- recalibration and gate ---------------------------------------------------

_POINTS = ([0.0, 0.25, 0.5, 0.5, 0.8, 1.0], [0.1, 0.1, 0.3, 0.4, 0.9, 0.95])


def _interp_sql(x: str, xs: list[float], ys: list[float]) -> str:
    parts = [f"when {x} <= {xs[0]!r}::DOUBLE then {ys[0]!r}::DOUBLE"]
    for a, b, c, d in zip(xs, ys, xs[1:], ys[1:]):
        if c > a:
            parts.append(f"when {x} < {c!r}::DOUBLE then {b!r}::DOUBLE + ({x} - {a!r}::DOUBLE) * ({d - b!r}::DOUBLE / {c - a!r}::DOUBLE)")
    return f"case {' '.join(parts)} else {ys[-1]!r}::DOUBLE end"


_GRID = "grid as (select i, i / 40.0::DOUBLE - 0.125 as v from range(51) t(i))"


def _grid(spark) -> DataFrame:
    return spark.range(51).select(F.col("id").alias("i"), (F.col("id") / F.lit(40.0) - 0.125).alias("v"))


@query(f"with {_GRID} select i, {_r(_interp_sql('v', *_POINTS))} as score from grid")
def isotonic_apply(spark, sf):
    return _grid(spark).select("i", r6(recalibration.recalibrated(F.col("v"), _POINTS), "score"))


_GM = gate.DEFAULT
_PRED = f"grid as (select i, k, 0.8::DOUBLE + i / 200.0::DOUBLE as top1, k / 10.0::DOUBLE as mc from range(41) a(i), range(13) b(k)), p as (select *, {_interp_sql('top1', _GM.xs, _GM.ys)} as p, {_GM.half_width!r}::DOUBLE + case when mc < 0.85 then (0.85 - mc) * 0.5 else 0 end as h from grid), b as (select *, greatest(0, p - h) as lo, least(1, p + h) as hi from p)"


def _predicted(spark) -> DataFrame:
    grid = spark.range(41).select(F.col("id").alias("i")).crossJoin(spark.range(13).select(F.col("id").alias("k")))
    grid = grid.withColumn("top1", F.lit(0.8) + F.col("i") / F.lit(200.0)).withColumn("mc", F.col("k") / F.lit(10.0))
    p, lo, hi = gate.predict(F.col("top1"), F.col("mc"))
    return grid.select("i", "k", p.alias("p"), lo.alias("lo"), hi.alias("hi"))


@query(f"with {_PRED} select i, k, {_r('p')} as predicted, {_r('lo')} as lower, {_r('hi')} as upper from b")
def gate_predict_curve(spark, sf):
    return _predicted(spark).select("i", "k", r6("p", "predicted"), r6("lo", "lower"), r6("hi", "upper"))


@query(f"with {_PRED} select i, k, case when lo >= 0.75 then 'PASS' when hi < 0.55 then 'FAIL' else 'WARN' end as verdict from b")
def gate_verdict_grid(spark, sf):
    return _predicted(spark).select("i", "k", gate.verdict(F.col("lo"), F.col("hi")).alias("verdict"))


def _scores(spark, sf) -> DataFrame:
    return materialize(recalibration.score_pairs(pairs(spark, sf), "m", "t"), "scores")


def _score_means(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), r6(F.avg("mapped"), "mean_mapped"), r6(F.avg("ceiling"), "mean_ceiling"), r6(F.corr("mapped", "ceiling"), "correlation"))


def _agreement(scores: DataFrame) -> DataFrame:
    return recalibration.threshold_agreement(scores, F.round("mapped", 9), F.round("ceiling", 9)).select("threshold", r6("agreement"))


_SCORES = f"""with {PAIR}, num as (select *, row_number() over (order by id) - 1 as k from pair), {sims_sql('near', 'm', 't')},
draw as (select {_DRAW.format('q')} as kq, {_DRAW.format('d')} as kd from (select unnest(range(least(50000, count(*) * count(*)))) as r from pair)),
chosen as (select a.id as q, b.id as d from draw join num a on a.k = kq join num b on b.k = kd union all select q, d from near where rank <= 20),
scores as (select c.q, c.d, list_dot_product(a.m, b.t) as mapped, list_dot_product(a.t, b.t) as ceiling from chosen c join pair a on a.id = c.q join pair b on b.id = c.d)"""


@query(_SCORES + f" select count(*) as n, {_r('avg(mapped)')} as mean_mapped, {_r('avg(ceiling)')} as mean_ceiling, {_r('corr(mapped, ceiling)')} as correlation from scores")
def score_pairs(spark, sf):
    return _score_means(_scores(spark, sf))


@query(_SCORES + f", tau as (select unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) as threshold) select threshold, {_r('avg(((round(mapped, 9) >= threshold) = (round(ceiling, 9) >= threshold))::INT::DOUBLE)')} as agreement from scores, tau group by threshold")
def threshold_agreement(spark, sf):
    return _agreement(_scores(spark, sf))


@query(_SCORES + f", top as (select mapped as s from scores order by mapped desc limit 20), d as (select s, s - lag(s) over (order by s) as gap from top) select {_r('avg(gap)')} as gap from d")
def top20_margin(spark, sf):
    return recalibration.top_gap(_scores(spark, sf), F.col("mapped")).select(r6("gap"))


_CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


@query(_MT + f", r as (select q as id, rank from mt where q = d), dr as (select b, rank, ('0x' || substr(md5('0:' || b::VARCHAR || ':' || id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE as u from r, range(1, 1001) t(b)), w as (select b, rank, {' + '.join(f'(u >= {c!r}::DOUBLE)::INT' for c in _CUTS)} as w from dr), p as (select b, sum((rank <= 1)::INT * w) / sum(w)::DOUBLE as recall_1, sum((rank <= 5)::INT * w) / sum(w)::DOUBLE as recall_5, sum((rank <= 10)::INT * w) / sum(w)::DOUBLE as recall_10, sum(w / rank::DOUBLE) / sum(w) as mrr from w group by b), l as (unpivot p on recall_1, recall_5, recall_10, mrr into name metric value v) select metric, {_r('quantile_cont(v, 0.1)')} as low, {_r('quantile_cont(v, 0.9)')} as high from l group by metric")
def bootstrap_ci(spark, sf):
    ranks = knn.self_ranks(pairs(spark, sf), "m", "t")
    return gate.bootstrap(ranks).select("metric", r6("low"), r6("high"))
