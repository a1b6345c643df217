"""The query catalogue, third part: fitted maps, the gate, and other results that need a system solved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.operators import analysis, calibration, gate, mapping, metrics, protocol, recalibration
from meridian.plans.catalog import _DRAW, _GM, _MT, _interp_sql, _r, _scores, query, r6
from meridian.plans.catalog_ops import _RUNS_SQL, _runs
from meridian.plans.fixtures import DIMS, PAIR, pairs, table
from meridian.plans.materialize import materialize
from meridian.plans.sql_algebra import augmented, columns_of, gauss, polar
from meridian.streaming import pipelines

_SPLIT = """parts as (select *, row_number() over (order by md5('1:' || id::VARCHAR), id) > ceil(round((select count(*) from pair) * {0}::DOUBLE * 1e9) / 1e9) as train from pair),
tr as (select *, list_append(x, 1.0::DOUBLE) as x1, list_append(y, 1.0::DOUBLE) as y1 from parts where train), te as (select *, list_append(x, 1.0::DOUBLE) as x1 from parts where not train)"""
_REPORT = ("mean", "median", "p5", "min", "max", "top1_retention", "top5_retention", "top10_retention", "mrr")


def _report_sql(vector: str, alpha: str) -> str:
    """The retention report of the held-out rows under the map whose columns are ``w`` (key, j, col)."""
    return f"""mapped as (select id, any_value(t) as t, list(list_dot_product({vector}, col) order by j) as w0 from te, w group by id),
unit as (select id, t, list_transform(w0, lambda e: e / greatest(sqrt(list_dot_product(w0, w0)), 1e-12::DOUBLE)) as w from mapped),
sims as (select a.id as q, b.id as d, round(list_dot_product(a.w, b.t), 9) as sim from unit a, unit b),
ranked as (select q, d, row_number() over (partition by q order by sim desc, d) as rank from sims), own as (select rank from ranked where q = d),
cosines as (select avg(c) as mean, median(c) as median, quantile_cont(c, 0.05) as p5, min(c) as min, max(c) as max from (select list_dot_product(w, t) as c from unit)),
kept as (select avg((rank <= 1)::INT::DOUBLE) as top1_retention, avg((rank <= 5)::INT::DOUBLE) as top5_retention, avg((rank <= 10)::INT::DOUBLE) as top10_retention, avg(1.0::DOUBLE / rank) as mrr from own)
select {', '.join(f'{_r(c)} as {c}' for c in _REPORT)}, {alpha} as alpha from cosines, kept"""


def _fit_query(name: str, kind: str, sql: str | None = None, **options) -> None:
    @query(sql, name=name)
    def run(spark, sf):
        """Fit on two thirds of the pairs and measure on the rest."""
        p = materialize(calibration.holdout(pairs(spark, sf), 1 / 3, 1), "split")
        m = mapping.fit(kind, p.where("not is_holdout").select("id", "x", "y"), **options)
        mapped = m.transform(p.where("is_holdout").select("id", "x", "t"), "x", "w")
        return metrics.retention_report(mapped, "w", "t").select(*[r6(c) for c in _REPORT], r6(F.lit(m.alpha).cast("double"), "alpha"))


_THIRD = f"with recursive {PAIR}, {_SPLIT.format('(1.0::DOUBLE / 3)')}"
_HALF = "alphas as (select 0 as key, 0.5::DOUBLE as alpha)"
_fit_query("ridge_fit", "ridge", f"{_THIRD}, {_HALF}, {augmented('g', 'tr', 'x1', 'y', DIMS + 1, DIMS, 'alphas')}, {gauss('g', DIMS + 1)}, {columns_of('w', 'g', DIMS + 1, DIMS + 2, 2 * DIMS + 1)}, {_report_sql('x1', '0.5::DOUBLE')}", alpha=0.5)
_fit_query("procrustes_fit", "procrustes", f"{_THIRD}, {polar('o', 'tr', 'x', 'y', DIMS)}, w as (select * from o_w), {_report_sql('x', 'null::DOUBLE')}")
_SCALED = """turned as (select id, any_value(y) as y, list(list_dot_product(x, col) order by j) as r from tr, o_w group by id),
factors as (select j, sum(r[j] * y[j]) / greatest(sum(r[j] * r[j]), 1e-8) as s from turned, range(1, 65) t(j) group by j),
w as (select 0 as key, j, list_transform(col, lambda v: v * s) as col from o_w join factors using (j))"""
_fit_query("procrustes_diag_fit", "procrustes_diag", f"{_THIRD}, {polar('o', 'tr', 'x', 'y', DIMS)}, {_SCALED}, {_report_sql('x', 'null::DOUBLE')}")
_fit_query("lstsq_protocol", "protocol", f"{_THIRD}, alphas as (select 0 as key, greatest(1e-4 * (select count(*) from tr) / 1000, 1e-10::DOUBLE) as alpha), {augmented('g', 'tr', 'x', 'y', DIMS, DIMS, 'alphas')}, {gauss('g', DIMS)}, {columns_of('w', 'g', DIMS, DIMS + 1, 2 * DIMS)}, {_report_sql('x', 'null::DOUBLE')}")
_ALPHAS = "alphas as (select k as key, 10.0::DOUBLE ** (k / 4.0::DOUBLE - 3) as alpha from range(25) t(k))"
_LOO = f"""{columns_of('every', 'g', DIMS + 1, DIMS + 2, 2 * DIMS + 1)}, {columns_of('inverse', 'g', DIMS + 1, 2 * DIMS + 2, 3 * DIMS + 2)},
leverage as (select key, id, list_dot_product(any_value(x1), list(list_dot_product(x1, col) order by j)) as h from tr, inverse group by key, id),
misses as (select e.key, sum(((tr.y[e.j] - list_dot_product(tr.x1, e.col)) / (1 - h)) ** 2) as e from tr, every e join leverage l on l.key = e.key where l.id = tr.id group by e.key),
best as (select key, alpha from misses join alphas using (key) order by e, key limit 1), w as (select j, col from every join best using (key))"""
_fit_query("ridge_auto_alpha", "ridge", f"{_THIRD}, {_ALPHAS}, {augmented('g', 'tr', 'x1', 'y', DIMS + 1, DIMS, 'alphas', identity=True)}, {gauss('g', DIMS + 1)}, {_LOO}, {_report_sql('x1', _r('(select alpha from best)'))}")
_fit_query("lowrank_fit", "lowrank", rank=32, alpha=0.5)
_fit_query("mlp_fit", "mlp")


@query()
def residual_spectrum(spark, sf):
    p = materialize(pairs(spark, sf), "pairs")
    return analysis.residual_spectrum(p.select("id", "x", "y"), mapping.fit_ridge(p, alpha=0.5))


@query(f"""with recursive {PAIR}, {_ALPHAS}, {augmented('g', 'pair', 'x', 'y', DIMS, DIMS, 'alphas')}, {gauss('g', DIMS)}, {columns_of('every', 'g', DIMS, DIMS + 1, 2 * DIMS)},
errors as (select key, j, avg((y[j] - list_dot_product(x, col)) ** 2) as e from pair, every group by key, j), totals as (select key, avg(e) as mse from errors group by key),
firsts as (select j, arg_min(key, (e, key)) as key from errors group by j), counted as (select key, count(*) as n from firsts group by key)
select {_r('alpha')} as alpha, {_r('mse')} as mse, mse <= 1.05 * (select min(mse) from totals) as within_5pct, coalesce(n, 0)::INT as n_best_dims from totals join alphas using (key) left join counted using (key)""")
def alpha_curve(spark, sf):
    return analysis.alpha_curve(pairs(spark, sf)).select(r6("alpha"), r6("mse"), "within_5pct", "n_best_dims")


_TRIP = f"""{_SPLIT.format('0.2')}, alphas as (select 0 as key, greatest(1e-4 * (select count(*) from tr) / 1000, 1e-10::DOUBLE) as alpha),
{augmented('g', 'tr', 'x', 'y', DIMS, DIMS, 'alphas')}, {gauss('g', DIMS)}, {columns_of('there', 'g', DIMS, DIMS + 1, 2 * DIMS)},
{augmented('b', 'tr', 'y', 'x', DIMS, DIMS, 'alphas')}, {gauss('b', DIMS)}, {columns_of('back', 'b', DIMS, DIMS + 1, 2 * DIMS)},
gone as (select id, any_value(train) as train, any_value(x) as x, list(list_dot_product(x, col) order by j) as v from parts, there group by id),
came as (select id, any_value(train) as train, any_value(x) as x, list(list_dot_product(v, col) order by j) as u from gone, back group by id),
trips as (select train, list_cosine_similarity(x, u) as s from came)"""


@query(f"""with recursive {PAIR}, {_TRIP} select p.*, {_r('(select avg(s) from trips where train)')} as training, {_r('(select avg(s) from trips where not train)')} as quality, {_r('(select min(s) from trips where not train)')} as worst, {DIMS} as d_src, {DIMS} as d_tgt, true as valid
from (values ('a', 'b'), ('b', 'a')) p(source, target)""")
def protocol_calibrate(spark, sf):
    p = materialize(calibration.holdout(pairs(spark, sf).select("id", "x", "y"), 0.2, 1), "split")
    models, _ = protocol.calibrate(spark, p.where("not is_holdout"), p.where("is_holdout"), "a", "b", 0.5)
    return models.select("source", "target", r6("training"), r6("quality"), r6("worst"), F.size("weights").alias("d_src"), F.size(F.col("weights")[0]).alias("d_tgt"), (F.col("valid_until") > F.col("created")).alias("valid"))


# --- the gate ----------------------------------------------------------------

_GATE = f"""{_MT}, ranks as (select count(*) as n, avg((rank <= 1)::INT::DOUBLE) as top1, avg((rank <= 10)::INT::DOUBLE) as top10, avg(1.0::DOUBLE / rank) as mrr from mt where q = d),
cosines as (select avg(c) as mean, median(c) as median, quantile_cont(c, 0.05) as p5, min(c) as min, max(c) as max, var_pop(c) as v from (select list_dot_product(m, t) as c from pair)),
num as (select *, row_number() over (order by id) - 1 as k from pair), dr as (select {_DRAW.format('a')} as ka, {_DRAW.format('b')} as kb from range((select count(*) from pair)) t(r)),
random as (select var_pop(list_dot_product(a.t, b.t)) as r from dr join num a on a.k = ka join num b on b.k = kb),
few as (select * from pair order by md5(id::VARCHAR), id limit 200),
s2 as (select a.id as q, b.id as d, round(list_dot_product(a.m, b.m), 9) as sa, round(list_dot_product(a.t, b.t), 9) as sb from few a join few b on a.id < b.id),
r2 as (select row_number() over (order by sa, q, d) as ra, row_number() over (order by sb, q, d) as rb from s2), rho as (select coalesce(corr(ra::DOUBLE, rb::DOUBLE), 0) as rank_correlation from r2),
row1 as (select *, v / r as compression from ranks, cosines, random, rho),
row2 as (select *, {_interp_sql('top1', _GM.xs, _GM.ys)} as predicted, {_GM.half_width!r}::DOUBLE + case when compression < 0.85 then (0.85 - compression) * 0.5 else 0 end as half from row1),
row3 as (select *, greatest(0.0::DOUBLE, predicted - half) as lower, least(1.0::DOUBLE, predicted + half) as upper from row2)"""
_GATED = ("mean", "median", "p5", "min", "max", "top1", "top10", "mrr", "compression", "rank_correlation", "predicted", "lower", "upper", "optimism_gap")


@query(f"""{_GATE}, row4 as (select *, 0.99::DOUBLE - top1 as optimism_gap from row3) select n, {', '.join(f'{_r(c)} as {c}' for c in _GATED)}, optimism_gap > 0.2 as optimism_exceeded, mean >= 0.6 as cosine_ok,
case when lower >= 0.75 then 'PASS' when upper < 0.55 then 'FAIL' else 'WARN' end as verdict, case when top1 >= 0.75 then 'PASS' when top1 < 0.55 then 'FAIL' else 'WARN' end as raw_verdict,
case when compression < 0.8 then 'recalibrate score thresholds: margins are compressed to ' || printf('%.2f', compression) end as recommendation from row4""")
def gate_report(spark, sf):
    """With the top-1 retention of a holdout, from which the optimism gap is measured."""
    return gate.evaluate(pairs(spark, sf), "m", "t", holdout_top1=0.99).select("n", *[r6(c) for c in _GATED], "optimism_exceeded", "cosine_ok", "verdict", "raw_verdict", "recommendation")


# --- isotonic fits -----------------------------------------------------------


def _isotonic_sql(source: str) -> str:
    """CTEs that end in ``fitted`` (key, x, y): the non-decreasing least-squares fit of ``source`` (key, x, y) by the max-min formula."""
    return f"""level as (select key, x, sum(y) as s, count(*) as c from {source} group by key, x),
sums as (select key, x, row_number() over w as k, sum(s) over w as s, sum(c) over w as c from level window w as (partition by key order by x)),
spans as (select a.key, a.k as low, b.k as high, (b.s - coalesce(p.s, 0)) / (b.c - coalesce(p.c, 0)) as mean from sums a join sums b on a.key = b.key and b.k >= a.k left join sums p on p.key = a.key and p.k = a.k - 1),
least_of as (select key, low, high, min(mean) over (partition by key, low order by high desc rows unbounded preceding) as m from spans),
fitted as (select l.key, s.x, max(l.m) as y from least_of l join sums s on s.key = l.key and s.k = l.high group by l.key, s.k, s.x)"""


_OWN = "own as (select 0 as key, round(list_cosine_similarity(x, y), 9) as x, list_dot_product(m, t) as y from pair)"


@query(f"with {PAIR}, {_OWN}, {_isotonic_sql('own')} select id, {_r('f.y')} as fitted from pair join fitted f on f.x = round(list_cosine_similarity(pair.x, pair.y), 9)")
def isotonic_own_pairs(spark, sf):
    """The fit of the paired cosines after mapping on those before, at every row."""
    from meridian.functions import vec

    p = pairs(spark, sf).select("id", F.round(vec.cosine(F.col("x"), F.col("y")), 9).alias("mapped"), vec.cosine(F.col("m"), F.col("t")).alias("ceiling"))
    points = recalibration.fit_isotonic(p)
    return p.select("id", r6(recalibration.recalibrated(F.col("mapped"), points), "fitted"))


@query()
def isotonic_fit(spark, sf):
    xs, ys = recalibration.fit_isotonic(_scores(spark, sf))
    return spark.createDataFrame(list(zip(range(len(xs)), xs, ys)), "k int, x double, y double")


@query()
def recal_report(spark, sf):
    s = _scores(spark, sf)
    return recalibration.report(s, recalibration.fit_isotonic(s))


_LEFT_OUT = f"""with {_RUNS_SQL}, kept as (select o.adapter as key, r.top1 as x, r.retention as y from (select distinct adapter from runs) o join runs r on r.adapter <> o.adapter), {_isotonic_sql('kept')},
judged as (select r.adapter as pair, r.top1, r.retention,
  (select arg_max((f.x, f.y), f.x) from fitted f where f.key = r.adapter and f.x <= r.top1) as low, (select arg_min((f.x, f.y), f.x) from fitted f where f.key = r.adapter and f.x >= r.top1) as high from runs r),
res as (select pair, retention - case when low is null then high[2] when high is null then low[2] when low[1] = high[1] then low[2] else low[2] + (top1 - low[1]) * ((high[2] - low[2]) / (high[1] - low[1])) end as residual from judged),
placed as (select *, row_number() over (order by abs(residual)) - 1 as k, count(*) over () as n from res)"""


@query(f"{_LEFT_OUT} select max(n) as n, {_r('avg(abs(residual))')} as mae, {_r('sqrt(avg(residual * residual))')} as rmse, {_r('max(case when k = floor(0.8 * n) then abs(residual) end)')} as half_width_80, {_r('avg(residual)')} as mean_residual, {_r('stddev_pop(residual)')} as std_residual from placed")
def lopo_errors(spark, sf):
    d = analysis.residual_summary(analysis.leave_one_out(_runs(spark), "adapter"))
    return d.select("n", *[r6(c) for c in ("mae", "rmse", "half_width_80", "mean_residual", "std_residual")])


# --- circuit breakers --------------------------------------------------------


def _calls(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("seq"))


@query("""with recursive calls as (select user_id as source, epoch_us(ts) // 1000 as ms, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as called, event_type <> 'error' as ok, row_number() over (partition by user_id order by ts, event_id) as n from events),
walk as (select source, 0::BIGINT as n, null::VARCHAR as called, null::BOOLEAN as ok, true as allowed, 'CLOSED' as state, 0 as failures, 0::BIGINT as last, 0 as tries from (select distinct source from calls)
union all select source, n, called, ok, not shut, case when shut then s when ok then 'CLOSED' when s = 'HALF_OPEN' or failures >= 4 then 'OPEN' else s end,
  case when shut then failures when ok then 0 else failures + 1 end, case when shut or ok then last else ms end, tries + (not shut and s = 'HALF_OPEN')::INT
from (select *, s = 'OPEN' or (s = 'HALF_OPEN' and tries >= 1) as shut from (
  select c.source, c.n, c.called, c.ok, c.ms, w.failures, w.last, case when w.state = 'OPEN' and c.ms - w.last >= 60000 then 'HALF_OPEN' else w.state end as s, case when w.state = 'OPEN' and c.ms - w.last >= 60000 then 0 else w.tries end as tries
  from walk w join calls c on c.source = w.source and c.n = w.n + 1)))
select source, called, ok, allowed, state, failures from walk where n > 0""")
def circuit_breaker_states(spark, sf):
    return pipelines.breaker_states(_calls(spark, sf)).select("source", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("called"), "ok", "allowed", "state", "failures")
