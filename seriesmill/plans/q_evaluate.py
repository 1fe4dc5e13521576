"""Queries on point metrics, thresholds, calibration and completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import evaluate as me
from seriesmill.operators import events as ev
from seriesmill.plans.twin import TRUTH_SQL, Registry, big, r6, rounded, runs_sql, sql
from seriesmill.sources.points import points

registry = Registry()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES

_LEVELS = """lv as (select dataset, v as score, sum(y) as pos, count(*) as n from pts group by 1, 2),
lw as (select *, sum(pos) over d as tp, sum(n) over d as pp, sum(pos) over (partition by dataset) as p, sum(n) over (partition by dataset) as total from lv
  window d as (partition by dataset order by score desc rows unbounded preceding))"""


@registry(sql(_LEVELS, select=f"select dataset, {r6('sum(pos * (total - pp - (p - tp) + (n - pos) / 2e0)) / (max(p)::double * (max(total) - max(p)))')} as auroc from lw group by 1"))
def auroc(spark, sf_dir):
    return rounded(me.auroc(points(spark, sf_dir), ("dataset",)))


@registry(sql(_LEVELS, select=f"select dataset, {r6('sum(pos::double / p * tp / pp)')} as auprc from lw group by 1"))
def avg_precision(spark, sf_dir):
    return rounded(me.average_precision(points(spark, sf_dir), ("dataset",)))


def _prf_sql(hit: str, keys: str) -> str:
    return f"""select {keys}, {r6("p")} as precision, {r6("r")} as recall, {r6("case when p + r > 0 then 2 * p * r / (p + r) else 0 end")} as f1 from (select {keys}, case when sum(h) > 0 then sum(h * y)::double / sum(h) else 0 end as p,
 case when sum(y) > 0 then sum(h * y)::double / sum(y) else 0 end as r from (select *, case when {hit} then 1 else 0 end as h from pts) group by {keys})"""


@registry(sql(select=_prf_sql("v >= 30", "dataset")))
def prf_at_threshold(spark, sf_dir):
    return rounded(me.prf_at(points(spark, sf_dir), 30.0, ("dataset",)))


@registry(sql(select=_prf_sql("v >= 30", "series_id")))
def per_series_point_metrics(spark, sf_dir):
    return rounded(me.prf_at(points(spark, sf_dir), 30.0, ("series_id",)))


_BEST = """c as (select *, row_number() over (partition by dataset order by score) as i, lead(tp) over (partition by dataset order by score) as tp1, lead(pp) over (partition by dataset order by score) as pp1 from lw),
f as (select *, case when pp1 is null then 1 else tp1::double / pp1 end as pr, case when pp1 is null then 0 else tp1::double / p end as re from c),
b as (select dataset, score, i, round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end, 12) as f1 from f)"""


@registry(sql(_LEVELS, _BEST, select=f"select dataset, {r6('score')} as threshold, {r6('f1')} as f1 from (select *, row_number() over (partition by dataset order by f1 desc, i) as k from b) where k = 1"))
def best_f1_reference(spark, sf_dir):
    return rounded(me.best_f1_reference(points(spark, sf_dir), ("dataset",)))


@registry(sql("e as (select dataset, min(v) as lo, max(v) as hi from pts group by 1)", select=f"select dataset, k, {r6('lo + (hi - lo) * k / 24e0')} as threshold from e, lateral (select unnest(generate_series(0::bigint, case when hi > lo then 24 else 0 end)) as k)"))
def grid_linear(spark, sf_dir):
    return rounded(me.linear_grid(points(spark, sf_dir), 25, ("dataset",)))


_QGRID = "qg as (select dataset, unnest(list_distinct(list_transform(quantile_cont(v, [{levels}]), lambda x: round(x, 9)))) as threshold from pts group by 1)".format(levels=", ".join(repr(i / 24) for i in range(25)))


@registry(sql(_QGRID, select=f"select dataset, {r6('threshold')} as threshold from qg"))
def grid_quantile(spark, sf_dir):
    return rounded(me.quantile_grid(points(spark, sf_dir), 25, ("dataset",)))


_GRID_F = f"""gf as (select g.dataset, threshold, sum(case when v >= threshold then y else 0 end) as tp, sum(case when v >= threshold then 1 else 0 end) as pp, sum(y) as p, count(*) - sum(y) as neg from qg g join pts using (dataset) group by 1, 2),
ff as (select *, round(case when pp + p > 0 then 2e0 * tp / (pp + p) else 0 end, 12) as f1 from gf)"""


@registry(sql(_QGRID, _GRID_F, select=f"select dataset, {r6('threshold')} as threshold, {r6('f1')} as f1 from (select *, row_number() over (partition by dataset order by f1 desc, threshold) as k from ff) where k = 1"))
def tune_point_f1(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(me.tuned_by_point_f1(p, me.quantile_grid(p, 25, ("dataset",)), ("dataset",)))


@registry(sql(select=f"select dataset, {r6('quantile_cont(v, 0.8)')} as threshold from pts group by 1"))
def fixed_quantile(spark, sf_dir):
    return rounded(points(spark, sf_dir).groupBy("dataset").agg(F.percentile("v", 0.8).alias("threshold")))


@registry(sql(select=f"select dataset, {r6('quantile_cont(v, 0.95)')} as threshold from pts where y = 0 group by 1"))
def calib_quantile(spark, sf_dir):
    return rounded(points(spark, sf_dir).where("y = 0").groupBy("dataset").agg(F.percentile("v", 0.95).alias("threshold")))


def _separation_sql(penalty: float, violation: str) -> str:
    levels = ", ".join(repr(i / 39) for i in range(40))
    return sql(
        "bo as (select case when y = 0 then v else v * 2 + 20 end as v, y from pts)",
        f"qg as (select unnest(list_distinct(list_transform(quantile_cont(v, [{levels}]), lambda x: round(x, 9)))) as threshold from bo)",
        "gf as (select threshold, sum(case when v >= threshold then y else 0 end) as tp, sum(case when v >= threshold then 1 else 0 end) as pp, sum(y) as p, count(*) - sum(y) as neg from qg, bo group by 1)",
        f"ff as (select *, (pp - tp)::double / neg as fpr, case when pp > 0 then tp::double / pp else 0 end as prec, case when pp + p > 0 then 2e0 * tp / (pp + p) else 0 end as f1 from gf)",
        f"vv as (select *, round({violation}, 12) as violation, round(f1 - {penalty} * fpr, 12) as value from ff)",
        select=f"select {r6('threshold')} as threshold, {r6('value')} as value, {r6('violation')} as violation, {r6('fpr')} as fpr, {r6('f1')} as f1 from vv order by vv.violation, vv.value desc, vv.threshold limit 1",
    )


def _two_sides(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.where("y = 0").select("v"), p.where("y = 1").select((F.col("v") * 2 + 20).alias("v"))


@registry(_separation_sql(0.0, "0e0"))
def calib_separation(spark, sf_dir):
    return rounded(me.separation(*_two_sides(spark, sf_dir), size=40))


@registry(_separation_sql(1.0, "greatest(fpr - 0.02, 0e0) + greatest(0.1 - prec, 0e0)"))
def calib_fp_aware(spark, sf_dir):
    return rounded(me.separation(*_two_sides(spark, sf_dir), size=40, penalty=1.0, max_fpr=0.02, min_precision=0.1))


@registry(sql(select="select series_id, cast(r = '' as varchar) as metrics_valid, r as metrics_invalid_reason from (select series_id, case when min(y) = max(y) then 'single_class' when max(v) - min(v) < 1e-12 then 'constant_score' else '' end as r from pts group by 1)"))
def metric_validity(spark, sf_dir):
    return me.validity(points(spark, sf_dir), ("series_id",)).withColumn("metrics_valid", F.col("metrics_valid").cast("string"))


_PARTS = ("prefix", "suffix", "middle")
_MASKS = """seg as (select w.series_id, w.event_id, e - s as n, list(p.v order by p.t) as vals from truth w join pts p on p.series_id = w.series_id and p.t >= w.s and p.t < w.e group by 1, 2, 3 having e - s >= 3),
ml as (select *, cast(least(greatest(round_even(n * 0.4, 0), 1), n - 1) as bigint) as len from seg),
mk as (select *, 'prefix' as policy, 0 as a from ml union all select *, 'suffix', n - len from ml union all select *, 'middle', (n - len) // 2 from ml)"""


def _masked(spark, sf_dir):
    p = points(spark, sf_dir)
    rows = ev.segments(p, ev.labelled(p)).where("e - s >= 3").withColumn("n", F.col("e") - F.col("s"))
    spans = {policy: me.mask_interval(F.col("n"), 0.4, policy) for policy in _PARTS}
    kinds = F.array(*[F.struct(F.lit(k).alias("policy"), a.cast("long").alias("start"), b.cast("long").alias("stop")) for k, (a, b) in spans.items()])
    return rows.select("series_id", "event_id", "values", F.explode(kinds).alias("m")).select("series_id", "event_id", "values", "m.*")


@registry(sql(TRUTH_SQL, _MASKS, select=f"select series_id, event_id, policy, {big('a')} as start, {big('a + len')} as stop from mk"))
def mask_interval(spark, sf_dir):
    return _masked(spark, sf_dir).select("series_id", "event_id", "policy", "start", "stop")


_FILL = """pt as (select series_id, event_id, policy, a, len, n, vals, unnest(range(n)) as i from mk),
fl as (select *, vals[i + 1] as x, case when i < a or i >= a + len then vals[i + 1] else coalesce(case when a > 0 then vals[a] end + (case when a + len < n then vals[a + len + 1] end - vals[case when a > 0 then a else 1 end]) * (i - a + 1) / (len + 1),
  case when a > 0 then vals[a] end, case when a + len < n then vals[a + len + 1] end) end as f from pt)"""


def _filled(spark, sf_dir):
    rows = _masked(spark, sf_dir)
    return rows.withColumn("filled", me.linear_fill(F.col("values"), F.col("start"), F.col("stop")))


@registry(sql(TRUTH_SQL, _MASKS, _FILL, select=f"select series_id, event_id, policy, i as k, {r6('f')} as filled from fl"))
def complete_linear(spark, sf_dir):
    return rounded(_filled(spark, sf_dir).select("series_id", "event_id", "policy", F.posexplode("filled").alias("k", "filled")))


_RECON = f"""rc as (select series_id, event_id, policy, avg(abs(x - f)) filter (where i >= a and i < a + len) as mae, avg((x - f) * (x - f)) filter (where i >= a and i < a + len) as mse, stddev_pop(x) as sd from fl group by 1, 2, 3)"""


@registry(sql(TRUTH_SQL, _MASKS, _FILL, _RECON, select=f"select series_id, event_id, policy, {r6('mae')} as mae, {r6('mse')} as mse, {r6('mae / greatest(sd, 1e-8)')} as normalized_mae from rc"))
def recon_metrics(spark, sf_dir):
    return rounded(me.reconstruction(_filled(spark, sf_dir), ("series_id", "event_id", "policy")).drop("boundary_error", "shape_correlation"))


@registry(sql(TRUTH_SQL, _MASKS, _FILL, _RECON, select=f"select coalesce(policy, 'all') as policy, {big('count(*)')} as n, {r6('avg(mae)')} as mae, {r6('avg(mse)')} as mse from rc group by grouping sets ((policy), ())"))
def recon_rollup(spark, sf_dir):
    rows = me.reconstruction(_filled(spark, sf_dir), ("series_id", "event_id", "policy"))
    total = rows.rollup("policy").agg(F.count("*").alias("n"), F.avg("mae").alias("mae"), F.avg("mse").alias("mse"))
    return rounded(total.withColumn("policy", F.coalesce("policy", F.lit("all"))))


_TUNE = f"""grid as (select dataset, k as g, lo + (hi - lo) * k / 9e0 as thr from (select dataset, quantile_cont(v, 0.5) as lo, quantile_cont(v, 0.95) as hi from pts group by 1), lateral (select unnest(generate_series(0::bigint, 9)) as k)),
gp as (select concat(p.series_id, '#', g.g) as series_id, p.dataset, p.t, p.v, g.thr from pts p join grid g using (dataset)),
{runs_sql("pred", "v >= thr", 3, 2, source="gp")},
tx as (select concat(series_id, '#', g.g) as series_id, truth.dataset, event_id, s, e from truth join grid g using (dataset))"""


_TUNE_WALK = """near as (select p.series_id, p.event_id as j, t.event_id as i, cast(greatest(least(p.e, t.e) - greatest(p.s, t.s), 0) as double) / (greatest(p.e, t.e) - least(p.s, t.s)) as iou from pred p join tx t on p.series_id = t.series_id),
walk as (select distinct series_id, dataset, cast(-1 as bigint) as j, []::bigint[] as used from pred union all
 select w.series_id, w.dataset, w.j + 1, case when max(n.i) is null then w.used else list_append(w.used, arg_max(n.i, (n.iou, -n.i))) end from walk w join pred p on p.series_id = w.series_id and p.event_id = w.j + 1
 left join near n on n.series_id = p.series_id and n.j = p.event_id and n.iou >= 0.1 and not list_contains(w.used, n.i) group by w.series_id, w.dataset, w.j, w.used),
mm as (select dataset, cast(split_part(series_id, '#', 2) as bigint) as g, max(len(used)) as m from walk group by series_id, dataset),
cc as (select g.dataset, g.g, thr, (select count(*) from truth t where t.dataset = g.dataset) as nt, (select count(*) from pred p where p.dataset = g.dataset and split_part(p.series_id, '#', 2) = cast(g.g as varchar)) as np, (select coalesce(sum(m), 0) from mm where mm.dataset = g.dataset and mm.g = g.g) as nm from grid g),
sc as (select *, round(case when nt + np > 0 and nm > 0 then (1 + BETA2) * nm::double / (BETA2 * nt + np) else 0 end, 12) as f, np - nm as fp from cc)"""
_TUNED = lambda beta2: (sql(TRUTH_SQL, _TUNE, _TUNE_WALK.replace("BETA2", beta2), select=f"select dataset, {r6('thr')} as threshold, {r6('f')} as f, {big('fp')} as false_positives from (select *, row_number() over (partition by dataset order by f desc, fp, thr desc) as k from sc) where k = 1", recursive=True))


def _grid(p):
    ends = p.groupBy("dataset").agg(F.percentile("v", 0.5).alias("lo"), F.percentile("v", 0.95).alias("hi"))
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("g")
    return ends.select("dataset", "lo", "hi", places).select("dataset", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("g") / 9.0).alias("threshold"))


@registry(_TUNED("1"))
def tune_event_f1(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(me.tuned_by_event_f(p, ev.labelled(p), _grid(p), ("dataset",)))


@registry(_TUNED("0.25"))
def tune_event_fbeta(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(me.tuned_by_event_f(p, ev.labelled(p), _grid(p), ("dataset",), beta=0.5))
