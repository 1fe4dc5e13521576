"""Queries on synthesis, confidence, filters and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import compat as co
from seriesmill.operators import donors as do
from seriesmill.operators import events as ev
from seriesmill.operators import partial as pa
from seriesmill.operators import synth as sy
from seriesmill.plans.q_compat import _PAIRS, _PROFILE, _SIDES, _SPECTRAL, _profiles, _sources
from seriesmill.plans.twin import TRUTH_SQL, Registry, big, rounded, sql
from seriesmill.session import checkpointed
from seriesmill.sources.points import points

registry = Registry()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES

_SRC = "src as (select target, source from rk where rank <= 3)"
_SHAPES = """seg as (select w.series_id, w.event_id, e - s as n, list(p.v order by p.t) as vals from truth w join pts p on p.series_id = w.series_id and p.t >= w.s and p.t < w.e group by 1, 2, 3),
grid as (select series_id, event_id, n, vals, j, vals[lo + 1] + coalesce((vals[lo + 2] - vals[lo + 1]) * (pos - lo), 0) as x from (select *, least(cast(floor(pos) as bigint), greatest(n - 2, 0)) as lo from (select *, j * (n - 1) / 7e0 as pos from seg, lateral (select unnest(range(8)) as j)))),
shp as (select series_id, event_id, n, vals, list(x order by j) as shape from grid group by 1, 2, 3, 4),
cnd as (select a.series_id, a.event_id, a.n, a.vals, s.source, b.event_id as donor_id, b.n as dn, b.vals as donor, round(list_dot_product(a.shape, b.shape) / greatest(sqrt(list_dot_product(a.shape, a.shape)) * sqrt(list_dot_product(b.shape, b.shape)), 1e-8), 9) as sim
  from shp a join src s on s.target = a.series_id join shp b on b.series_id = s.source),
c1 as (select * from cnd qualify row_number() over (partition by series_id, event_id, source order by sim desc, donor_id) = 1),
cd as (select *, row_number() over (partition by series_id, event_id order by sim desc, source, donor_id) as rank from c1),
fit as (select *, donor[lo + 1] + coalesce((donor[lo + 2] - donor[lo + 1]) * (pos - lo), 0) as x from (select *, least(cast(floor(pos) as bigint), greatest(dn - 2, 0)) as lo from (select *, j * (dn - 1) / greatest(n - 1, 1)::double as pos from cd, lateral (select unnest(range(n)) as j) where rank <= 3))),
syn as (select series_id, event_id, j, any_value(vals[j + 1]) as v, avg(x) as m, case when sum(greatest(sim, 0)) > 0 then sum(greatest(sim, 0) * x) / sum(greatest(sim, 0)) else avg(x) end as w, max(x) filter (where rank = 1) as f from fit group by 1, 2, 3)"""
_ALL = (TRUTH_SQL, _PROFILE, _SIDES, _SPECTRAL, _PAIRS, _SRC, _SHAPES)


def _candidates(spark, sf_dir):
    p = points(spark, sf_dir)
    sources = _sources(spark, sf_dir).select("target", "source")
    return sy.candidates(ev.segments(p, ev.labelled(p)).select("series_id", "event_id", "values"), sources)


def _synthesized(spark, sf_dir):
    return sy.synthesized(sy.donors(_candidates(spark, sf_dir)))


def _r9(c: str) -> str:
    return f"round(cast({c} as double), 8)"


def _points_of(name: str, column: str, oracle: str):
    def query(spark, sf_dir):
        rows = _synthesized(spark, sf_dir).select("series_id", "event_id", F.posexplode(column).alias("k", "x"))
        return rounded(rows, 8)

    query.__name__ = name
    registry(sql(*_ALL, select=f"select series_id, event_id, j as k, {_r9(oracle)} as x from syn"))(query)


_points_of("synth_mean", "by_mean", "m")
_points_of("synth_weighted", "by_weight", "w")
_points_of("synth_top1", "by_first", "f")


@registry(sql(*_ALL, select=f"select series_id, event_id, source, donor_id, {big('rank')} as rank, round(sim, 6) as sim from cd where rank <= 3"))
def audit_pairs(spark, sf_dir):
    return rounded(_candidates(spark, sf_dir).select("series_id", "event_id", "source", "donor_id", "rank", "sim"))


@registry(sql(*_ALL, select=f"select series_id, event_id, {big('count(*)')} as n_donors, string_agg(source, '|' order by rank) as donor_series_ids, string_agg(cast(donor_id as varchar), '|' order by rank) as donor_events from cd where rank <= 3 group by 1, 2"))
def audit_flat(spark, sf_dir):
    rows = sy.donors(_candidates(spark, sf_dir))
    joined = lambda f: F.array_join(F.transform("donors", lambda d: d[f].cast("string")), "|")
    return rounded(rows.select("series_id", "event_id", F.size("donors").alias("n_donors"), joined("source").alias("donor_series_ids"), joined("donor_id").alias("donor_events")))


_CAL = "cal as (select syn.*, sd.pre_mean from syn join sd using (series_id, event_id)), mu as (select series_id, event_id, avg(m) as mm, any_value(pre_mean) as pm, stddev_pop(m) as sm from cal group by 1, 2)"


def _with_context(spark, sf_dir):
    p = points(spark, sf_dir)
    side = co.sides(p, ev.labelled(p)).select("series_id", "event_id", "pre_mean", "pre_std")
    return _synthesized(spark, sf_dir).join(side, ["series_id", "event_id"]).where("pre_mean is not null")


@registry(sql(*_ALL, _CAL, select=f"select series_id, event_id, j as k, {_r9('m + pm - mm')} as x from cal join mu using (series_id, event_id) where pm is not null"))
def amp_shift(spark, sf_dir):
    rows = _with_context(spark, sf_dir)
    return rounded(rows.select("series_id", "event_id", F.posexplode(sy.shifted(F.col("by_mean"), F.col("pre_mean"))).alias("k", "x")), 8)


@registry(sql(*_ALL, """rq as (select series_id, event_id, avg(m) as mm, greatest(case when quantile_cont(m, 0.75) > quantile_cont(m, 0.25) then (quantile_cont(m, 0.75) - quantile_cont(m, 0.25)) / 1.349 else stddev_pop(m) end, 1e-6) as own,
  greatest(case when quantile_cont(v, 0.75) > quantile_cont(v, 0.25) then (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349 else stddev_pop(v) end, 1e-6) as tgt from syn group by 1, 2)""",
    select="select syn.series_id, syn.event_id, j as k, round((m - mm) * case when pre_std > 0 then pre_std else tgt end / own + pre_mean, 4) as x from syn join rq using (series_id, event_id) join sd using (series_id, event_id) where pre_mean is not null"))
def amp_robust(spark, sf_dir):
    moved = pa.calibrated(F.col("by_mean"), F.col("values"), F.col("pre_mean"), F.col("pre_std"), "robust_scale_shift")
    return rounded(_with_context(spark, sf_dir).select("series_id", "event_id", F.posexplode(moved["x"]).alias("k", "x")), 4)


_CONF = """st as (select series_id, event_id, avg(v) as mv, stddev_pop(v) as dv, avg(w) as ms, stddev_pop(w) as ds from syn group by 1, 2),
dl as (select series_id, event_id, rank, any_value(sim) as sim, list(x order by j) as x from fit group by 1, 2, 3),
sm as (select series_id, event_id, avg((sim + 1) / 2) as similarity from dl group by 1, 2),
ag as (select a.series_id, a.event_id, avg((list_dot_product(a.x, b.x) / greatest(sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x)), 1e-8) + 1) / 2) as agreement from dl a join dl b on a.series_id = b.series_id and a.event_id = b.event_id and a.rank < b.rank group by 1, 2),
ln as (select series_id, event_id, count(*) as n, list(m order by j) as lm, list(w order by j) as lw from syn group by 1, 2),
gd as (select *, least(cast(floor(pos) as bigint), greatest(n - 2, 0)) as lo from (select *, g * (n - 1) / 7e0 as pos from ln, lateral (select unnest(range(8)) as g))),
cy as (select series_id, event_id, exp(-avg(pow(lm[lo + 1] + coalesce((lm[lo + 2] - lm[lo + 1]) * (pos - lo), 0) - lw[lo + 1] - coalesce((lw[lo + 2] - lw[lo + 1]) * (pos - lo), 0), 2))) as consistency from gd group by 1, 2),
cf as (select series_id, event_id, greatest(0, least(1, similarity)) as similarity, consistency, greatest(0, least(1, coalesce(agreement, 1))) as agreement, exp(-(abs(mv - ms) + abs(dv - ds)) / greatest(dv, ds, 1e-6)) as amplitude from sm join st using (series_id, event_id) join cy using (series_id, event_id) left join ag using (series_id, event_id)),
cn as (select *, (similarity + consistency + agreement + amplitude) / 4 as confidence from cf)"""


@registry(sql(*_ALL, _CONF, select="select series_id, event_id, round(similarity, 5) as similarity, round(consistency, 5) as consistency, round(agreement, 5) as agreement, round(amplitude, 5) as amplitude, round(confidence, 5) as confidence from cn"))
def conf_components(spark, sf_dir):
    return rounded(sy.confidence(_synthesized(spark, sf_dir), "by_weight").select("series_id", "event_id", "similarity", "consistency", "agreement", "amplitude", "confidence"), 5)


@registry(sql(*_ALL, select="select series_id, event_id, round(0.85 * least(1, 0.6 + 0.1 * count(*)) * case when count(distinct source) = 1 then 0.85 else 1 end, 6) as prior from cd where rank <= 3 group by 1, 2"))
def conf_prior(spark, sf_dir):
    rows = sy.donors(_candidates(spark, sf_dir))
    single = F.size(F.array_distinct(F.transform("donors", lambda d: d["source"]))) == 1
    return rounded(rows.select("series_id", "event_id", sy.prior(F.size("donors"), F.lit("mean"), single).alias("prior")))


def _filter(name: str, policy: str, value: float, oracle: str):
    def query(spark, sf_dir):
        rows = sy.filtered(sy.confidence(_synthesized(spark, sf_dir), "by_weight"), policy, value)
        return rows.groupBy("rejection_reason").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"))

    query.__name__ = name
    registry(sql(*_ALL, _CONF, f"fl as (select case when {oracle} end as r from cn)", select=f"select r as rejection_reason, {big('count(*)')} as n, {big('count(*) filter (where r = $$$$)')} as n_accepted from fl group by 1"))(query)


_filter("filter_none", "no_filter", 0.0, "true then ''")
_filter("filter_top_quantile", "top_quantile", 0.5, "round(confidence, 9) >= round((select quantile_cont(confidence, 0.5) from cn), 9) then '' else 'below_top_quantile_0.5'")
_filter("filter_min_conf", "min_confidence", 0.8, "confidence >= 0.8 then '' else 'below_quality_threshold'")
_STRICT_SQL = "concat_ws(',', case when similarity < 0.9 then 'donor_similarity_confidence' end, case when consistency < 0.9 then 'reconstruction_consistency_confidence' end, case when agreement < 0.9 then 'donor_agreement_confidence' end, case when amplitude < 0.9 then 'amplitude_compatibility_score' end, case when confidence < 0.9 then 'aggregate_confidence' end)"
_filter("filter_strict", "strict", 0.9, f"{_STRICT_SQL} = '' then '' else 'strict_filter_failed:' || {_STRICT_SQL}")


@registry()
def synth_dtw(spark, sf_dir):
    return rounded(sy.warped(_candidates(spark, sf_dir)).select("series_id", "event_id", F.posexplode("synthetic").alias("k", "x")))


@registry()
def synth_prototype(spark, sf_dir):
    return rounded(sy.warped(_candidates(spark, sf_dir), "prototype").select("series_id", "event_id", F.posexplode("synthetic").alias("k", "x")))


@registry()
def dtw_distance(spark, sf_dir):
    c = _candidates(spark, sf_dir).select("series_id", "event_id", "source", "donor_id", F.col("values").alias("a"), F.col("donor").alias("b"))
    return rounded(sy.dtw_distances(c))


def _embedded(spark, sf_dir):
    p = points(spark, sf_dir)
    truth = ev.labelled(p)
    return co.embedding(ev.segments(p, truth), co.sides(p, truth), p)


@registry()
def event_groups(spark, sf_dir):
    """Donor windows in four groups by their embeddings; targets at the nearest centre."""
    rows = _embedded(spark, sf_dir)
    donor = F.pmod(F.crc32("series_id"), F.lit(5)) != 0
    model = sy.event_groups(rows.where(donor), 4)
    return sy.grouped(rows, model).select("series_id", "event_id", "event_group")


@registry()
def learned_weights(spark, sf_dir):
    """Weights learned on all ordered pairs of series whose events have groups."""
    shares = do.group_shares(sy.grouped(_embedded(spark, sf_dir), sy.event_groups(_embedded(spark, sf_dir), 4)))
    some = shares.select("series_id").distinct()
    pairs = co.pairs(_profiles(spark, sf_dir).join(some, "series_id", "left_semi"))
    weights, reason = sy.learned_weights(checkpointed(do.group_overlap(pairs, shares)), dict(co.WEIGHTS))
    return spark.createDataFrame([(k, round(float(v), 9), reason) for k, v in weights.items()], "component string, weight double, reason string")
