"""Queries on profiles, pairs, donors and retrieval."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.operators import compat as co
from seriesmill.operators import events as ev
from seriesmill.plans.twin import DIGITS, TRUTH_SQL, Registry, big, r6, rounded, sql
from seriesmill.session import checkpointed, table
from seriesmill.sources.points import points

registry = Registry()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES

_PROFILE = """nx as (select *, lead(v) over (partition by series_id order by t) as nxt from pts),
dur as (select series_id, count(*) as n_events, quantile_cont((e - s)::double, 0.5) as median_duration, avg(e - s) as mean_duration from truth group by 1),
b0 as (select series_id, dataset, count(*) as length, avg(v) as mean, stddev_pop(v) as std, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) as iqr, min(v) as min, max(v) as max,
  least(abs(corr(v, t)) * count(*)::double / (count(*) - 1), 1) as trend_strength, corr(v, nxt) filter (where nxt is not null) as autocorr_lag1, avg(y) as anomaly_ratio from nx group by 1, 2),
prof as (select b0.*, greatest(iqr, std, 1e-6) as robust_amplitude, coalesce(n_events, 0) as n_events, coalesce(median_duration, 0) as median_duration, coalesce(mean_duration, 0) as mean_duration from b0 left join dur using (series_id))"""

_SIDES = """sd as (select p.series_id, w.event_id,
  avg(p.v) filter (where t < w.s) as pre_mean, stddev_pop(p.v) filter (where t < w.s) as pre_std,
  case when count(*) filter (where t < w.s) >= 2 then (arg_max(p.v, t) filter (where t < w.s) - arg_min(p.v, t) filter (where t < w.s)) / (count(*) filter (where t < w.s) - 1) else 0 end as pre_slope,
  avg(p.v) filter (where t >= w.e) as post_mean, stddev_pop(p.v) filter (where t >= w.e) as post_std,
  case when count(*) filter (where t >= w.e) >= 2 then (arg_max(p.v, t) filter (where t >= w.e) - arg_min(p.v, t) filter (where t >= w.e)) / (count(*) filter (where t >= w.e) - 1) else 0 end as post_slope,
  max(p.v) filter (where t >= w.s and t < w.e) - min(p.v) filter (where t >= w.s and t < w.e) as event_range
  from pts p join truth w on p.series_id = w.series_id and p.t between w.s - 5 and w.e + 4 group by 1, 2),
ctx as (select series_id, coalesce(pm, m) as pre_mean, coalesce(ps, d) as pre_std, coalesce(qm, m) as post_mean, coalesce(qs, d) as post_std from (select series_id, avg(v) as m, stddev_pop(v) as d from pts group by 1) a
  left join (select series_id, avg(pre_mean) as pm, avg(pre_std) as ps, avg(post_mean) as qm, avg(post_std) as qs from sd group by 1) b using (series_id))"""

_SPECTRAL = """cen as (select series_id, t, v - avg(v) over (partition by series_id) as x, count(*) over (partition by series_id) as n from pts),
bn as (select series_id, n, k, sum(x * cos(2 * pi() * ((k * t) % n) / n)) as re, sum(x * sin(2 * pi() * ((k * t) % n) / n)) as im from cen, lateral (select unnest(generate_series(0::bigint, n // 2)) as k) group by 1, 2, 3),
spec as (select series_id, case when n < 4 or sum(re * re + im * im) <= 1e-12 then 0 else sum(re * re + im * im) filter (where k < greatest(1, (n // 2 + 1) // 4)) / sum(re * re + im * im) end as spectral from bn group by series_id, n)"""


def _sim(c: str) -> str:
    return f"(1 / (1 + abs(a.{c} - b.{c}) / greatest(abs(a.{c}), abs(b.{c}), 1e-6)))"


def _mean(*cs: str) -> str:
    return "(" + " + ".join(map(_sim, cs)) + f") / {len(cs)}"


_PAIRS = f"""full_prof as (select prof.*, pre_mean, pre_std, post_mean, post_std, spectral from prof join ctx using (series_id) join spec using (series_id)),
pr as (select a.series_id as target, b.series_id as source, a.dataset as t_dataset, b.dataset as s_dataset, {_mean('mean', 'std', 'median', 'iqr')} as shape, {_mean('robust_amplitude', 'min', 'max', 'std')} as amplitude,
  case when a.n_events > 0 or b.n_events > 0 then {_mean('length', 'median_duration', 'mean_duration', 'anomaly_ratio')} else {_sim('length')} end as duration,
  {_mean('pre_mean', 'pre_std', 'post_mean', 'post_std')} as context, (2 * {_sim('spectral')} + {_sim('autocorr_lag1')}) / 3 as frequency, {_sim('trend_strength')} as trend, 0.5e0 as grp
  from full_prof a join full_prof b on a.series_id <> b.series_id),
sc as (select *, greatest(0e0, least(1e0, 0.25 * shape + 0.25 * amplitude + 0.15 * duration + 0.15 * context + 0.1 * frequency + 0.1 * trend + case when t_dataset = s_dataset then 0.05 else 0 end)) as score from pr),
rk as (select *, row_number() over (partition by target order by round(score, 12) desc, source) as rank, count(*) over (partition by target) as n from sc where score >= 0.5)"""


def _profiles(spark, sf_dir):
    p = checkpointed(points(spark, sf_dir))  # three plans read it
    e = checkpointed(ev.labelled(p))
    return co.profile(p, e).join(co.context(p, e), "series_id").join(co.spectral_share_long(p), "series_id")


def _scored(spark, sf_dir):
    return co.scored(co.pairs(_profiles(spark, sf_dir)))


def _pair_rows(spark, sf_dir, *columns):
    """All pairs of series with some columns, rounded."""
    rows = co.pair_rows(_profiles(spark, sf_dir).withColumn("name", F.col("series_id")), columns, digits=DIGITS)
    return rows.where(F.col("target") != F.col("source"))


def _sources(spark, sf_dir):
    """Of each target the three best sources that pass the least score."""
    return co.best_pairs(_profiles(spark, sf_dir), 3)


@registry(sql(TRUTH_SQL, _PROFILE, select="select series_id, " + ", ".join(f"{r6(c)} as {c}" for c in ("mean", "std", "median", "iqr", "min", "max", "robust_amplitude")) + f", {big('length')} as length from prof"))
def profile_moments(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(co.profile(p, ev.labelled(p)).select("series_id", "mean", "std", "median", "iqr", "min", "max", "robust_amplitude", "length"))


@registry(sql(TRUTH_SQL, _PROFILE, select=f"select series_id, {r6('trend_strength')} as trend_strength, {r6('autocorr_lag1')} as autocorr_lag1, {big('n_events')} as n_events, {r6('median_duration')} as median_duration, {r6('mean_duration')} as mean_duration, {r6('anomaly_ratio')} as anomaly_ratio from prof"))
def profile_trend_ac(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(co.profile(p, ev.labelled(p)).select("series_id", "trend_strength", "autocorr_lag1", "n_events", "median_duration", "mean_duration", "anomaly_ratio"))


@registry(sql(_SPECTRAL, select=f"select series_id, {r6('spectral')} as spectral from spec"))
def profile_spectral(spark, sf_dir):
    return rounded(co.spectral_share(points(spark, sf_dir)))


@registry(sql(_SPECTRAL, select=f"select series_id, {r6('spectral')} as spectral from spec"))
def profile_spectral_long(spark, sf_dir):
    return rounded(co.spectral_share_long(points(spark, sf_dir)))


@registry(sql(TRUTH_SQL, _SIDES, select="select series_id, event_id, " + ", ".join(f"{r6(c)} as {c}" for c in ("pre_mean", "pre_std", "pre_slope", "post_mean", "post_std", "post_slope", "event_range")) + " from sd"))
def local_context(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(co.sides(p, ev.labelled(p)))


@registry(sql(TRUTH_SQL, _SIDES, select="select series_id, " + ", ".join(f"round(cast({c} as double), 10) as {c}" for c in ("pre_mean", "pre_std", "post_mean", "post_std")) + " from ctx"))
def profile_context(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(co.context(p, ev.labelled(p)), 10)


@registry(sql(TRUTH_SQL, _PROFILE, _SIDES, _SPECTRAL, _PAIRS, select="select target, source, " + ", ".join(f"{r6(c)} as {c}" for c in ("shape", "amplitude", "duration", "context", "frequency", "trend")) + " from pr"))
def pair_components(spark, sf_dir):
    return _pair_rows(spark, sf_dir, "shape", "amplitude", "duration", "context", "frequency", "trend")


@registry(sql(TRUTH_SQL, _PROFILE, _SIDES, _SPECTRAL, _PAIRS, select=f"select target, source, {r6('score')} as score, cast(score >= 0.5 as varchar) as kept from sc"))
def pair_score(spark, sf_dir):
    return _pair_rows(spark, sf_dir, "score", "kept").withColumn("kept", F.when(F.col("kept"), "true").otherwise("false"))


@registry(sql(TRUTH_SQL, _PROFILE, _SIDES, _SPECTRAL, _PAIRS, select=f"select target, source, {big('rank')} as rank from (select *, row_number() over (partition by target order by round(score, 12) desc, source) as rank from sc) where rank <= 5"))
def pair_rank(spark, sf_dir):
    return rounded(co.best_pairs(_profiles(spark, sf_dir), 5, None).select("target", "source", "rank"))


@registry(sql(TRUTH_SQL, _PROFILE, _SIDES, _SPECTRAL, _PAIRS, select="select target, source from rk where rank <= 3"))
def pair_filter_topk(spark, sf_dir):
    return _sources(spark, sf_dir).select("target", "source")


@registry(sql(TRUTH_SQL, _PROFILE, _SIDES, _SPECTRAL, _PAIRS, select="select target, source from rk where rank <= ceil(n * 0.1)"))
def pair_filter_quantile(spark, sf_dir):
    return co.filtered(_scored(spark, sf_dir), quantile=0.1).select("target", "source")


@registry(sql(TRUTH_SQL, _PROFILE, _SIDES, _SPECTRAL, _PAIRS, select=f"select t_dataset, s_dataset, {big('count(*)')} as n_pairs, {big('count(*) filter (where score >= 0.5)')} as n_kept, {r6('avg(score)')} as mean_score from sc group by 1, 2"))
def dataset_pair_counts(spark, sf_dir):
    rows = co.pair_totals(_profiles(spark, sf_dir)).groupBy("t_dataset", "s_dataset")
    return rounded(rows.agg(F.sum("n").alias("n_pairs"), F.sum("n_kept").alias("n_kept"), (F.sum("score") / F.sum("n")).alias("mean_score")))


def _donors(name: str, condition: str, among: str, min_score: float | None = None):
    def query(spark, sf_dir):
        return co.best_pairs(_profiles(spark, sf_dir), 3, min_score, among).groupBy("target").agg(F.array_join(F.sort_array(F.collect_list("source")), "|").alias("sources"))

    query.__name__ = name
    registry(sql(TRUTH_SQL, _PROFILE, _SIDES, _SPECTRAL, _PAIRS, f"rr as (select *, row_number() over (partition by target order by round(score, 12) desc, source) as r from sc where {condition})", select="select target, array_to_string(list(source order by source), '|') as sources from rr where r <= 3 group by 1"))(query)


_donors("donors_same", "t_dataset = s_dataset", "same")
_donors("donors_cross", "t_dataset <> s_dataset", "other")
_donors("donors_compatible", "score >= 0.5", "all", co.MIN_SCORE)


_GROUPS = """dist as (select series_id, len, cast(count(*) as double) / sum(count(*)) over (partition by series_id) as share from (select series_id, least(e - s, 3) as len from truth) group by 1, 2)"""


def _shares(spark, sf_dir):
    e = ev.labelled(points(spark, sf_dir)).select("series_id", F.least(F.col("e") - F.col("s"), F.lit(3)).alias("len"))
    return e.groupBy("series_id", "len").count().select("series_id", "len", (F.col("count") / F.sum("count").over(W.partitionBy("series_id"))).alias("share"))


@registry(sql(TRUTH_SQL, _GROUPS, select=f"select series_id, {big('len')} as len, {r6('share')} as share from dist"))
def group_distribution(spark, sf_dir):
    return rounded(_shares(spark, sf_dir))


@registry(sql(TRUTH_SQL, _GROUPS, select=f"select a.series_id as target, b.series_id as source, {r6('sum(least(a.share, b.share))')} as overlap from dist a join dist b on a.len = b.len and a.series_id < b.series_id group by 1, 2"))
def group_overlap(spark, sf_dir):
    d = _shares(spark, sf_dir)
    a, b = d.select(F.col("series_id").alias("target"), "len", F.col("share").alias("p")), d.select(F.col("series_id").alias("source"), "len", F.col("share").alias("q"))
    both = a.join(b, "len").where("target < source")
    return rounded(both.groupBy("target", "source").agg(F.sum(F.least("p", "q")).alias("overlap")))


@registry(f"select a.vec_id as a, b.vec_id as b, {r6('list_cosine_similarity(a.embedding::double[], b.embedding::double[])')} as cosine from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id")
def cosine_pairs(spark, sf_dir):
    e = _units(spark, sf_dir)
    b = e.select(F.col("vec_id").alias("b"), "label", F.col("x").alias("y"))
    return rounded(e.withColumnRenamed("vec_id", "a").join(b, "label").where("a < b").select("a", "b", co.dot(F.col("x"), F.col("y")).alias("cosine")))


def _units(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", co.unit(F.col("embedding").cast("array<double>")).alias("x"))


@registry(f"select target, source, {big('r')} as rank, round(c, 6) as cosine from (select a.vec_id as target, b.vec_id as source, c, row_number() over (partition by a.vec_id order by round(c, 9) desc, b.vec_id) as r from (select a, b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as c from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id)) where r <= 3")
def donor_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return rounded(co.nearest_within(e, "vec_id", "label", 3).select("target", "source", "rank", "cosine"))


@registry(f"""with d as (select vec_id, label, unnest(embedding)::double as x, unnest(range(64)) as i from embeddings), c as (select label as g, i, avg(x) as m from d group by 1, 2),
s as (select vec_id, g, sum(x * m) / greatest(sqrt(sum(x * x)) * sqrt(sum(m * m)), 1e-8) as cos from d join c using (i) group by 1, 2)
select vec_id, {big('arg_max(g, (round(cos, 9), -g))')} as nearest from s group by 1""")
def nearest_group(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    dims = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    centres = dims.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("c"))
    lists = centres.agg(F.sort_array(F.collect_list(F.struct(F.col("label").alias("g"), "c"))).alias("all"))  # a row a label
    best = F.array_max(F.transform("all", lambda p: F.struct(F.round(co.cosine(F.col("x"), p["c"]), 9).alias("s"), (-p["g"]).alias("g"))))
    return rounded(e.crossJoin(F.broadcast(lists)).select("vec_id", (-best["g"]).alias("nearest")))


_RES = """seg as (select w.series_id, w.event_id, e - s as n, list(p.v order by p.t) as vals from truth w join pts p on p.series_id = w.series_id and p.t >= w.s and p.t < w.e group by 1, 2, 3),
rs as (select series_id, event_id, j, vals[lo + 1] + coalesce((vals[lo + 2] - vals[lo + 1]) * (pos - lo), 0) as x from (select *, least(cast(floor(pos) as bigint), greatest(n - 2, 0)) as lo from (select *, j * (n - 1) / 7e0 as pos from seg, lateral (select unnest(range(8)) as j))))"""


@registry(sql(TRUTH_SQL, _RES, select=f"select series_id, event_id, j as k, {r6('x')} as x from rs"))
def resample_grid(spark, sf_dir):
    p = points(spark, sf_dir)
    rows = ev.segments(p, ev.labelled(p)).select("series_id", "event_id", co.resampled(F.col("values"), 8).alias("x"))
    return rounded(rows.select("series_id", "event_id", F.posexplode("x").alias("k", "x")))


@registry(sql(TRUTH_SQL, _RES, select=f"select split_part(series_id, '/', 1) as dataset, j as k, {r6('avg(x)')} as prototype, {big('count(*)')} as n from rs group by 1, 2"))
def prototype_mean(spark, sf_dir):
    p = points(spark, sf_dir)
    rows = ev.segments(p, ev.labelled(p)).select(F.split_part(F.col("series_id"), F.lit("/"), F.lit(1)).alias("dataset"), F.posexplode(co.resampled(F.col("values"), 8)).alias("k", "x"))
    return rounded(rows.groupBy("dataset", "k").agg(F.avg("x").alias("prototype"), F.count("*").alias("n")))


@registry(sql(select=f"select series_id, {r6('greatest(case when quantile_cont(v, 0.75) > quantile_cont(v, 0.25) then (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349 else stddev_pop(v) end, 1e-6)')} as robust_std from pts group by 1"))
def robust_std(spark, sf_dir):
    iqr = F.percentile("v", 0.75) - F.percentile("v", 0.25)
    return rounded(points(spark, sf_dir).groupBy("series_id").agg(F.greatest(F.when(iqr > 0, iqr / 1.349).otherwise(F.stddev_pop("v")), F.lit(1e-6)).alias("robust_std")))
