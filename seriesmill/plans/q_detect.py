"""Queries on windows, features and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import detectors as de
from seriesmill.operators import windows as wi
from seriesmill.plans.twin import TRUTH_SQL, Registry, big, r6, rounded, sql
from seriesmill.sources.points import points

registry = Registry()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES

_WIN = """arr as (select series_id, count(*) as n, list(v order by t) as vals from pts group by 1),
st as (select series_id, n, vals, unnest(list_sort(list_distinct(list_concat(generate_series(0, n - 16, 8), [n - 16])))) as s from arr),
wn as (select series_id, cast(row_number() over (partition by series_id order by s) - 1 as bigint) as w, s, s + 16 as e, vals[s + 1 : s + 16] as x from st)"""


@registry(sql(_WIN, select=f"select series_id, w, {big('s')} as s, {big('e')} as e, {big('len(x)')} as n, {r6('list_sum(x)')} as total from wn"))
def win_slices(spark, sf_dir):
    w = wi.windows(points(spark, sf_dir), 16, 8)
    return rounded(w.select("series_id", F.col("w").cast("long").alias("w"), "s", "e", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")))


@registry(sql(_WIN, select=f"select series_id, w, {big('s')} as s, {big('e')} as e, {r6('list_avg(x)')} as mean, {r6('list_stddev_pop(x)')} as std, {r6('list_min(x)')} as min, {r6('list_max(x)')} as max, {r6('x[16] - x[1]')} as delta from wn"))
def win_features(spark, sf_dir):
    return rounded(wi.features(wi.windows(points(spark, sf_dir), 16, 8)))


_WSCORE = "ws as (select series_id, s, e, list_avg(x) - 50 as score from wn)"


def _window_scores(spark, sf_dir):
    p = points(spark, sf_dir)
    return p, wi.features(wi.windows(p, 16, 8)).select("series_id", "s", "e", (F.col("mean") - 50).alias("score"))


@registry(sql(_WIN, _WSCORE, select=f"select p.series_id, p.t, {r6('coalesce(greatest(0e0, max(score)), 0)')} as score from pts p left join ws on p.series_id = ws.series_id and p.t >= s and p.t < e group by 1, 2"))
def win_to_points_max(spark, sf_dir):
    return rounded(wi.to_points(*_window_scores(spark, sf_dir)))


@registry(sql(_WIN, _WSCORE, select="select p.series_id, p.t, round(coalesce(avg(score), 0), 9) as score from pts p left join ws on p.series_id = ws.series_id and p.t >= s and p.t < e group by 1, 2"))
def win_to_points_mean(spark, sf_dir):
    return rounded(wi.to_points(*_window_scores(spark, sf_dir), how="mean"), 9)


_FC = """arr as (select series_id, count(*) as n, list(v order by t) as vals from pts group by 1),
fs as (select series_id, n, vals, unnest(list_distinct(list_concat(generate_series(0, n - 13, 4), [n - 13]))) as s from arr where n >= 13),
fp as (select series_id, s + 12 as pos, list_avg(vals[s + 1 : s + 12]) as guess, vals[s + 13] as target from fs)"""


def _forecasts(spark, sf_dir):
    p = points(spark, sf_dir)
    rows = wi.forecast_pairs(p, 12, 4)
    return p, rows.select("series_id", "at", (F.aggregate("context", F.lit(0.0), lambda a, x: a + x) / F.size("context")).alias("guess"), F.get("target", F.lit(0)).alias("target"))


@registry(sql(_FC, select=f"select series_id, {big('pos')} as \"at\", {r6('guess')} as guess, {r6('target')} as target from fp"))
def forecast_pairs(spark, sf_dir):
    return rounded(_forecasts(spark, sf_dir)[1])


@registry(sql(_FC, "er as (select series_id, pos, (guess - target) * (guess - target) as err from fp), ff as (select series_id, min(pos) as a0, arg_min(err, pos) as e0 from er group by 1)", select="select p.series_id, p.t, round(case when p.t < a0 then e0 else coalesce(err, 0) end, 4) as score from pts p join ff using (series_id) left join er on er.series_id = p.series_id and er.pos = p.t"))
def forecast_to_points(spark, sf_dir):
    p, rows = _forecasts(spark, sf_dir)
    err = rows.select("series_id", F.col("at").alias("t"), ((F.col("guess") - F.col("target")) ** 2).alias("err"))
    first = err.groupBy("series_id").agg(F.min("t").alias("a0"), F.min_by("err", "t").alias("e0"))
    joined = p.join(first, "series_id").join(err, ["series_id", "t"], "left")
    return rounded(joined.select("series_id", "t", F.when(F.col("t") < F.col("a0"), F.col("e0")).otherwise(F.coalesce("err", F.lit(0.0))).alias("score")), 4)


_FEAT = """pf as (select series_id, t, v, avg(v) over f as mean, stddev_pop(v) over f as std, v - coalesce(lag(v, 1) over o, first_value(v) over o) as diff, min(v) over f as min, max(v) over f as max, coalesce(lag(v, 1) over o, first_value(v) over o) as lag1, coalesce(lag(v, 2) over o, first_value(v) over o) as lag2
  from pts window o as (partition by series_id order by t), f as (partition by series_id order by t rows between 4 preceding and current row))"""
_NAMES = ("v", "mean", "std", "diff", "min", "max", "lag1", "lag2")


@registry(sql(_FEAT, select="select series_id, t, " + ", ".join(f"round(cast({c} as double), 9) as {c}" for c in _NAMES) + " from pf"))
def point_features(spark, sf_dir):
    return rounded(wi.point_features(points(spark, sf_dir)), 9)


@registry(sql(select=f"select series_id, t, {r6('case when max(v) over w - min(v) over w < 1e-8 then 0 else (v - min(v) over w) / (max(v) over w - min(v) over w) end')} as v from pts window w as (partition by series_id)"))
def score_minmax(spark, sf_dir):
    return rounded(wi.min_max(points(spark, sf_dir), "v").select("series_id", "t", "v"))


@registry(sql(_FEAT, "ms as (select avg(v) as vm, stddev_pop(v) as vs, avg(std) as sm, stddev_pop(std) as ss, avg(diff) as dm, stddev_pop(diff) as ds from pf)", select=f"select series_id, t, {r6('greatest(abs(v - vm) / vs, abs(std - sm) / ss, abs(diff - dm) / ds)')} as score from pf, ms"))
def zscore_scores(spark, sf_dir):
    return rounded(wi.z_scores(wi.point_features(points(spark, sf_dir)), ("v", "std", "diff")).select("series_id", "t", "score"))


@registry(sql(TRUTH_SQL, "syn as (select p.series_id, p.t, avg(p.v) over (partition by p.series_id, w.event_id) as sv from pts p join truth w on p.series_id = w.series_id and p.t >= w.s and p.t < w.e)", select=f"select series_id, t, {r6('coalesce(sv, v)')} as v, {big('case when sv is null then y else 1 end')} as y from pts left join syn using (series_id, t)"))
def splice_context(spark, sf_dir):
    from pyspark.sql import Window as W

    from seriesmill.operators import events as ev

    p = points(spark, sf_dir)
    w = ev.labelled(p).select(F.col("series_id").alias("k"), "event_id", "s", "e")
    inside = p.join(w, (F.col("series_id") == F.col("k")) & F.col("t").between(F.col("s"), F.col("e") - 1))
    syn = inside.select("series_id", "t", F.avg("v").over(W.partitionBy("series_id", "event_id")).alias("sv"), F.lit(1).alias("sy"))
    return rounded(wi.spliced(p, syn))


@registry(sql("th as (select quantile_cont(v, 0.9) as thr from pts where y = 0)", select=f"select series_id, {big('count(*) filter (where v >= thr)')} as n_predicted, {big('count(*) filter (where v >= thr and y = 1)')} as n_hit from pts, th group by 1"))
def predict_threshold(spark, sf_dir):
    p = points(spark, sf_dir)
    threshold = p.where("y = 0").agg(F.percentile("v", 0.9).alias("thr"))
    rows = p.crossJoin(F.broadcast(threshold))  # one row
    return rows.groupBy("series_id").agg(F.count_if(F.col("v") >= F.col("thr")).alias("n_predicted"), F.count_if((F.col("v") >= F.col("thr")) & (F.col("y") == 1)).alias("n_hit"))


def _features(spark, sf_dir):
    p = points(spark, sf_dir)
    return wi.point_features(p).join(p.select("series_id", "t", "y"), ["series_id", "t"])


def _ml(kind: str):
    def query(spark, sf_dir):
        rows = _features(spark, sf_dir)
        return rounded(wi.score_column(rows, list(_NAMES), kind)(rows).select("series_id", "t", "score"))

    query.__name__ = f"detect_{kind}"
    registry()(query)


def _numpy(name: str, fit):
    def query(spark, sf_dir):
        rows = _features(spark, sf_dir)
        return rounded(de.applied(rows, list(_NAMES), fit(de.sampled(rows, list(_NAMES)))))

    query.__name__ = f"detect_{name}"
    registry()(query)


def _forecaster(name: str, fit):
    def query(spark, sf_dir):
        rows = wi.forecast_pairs(points(spark, sf_dir), 24)
        columns = [f"c{i}" for i in range(25)]
        flat = rows.select("series_id", F.col("at").alias("t"), *[F.get(F.concat("context", "target"), F.lit(i)).alias(c) for i, c in enumerate(columns)])
        return rounded(de.applied(flat, columns, fit(de.sampled(flat, columns))))

    query.__name__ = f"detect_{name}"
    registry()(query)


for _kind in ("forest", "logistic"):
    _ml(_kind)
for _name, _fit in (("iforest", de.IsolationForest), ("ocsvm", de.OneClassBoundary), ("lof", lambda x: de.LocalOutlierFactor(x[:4000])), ("autoencoder", de.AutoEncoder)):
    _numpy(_name, _fit)
for _name, _fit in (("cnn", de.ConvForecaster), ("periodic", de.PeriodForecaster)):
    _forecaster(_name, _fit)
