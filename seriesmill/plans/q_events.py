"""Queries on events, loading and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import events as ev
from seriesmill.operators import splits as sp
from seriesmill.plans.twin import MATCH_SQL, PRED_SQL, TRUTH_SQL, Registry, big, r6, rounded, runs_sql, sql
from seriesmill.session import table
from seriesmill.sources.points import points

registry = Registry()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@registry(sql(TRUTH_SQL, select="select * from truth"))
def ev_windows(spark, sf_dir):
    return ev.labelled(points(spark, sf_dir))


@registry(sql(runs_sql("w", "y = 1", 2, 1), select="select * from w"))
def ev_windows_merged(spark, sf_dir):
    return ev.labelled(points(spark, sf_dir), min_length=2, merge_gap=1)


@registry(sql(runs_sql("w", "y = 1", 2, 1), select="select p.series_id, p.t, cast(max(case when w.s is null then 0 else 1 end) as bigint) as m from pts p left join w on p.series_id = w.series_id and p.t >= w.s and p.t < w.e group by 1, 2"))
def ev_mask(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(ev.mask(p, ev.labelled(p, 2, 1)))


@registry(sql(TRUTH_SQL, select=f"select {big('count(distinct series_id)')} as n_series, {big('count(*)')} as n_points, {r6('avg(y)')} as anomaly_ratio, {big('(select count(*) from truth)')} as n_events, {big('(select min(e-s) from truth)')} as min_length, {r6('(select avg(e-s) from truth)')} as mean_length, {big('(select max(e-s) from truth)')} as max_length from pts"))
def ev_stats(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(ev.stats(p, ev.labelled(p)))


_SEGMENT = """select w.series_id, w.event_id, w.s, w.e,
  array_to_string(list(round(p.v, 3)::varchar order by p.t) filter (where p.t >= w.s and p.t < w.e), ' ') as vals,
  cast(count(*) as bigint) as n_context, round(cast(sum(p.v) as double), 6) as context_sum
from truth w join pts p on p.series_id = w.series_id and p.t between w.s - 3 and w.e + 2 group by 1, 2, 3, 4"""


@registry(sql(TRUTH_SQL, select=f"select w.series_id, w.event_id, w.s, w.e, cast(count(*) filter (where p.t >= w.s and p.t < w.e) as bigint) as n_values, {r6('sum(p.v) filter (where p.t >= w.s and p.t < w.e)')} as values_sum, {big('count(*)')} as n_context, {r6('sum(p.v)')} as context_sum from truth w join pts p on p.series_id = w.series_id and p.t between w.s - 3 and w.e + 2 group by 1, 2, 3, 4"))
def ev_segments_context(spark, sf_dir):
    p = points(spark, sf_dir)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    s = ev.segments(p, ev.labelled(p), padding=3)
    return rounded(s.select("series_id", "event_id", "s", "e", F.size("values").alias("n_values"), total("values").alias("values_sum"), F.size("context").alias("n_context"), total("context").alias("context_sum")))


@registry(sql(TRUTH_SQL, select=f"select w.series_id, w.event_id, p.t - w.s as k, {r6('case when w.e - w.s = 1 then 0 else (p.t - w.s)::double / (w.e - w.s - 1) end')} as local_time, {r6('p.v')} as v from truth w join pts p on p.series_id = w.series_id and p.t >= w.s and p.t < w.e"))
def ev_local_time(spark, sf_dir):
    p = points(spark, sf_dir)
    s = ev.segments(p, ev.labelled(p))
    rows = s.select("series_id", "event_id", F.posexplode(F.arrays_zip("local_time", "values")).alias("k", "x"))
    return rounded(rows.select("series_id", "event_id", "k", F.col("x.local_time").alias("local_time"), F.col("x.values").alias("v")))


@registry(sql(TRUTH_SQL, select="select series_id, event_id, e - s as n from truth order by n desc, series_id, event_id limit 10"))
def ev_top_longest(spark, sf_dir):
    w = ev.labelled(points(spark, sf_dir))
    return w.select("series_id", "event_id", (F.col("e") - F.col("s")).alias("n")).orderBy(F.desc("n"), "series_id", "event_id").limit(10)


@registry(sql(TRUTH_SQL, select=f"select series_id, {big('count(*)')} as n_events from truth group by 1 order by 2 desc, 1 limit 10"))
def ev_top_eventful(spark, sf_dir):
    return ev.labelled(points(spark, sf_dir)).groupBy("series_id").agg(F.count("*").alias("n_events")).orderBy(F.desc("n_events"), "series_id").limit(10)


@registry(sql(TRUTH_SQL, select=f"select dataset, {big('min(e-s)')} as lo, {r6('avg(e-s)')} as mean, {r6('quantile_cont(e-s, 0.5)')} as median, {big('max(e-s)')} as hi from truth group by 1"))
def ev_length_stats(spark, sf_dir):
    n = F.col("e") - F.col("s")
    return rounded(ev.labelled(points(spark, sf_dir)).groupBy("dataset").agg(F.min(n).alias("lo"), F.avg(n.cast("double")).alias("mean"), F.percentile(n, 0.5).alias("median"), F.max(n).alias("hi")))


@registry(sql(select=f"select dataset, {big('count(distinct series_id)')} as n_series, {big('count(*)')} as n_points, {big('sum(y)')} as n_anomalies, {big('count(distinct case when y = 1 then series_id end)')} as n_eventful from pts group by 1"))
def ds_distribution(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(p.groupBy("dataset").agg(F.countDistinct("series_id").alias("n_series"), F.count("*").alias("n_points"), F.sum("y").alias("n_anomalies"), F.countDistinct(F.when(F.col("y") == 1, F.col("series_id"))).alias("n_eventful")))


_SERIES = "ser as (select series_id, dataset, cast(count(*) as bigint) as n, cast(sum(y) as bigint) as n_pos, max(y) as has_event from pts group by 1, 2)"


def _split_sql(strata: str) -> str:
    return f"""ranked as (select *, row_number() over (partition by {strata} order by md5(concat('42|', series_id)), series_id) as rank, count(*) over (partition by {strata}) as sz from ser),
sized as (select *, greatest(1, cast(round_even(sz * 0.7, 0) as int)) as a, greatest(1, cast(round_even(sz * 0.1, 0) as int)) as b from ranked),
fixed as (select *, case when a + b >= sz then greatest(1, sz - b - 1) else a end as c from sized),
spl as (select series_id, dataset, n, n_pos, has_event, case when sz = 1 or rank = 1 then 'train' when sz = 2 then 'test' when rank <= c then 'train' when rank <= c + b then 'val' else 'test' end as split from fixed)"""


@registry(sql(_SERIES, _split_sql("dataset"), select="select series_id, split from spl"))
def split_hash(spark, sf_dir):
    return sp.split(sp.series(points(spark, sf_dir)), 42).select("series_id", "split")


@registry(sql(_SERIES, _split_sql("has_event"), select="select series_id, split from spl"))
def split_by_event(spark, sf_dir):
    return sp.split(sp.series(points(spark, sf_dir)), 42, strata=("has_event",)).select("series_id", "split")


@registry(sql(_SERIES, _split_sql("dataset"), select=f"select dataset, {big('count(*) filter (where split = $$train$$)')} as n_train, {big('count(*) filter (where split = $$val$$)')} as n_val, {big('count(*) filter (where split = $$test$$)')} as n_test from spl group by 1"))
def ds_split_coverage(spark, sf_dir):
    s = sp.split(sp.series(points(spark, sf_dir)), 42)
    return s.groupBy("dataset").agg(*[F.count_if(F.col("split") == x).alias(f"n_{x}") for x in ("train", "val", "test")])


_COVER = """bare as (select series_id, dataset, case when dataset = 'd1' then (case when series_id < 'd1/u3' then 'val' else 'train' end) else 'test' end as split from ser),
fix as (select *, max(case when split = 'test' then 1 else 0 end) over (partition by dataset) = 0 and row_number() over (partition by dataset order by case split when 'train' then 0 when 'val' then 1 else 2 end, series_id) = 1 as moved from bare)"""


@registry(sql(_SERIES, _COVER, select="select series_id, moved, case when moved then 'test' else split end as split from fix"))
def split_coverage_fix(spark, sf_dir):
    bare = sp.series(points(spark, sf_dir)).select(
        "series_id", "dataset", F.when(F.col("dataset") == "d1", F.when(F.col("series_id") < "d1/u3", "val").otherwise("train")).otherwise("test").alias("split")
    )
    return sp.cover_tests(bare).select("series_id", "moved", "split")


@registry(sql(_SERIES, select="select series_id, dataset, n from (select *, row_number() over (partition by dataset order by md5(concat('7|', series_id)), series_id) as turn from ser) order by turn, dataset limit 20"))
def cap_round_robin(spark, sf_dir):
    return sp.cap_round_robin(sp.series(points(spark, sf_dir)), 20, 7).select("series_id", "dataset", "n")


_FILTER = """cnt as (select series_id, count(*) as n_events from truth group by 1),
fr as (select s.series_id, case when not regexp_matches(s.series_id, '^d[01]/') then 'pattern' when n < 55 then 'too_short' when n > 75 then 'too_long' when coalesce(n_events, 0) < 8 then 'few_events' when n_pos::double / n > 0.25 then 'event_ratio' end as drop_reason from ser s left join cnt using (series_id))"""


@registry(sql(_SERIES, TRUTH_SQL, _FILTER, select="select * from fr"))
def series_filter_reasons(spark, sf_dir):
    p = points(spark, sf_dir)
    return sp.filter_reasons(sp.series(p), ev.labelled(p), "^d[01]/", 55, 75, 8, 0.25).select("series_id", "drop_reason")


@registry(sql(_SERIES, TRUTH_SQL, _FILTER, select=f"select coalesce(drop_reason, 'kept') as reason, {big('count(*)')} as n from fr group by 1"))
def load_summary(spark, sf_dir):
    p = points(spark, sf_dir)
    rows = sp.filter_reasons(sp.series(p), ev.labelled(p), "^d[01]/", 55, 75, 8, 0.25)
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@registry(sql(_SERIES, select="select series_id, dataset from (select *, row_number() over (partition by dataset order by has_event desc, md5(concat('5|', series_id)), series_id) as rank from ser) where rank <= 12"))
def balance_cap(spark, sf_dir):
    return sp.balanced(sp.series(points(spark, sf_dir)), 12, 5).select("series_id", "dataset")


_MASK = """pick as (select *, row_number() over (partition by series_id order by md5(concat('9|', series_id, '|', cast(event_id as varchar))), event_id) as pick, count(*) over (partition by series_id) as k from truth),
keepers as (select * from pick where pick <= case when k = 1 then 1 else round_even(k * 0.2, 0) end)"""


@registry(sql(TRUTH_SQL, _MASK, select=f"select p.series_id, {big('sum(p.y)')} as before, {big('sum(case when w.s is null then 0 else p.y end)')} as after from pts p left join keepers w on p.series_id = w.series_id and p.t >= w.s and p.t < w.e group by 1"))
def mask_low_label(spark, sf_dir):
    p = points(spark, sf_dir)
    masked = sp.masked_labels(p, ev.labelled(p), 0.2, 9).groupBy("series_id").agg(F.sum("y").alias("after"))
    return p.groupBy("series_id").agg(F.sum("y").alias("before")).join(masked, "series_id")


@registry(sql(_SERIES, TRUTH_SQL, _MASK, _split_sql("dataset"), select=f"select series_id, {big('row_number() over (partition by series_id order by s) - 1')} as event_id, s, e from keepers w where not exists (select 1 from spl where spl.series_id = w.series_id and split <> 'train')"))
def donor_pool_anti(spark, sf_dir):
    """Donors: the events that the mask left visible, of training series alone."""
    p = points(spark, sf_dir)
    pool = sp.donor_pool(p, sp.split(sp.series(p), 42), 0.2, 9)
    return pool.select("series_id", "event_id", "s", "e")


@registry(sql(TRUTH_SQL, "cnt as (select series_id, count(*) as c from truth group by 1)", select="select w.series_id, w.event_id, w.s, w.e, g.copy from truth w join cnt using (series_id), lateral (select unnest(generate_series(0, least(greatest(cast(floor((select max(c) from cnt) * 1.5) as bigint) - c, 0), 2))) as copy) g"))
def oversample_events(spark, sf_dir):
    return sp.oversampled(ev.labelled(points(spark, sf_dir)), 1.5)


@registry(sql("neg as (select * from pts where y = 0 order by md5(concat('3|', series_id, '|', cast(t as varchar))), series_id, t limit (select cast(floor(count(*) * 1.5) as bigint) from pts where y = 1))", select=f"select series_id, t, {r6('v')} as v, {big('y')} as y from (select * from pts where y = 1 union all select * from neg)"))
def negative_subsample(spark, sf_dir):
    return rounded(sp.negatives_capped(points(spark, sf_dir), 1.5, 3).select("series_id", "t", "v", "y"))


@registry(sql(_SERIES, TRUTH_SQL, _split_sql("dataset"), select=f"""select coalesce(split, '?') as split, {big("count(*)")} as n_points, {big("sum(y)")} as n_pos, {big("count(*) - sum(y)")} as n_neg, {big("count(distinct series_id)")} as n_series,
 {big("(select count(*) from truth w join spl x using (series_id) where x.split = s.split)")} as n_events from pts join spl s using (series_id) group by split"""))
def train_label_stats(spark, sf_dir):
    p = points(spark, sf_dir)
    s = sp.split(sp.series(p), 42).select("series_id", "split")
    e = ev.labelled(p).join(s, "series_id").groupBy("split").agg(F.count("*").alias("n_events"))
    rows = p.join(s, "series_id").groupBy("split").agg(F.count("*").alias("n_points"), F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg"), F.countDistinct("series_id").alias("n_series"))
    return rows.join(e, "split", "left")


@registry(sql(TRUTH_SQL, "last as (select series_id, max(t) as m from pts group by 1)", select=f"select w.series_id, w.event_id, {big('least(floor(least(greatest((w.s + w.e - 1) / 2e0 / m, 0), 1) * 8), 7)')} as bucket from truth w join last using (series_id)"))
def time_buckets(spark, sf_dir):
    p = points(spark, sf_dir)
    last = p.groupBy("series_id").agg(F.max("t").alias("m"))
    centre = F.least(F.greatest((F.col("s") + F.col("e") - 1) / 2.0 / F.col("m"), F.lit(0.0)), F.lit(1.0))
    return ev.labelled(p).join(last, "series_id").select("series_id", "event_id", F.least(F.floor(centre * 8), F.lit(7).cast("long")).alias("bucket"))


@registry("""select event_id, cast(case when lower(trim(event_type)) in ('error', 'anomaly', 'true', '1') then 1 when lower(trim(event_type)) in ('click', 'normal', 'false', '0') then 0
 else coalesce(cast(try_cast(event_type as double) > 0 as int), 0) end as bigint) as y from events""")
def label_normalize(spark, sf_dir):
    from seriesmill.functions.labels import normalized

    return table(spark, sf_dir, "events").select("event_id", normalized(F.col("event_type"), ("error", "anomaly", "true", "1"), ("click", "normal", "false", "0")).cast("long").alias("y"))


@registry(sql(select=f"select series_id, split_part(series_id, '/', 1) as dataset, {big('count(*)')} as n, {big('max(t)')} as last_t from pts group by 1"))
def series_identity(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.groupBy("series_id", F.split_part(F.col("series_id"), F.lit("/"), F.lit(1)).alias("dataset")).agg(F.count("*").alias("n"), F.max("t").alias("last_t"))


@registry(sql(PRED_SQL, select="select series_id, event_id, s, e from pred"))
def score_events(spark, sf_dir):
    return ev.predicted(points(spark, sf_dir), 30.0).select("series_id", "event_id", "s", "e")


@registry(sql(TRUTH_SQL, PRED_SQL, MATCH_SQL, select="select series_id, j as pred, hit as truth, round(iou, 6) as iou from walk where hit is not null", recursive=True))
def event_match(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(ev.matches(ev.labelled(p), ev.predicted(p, 30.0)))


def _prf_sql(beta: float) -> str:
    b = beta * beta
    return f"""select dataset, n_truth, n_pred, n_match, {r6("p")} as precision, {r6("r")} as recall, {r6(f"case when {b} * p + r > 0 then (1 + {b}) * p * r / ({b} * p + r) else 0 end")} as f, n_pred - n_match as false_positives from (
  select *, case when n_pred > 0 then n_match::double / n_pred else 0 end as p, case when n_truth > 0 then n_match::double / n_truth else 0 end as r from (
   select dataset, {big("(select count(*) from truth x where x.dataset = d.dataset)")} as n_truth, {big("(select count(*) from pred x where x.dataset = d.dataset)")} as n_pred,
    {big("(select count(*) from walk x where x.hit is not null and split_part(x.series_id, '/', 1) = d.dataset)")} as n_match from (select distinct dataset from pts) d))"""


@registry(sql(TRUTH_SQL, PRED_SQL, MATCH_SQL, select=_prf_sql(1.0), recursive=True))
def event_prf(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(ev.prf(ev.matched_counts(ev.labelled(p), ev.predicted(p, 30.0))))


@registry(sql(TRUTH_SQL, PRED_SQL, MATCH_SQL, select=_prf_sql(0.5), recursive=True))
def event_fbeta(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(ev.prf(ev.matched_counts(ev.labelled(p), ev.predicted(p, 30.0)), 0.5))


@registry()
def balance_points(spark, sf_dir):
    """Series within 2000 points a dataset. Tests hold the fold against a plain loop."""
    return sp.within_point_budget(sp.series(points(spark, sf_dir)), 2000, 5).select("series_id", "dataset", "n")


@registry(sql("fo as (select distinct dataset from pts), fr as (select dataset, row_number() over (order by md5(concat('42|', dataset)), dataset) as r, count(*) over () as n from fo)",
    select="select p.series_id, case when n = 1 or r = 1 then 'train' when n = 2 then 'test' when r <= case when a + b >= n then greatest(1, n - b - 1) else a end then 'train' when r <= case when a + b >= n then greatest(1, n - b - 1) else a end + b then 'val' else 'test' end as split from (select distinct series_id, dataset from pts) p join (select *, greatest(1, cast(round_even(n * 0.7, 0) as int)) as a, greatest(1, cast(round_even(n * 0.1, 0) as int)) as b from fr) using (dataset)"))
def split_folders(spark, sf_dir):
    return sp.split_by_folder(sp.series(points(spark, sf_dir)), 42).select("series_id", "split")
