"""Queries on reporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import audit as au
from seriesmill.operators import report as re
from seriesmill.plans.twin import Registry, big, r6, rounded
from seriesmill.session import table

registry = Registry()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES

_M = """with m as (select event_id, event_type as detector, concat('p', cast(user_id % 4 as varchar)) as policy, user_id % 5 as seed, value / 600 as event_f1, event_id % 50 as false_positives,
  case when event_id % 11 <> 0 then true when event_id % 22 = 0 then false end as metrics_valid from events),
v as (select * from m where metrics_valid is true)"""


def _metrics(spark, sf_dir):
    return re.metrics_from_events(table(spark, sf_dir, "events"))


@registry(f"{_M} select detector, policy, {r6('avg(event_f1)')} as event_f1_mean, {r6('stddev_pop(event_f1)')} as event_f1_std, {big('count(*)')} as n from m group by 1, 2")
def mean_std(spark, sf_dir):
    return rounded(re.mean_std(_metrics(spark, sf_dir), ["detector", "policy"], ["event_f1"]))


_G = f"g as (select detector, policy, avg(event_f1) as f, avg(false_positives) as fp from v group by 1, 2)"


def _grouped(spark, sf_dir):
    return re.valid(_metrics(spark, sf_dir)).groupBy("detector", "policy").agg(F.avg("event_f1").alias("f"), F.avg("false_positives").alias("fp"))


@registry(f"{_M}, {_G} select detector, policy, {big('dense_rank() over (partition by detector order by f desc)')} as rank from g")
def dense_rank(spark, sf_dir):
    return rounded(re.ranked(_grouped(spark, sf_dir), "f", ("detector",)).select("detector", "policy", "rank"))


@registry(f"{_M}, {_G} select a.detector, a.policy, {r6('case when abs(b.f) > 1e-12 then (a.f - b.f) / abs(b.f) end')} as f_gain from g a left join g b on a.detector = b.detector and b.policy = 'p0'")
def relative_improvement(spark, sf_dir):
    return rounded(re.relative_improvement(_grouped(spark, sf_dir), "p0", ["f"], ["detector"]).select("detector", "policy", "f_gain"))


@registry(f"{_M}, {_G} select detector, policy, {r6('f / (1 + ln(1 + fp))')} as balance, printf('%.3f', f) as text from g")
def balance_score(spark, sf_dir):
    return rounded(_grouped(spark, sf_dir).select("detector", "policy", re.balance(F.col("f"), F.col("fp")).alias("balance"), F.format_string("%.3f", "f").alias("text")))


@registry(f"{_M}, {_G} select detector, arg_max(policy, f) as policy, {r6('max(f)')} as f from g group by 1")
def best_per_group(spark, sf_dir):
    return rounded(re.first_best(_grouped(spark, sf_dir), "f", ("detector",), ("policy",)).select("detector", "policy", "f"))


@registry(f"{_M}, s as (select seed, sum(false_positives) as p from v group by 1) select {big('count(*)')} as violations from (select p, lag(p) over (order by seed) as q from s) where p < q")
def monotone_check(spark, sf_dir):
    from pyspark.sql import Window as W

    s = re.valid(_metrics(spark, sf_dir)).groupBy("seed").agg(F.sum("false_positives").alias("p"))  # a row a seed
    return s.withColumn("q", F.lag("p").over(W.orderBy("seed"))).agg(F.count_if(F.col("p") < F.col("q")).alias("violations"))


@registry(f"{_M}, f as (select seed, policy, avg(event_f1) as f from v group by 1, 2) select a.seed, a.policy, {r6('a.f - b.f')} as delta from f a join f b on a.seed = b.seed and b.policy = 'p0' where a.policy <> 'p0'")
def sweep_deltas(spark, sf_dir):
    f = re.valid(_metrics(spark, sf_dir)).groupBy("seed", "policy").agg(F.avg("event_f1").alias("f"))
    base = f.where("policy = 'p0'").select("seed", F.col("f").alias("b"))
    return rounded(f.where("policy <> 'p0'").join(base, "seed").select("seed", "policy", (F.col("f") - F.col("b")).alias("delta")))


@registry(f"{_M}, {_G} select detector, round(corr(f, fp), 5) as r, {big('count(*)')} as n from g group by 1")
def transfer_corr(spark, sf_dir):
    return rounded(_grouped(spark, sf_dir).groupBy("detector").agg(F.corr("f", "fp").alias("r"), F.count("*").alias("n")), 5)


@registry(f"{_M} select detector, " + ", ".join(f"""{r6(f"avg(event_f1) filter (where policy = 'p{k}')")} as p{k}""" for k in range(4)) + " from v group by 1")
def pivot_metric(spark, sf_dir):
    return rounded(re.valid(_metrics(spark, sf_dir)).groupBy("detector").pivot("policy", ["p0", "p1", "p2", "p3"]).agg(F.avg("event_f1")))


@registry(f"{_M}, w as (select detector, avg(event_f1) filter (where policy = 'p9') as pref, avg(event_f1) filter (where policy = 'p1') as alt, avg(event_f1) filter (where policy = 'p0') as base from v group by 1) select detector, {r6('coalesce(pref, alt) - base')} as gain, cast(coalesce(pref, alt) > base as varchar) as strict from w")
def gain_summary(spark, sf_dir):
    of = lambda p: F.avg(F.when(F.col("policy") == p, F.col("event_f1")))
    w = re.valid(_metrics(spark, sf_dir)).groupBy("detector").agg(F.coalesce(of("p9"), of("p1")).alias("x"), of("p0").alias("base"))
    return rounded(w.select("detector", (F.col("x") - F.col("base")).alias("gain"), (F.col("x") > F.col("base")).cast("string").alias("strict")))


@registry(f"{_M} select detector, {big('count(*)')} as n_valid from v group by 1")
def valid_rows(spark, sf_dir):
    return re.valid(_metrics(spark, sf_dir)).groupBy("detector").agg(F.count("*").alias("n_valid"))


@registry(f"""{_M} select detector, policy, {big('count(distinct seed)')} as seeds, {big('count(distinct case when metrics_valid is true then seed end)')} as seeds_valid, {big('count(*) filter (where metrics_valid is not true)')} as rows_invalid,
 {r6('avg(event_f1) filter (where metrics_valid is true)')} as mean, {r6('stddev_pop(event_f1) filter (where metrics_valid is true)')} as std, {r6('quantile_cont(event_f1, 0.5) filter (where metrics_valid is true)')} as median,
 {r6('min(event_f1) filter (where metrics_valid is true)')} as min, {r6('max(event_f1) filter (where metrics_valid is true)')} as max, {big('min(case when metrics_valid is true then 1 else 0 end)')} as all_valid from m group by 1, 2""")
def aggregate_seeds(spark, sf_dir):
    return rounded(re.aggregated(_metrics(spark, sf_dir), ["detector", "policy"]))


_PAIR = "d as (select *, a - b as delta from (select detector, seed, avg(event_f1) filter (where policy = 'p1') as a, avg(event_f1) filter (where policy = 'p0') as b from v group by 1, 2) where a is not null and b is not null)"


@registry(f"{_M}, {_PAIR} select detector, {big('count(*)')} as seeds, {r6('avg(delta)')} as mean_delta, {r6('stddev_pop(delta)')} as std_delta, {big('count(*) filter (where delta > 0)')} as wins, {r6('avg(case when delta > 0 then 1e0 else 0 end)')} as win_rate, {r6('case when stddev_samp(delta) > 1e-12 then avg(delta) / (stddev_samp(delta) / sqrt(count(*)::double)) end')} as t from d group by 1")
def paired_stats(spark, sf_dir):
    return rounded(re.paired_stats(re.paired(_metrics(spark, sf_dir), "p1", "p0")))


@registry(f"{_M}, {_PAIR}, e as (select detector, seed, avg(false_positives) filter (where policy = 'p0') - avg(false_positives) filter (where policy = 'p1') as less from v group by 1, 2) select detector, {big('count(*) filter (where delta > 0)')} as wins, {big('count(*) filter (where less > 0)')} as fewer_fp, {r6('avg(less)')} as fp_reduction from d join e using (detector, seed) group by 1")
def win_table(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    both = re.paired(m, "p1", "p0").join(re.paired(m, "p0", "p1", "false_positives").select("detector", "seed", F.col("delta").alias("less")), ["detector", "seed"])
    return rounded(both.groupBy("detector").agg(F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("less") > 0).alias("fewer_fp"), F.avg("less").alias("fp_reduction")))


@registry(f"{_M}, {_G} select detector, policy, {r6('f')} as f, gain from (select g.*, case when f - b > 0.001 then 'gain' when f - b < -0.001 then 'hurt' else 'same' end as gain, row_number() over (partition by detector order by f desc, fp, policy) as k from g join (select detector, f as b from g where policy = 'p0') using (detector)) where k = 1")
def best_policy(spark, sf_dir):
    g = _grouped(spark, sf_dir)
    base = g.where("policy = 'p0'").select("detector", F.col("f").alias("b"))
    best = re.first_best(g.join(base, "detector"), "f", ("detector",), ("fp", "policy"))
    d = F.col("f") - F.col("b")
    return rounded(best.select("detector", "policy", "f", F.when(d > 0.001, "gain").when(d < -0.001, "hurt").otherwise("same").alias("gain")))


@registry(f"{_M}, {_PAIR}, e as (select detector, seed, avg(false_positives) filter (where policy = 'p1') - avg(false_positives) filter (where policy = 'p0') as more from v group by 1, 2) select detector, seed, concat_ws('|', case when delta < 0 then 'lower_f1' end, case when more > 0 then 'more_fp' end) as reasons from d join e using (detector, seed) where delta < 0 or more > 0")
def negative_cases(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    both = re.paired(m, "p1", "p0").join(re.paired(m, "p1", "p0", "false_positives").select("detector", "seed", F.col("delta").alias("more")), ["detector", "seed"])
    why = F.concat_ws("|", F.when(F.col("delta") < 0, "lower_f1"), F.when(F.col("more") > 0, "more_fp"))
    return both.where("delta < 0 or more > 0").select("detector", "seed", why.alias("reasons"))


_CURVE = "c as (select detector, floor(event_f1 * 10) / 10 as threshold, avg(event_f1) * (1 - abs(floor(event_f1 * 10) / 10 - 0.1)) as f, sum(false_positives) % 97 as fp, 40 as n_truth from v group by 1, 2)"


def _curve(spark, sf_dir):
    step = F.floor(F.col("event_f1") * 10) / 10
    rows = re.valid(_metrics(spark, sf_dir)).groupBy("detector", step.alias("threshold")).agg(F.avg("event_f1").alias("x"), (F.sum("false_positives") % 97).alias("fp"))
    return rows.select("detector", "threshold", (F.col("x") * (1 - F.abs(F.col("threshold") - 0.1))).alias("f"), "fp", F.lit(40).cast("long").alias("n_truth"))


@registry(f"""{_M}, {_CURVE}, r as (select *, row_number() over (partition by detector order by f desc, fp, threshold desc) as r1,
 row_number() over (partition by detector order by case when fp <= 40 then 0 else 1 end, case when fp <= 40 then -f else fp end, fp, threshold desc) as r2 from c)
 select detector, {r6('max(threshold) filter (where r1 = 1)')} as best_threshold, {r6('max(f) filter (where r1 = 1)')} as best_f, {big('max(fp) filter (where r1 = 1)')} as best_fp,
 {r6('max(threshold) filter (where r2 = 1)')} as limited_threshold, {r6('max(f) filter (where r2 = 1)')} as limited_f, {big('max(fp) filter (where r2 = 1)')} as limited_fp from r group by 1""")
def tradeoff_points(spark, sf_dir):
    return rounded(re.trade_off(_curve(spark, sf_dir), ("detector",)))


@registry(f"{_M}, s as (select detector, seed, count(*) as n, sum(false_positives) as fp from m group by 1, 2) select coalesce(detector, 'TOTAL') as detector, {r6('avg(n)')} as mean_n, {big('min(n)')} as min_n, {big('max(n)')} as max_n from (select detector, seed, n from s union all select null, seed, sum(n) from s group by seed) group by detector")
def setup_rollup(spark, sf_dir):
    s = _metrics(spark, sf_dir).groupBy("detector", "seed").agg(F.count("*").alias("n"))
    total = s.groupBy("seed").agg(F.sum("n").alias("n")).select(F.lit("TOTAL").alias("detector"), "seed", "n")
    return rounded(s.unionByName(total).groupBy("detector").agg(F.avg("n").alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n")))


@registry(f"{_M} select detector, policy, coalesce(concat(printf('%.3f', avg(event_f1)), ' ± ', printf('%.3f', stddev_pop(event_f1))), '-') as text from v group by 1, 2")
def full_table(spark, sf_dir):
    g = re.valid(_metrics(spark, sf_dir)).groupBy("detector", "policy").agg(F.avg("event_f1").alias("m"), F.stddev_pop("event_f1").alias("s"))
    return g.select("detector", "policy", re.plus_minus(F.col("m"), F.col("s"), 3).alias("text"))


@registry(f"{_M}, {_G}, b as (select detector, policy, f, row_number() over (partition by detector order by f desc, policy) as k from g where policy <> 'p0') select b.detector, b.policy, {r6('b.f - g.f')} as delta from b join g on g.detector = b.detector and g.policy = 'p0' where k = 1")
def best_vs_baseline(spark, sf_dir):
    g = _grouped(spark, sf_dir)
    best = re.first_best(g.where("policy <> 'p0'"), "f", ("detector",), ("policy",))
    base = g.where("policy = 'p0'").select("detector", F.col("f").alias("b"))
    return rounded(best.join(base, "detector").select("detector", "policy", (F.col("f") - F.col("b")).alias("delta")))


@registry(f"{_M} select detector, policy, {big('count(*) filter (where false_positives < 20)')} as kept, {big('count(*) filter (where false_positives >= 20)')} as rejected, {r6('avg(event_f1) filter (where false_positives < 20)')} as mean_kept, {r6('avg(event_f1) filter (where false_positives >= 20)')} as mean_rejected from m group by 1, 2")
def compat_filter_summary(spark, sf_dir):
    kept = F.col("false_positives") < 20
    return rounded(_metrics(spark, sf_dir).groupBy("detector", "policy").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("rejected"), F.avg(F.when(kept, F.col("event_f1"))).alias("mean_kept"), F.avg(F.when(~kept, F.col("event_f1"))).alias("mean_rejected")))


@registry("select distinct event_type as detector, case event_type when 'view' then 'View' when 'click' then 'Click' when 'purchase' then 'Purchase' else event_type end as label, cast(coalesce(list_position(['view', 'click', 'purchase'], event_type), 99) as bigint) as place from events")
def label_order(spark, sf_dir):
    d = F.col("event_type")
    order = F.array(*map(F.lit, ("view", "click", "purchase")))
    place = F.array_position(order, d)
    return table(spark, sf_dir, "events").select(d.alias("detector"), F.when(d.isin("view", "click", "purchase"), F.initcap(d)).otherwise(d).alias("label"), F.when(place > 0, place).otherwise(99).cast("long").alias("place")).distinct()


@registry(f"{_M}, u as (select detector, policy, event_f1, cast(null as bigint) as fraction from m where policy = 'p0' union all select detector, policy, event_f1, seed from m where policy <> 'p0') select policy, fraction, {big('count(*)')} as n, {r6('avg(event_f1)')} as f from u group by 1, 2")
def sweep_union(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    a = m.where("policy = 'p0'").select("detector", "policy", "event_f1")
    b = m.where("policy <> 'p0'").select("detector", "policy", "event_f1", F.col("seed").alias("fraction"))
    return rounded(a.unionByName(b, allowMissingColumns=True).groupBy("policy", "fraction").agg(F.count("*").alias("n"), F.avg("event_f1").alias("f")))


#: Raw reasons, their stages and the names they get: a row of ``events`` takes one by its id.
_CASES = (
    ("", "kept", ""), ("below_min_score:shape", "compatibility", "below_compatibility_threshold"), ("below_top_quantile_0.9", "compatibility", "below_top_quantile_0.5"),
    ("cross_dataset_not_allowed", "compatibility", "cross_dataset_disallowed"), ("skip", "synthesis", "no_compatible_donor"), ("no_donors_found", "synthesis", "synthesis_failed"),
    ("strict_filter_failed:aggregate_confidence", "strict_filter", "strict_filter_failed:aggregate_confidence"), ("aggregate_confidence_below_0.5", "quality_filter", "below_quality_threshold"),
    ("odd", "compatibility", "rejected_incompatible_donor"), ("odd", "evaluator", "odd"), ("filtered_by_top_k_or_quantile", "compatibility", "below_top_quantile_0.5"), ("", "compatibility", ""),
)
_KEYS = ("kept", "below_compatibility_threshold", "below_top_quantile_0.5", "cross_dataset_disallowed", "no_compatible_donor", "synthesis_failed", "strict_filter_failed:aggregate_confidence", "below_quality_threshold",
         "rejected_incompatible_donor", "evaluator_invalid", "below_top_quantile_0.5", "rejected_incompatible_donor")


def _case_sql(values) -> str:
    return f"case event_id % {len(_CASES)} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


def _reasons(spark, sf_dir):
    k = (F.col("event_id") % len(_CASES)).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(c[i]) for c in _CASES]), k)
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("method"), pick(0).alias("raw"), pick(1).alias("stage"), (k == 0).alias("accepted"))


@registry(f"select event_id, {_case_sql(c[0] for c in _CASES)} as raw, {_case_sql(c[2] for c in _CASES)} as reason from events")
def rejection_norm(spark, sf_dir):
    return _reasons(spark, sf_dir).select("event_id", "raw", au.normalized_reason(F.col("raw"), F.col("stage")).alias("reason"))


@registry(f"select event_type as method, {_case_sql(_KEYS)} as reason, {big('count(*)')} as n from events group by 1, 2")
def rejection_counts(spark, sf_dir):
    rows = _reasons(spark, sf_dir)
    return rows.groupBy("method", au.reason_key(F.col("accepted"), F.col("stage"), F.col("raw")).alias("reason")).agg(F.count("*").alias("n"))


@registry(f"{_M} select policy, {big('count(*)')} as n_windows, {big('sum(false_positives)')} as n_points, {big('count(*) filter (where metrics_valid is false)')} as n_rejected from m group by 1")
def synth_counts(spark, sf_dir):
    return _metrics(spark, sf_dir).groupBy("policy").agg(F.count("*").alias("n_windows"), F.sum("false_positives").alias("n_points"), F.count_if(~F.col("metrics_valid")).alias("n_rejected"))


def _stats_sql(c: str) -> str:
    v = f"filter (where metrics_valid is true)"
    return f"{r6(f'avg({c}) {v}')} as {c}_mean, {r6(f'stddev_pop({c}) {v}')} as {c}_std, {r6(f'quantile_cont({c}::double, 0.5) {v}')} as {c}_median, {r6(f'min({c}) {v}')} as {c}_min, {r6(f'max({c}) {v}')} as {c}_max"


@registry(f"""{_M}, mo as (select detector, policy, first(k order by n desc, k) as k from (select detector, policy, concat('k', cast(event_id % 7 as varchar)) as k, count(*) as n from m group by 1, 2, 3) group by 1, 2)
select m.detector, m.policy, {big('count(distinct seed)')} as num_seeds_total, {big('count(distinct case when metrics_valid is true then seed end)')} as num_seeds_valid, {big('count(distinct case when metrics_valid is not true then seed end)')} as num_seeds_invalid,
 any_value(mo.k) as kind_mode, {_stats_sql('event_f1')}, {_stats_sql('false_positives')}, bool_or(metrics_valid is true) as any_seed_valid, bool_and(metrics_valid is true) as all_seeds_valid from m join mo using (detector, policy) group by 1, 2""")
def aggregate_runs(spark, sf_dir):
    rows = _metrics(spark, sf_dir).withColumn("kind", F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string")))
    out = re.aggregated_runs(rows, ["detector", "policy"], ["event_f1", "false_positives"], ["kind"])
    return rounded(out.withColumns({c: F.col(c).cast("double") for c in ("false_positives_min", "false_positives_max")}))


@registry(f"""{_M}, bs as (select detector, policy, seed, avg(event_f1) as f, avg(false_positives) as fp from v group by 1, 2, 3), bb as (select bs.*, z.f as b from bs left join (select detector, seed, f from bs where policy = 'p0') z using (detector, seed)),
od as (select d as detector, i, p as policy, j from (select unnest(['click', 'view', 'odd']) as d, unnest(range(3)) as i), (select unnest(['p0', 'p2']) as p, unnest(range(2)) as j)),
tb as (select detector, policy, concat(printf('%.3f', avg(f)), ' ± ', printf('%.3f', stddev_pop(f))) as a, concat(printf('%.1f', avg(fp)), ' ± ', printf('%.1f', stddev_pop(fp))) as c, count(*) filter (where f > b) as w, count(b) as n from bb group by 1, 2)
select {big('i')} as i, {big('j')} as j, detector, policy, coalesce(a, '-') as event_f1, coalesce(c, '-') as false_positives, case when policy = 'p0' or coalesce(n, 0) = 0 then '-' else concat(w, '/', n) end as wins from od left join tb using (detector, policy)""")
def main_table(spark, sf_dir):
    return re.main_table(_metrics(spark, sf_dir), "p0", ["click", "view", "odd"], ["p0", "p2"])
