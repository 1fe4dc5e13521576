"""Reporting over metric rows: tables, pivots, paired statistics, trade-offs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def metrics_from_events(events: DataFrame) -> DataFrame:
    """Metric rows derived from the events table: a row a (seed, detector, policy) observation."""
    return events.select(
        F.col("event_id"), F.col("event_type").alias("detector"), F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("policy"),
        (F.col("user_id") % 5).cast("long").alias("seed"), (F.col("value") / 600).alias("event_f1"), (F.col("event_id") % 50).cast("long").alias("false_positives"),
        F.when(F.col("event_id") % 11 != 0, True).when(F.col("event_id") % 22 == 0, False).alias("metrics_valid"),
    )


def valid(rows: DataFrame) -> DataFrame:
    """Rows whose metrics are known to be valid; null is invalid."""
    return rows.where(F.coalesce("metrics_valid", F.lit(False)))


def mean_std(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean, population std and count by group, null groups kept."""
    return rows.groupBy(*keys).agg(*[a for c in columns for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))], F.count("*").alias("n"))


def ranked(rows: DataFrame, metric: str, keys: tuple[str, ...] = (), higher: bool = True) -> DataFrame:
    """Dense rank within groups; missing metrics last."""
    order = F.desc_nulls_last(metric) if higher else F.asc_nulls_last(metric)
    return rows.withColumn("rank", F.dense_rank().over(W.partitionBy(*keys).orderBy(order)))


def relative_improvement(rows: DataFrame, baseline: str, metrics: list[str], keys: list[str], method: str = "policy") -> DataFrame:
    """(x - b) / |b| against the baseline row of the group; null if there is none or it is 0."""
    base = rows.where(F.col(method) == baseline).select(*keys, *[F.col(m).alias(f"{m}_base") for m in metrics])
    out = rows.join(base, keys, "left")
    gain = lambda m: F.when(F.abs(f"{m}_base") > 1e-12, (F.col(m) - F.col(f"{m}_base")) / F.abs(f"{m}_base"))
    return out.withColumns({f"{m}_gain": gain(m) for m in metrics}).drop(*[f"{m}_base" for m in metrics])


def balance(performance: Column, count: Column) -> Column:
    """Performance per log of the synthetic effort."""
    return performance / (1 + F.log1p(count))


def first_best(rows: DataFrame, metric: str, keys: tuple[str, ...], ties: tuple[str, ...]) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc_nulls_last(metric), *ties)
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def aggregated(rows: DataFrame, keys: list[str], metric: str = "event_f1") -> DataFrame:
    """Seeds in all, valid and invalid, and mean, std, median, min, max of the valid rows' metric."""
    ok = F.coalesce("metrics_valid", F.lit(False))
    x = F.when(ok, F.col(metric))
    return rows.groupBy(*keys).agg(
        F.countDistinct("seed").alias("seeds"), F.countDistinct(F.when(ok, F.col("seed"))).alias("seeds_valid"), F.count_if(~ok).alias("rows_invalid"), F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"), F.percentile(x, 0.5).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), F.min(ok.cast("int")).cast("long").alias("all_valid"),
    )


def paired(rows: DataFrame, a: str, b: str, metric: str = "event_f1") -> DataFrame:
    """Per detector and seed: the two policies' means on valid rows and their difference, where both exist."""
    by = valid(rows).groupBy("detector", "seed").agg(F.avg(F.when(F.col("policy") == a, F.col(metric))).alias("a"), F.avg(F.when(F.col("policy") == b, F.col(metric))).alias("b"))
    return by.where("a is not null and b is not null").withColumn("delta", F.col("a") - F.col("b"))


def paired_stats(pairs: DataFrame) -> DataFrame:
    """Per detector: seeds, mean, std, wins, win rate and t statistic of the differences."""
    sd = F.stddev_samp("delta")
    return pairs.groupBy("detector").agg(
        F.count("*").alias("seeds"), F.avg("delta").alias("mean_delta"), F.stddev_pop("delta").alias("std_delta"), F.count_if(F.col("delta") > 0).alias("wins"),
        F.avg((F.col("delta") > 0).cast("double")).alias("win_rate"), F.when(sd > 1e-12, F.avg("delta") / (sd / F.sqrt(F.count("*").cast("double")))).alias("t"),
    )


def t_p_value(t: float, df: int) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a if x > 0 else 0.0
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > 1e-300 else 1e-300), c if abs(c) > 1e-300 else 1e-300
            f *= d * c
    value = front * f
    return min(1.0, max(0.0, 1 - value if flip else value))


def wilcoxon_p_value(deltas: list[float]) -> float:
    """Two-sided exact signed-rank p, zeros dropped; 1 if all differences are alike. Up to 20 pairs, else the normal limit."""
    if not deltas or all(abs(d - deltas[0]) < 1e-12 for d in deltas):
        return 1.0
    d = sorted((x for x in deltas if x != 0), key=abs)
    n, ranks, i = len(d), [], 0
    while i < n:
        j = i
        while j + 1 < n and abs(d[j + 1]) == abs(d[i]):
            j += 1
        ranks += [(i + j) / 2 + 1] * (j - i + 1)
        i = j + 1
    plus = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
    w = min(plus, sum(ranks) - plus)
    if n > 20:
        z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
        return math.erfc(abs(z) / math.sqrt(2))
    sums = {0.0: 1}
    for r in ranks:
        more = dict(sums)
        for s, c in sums.items():
            more[s + r] = more.get(s + r, 0) + c
        sums = more
    return min(1.0, 2 * sum(c for s, c in sums.items() if s <= w) / 2**n)


def trade_off(curve: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per curve: the best point (F1, then fewer false positives, then the higher threshold), and the best with few false positives.

    Few is at most the true events, one at least; without such a point the one with the fewest.
    """
    by = W.partitionBy(*keys)
    best = F.row_number().over(by.orderBy(F.desc("f"), "fp", F.desc("threshold")))
    few = (F.col("fp") <= F.greatest(F.col("n_truth"), F.lit(1))).cast("int")
    limited = F.row_number().over(by.orderBy(F.desc(few), F.when(few == 1, -F.col("f")).otherwise(F.col("fp")), "fp", F.desc("threshold")))
    rows = curve.withColumns({"r1": best, "r2": limited})
    pick = lambda c, r: F.max(F.when(F.col(r) == 1, F.col(c)))
    return rows.groupBy(*keys).agg(
        pick("threshold", "r1").alias("best_threshold"), pick("f", "r1").alias("best_f"), pick("fp", "r1").alias("best_fp"), pick("threshold", "r2").alias("limited_threshold"), pick("f", "r2").alias("limited_f"), pick("fp", "r2").alias("limited_fp")
    )


def plus_minus(mean: Column, std: Column, digits: int = 4) -> Column:
    """'mean ± std' with fixed digits, '-' for null."""
    text = F.concat(F.format_string(f"%.{digits}f", mean), F.lit(" ± "), F.format_string(f"%.{digits}f", std))
    return F.when(mean.isNotNull() & std.isNotNull(), text).otherwise("-")


def mode_of(column: str) -> Column:
    """The most frequent string of a group, the smallest of equal ones; nulls don't count."""
    return F.mode(column, deterministic=True)


def aggregated_runs(rows: DataFrame, keys: list[str], metrics: list[str], modes: list[str] = (), sums: list[str] = ()) -> DataFrame:
    """A row a group (null keys kept): distinct seeds in all, valid and invalid, modes, mean, std (population), median, min and max of each metric over valid rows, means of counts, validity flags."""
    ok = F.coalesce("metrics_valid", F.lit(False))
    of = lambda m: F.when(ok, F.col(m))
    stats = [a for m in metrics for a in (F.avg(of(m)).alias(f"{m}_mean"), F.stddev_pop(of(m)).alias(f"{m}_std"), F.percentile(of(m), 0.5).alias(f"{m}_median"), F.min(of(m)).alias(f"{m}_min"), F.max(of(m)).alias(f"{m}_max"))]
    return rows.groupBy(*keys).agg(
        F.count_distinct("seed").alias("num_seeds_total"), F.count_distinct(F.when(ok, F.col("seed"))).alias("num_seeds_valid"), F.count_distinct(F.when(~ok, F.col("seed"))).alias("num_seeds_invalid"),
        *[mode_of(m).alias(f"{m}_mode") for m in modes], *stats, *[F.avg(c).alias(f"{c}_mean") for c in sums], F.max(ok).alias("any_seed_valid"), F.min(ok).alias("all_seeds_valid"),
    )


def pair_report(audit: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Donor pairs of an audit by keys (nulls kept): kept and rejected ones, the share kept, and each column's mean on either side."""
    ok = F.coalesce("accepted", F.lit(False))
    sides = [F.avg(F.when(side, F.col(c))).alias(f"{c}_{name}") for c in columns for name, side in (("kept", ok), ("rejected", ~ok))]
    rows = audit.where("record_type = 'donor_pair'").groupBy(*keys)
    return rows.agg(F.count("*").alias("num_pairs"), F.count_if(ok).alias("num_kept"), F.count_if(~ok).alias("num_rejected"), F.avg(ok.cast("double")).alias("keep_rate"), *sides)


def top_reasons(audit: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent rejection reasons, equal ones by name."""
    rows = audit.where("not accepted and coalesce(rejection_reason, '') <> ''").groupBy("rejection_reason").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "rejection_reason").limit(k)


def main_table(rows: DataFrame, baseline: str, detectors: list[str], policies: list[str]) -> DataFrame:
    """The main table: detectors by policies in a fixed order, F1 and false positives as mean ± std, and the share of seeds that beat the baseline's F1, as text."""
    by = valid(rows).groupBy("detector", "policy", "seed").agg(F.avg("event_f1").alias("f"), F.avg("false_positives").alias("fp"))
    base = by.where(F.col("policy") == baseline).select("detector", "seed", F.col("f").alias("b"))
    both = by.join(base, ["detector", "seed"], "left")
    table = both.groupBy("detector", "policy").agg(
        F.avg("f").alias("fm"), F.stddev_pop("f").alias("fs"), F.avg("fp").alias("pm"), F.stddev_pop("fp").alias("ps"), F.count_if(F.col("f") > F.col("b")).alias("wins"), F.count("b").alias("n"),
    )
    spark = rows.sparkSession
    order = spark.createDataFrame([(d, p, i, j) for i, d in enumerate(detectors) for j, p in enumerate(policies)], "detector string, policy string, i long, j long")
    rate = F.when((F.col("policy") == baseline) | (F.coalesce("n", F.lit(0)) == 0), "-").otherwise(F.concat_ws("/", F.col("wins").cast("string"), F.col("n").cast("string")))
    out = order.join(table, ["detector", "policy"], "left").orderBy("i", "j")
    return out.select("i", "j", "detector", "policy", plus_minus(F.col("fm"), F.col("fs"), 3).alias("event_f1"), plus_minus(F.col("pm"), F.col("ps"), 1).alias("false_positives"), F.coalesce(rate, F.lit("-")).alias("wins"))


def markdown(rows: DataFrame, digits: int = 4) -> str:
    """A small table as Markdown text, '-' for nulls."""
    show = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [rows.columns, ["---"] * len(rows.columns), *[[show(v) for v in r] for r in rows.collect()]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


def sweep_page(metrics: DataFrame, baseline: str = "real_only", metric: str = "event_f1") -> str:
    """A page on a label sweep: the best method a fraction, each method's difference from the baseline, and what stands out in words."""
    by = metrics.groupBy("labeled_fraction", "method").agg(F.avg(metric).alias(metric), F.avg("num_synthetic_windows").alias("windows"))
    base = by.where(F.col("method") == baseline).select("labeled_fraction", F.col(metric).alias("base"))
    rows = by.join(base, "labeled_fraction", "left").withColumn("delta", F.col(metric) - F.col("base"))
    best = first_best(rows, metric, ("labeled_fraction",), ("method",)).orderBy("labeled_fraction").select("labeled_fraction", "method", metric, "delta")
    words = []
    for r in best.collect():
        words.append(f"- At {r.labeled_fraction:g} of the labels {r.method} is best" + (f", {r.delta:+.4f} against {baseline}." if r.delta is not None and r.method != baseline else "."))
    idle = [r.method for r in rows.where("windows = 0").where(F.col("method") != baseline).select("method").distinct().orderBy("method").collect()]
    words += [f"- Without any synthetic window: {', '.join(idle)}."] if idle else []
    every = rows.orderBy("labeled_fraction", "method").select("labeled_fraction", "method", metric, "delta", "windows")
    return "\n".join(["# Label sweep", "", *words, "", "## Best method", "", markdown(best), "## All methods", "", markdown(every)])


def snippet(points: DataFrame, windows_: DataFrame, padding: int = 20) -> DataFrame:
    """Figure data: each window (series_id, event_id, s, e) with ``padding`` points on either side, as standard scores of the snippet, and whether a point lies inside."""
    w = windows_.select(F.col("series_id").alias("k"), "event_id", "s", "e")
    rows = points.join(w, (F.col("series_id") == F.col("k")) & F.col("t").between(F.col("s") - padding, F.col("e") + padding - 1))
    by = W.partitionBy("series_id", "event_id")
    std = F.stddev_pop("v").over(by)
    return rows.select("series_id", "event_id", "t", ((F.col("v") - F.avg("v").over(by)) / F.when(std > 1e-8, std).otherwise(1.0)).alias("z"), ((F.col("t") >= F.col("s")) & (F.col("t") < F.col("e"))).alias("inside"))
