"""Event windows of labelled points: runs, masks, statistics, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(points: DataFrame, positive: Column, min_length: int = 1, merge_gap: int = 0) -> DataFrame:
    """Half-open windows (series_id, dataset, event_id, s, e) of consecutive positive points.

    Windows whose gap is at most ``merge_gap`` become one, then windows shorter
    than ``min_length`` go. One exchange by series; gaps-and-islands on t.
    """
    by = W.partitionBy("series_id").orderBy("t")
    hot = points.where(positive).select("series_id", "dataset", "t")
    apart = hot.withColumn("new", (F.col("t") - F.lag("t").over(by) - 1 > F.lit(merge_gap)).cast("int"))
    grouped = apart.withColumn("island", F.sum(F.coalesce("new", F.lit(1))).over(by.rowsBetween(W.unboundedPreceding, 0)))
    spans = grouped.groupBy("series_id", "dataset", "island").agg(F.min("t").alias("s"), (F.max("t") + 1).alias("e"))
    kept = spans.where(F.col("e") - F.col("s") >= min_length)
    number = F.row_number().over(W.partitionBy("series_id").orderBy("s")) - 1
    return kept.select("series_id", "dataset", number.cast("long").alias("event_id"), "s", "e")


def labelled(points: DataFrame, min_length: int = 1, merge_gap: int = 0) -> DataFrame:
    return runs(points, F.col("y") == 1, min_length, merge_gap)


def predicted(points: DataFrame, threshold: float, min_length: int = 3, merge_gap: int = 2, score: str = "v") -> DataFrame:
    """Windows of points whose score reaches the threshold, smoothed."""
    return runs(points, F.col(score) >= threshold, min_length, merge_gap)


def mask(points: DataFrame, windows: DataFrame) -> DataFrame:
    """Points with m = 1 inside a window: a range join under the series key."""
    w = windows.select(F.col("series_id").alias("k"), "s", "e")
    inside = points.join(w, (F.col("series_id") == F.col("k")) & F.col("t").between(F.col("s"), F.col("e") - 1), "left")
    return inside.groupBy("series_id", "t").agg(F.max(F.when(F.col("k").isNotNull(), 1).otherwise(0)).alias("m"))


def stats(points: DataFrame, windows: DataFrame) -> DataFrame:
    """One row: series, points, events, event lengths, anomaly ratio."""
    p = points.agg(F.countDistinct("series_id").alias("n_series"), F.count("*").alias("n_points"), F.avg(F.col("y").cast("double")).alias("anomaly_ratio"))
    n = F.col("e") - F.col("s")
    e = windows.agg(F.count("*").alias("n_events"), F.min(n).alias("min_length"), F.avg(n.cast("double")).alias("mean_length"), F.max(n).alias("max_length"))
    return p.crossJoin(F.broadcast(e))  # one row each


def segments(points: DataFrame, windows: DataFrame, padding: int = 0) -> DataFrame:
    """Windows with their values, local time (0 to 1) and padded context."""
    w = windows.select(F.col("series_id").alias("k"), "event_id", "s", "e")
    joined = points.join(w, (F.col("series_id") == F.col("k")) & F.col("t").between(F.col("s") - padding, F.col("e") + padding - 1))
    inside = (F.col("t") >= F.col("s")) & (F.col("t") < F.col("e"))
    pair = F.struct("t", "v")
    rows = joined.groupBy("series_id", "event_id", "s", "e").agg(F.sort_array(F.collect_list(pair)).alias("c"), F.sort_array(F.collect_list(F.when(inside, pair))).alias("x"))
    n = F.col("e") - F.col("s")
    local = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(n == 1, 0.0).otherwise(i / (n - 1)))
    return rows.select(
        "series_id", "event_id", "s", "e", F.transform("x", lambda p: p["v"]).alias("values"), local.alias("local_time"), F.transform("c", lambda p: p["v"]).alias("context")
    )


def matches(truth: DataFrame, preds: DataFrame, iou_threshold: float = 0.1) -> DataFrame:
    """Greedy matches (series_id, pred, truth, iou), predictions in order, each truth once.

    The overlap is over the hull of both windows. Each prediction takes the best
    unmatched truth, the first of equal ones. Matching depends on order, so it is a
    fold over predictions; only truths that overlap are offered. Predictions whose
    offers no earlier one shares begin an island, and each island is folded alone, so a
    long series costs what its islands do.
    """
    p = preds.select("series_id", F.col("event_id").alias("j"), F.col("s").alias("ps"), F.col("e").alias("pe"))
    t = truth.select(F.col("series_id").alias("k"), F.col("event_id").alias("i"), "s", "e")
    common = F.greatest(F.least("pe", "e") - F.greatest("ps", "s"), F.lit(0))
    iou = common / (F.greatest("pe", "e") - F.least("ps", "s"))
    near = p.join(t, (F.col("series_id") == F.col("k")) & (F.col("s") < F.col("pe")) & (F.col("ps") < F.col("e"))).withColumn("iou", iou)
    offers = near.where(F.col("iou") >= iou_threshold).groupBy("series_id", "j").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("u"), "i"))).alias("offer"), F.min("i").alias("low"), F.max("i").alias("high")
    )
    by = W.partitionBy("series_id").orderBy("j")
    apart = F.coalesce((F.col("low") > F.max("high").over(by.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(0))
    islands = offers.withColumn("new", apart).withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    lists = islands.groupBy("series_id", "island").agg(F.sort_array(F.collect_list(F.struct("j", "offer"))).alias("q"))
    none = F.array().cast("array<struct<j:bigint,i:bigint,iou:double>>")

    def step(done: Column, x: Column) -> Column:
        free = F.filter(x["offer"], lambda o: ~F.exists(done, lambda d: d["i"] == o["i"]))
        best = F.get(free, F.lit(0))
        return F.when(F.size(free) > 0, F.concat(done, F.array(F.struct(x["j"].alias("j"), best["i"].alias("i"), (-best["u"]).alias("iou"))))).otherwise(done)

    return lists.select("series_id", F.explode(F.aggregate("q", none, step)).alias("m")).select("series_id", F.col("m.j").alias("pred"), F.col("m.i").alias("truth"), F.col("m.iou").alias("iou"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def f_beta(p: Column, r: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return ratio((1 + b) * p * r, b * p + r)


def matched_counts(truth: DataFrame, preds: DataFrame, keys: tuple[str, ...] = ("dataset",), iou_threshold: float = 0.1) -> DataFrame:
    """n_truth, n_pred and n_match by the keys of the windows."""
    found = matches(truth, preds, iou_threshold).withColumnRenamed("pred", "event_id")
    hit = preds.join(found, ["series_id", "event_id"], "left")
    p = hit.groupBy(*keys).agg(F.count("*").alias("n_pred"), F.count("truth").alias("n_match"))
    t = truth.groupBy(*keys).agg(F.count("*").alias("n_truth"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.join(p, list(keys), "full").select(*keys, zero("n_truth"), zero("n_pred"), zero("n_match"))


def prf(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """Adds precision, recall, F-beta and false positives."""
    p, r = ratio(F.col("n_match"), F.col("n_pred")), ratio(F.col("n_match"), F.col("n_truth"))
    return counts.withColumns({"precision": p, "recall": r, "f": f_beta(p, r, beta), "false_positives": F.col("n_pred") - F.col("n_match")})
