"""Point metrics, threshold grids, calibration and reconstruction metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.operators.events import f_beta, ratio
from seriesmill.session import checkpointed


def levels(points: DataFrame, keys: tuple[str, ...] = (), score: str = "v", label: str = "y") -> DataFrame:
    """Per distinct score: positives and points at it (pos, n) and at or above it (tp, pp), and the totals (p, total).

    Scores are pre-aggregated, so the running sums go over distinct scores only. Without keys these are dealt to ranges
    of scores; a range sums its own, and adds the sums of the ranges above, a row each.
    """
    by = points.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.col(label)).alias("pos"), F.count("*").alias("n"))
    if keys:
        down = W.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
        every = W.partitionBy(*keys)
        return by.withColumns({"tp": F.sum("pos").over(down), "pp": F.sum("n").over(down), "p": F.sum("pos").over(every), "total": F.sum("n").over(every)})
    dealt = checkpointed(by.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()))
    few = W.partitionBy(F.lit(0)).orderBy("part")  # a row a range
    above = dealt.groupBy("part").agg(F.sum("pos").alias("a"), F.sum("n").alias("b"))
    above = above.select("part", *[F.coalesce(F.sum(c).over(few.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"{c}_above") for c in "ab"], F.sum("a").over(W.partitionBy(F.lit(0))).alias("p"), F.sum("b").over(W.partitionBy(F.lit(0))).alias("total"))
    down = W.partitionBy("part").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    own = dealt.withColumns({"tp": F.sum("pos").over(down), "pp": F.sum("n").over(down)}).join(F.broadcast(above), "part")
    return own.select("score", "pos", "n", (F.col("tp") + F.col("a_above")).alias("tp"), (F.col("pp") + F.col("b_above")).alias("pp"), "p", "total")


def auroc(points: DataFrame, keys: tuple[str, ...] = (), score: str = "v", label: str = "y") -> DataFrame:
    """Area under the ROC curve by mid-ranks; null for one class."""
    by = levels(points, keys, score, label)
    # of each level: negatives below plus half of those at it, for each positive
    below = F.col("total") - F.col("pp") - (F.col("p") - F.col("tp"))
    at = F.col("n") - F.col("pos")
    wins = F.sum(F.col("pos") * (below + at / 2.0))
    return by.groupBy(*keys).agg(wins.alias("w"), F.max("p").alias("p"), F.max("total").alias("total")).select(
        *keys, F.when((F.col("p") > 0) & (F.col("p") < F.col("total")), F.col("w") / (F.col("p").cast("double") * (F.col("total") - F.col("p")))).alias("auroc")
    )


def average_precision(points: DataFrame, keys: tuple[str, ...] = (), score: str = "v", label: str = "y") -> DataFrame:
    """Step-wise average precision; null for one class."""
    by = levels(points, keys, score, label)
    area = F.sum(F.col("pos") / F.col("p") * F.col("tp") / F.col("pp"))
    return by.groupBy(*keys).agg(area.alias("a"), F.max("p").alias("p"), F.max("total").alias("total")).select(
        *keys, F.when((F.col("p") > 0) & (F.col("p") < F.col("total")), F.col("a")).alias("auprc")
    )


def prf_at(points: DataFrame, threshold: Column | float, keys: tuple[str, ...] = (), score: str = "v", label: str = "y") -> DataFrame:
    """Precision, recall and F1 of score >= threshold, 0 where undefined."""
    hit = F.col(score) >= threshold
    tp, pp, pos = F.sum((hit & (F.col(label) == 1)).cast("long")), F.sum(hit.cast("long")), F.sum(F.col(label))
    rows = points.groupBy(*keys).agg(tp.alias("tp"), pp.alias("pp"), pos.alias("p"))
    p, r = ratio(F.col("tp"), F.col("pp")), ratio(F.col("tp"), F.col("p"))
    return rows.select(*keys, p.alias("precision"), r.alias("recall"), f_beta(p, r).alias("f1"))


def best_f1_reference(points: DataFrame, keys: tuple[str, ...] = (), shifted: bool = True) -> DataFrame:
    """Threshold of the best F1 along the precision-recall curve, the first of equal ones.

    ``shifted`` pairs threshold i with the precision and recall of level i + 1, as the reference does;
    without it each threshold gets its own.
    """
    by = levels(points, keys)
    up = W.partitionBy(*keys).orderBy("score")
    tp, pp = (F.lead(c).over(up) if shifted else F.col(c) for c in ("tp", "pp"))
    rows = by.withColumns({"tp1": tp, "pp1": pp, "i": F.row_number().over(up)})
    p = F.when(F.col("pp1").isNull(), 1.0).otherwise(ratio(F.col("tp1"), F.col("pp1")))
    r = F.when(F.col("pp1").isNull(), 0.0).otherwise(ratio(F.col("tp1"), F.col("p")))
    best = rows.withColumn("f1", F.round(f_beta(p, r), 12)).withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("f1"), "i")))
    return best.where("k = 1").select(*keys, F.col("score").alias("threshold"), "f1")


def linear_grid(points: DataFrame, size: int, keys: tuple[str, ...] = (), score: str = "v") -> DataFrame:
    """Equally spaced thresholds from the smallest to the largest score; one if they are equal."""
    ends = points.groupBy(*keys).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    last = F.when(F.col("hi") > F.col("lo"), F.lit(size - 1)).otherwise(F.lit(0)).cast("long")
    rows = ends.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    return rows.select(*keys, "k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / float(size - 1)).alias("threshold"))


def quantile_grid(points: DataFrame, size: int, keys: tuple[str, ...] = (), score: str = "v") -> DataFrame:
    """Distinct exact quantiles of the scores at ``size`` levels."""
    at = [i / (size - 1) for i in range(size)]
    rows = points.groupBy(*keys).agg(F.percentile(score, F.array(*map(F.lit, at))).alias("q"))
    return rows.select(*keys, F.explode(F.array_distinct(F.transform("q", lambda x: F.round(x, 9)))).alias("threshold"))


def point_f1_on_grid(points: DataFrame, grid: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """tp, pp, p and F1 at each threshold of a grid.

    The counts at or above a threshold come from the running counts of the distinct scores:
    thresholds and scores are sorted together once, not joined with all points.
    """
    by = levels(points, keys).select(*keys, "score", "tp", "pp", "p", F.lit(False).alias("is_grid"))
    asked = grid.select(*keys, F.col("threshold").alias("score"), *[F.lit(None).cast("long").alias(c) for c in ("tp", "pp", "p")], F.lit(True).alias("is_grid"))
    down = W.partitionBy(*keys).orderBy(F.desc("score"), "is_grid").rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(*keys)
    filled = by.unionByName(asked).withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(down), F.lit(0)) for c in ("tp", "pp")} | {"p": F.max("p").over(every)})
    p, r = ratio(F.col("tp"), F.col("pp")), ratio(F.col("tp"), F.col("p"))
    return filled.where("is_grid").select(*keys, F.col("score").alias("threshold"), "tp", "pp", "p", f_beta(p, r).alias("f1"))


def tuned_by_point_f1(points: DataFrame, grid: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The lowest threshold of the grid with the best point F1."""
    rows = point_f1_on_grid(points, grid, keys).withColumn("f1", F.round("f1", 12))
    return rows.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("f1"), "threshold"))).where("k = 1").select(*keys, "threshold", "f1")


def separation(normal: DataFrame, synthetic: DataFrame, size: int = 200, penalty: float = 0.0, max_fpr: float | None = None, min_precision: float | None = None) -> DataFrame:
    """Calibrated threshold between normal and synthetic scores (columns v).

    Candidates are the distinct quantiles of both together; smaller violation of the bounds wins, then F1 minus penalty times the
    false positive rate, then the lower threshold.
    """
    both = normal.select("v", F.lit(0).alias("y")).unionByName(synthetic.select("v", F.lit(1).alias("y")))
    rows = point_f1_on_grid(both, quantile_grid(both, size))
    total = both.agg(F.sum(1 - F.col("y")).alias("n_neg"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    fpr = ratio(F.col("pp") - F.col("tp"), F.col("n_neg"))
    precision = ratio(F.col("tp"), F.col("pp"))
    over = F.greatest(fpr - max_fpr, F.lit(0.0)) if max_fpr is not None else F.lit(0.0)
    under = F.greatest(min_precision - precision, F.lit(0.0)) if min_precision is not None else F.lit(0.0)
    rows = rows.withColumns({"violation": F.round(over + under, 12), "value": F.round(F.col("f1") - penalty * fpr, 12), "fpr": fpr})
    return rows.orderBy("violation", F.desc("value"), "threshold").limit(1).select("threshold", "value", "violation", "fpr", "f1")


def validity(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """metrics_valid and the reason why not: single class, or constant score."""
    rows = points.groupBy(*keys).agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.min("v").alias("a"), F.max("v").alias("b"))
    reason = F.when(F.col("lo") == F.col("hi"), "single_class").when(F.col("b") - F.col("a") < 1e-12, "constant_score").otherwise("")
    return rows.select(*keys, (reason == "").alias("metrics_valid"), reason.alias("metrics_invalid_reason"))


def mask_interval(n: Column, fraction: float, policy: str, key: Column | None = None) -> tuple[Column, Column]:
    """Half-open masked interval of an event of n points: prefix, suffix, middle, or random, whose start is a hash of ``key``. What follows an underscore is no part of a policy's name."""
    size = F.least(F.greatest(F.bround(n * fraction).cast("long"), F.lit(1).cast("long")), n - 1)
    name = policy.split("_")[0] or "middle"
    if name == "random":
        start = F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 12), 16, 10).cast("long"), n - size + 1)
    else:
        start = {"prefix": F.lit(0).cast("long"), "suffix": n - size, "middle": F.floor((n - size) / 2)}[name]
    return start, start + size


def linear_fill(values: Column, start: Column, stop: Column) -> Column:
    """An array with [start, stop) replaced by a line between the values beside it; an open side holds the other value."""
    left, right = F.get(values, (start - 1).cast("int")), F.get(values, stop.cast("int"))
    inside = lambda i: (i >= start) & (i < stop)
    line = lambda i: F.coalesce(left + (right - left) * (i - start + 1) / (stop - start + 1), left, right)
    return F.transform(values, lambda x, i: F.when(inside(i), line(i)).otherwise(x))


def reconstruction(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """MAE, MSE, normalised MAE, shape correlation and border error of masked events; columns values, filled, start, stop.

    The correlation of one point, or of a constant, is 1 if both are close, else 0.
    """
    n = F.size("values")
    cut = lambda c: F.slice(c, F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    spread = lambda a: F.sqrt(F.greatest(mean(F.transform(a, lambda x: x * x)) - mean(a) * mean(a), F.lit(0.0)))
    border = lambda i: F.abs((F.get("filled", i) - F.get("filled", i - 1)) - (F.get("values", i) - F.get("values", i - 1)))
    at = [F.col("start").cast("int"), F.col("stop").cast("int")]
    inner = [F.when((i > 0) & (i < n), border(i)) for i in at]
    count = sum(F.when(x.isNotNull(), 1).otherwise(0) for x in inner)
    out = rows.withColumns({"a": cut("values"), "b": cut("filled")}).withColumn("gap", F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    out = out.withColumns({"ma": mean(F.col("a")), "mb": mean(F.col("b"))})
    out = out.withColumns({"da": F.transform("a", lambda x: x - F.col("ma")), "db": F.transform("b", lambda x: x - F.col("mb"))})
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    close = F.forall(F.zip_with("a", "b", lambda x, y: F.abs(x - y) <= 1e-8 + 1e-5 * F.abs(y)), lambda c: c)
    flat = (F.size("a") < 2) | (F.sqrt(mean(F.transform("da", lambda x: x * x))) <= 1e-12) | (F.sqrt(mean(F.transform("db", lambda x: x * x))) <= 1e-12)
    correlation = F.when(flat, F.when(close, 1.0).otherwise(0.0)).otherwise(dot("da", "db") / F.sqrt(dot("da", "da") * dot("db", "db")))
    return out.select(
        *keys, mean(F.col("gap")).alias("mae"), mean(F.transform("gap", lambda x: x * x)).alias("mse"), (mean(F.col("gap")) / F.greatest(spread(F.col("values")), F.lit(1e-8))).alias("normalized_mae"),
        correlation.alias("shape_correlation"), F.when(count > 0, sum(F.coalesce(x, F.lit(0.0)) for x in inner) / count).otherwise(0.0).alias("boundary_error"),
    )


def tuned_by_event_f(points: DataFrame, truth: DataFrame, grid: DataFrame, keys: tuple[str, ...] = (), beta: float = 1.0, min_length: int = 3, merge_gap: int = 2, iou: float = 0.1, score: str = "v") -> DataFrame:
    """keys, threshold, f, false_positives: of a grid (keys, threshold) the best event F-beta, then the fewest false positives, then the higher threshold.

    Each threshold's windows are found side by side, under the series' and the threshold's number. A grid is small, and is broadcast.
    """
    from seriesmill.operators import events as ev

    small = grid.withColumn("g", F.row_number().over(W.partitionBy(*keys).orderBy("threshold")).cast("string"))
    join = lambda df: df.join(F.broadcast(small), list(keys)) if keys else df.crossJoin(F.broadcast(small))
    named = lambda df: join(df).withColumn("series_id", F.concat_ws("#", "series_id", "g"))
    preds = ev.runs(named(points), F.col(score) >= F.col("threshold"), min_length, merge_gap)
    number = F.element_at(F.split("series_id", "#"), -1).alias("g")
    counts = ev.matched_counts(named(truth).select("series_id", "dataset", "event_id", "s", "e").select("*", number), preds.select("*", number), (*keys, "g"), iou)
    scored = ev.prf(counts, beta).join(small, [*keys, "g"]).withColumn("f", F.round("f", 12))
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("f"), "false_positives", F.desc("threshold")))
    return scored.withColumn("k", best).where("k = 1").select(*keys, "threshold", "f", "false_positives")


def selected_threshold(points: DataFrame, truth: DataFrame, mode: str = "point_f1", size: int = 200, quantile: float = 0.95, beta: float = 0.5, score: str = "score") -> DataFrame:
    """One row with the validation threshold of a mode: point_f1, event_f1, event_fbeta or fixed_quantile."""
    rows = points.withColumn("v", F.col(score))
    if mode == "fixed_quantile":
        return rows.agg(F.percentile("v", quantile).alias("threshold"))
    grid = linear_grid(rows, size).select("threshold")
    if mode == "point_f1":
        return tuned_by_point_f1(rows, grid).select("threshold")
    if mode not in ("event_f1", "event_fbeta"):
        raise ValueError(f"no such threshold mode: {mode}")
    return tuned_by_event_f(rows, truth, grid, beta=1.0 if mode == "event_f1" else beta).select("threshold")
