"""Sliding windows and features of series, projections back to points, simple detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def arrays(points: DataFrame) -> DataFrame:
    """A row a series: its values in order, and their number."""
    rows = points.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("p"))
    return rows.select("series_id", F.transform("p", lambda x: x["v"]).alias("values"), F.size("p").cast("long").alias("n"))


def _cut(points: DataFrame, size: int, stride: int) -> DataFrame:
    """Windows (series_id, n, w, s, values) of a series of n points: every stride, one more at the tail, all points of a short series.

    Each point goes to the windows that hold it, and these are gathered by series and number under the exchange by
    series, so no whole series is copied into its windows.
    """
    n, t, last = F.count("*").over(W.partitionBy("series_id")), F.col("t"), F.col("n") - size
    full = F.floor(last / stride)  # number of the last regular window
    first = F.greatest(F.ceil((t - size + 1) / stride), F.lit(0))
    regular = F.when(first <= F.least(F.floor(t / stride), full), F.sequence(first, F.least(F.floor(t / stride), full)))
    tail = F.when((full * stride < last) & (t >= last), F.array(full + 1))
    none = F.array().cast("array<bigint>")
    held = F.when(last < 0, F.array(F.lit(0).cast("long"))).otherwise(F.concat(F.coalesce(regular, none), F.coalesce(tail, none)))
    rows = points.select("series_id", "t", "v", n.alias("n")).select("series_id", "n", "t", "v", F.explode(held).alias("w"))
    start = F.when(last < 0, F.lit(0).cast("long")).otherwise(F.least(F.col("w") * stride, last))
    made = rows.groupBy("series_id", "n", "w").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("p"))
    return made.select("series_id", "n", "w", start.alias("s"), F.transform("p", lambda x: x["v"]).alias("values"))


def windows(points: DataFrame, size: int, stride: int) -> DataFrame:
    """Windows (series_id, w, s, e, values): every stride, one more at the tail, a short series padded with its last value."""
    padded = F.concat(F.col("values"), F.array_repeat(F.element_at("values", -1), F.greatest(F.lit(size) - F.size("values"), F.lit(0))))
    return _cut(points, size, stride).select("series_id", F.col("w").cast("int").alias("w"), "s", F.least(F.col("s") + size, F.col("n")).alias("e"), padded.alias("values"))


def features(rows: DataFrame) -> DataFrame:
    """Mean, population std, min, max and last minus first of each window."""
    n = F.size("values")
    mean = F.aggregate("values", F.lit(0.0), lambda s, x: s + x) / n
    out = rows.withColumn("mean", mean)
    var = F.aggregate(F.transform("values", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), lambda s, x: s + x) / n
    return out.select("series_id", "w", "s", "e", "mean", F.sqrt(var).alias("std"), F.array_min("values").alias("min"), F.array_max("values").alias("max"), (F.element_at("values", -1) - F.get("values", F.lit(0))).alias("delta"))


def to_points(points: DataFrame, scores: DataFrame, how: str = "max", floor: float | None = 0.0) -> DataFrame:
    """Window scores (series_id, s, e, score) as point scores: the largest, from ``floor`` up, or the mean; uncovered points 0."""
    w = scores.select(F.col("series_id").alias("k"), "s", "e", F.col("score").alias("x"))
    rows = points.join(w, (F.col("series_id") == F.col("k")) & F.col("t").between(F.col("s"), F.col("e") - 1), "left")
    value = F.avg("x") if how == "mean" else F.max("x") if floor is None else F.greatest(F.max("x"), F.lit(floor))
    return rows.groupBy("series_id", "t").agg(F.coalesce(value, F.lit(0.0)).alias("score"))


def forecast_pairs(points: DataFrame, size: int, stride: int = 1, horizon: int = 1) -> DataFrame:
    """Context windows and the ``horizon`` values after each: series_id, at (index of the first target), context, target.

    A series too short for both has one pair, its context padded in front with the first value; one of no more than
    ``horizon`` points has none.
    """
    rows = _cut(points, size + horizon, stride).where(F.col("n") > horizon)
    known = F.size("values") - horizon
    front = F.array_repeat(F.get("values", F.lit(0)), F.greatest(F.lit(size) - known, F.lit(0)))
    context = F.concat(front, F.slice("values", 1, known))
    return rows.select("series_id", (F.col("s") + known).cast("long").alias("at"), context.alias("context"), F.slice("values", known + 1, horizon).alias("target"))


def point_features(points: DataFrame, size: int = 5, lags: int = 2) -> DataFrame:
    """Raw value, and mean, std, min, max of the trailing frame, difference and lags (missing ones: the first value)."""
    by = W.partitionBy("series_id").orderBy("t")
    frame = by.rowsBetween(-(size - 1), 0)
    first = F.first("v").over(by.rowsBetween(W.unboundedPreceding, 0))
    lag = lambda k: F.coalesce(F.lag("v", k).over(by), first)
    return points.select(
        "series_id", "t", "v", F.avg("v").over(frame).alias("mean"), F.stddev_pop("v").over(frame).alias("std"), (F.col("v") - lag(1)).alias("diff"), F.min("v").over(frame).alias("min"),
        F.max("v").over(frame).alias("max"), *[lag(k).alias(f"lag{k}") for k in range(1, lags + 1)],
    )


def min_max(scores: DataFrame, score: str = "score") -> DataFrame:
    """Scores scaled to [0, 1] within each series; a range under 1e-8 gives 0."""
    by = W.partitionBy("series_id")
    lo, hi = F.min(score).over(by), F.max(score).over(by)
    return scores.withColumn(score, F.when(hi - lo < 1e-8, 0.0).otherwise((F.col(score) - lo) / (hi - lo)))


def z_scores(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Largest |z| over the columns, with means and stds over all rows (one aggregation, one row, broadcast)."""
    stats = rows.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns])
    z = [F.abs((F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") < 1e-8, 1.0).otherwise(F.col(f"{c}_s"))) for c in columns]
    return rows.crossJoin(F.broadcast(stats)).withColumn("score", F.greatest(*z) if len(z) > 1 else z[0]).drop(*stats.columns)


def spliced(points: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Points with the values and labels of synthetic points (series_id, t, sv, sy) in their place."""
    rows = points.join(synthetic, ["series_id", "t"], "left")
    return rows.select("series_id", "t", F.coalesce("sv", "v").alias("v"), F.coalesce("sy", "y").alias("y"))


def score_column(fit_rows: DataFrame, columns: list[str], kind: str, seed: int = 42):
    """A fitted Spark ML classifier as a function of rows that adds ``score``, the probability of class 1; classes weigh alike."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    n = fit_rows.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    weight = F.when(F.col("y") == 1, n["n"] / (2.0 * max(n["p"], 1))).otherwise(n["n"] / (2.0 * max(n["n"] - n["p"], 1)))
    model = {
        "forest": RandomForestClassifier(labelCol="y", featuresCol="x", weightCol="w", numTrees=200, maxDepth=12, seed=seed),
        "logistic": LogisticRegression(labelCol="y", featuresCol="x", weightCol="w", maxIter=1000),
    }[kind]
    fitted = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x"), model]).fit(fit_rows.withColumn("w", weight))

    def score(rows: DataFrame) -> DataFrame:
        p: Column = vector_to_array("probability")
        out = fitted.transform(rows.withColumn("w", F.lit(1.0)))
        return out.withColumn("score", F.get(p, F.lit(1))).drop("x", "w", "rawPrediction", "probability", "prediction")

    return score
