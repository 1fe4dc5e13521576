"""Point streams: an extension, as the batch operators have no stream form in their model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_stats(points: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Count, mean, extremes and anomalies of each series and time window; rows later than the watermark are left out."""
    by = points.withWatermark(time, late).groupBy("series_id", F.window(time, size).alias("w"))
    stats = by.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum("y").alias("n_anomalies"))
    return stats.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "mean", "min", "max", "n_anomalies")
