"""The canonical POINTS table: series_id, dataset, t, v, y, one row a point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.session import table


def from_events(events: DataFrame) -> DataFrame:
    """Points of the ``events`` table: a series a user, in time order; label 1 for errors.

    Rows are dealt by series_id, which every later window and grouping uses too, so the exchange is shared.
    """
    user = F.col("user_id").cast("string")
    dataset = F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string"))
    named = events.select(
        F.concat(dataset, F.lit("/u"), user).alias("series_id"), dataset.alias("dataset"), "ts", "event_id", F.col("value").alias("v"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"),
    )
    order = W.partitionBy("series_id").orderBy("ts", "event_id")
    return named.select("series_id", "dataset", (F.row_number().over(order) - 1).cast("long").alias("t"), "v", "y")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


#: The same table for DuckDB, as a common table expression.
POINTS_SQL = """pts as (
  select concat('d', cast(user_id % 3 as varchar), '/u', cast(user_id as varchar)) as series_id,
         concat('d', cast(user_id % 3 as varchar)) as dataset,
         cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as t,
         value as v, case when event_type = 'error' then 1 else 0 end as y
  from events)"""
