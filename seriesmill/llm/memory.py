"""Executor memory between the stages of a long job."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch that goes to a Python worker; whole texts are long rows.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def settle(spark: SparkSession) -> None:
    """Lets executors give back what the stage before took, and keeps batches small.

    A heap that a JVM stage has filled stays at its full size beside the Python workers of the next stage, which a
    container's limit counts together. A small job asks every core's JVM to collect, after which the collector
    returns free heap to the system. Results depend on neither.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    n = 2 * spark.sparkContext.defaultParallelism
    asked = F.call_function("reflect", F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(asked.alias("x")).agg(F.count("x")).collect()
