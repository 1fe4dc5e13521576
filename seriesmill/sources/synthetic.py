"""A seeded benchmark of sine series with labelled bumps, made on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH, DOMAINS = 120, 3


def benchmark(spark: SparkSession, n_series: int = 30, n_bumps: int = 10, seed: int = 42) -> DataFrame:
    """POINTS of ``n_series`` sines with noise; bumps of 5 to 8 points lift the value by about 2.5 and have label 1.

    Noise and bump places come from hashes of (seed, series, number), so rows repeat on any cluster.
    """
    uniform = lambda *keys: (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = lambda *keys: F.sqrt(-2 * F.log(uniform(*keys, F.lit("r")))) * F.cos(2 * F.pi() * uniform(*keys, F.lit("a")))
    k, t = F.col("id"), F.col("t")
    dataset = F.concat(F.lit("domain_"), F.element_at(F.array(*map(F.lit, "abc")), (k % DOMAINS + 1).cast("int")))
    rows = spark.range(n_series).select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LENGTH - 1).cast("long"))).alias("t"))
    step = LENGTH // max(n_bumps, 1)
    bump = F.floor(t / step)
    start = bump * step + 1 + F.floor(3 * uniform(k, bump, F.lit("s")))
    inside = (bump < n_bumps) & (t >= start) & (t < F.least(start + 5 + F.floor(4 * uniform(k, bump, F.lit("n"))), (bump + 1) * step))
    value = F.sin(t * (4 * 3.141592653589793 / (LENGTH - 1))) + 0.1 * normal(k, t) + F.when(inside, 2.5 + 0.5 * normal(k, t, F.lit("b"))).otherwise(0.0)
    name = F.concat(dataset, F.lit("/series_"), F.lpad(k.cast("string"), 3, "0"))
    return rows.select(name.alias("series_id"), dataset.alias("dataset"), "t", value.alias("v"), F.when(inside, 1).otherwise(0).alias("y"))
