"""Result bundles: tables through Spark's writers, small metadata as one JSON line, nested arrays piped only here."""

from __future__ import annotations

import datetime
import json
import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """Arrays joined with a pipe, so that CSV can hold them."""
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), "|").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes])


def save_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """``kind`` is csv (with header), json or parquet."""
    writer = (flat(df) if kind == "csv" else df).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def run_metadata(experiment: str, seed: int, project: str = ".") -> dict:
    """Time in UTC, experiment, seed and git commit (null where git gives none within 5 s)."""
    try:
        done = subprocess.run(["git", "-C", project, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5, check=False)
        commit = done.stdout.strip() or None
    except (OSError, subprocess.TimeoutExpired):
        commit = None
    return {"time": datetime.datetime.now(datetime.UTC).isoformat(), "experiment": experiment, "seed": seed, "git_commit": commit}


def save_bundle(spark, path: str, tables: dict[str, DataFrame], metadata: dict) -> None:
    """One folder a table under ``path``, and the metadata as a JSON text."""
    for name, df in tables.items():
        save_table(df, f"{path}/{name}")
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
