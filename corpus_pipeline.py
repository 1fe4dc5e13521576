"""The corpus pipeline: quality rules, near copies, contamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``. ``run`` writes each stage's rows as Parquet into
the shared checkpoint folder and reads them again for the next.

No stage but the first and third needs more than its own rows: the host rates
are those of the rows it gets, and the third reads ``benchmark``. Each stage starts
by letting the executors give back what the one before took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import decontaminate, ngram_join, pieces, pii, quality
from seriesmill.llm.memory import settle
from seriesmill.session import removed, scratch_path, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their host's verdict keep."""
    return quality.kept(docs)


def ngram_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    settle(spark)
    return ngram_join.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to be contaminated."""
    settle(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced; n_chars follows the text."""
    settle(spark)
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the sampled token ids and their number."""
    settle(spark)
    coded = pieces.encoded(docs.select("doc_id", "text"))
    return coded.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_near_copies", ngram_near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]
#: The piece lattice and the signatures have no SQL form; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table goes as soon as the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark)
        docs = stored(stage(spark, docs, sf_dir), path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
