"""The query of each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import decontaminate, language_model, ngram_join, oracles, pieces, pii, quality, secret_scan, substring_dedup, toxicity, warc
from seriesmill.session import checkpointed, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).withColumn("n_hit", decontaminate.hit_words())
    return hit.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), check="lossless")
    return coded.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens", "lossless")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return language_model.scores(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secret_scan.fitted(docs)
    found = secret_scan.with_spans(docs, model=model)
    of_kind = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in secret_scan.KINDS]
    base = F.filter("secrets", lambda s: s["kind"].isin(*secret_scan.KINDS))
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("secrets")).alias("spans"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.verdicts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged.select(F.col("key").alias("doc_id"), *[f"quality.{n}" for n in names], "verdict.kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = substring_dedup.repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    total = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return runs.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        total(F.col("runs")).alias("repeated_bytes"),
        total(F.flatten(F.transform("runs", lambda r: r["copies"]))).alias("copied_bytes"),
        F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["start"], r["stop"])), ",").alias("runs"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = checkpointed(warc.write(table(spark, sf_dir, "pages").select("page_id", "html")))
    records = warc.read(archives).where("gap_start is null")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(f"pii.{kind}").cast("long").alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.listed(pii.all_spans(kinds=pii.BASE)), 256).alias("base_sha256"),
        pii.listed(pii.all_spans()).alias("spans"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_sentencepiece, op3_ngram_join, op4_lm_score, op5_secret_scan,
        op6_quality_rules, op7_substring_dedup, op8_warc, op9_toxicity, op10_pii,
    )
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
