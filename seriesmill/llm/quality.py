"""Quality rules with host verdicts, in DataFrame functions only.

Each document gets counts of its text and the rules it fails. A hard rule
rejects alone: fewer than 50 words, or over half of the words in repeated
three-word windows. A soft rule (symbols, repeated lines) rejects only together
with its host: failures are summed by host, the hosts' rates are shrunk towards
an empirical beta prior fitted by moments over all hosts, and a host whose
shrunk rate reaches ``HOST_RATE`` is a bad one. A document without any failed
rule is always kept.

Sums by host are pre-aggregated before the shuffle, so a hot host costs one row
a task; the verdicts, a row a host, are joined back by host.

Defined cases: a null text has no words and fails; a null host is a host of its
own; one host, or hosts that all have the same rate, give the plain rate; extra
columns are ignored; rows that repeat a doc_id are judged one by one. Three-word
windows are compared by 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.session import checkpointed

MIN_WORDS = 50
#: A document fails softly above this share of symbols among word characters, or of repeated lines.
SYMBOL_SHARE, DUP_LINE_SHARE = 0.1, 0.3
HOST_RATE = 0.2
BROADCAST_HOSTS = 200_000

#: Word separators and symbols, by contract.
SEPARATORS, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in three-word windows that the text has twice or more.

    Only texts with a repeated window are sorted: by (hash, place), repeated
    windows are neighbours; their places, in order, cover up to three words each.
    """

    def covered(keyed: Column) -> Column:
        again = F.filter(
            F.transform(keyed, lambda x, i: F.when((x["h"] == F.get(keyed, i - 1)["h"]) | (x["h"] == F.get(keyed, i + 1)["h"]), x["i"])), lambda x: x.isNotNull()
        )
        return let(F.sort_array(again), lambda at: F.aggregate(F.transform(at, lambda a, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - a, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x))

    def by_hash(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)
        )

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(hashes, by_hash))


def _counts(text: Column) -> Column:
    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words, F.size(words)).alias("n_repeat_words"),
        )

    lines = let(
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")
    )
    return F.struct(
        let(F.filter(F.split(text, SEPARATORS), lambda w: w != ""), of_words).alias("w"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        lines.alias("n_dup_lines"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its counts and failed rules under the struct column ``quality``."""
    q = F.col("_q")
    counted = docs.select("*", F.inline(F.array(F.struct(_counts(F.coalesce(F.col(text), F.lit(""))).alias("_q")))))
    n, chars, repeats = q["w"]["n_words"], q["w"]["word_chars"], q["w"]["n_repeat_words"]
    base = (n < MIN_WORDS) | (100 * repeats > 50 * n)
    soft = (q["n_symbols"] > SYMBOL_SHARE * chars) | (q["n_dup_lines"] > DUP_LINE_SHARE * q["n_lines"])
    quality = F.struct(
        n.alias("n_words"), chars.alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["n_dup_lines"].alias("n_dup_lines"),
        repeats.alias("n_repeat_words"), base.alias("base_failed"), soft.alias("soft_failed"),
    )
    return counted.withColumn("quality", quality).drop("_q")


def host_rates(judged: DataFrame, host: str = "host") -> DataFrame:
    """A row a host: documents, failures and the shrunk rate of failures.

    The prior's mean m is the rate over all documents; its weight alpha + beta
    solves var = m(1-m)/(weight+1) for the variance of the hosts' rates, each
    host counted by its documents.
    """
    hosts = judged.groupBy(host).agg(
        F.count("*").alias("n_docs"), F.sum((F.col("quality.base_failed") | F.col("quality.soft_failed")).cast("long")).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("m"), (F.sum(F.col("n_docs") * rate * rate) / F.sum("n_docs")).alias("second"))
    variance = F.col("second") - F.col("m") * F.col("m")
    prior = prior.select("m", F.when(variance > 1e-12, F.greatest(F.col("m") * (1 - F.col("m")) / variance - 1, F.lit(0.0))).otherwise(0.0).alias("weight"))
    shrunk = (F.col("n_failed") + F.col("m") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    return hosts.join(F.broadcast(prior)).select(host, "n_docs", "n_failed", shrunk.alias("host_rate"))


def with_verdicts(measured_docs: DataFrame, rates: DataFrame, host: str = "host") -> DataFrame:
    """Measured rows with the struct column ``verdict`` (host_rate, kept).

    The rates are broadcast where there are at most ``BROADCAST_HOSTS`` hosts; else both sides are dealt by host.
    """
    rates = checkpointed(rates.select(F.col(host).alias("_host"), "host_rate"))
    if rates.count() <= BROADCAST_HOSTS:
        rates = F.broadcast(rates)
    joined = measured_docs.join(rates, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")
    bad = F.col("quality.soft_failed") & (F.col("host_rate") >= HOST_RATE)
    verdict = F.struct(F.col("host_rate"), (~F.col("quality.base_failed") & ~bad).alias("kept"))
    return joined.withColumn("verdict", verdict).drop("host_rate")


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, host, quality and verdict of each row, without its text: counted once."""
    row = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("body"))
    counted = checkpointed(measured(row, "body").drop("body"))
    return with_verdicts(counted, host_rates(counted))


def kept(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with its columns.

    The counts are taken twice, for the hosts and for the rows: that costs less than to write the texts.
    """
    row = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("body"), F.col(host).alias("host"))
    rates = host_rates(measured(row.select("body", "host"), "body"))
    return with_verdicts(measured(row, "body"), rates).where("verdict.kept").select("doc.*")
