"""Series splits, label budgets and sampling, all by hash order so that they repeat anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.operators.events import labelled


def hash_order(seed: int, *keys: str) -> Column:
    """A repeatable shuffle key: md5 of the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def series(points: DataFrame) -> DataFrame:
    """A row a series: length, events' points, whether it has an event."""
    return points.groupBy("series_id", "dataset").agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"), F.max("y").alias("has_event"))


def filter_reasons(series_rows: DataFrame, events: DataFrame, pattern: str, min_length: int, max_length: int, min_events: int, max_ratio: float) -> DataFrame:
    """Adds drop_reason: the first filter that a series fails, in fixed order; null if it stays."""
    counts = events.groupBy("series_id").agg(F.count("*").alias("n_events"))
    rows = series_rows.join(counts, "series_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    reason = (
        F.when(~F.col("series_id").rlike(pattern), "pattern")
        .when(F.col("n") < min_length, "too_short")
        .when(F.col("n") > max_length, "too_long")
        .when(F.col("n_events") < min_events, "few_events")
        .when(F.col("n_pos") / F.col("n") > max_ratio, "event_ratio")
    )
    return rows.withColumn("drop_reason", reason)


def cap_round_robin(series_rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most so many series, dealt over the datasets in turn; within one by hash order."""
    turn = F.row_number().over(W.partitionBy("dataset").orderBy(hash_order(seed, "series_id"), "series_id"))
    return series_rows.withColumn("turn", turn).orderBy("turn", "dataset").limit(most)


def split(series_rows: DataFrame, seed: int, train: float = 0.7, val: float = 0.1, strata: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Adds the split of each series: strata shuffled by hash, counts rounded half to even, train and test never empty."""
    by = W.partitionBy(*strata)
    rank = F.row_number().over(by.orderBy(hash_order(seed, "series_id"), "series_id"))
    n = F.count("*").over(by)
    first = F.greatest(F.lit(1), F.bround(n * train).cast("int"))
    second = F.greatest(F.lit(1), F.bround(n * val).cast("int"))
    first = F.when(first + second >= n, F.greatest(F.lit(1), n - second - 1)).otherwise(first)
    name = (
        F.when((n == 1) | (F.col("rank") == 1), "train").when((n == 2), "test").when(F.col("rank") <= F.col("n_train"), "train")
        .when(F.col("rank") <= F.col("n_train") + F.col("n_val"), "val").otherwise("test")
    )
    rows = series_rows.withColumns({"rank": rank, "size": n, "n_train": first, "n_val": second})
    return rows.withColumn("split", name).drop("rank", "size", "n_train", "n_val")


def cover_tests(splits: DataFrame) -> DataFrame:
    """Datasets without a test series give one: their first train series by name, else the first val series."""
    by = W.partitionBy("dataset")
    order = by.orderBy(F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2), "series_id")
    lacking = F.max((F.col("split") == "test").cast("int")).over(by) == 0
    moved = lacking & (F.row_number().over(order) == 1)
    return splits.withColumns({"moved": moved}).withColumn("split", F.when(F.col("moved"), "test").otherwise(F.col("split")))


def masked_labels(points: DataFrame, events: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Points whose labels keep a fraction of each series' events: round half to even, a lone event always."""
    by = W.partitionBy("series_id")
    n = F.count("*").over(by)
    keep = F.when(n == 1, 1).otherwise(F.bround(n * fraction))
    ranked = events.withColumns({"pick": F.row_number().over(by.orderBy(hash_order(seed, "series_id", "event_id"), "event_id")), "keep": keep})
    kept = ranked.where(F.col("pick") <= F.col("keep")).select(F.col("series_id").alias("k"), "s", "e")
    joined = points.join(kept, (F.col("series_id") == F.col("k")) & F.col("t").between(F.col("s"), F.col("e") - 1), "left")
    return joined.select("series_id", "dataset", "t", "v", F.when(F.col("k").isNotNull(), F.col("y")).otherwise(0).alias("y"))


def oversampled(events: DataFrame, multiplier: float) -> DataFrame:
    """Events of each series with copies: needed = int(most * m) - count, at most two an event."""
    counts = events.groupBy("series_id").agg(F.count("*").alias("c"))
    most = counts.agg(F.max("c").alias("most"))
    need = F.greatest(F.floor(F.col("most") * multiplier) - F.col("c"), F.lit(0))
    rows = events.join(counts, "series_id").crossJoin(F.broadcast(most))  # one row
    copies = F.sequence(F.lit(0).cast("long"), F.least(need, F.lit(2)))
    return rows.select("series_id", "event_id", "s", "e", F.explode(copies).alias("copy"))


def negatives_capped(rows: DataFrame, ratio: float, seed: int, label: str = "y", keys: tuple[str, ...] = ("series_id", "t")) -> DataFrame:
    """All positives and, by hash order, ratio times as many negatives; max(int(ratio), 1) of them without positives.

    The hash that ends the sample is found from counts by its first four digits, a table of at most 65,536 rows; only the
    rows that share the last such digits are sorted, so no task sees all that are kept.
    """
    order = hash_order(seed, *keys)
    negative = rows.where(F.col(label) == 0)
    counts = rows.groupBy(F.when(F.col(label) == 0, F.substring(order, 1, 4)).alias("h"), (F.col(label) == 1).alias("positive")).count().collect()
    n_pos = sum(r["count"] for r in counts if r["positive"])
    cap = int(n_pos * ratio) if n_pos else max(int(ratio), 1)
    held, border = 0, None
    for r in sorted((r for r in counts if r["h"] is not None), key=lambda r: r["h"]):
        if held + r["count"] > cap:
            border = r["h"]
            break
        held += r["count"]
    kept = rows.where(F.col(label) == 1)
    if border is None:
        return kept.unionByName(negative)
    digits = F.substring(order, 1, 4)
    last = negative.where(digits == border).orderBy(order, *keys).limit(cap - held)
    return kept.unionByName(negative.where(digits < border)).unionByName(last)


def balanced(series_rows: DataFrame, most_series: int, seed: int) -> DataFrame:
    """At most so many series a dataset, those with events first, else by hash order."""
    order = W.partitionBy("dataset").orderBy(F.desc("has_event"), hash_order(seed, "series_id"), "series_id")
    return series_rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_series)


def donor_pool(points: DataFrame, split: DataFrame, fraction: float, seed: int, parts: tuple[str, ...] = ("train",), allow_validation: bool = False) -> DataFrame:
    """Donor windows without leakage: events of the masked labels of training series; validation series only by an explicit permission, test series never."""
    if "test" in parts or ("val" in parts and not allow_validation):
        raise ValueError(f"donors of {parts} would leak held-out labels")
    use = split.where(F.col("split").isin(*parts)).select("series_id")
    own = points.join(use, "series_id", "left_semi")
    masked = masked_labels(own, labelled(own), fraction, seed)
    test = split.where("split = 'test'").select("series_id")
    return labelled(masked).join(test, "series_id", "left_anti")


def split_by_folder(series_rows: DataFrame, seed: int, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """The split with whole folders (datasets) as units, so that no folder lies on two sides."""
    folders = series_rows.select(F.col("dataset").alias("series_id")).distinct()
    whole = split(folders, seed, train, val, strata=()).select(F.col("series_id").alias("dataset"), "split")
    return series_rows.join(F.broadcast(whole), "dataset")  # a row a folder


def within_point_budget(series_rows: DataFrame, most_points: int, seed: int) -> DataFrame:
    """Series of each dataset within a number of points: those with events first, else by hash order; one that is too long is passed over, not the end. At least the first stays.

    What fits depends on what was taken before, so it is a fold over a dataset's (id, length) pairs.
    """
    order = F.struct((1 - F.col("has_event")).alias("late"), hash_order(seed, "series_id").alias("h"), "series_id", F.col("n").cast("long").alias("n"))
    lists = series_rows.groupBy("dataset").agg(F.sort_array(F.collect_list(order)).alias("q"))
    none = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))

    def step(state: Column, x: Column) -> Column:
        fits = state["used"] + x["n"] <= most_points
        return F.struct((state["used"] + F.when(fits, x["n"]).otherwise(0)).alias("used"), F.when(fits, F.concat(state["ids"], F.array(x["series_id"]))).otherwise(state["ids"]).alias("ids"))

    picked = F.aggregate("q", none, step, lambda s: s["ids"])
    first = F.array(F.get("q", F.lit(0))["series_id"])
    kept = lists.withColumn("ids", picked).select(F.explode(F.when(F.size("ids") > 0, F.col("ids")).otherwise(first)).alias("series_id"))
    return series_rows.join(kept, "series_id", "left_semi")
