"""Series profiles and cross-series compatibility: pair scores, ranking, filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.session import checkpointed, stored

#: Base weights of the components, in order; the bonus for one dataset; the least score kept.
WEIGHTS = {"shape": 0.25, "amplitude": 0.25, "duration": 0.15, "context": 0.15, "frequency": 0.10, "trend": 0.10, "group": 0.0}
SAME_DATASET_BONUS, MIN_SCORE, CONTEXT_POINTS, BLOCK = 0.05, 0.5, 5, 4096
EPS = 1e-6


def profile(points: DataFrame, events: DataFrame) -> DataFrame:
    """A row a series: moments, quantiles, trend, lag-1 autocorrelation, event statistics.

    One window for the lag and one aggregation, both by series, so one exchange serves them.
    """
    by = W.partitionBy("series_id").orderBy("t")
    rows = points.withColumn("next", F.lead("v").over(by))
    pairs = F.when(F.col("next").isNotNull(), F.col("v"))
    n, std = F.count("*"), F.stddev_pop("v")
    iqr = F.percentile("v", 0.75) - F.percentile("v", 0.25)
    base = rows.groupBy("series_id", "dataset").agg(
        n.alias("length"), F.avg("v").alias("mean"), std.alias("std"), F.percentile("v", 0.5).alias("median"), iqr.alias("iqr"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.greatest(iqr, std, F.lit(EPS)).alias("robust_amplitude"),
        F.coalesce(F.least(F.abs(F.nanvl(F.corr("v", F.col("t").cast("double")), F.lit(0.0))) * n / (n - 1), F.lit(1.0)), F.lit(0.0)).alias("trend_strength"),
        F.coalesce(F.nanvl(F.corr(pairs, "next"), F.lit(0.0)), F.lit(0.0)).alias("autocorr_lag1"),
        F.avg(F.col("y").cast("double")).alias("anomaly_ratio"),
    )
    size = (F.col("e") - F.col("s")).cast("double")
    durations = events.groupBy("series_id").agg(F.count("*").alias("n_events"), F.percentile(size, 0.5).alias("median_duration"), F.avg(size).alias("mean_duration"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return base.join(durations, "series_id", "left").select(*base.columns, zero("n_events"), zero("median_duration"), zero("mean_duration"))


def sides(points: DataFrame, events: DataFrame, k: int = CONTEXT_POINTS) -> DataFrame:
    """Per event: mean, population std and slope of up to k points before and after, null without points; the event's range."""
    w = events.select(F.col("series_id").alias("key"), "event_id", "s", "e")
    near = points.join(w, (F.col("series_id") == F.col("key")) & F.col("t").between(F.col("s") - k, F.col("e") + k - 1))
    before, after = F.col("t") < F.col("s"), F.col("t") >= F.col("e")

    def side(inside: Column, name: str) -> list[Column]:
        v, t = F.when(inside, F.col("v")), F.when(inside, F.col("t"))
        n = F.count(v)
        slope = F.when(n >= 2, (F.max_by("v", t) - F.min_by("v", t)) / (n - 1)).otherwise(0.0)
        return [F.avg(v).alias(f"{name}_mean"), F.stddev_pop(v).alias(f"{name}_std"), slope.alias(f"{name}_slope")]

    own = F.when(~before & ~after, F.col("v"))
    return near.groupBy("series_id", "event_id").agg(*side(before, "pre"), *side(after, "post"), (F.max(own) - F.min(own)).alias("event_range"))


def context(points: DataFrame, events: DataFrame, k: int = CONTEXT_POINTS) -> DataFrame:
    """Per series: the sides averaged over the events that have them, else the series' mean and std."""
    avg = sides(points, events, k).groupBy("series_id").agg(*[F.avg(c).alias(c) for c in ("pre_mean", "pre_std", "post_mean", "post_std")])
    whole = points.groupBy("series_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"))
    rows = whole.join(avg, "series_id", "left")
    return rows.select("series_id", *[F.coalesce(c, "m" if c.endswith("mean") else "d").alias(c) for c in ("pre_mean", "pre_std", "post_mean", "post_std")])


def spectral_share(points: DataFrame) -> DataFrame:
    """Energy share of the lowest quarter of the frequencies of each centred series, by the direct sums of its own points.

    Points times half the length per series: for short series. Long ones go through ``spectral_share_long``.
    """
    n = F.count("*").over(W.partitionBy("series_id"))
    x = F.col("v") - F.avg("v").over(W.partitionBy("series_id"))
    rows = points.select("series_id", "t", x.alias("x"), n.alias("n"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 2))))
    angle = 2 * F.pi() * ((F.col("k") * F.col("t")) % F.col("n")) / F.col("n")
    bins = rows.groupBy("series_id", "n", "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    low = F.greatest(F.lit(1), F.floor((F.floor(F.col("n") / 2) + 1) / 4))
    share = bins.groupBy("series_id", "n").agg(F.sum(F.when(F.col("k") < low, power)).alias("low"), F.sum(power).alias("all"))
    return share.select("series_id", F.when((F.col("n") < 4) | (F.col("all") <= 1e-12), 0.0).otherwise(F.col("low") / F.col("all")).alias("spectral"))


def spectral_share_long(points: DataFrame) -> DataFrame:
    """The same share by FFT, one series at a time in a task."""

    def one(rows: pa.Table) -> pa.Table:
        v = rows.column("v").to_numpy()[np.argsort(rows.column("t").to_numpy(), kind="stable")].astype(float)
        power = np.abs(np.fft.rfft(v - v.mean())) ** 2
        total = power.sum()
        share = 0.0 if len(v) < 4 or total <= 1e-12 else float(power[: max(1, len(power) // 4)].sum() / total)
        return pa.table({"series_id": rows.column("series_id").slice(0, 1), "spectral": pa.array([share], pa.float64())})

    return points.select("series_id", "t", "v").groupBy("series_id").applyInArrow(one, "series_id string, spectral double")


def sim(a: Column, b: Column) -> Column:
    """1 / (1 + |a - b| / scale), the scale the larger magnitude."""
    return 1 / (1 + F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(EPS)))


def blocked(t: DataFrame, s: DataFrame) -> DataFrame:
    """Every row of ``t`` with every row of ``s`` of another series (columns target and source; no other name in both).

    Both sides are dealt to blocks of at most ``BLOCK`` rows, and each pair of blocks is a key of the join, so the work is
    even and a row is sent once a block of the other side.
    """
    t, s = checkpointed(t), checkpointed(s)
    blocks = [_blocks(rows.count(), BLOCK) for rows in (t, s)]
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    t = t.withColumns({"tb": F.pmod(F.xxhash64("target"), F.lit(blocks[0])), "sb": spread(blocks[1])})
    s = s.withColumns({"sb": F.pmod(F.xxhash64("source"), F.lit(blocks[1])), "tb": spread(blocks[0])})
    return t.join(s, ["tb", "sb"]).where(F.col("target") != F.col("source")).drop("tb", "sb")


def pairs(profiles: DataFrame, source_profiles: DataFrame | None = None, keep: tuple[str, ...] = (), only: DataFrame | None = None) -> DataFrame:
    """Ordered pairs of different series with the seven components; targets from ``profiles``, sources from there or from the second table.

    The score is a similarity of two whole profiles without a key to join by, so every pair is wanted, but where ``only``
    (target, source) names some. ``pair_rows`` makes such rows of many series at less cost. Profiles are a row a series, and callers restrict targets and sources before. The columns
    ``keep`` of the targets stay, so what belongs to a target needs no join after the pairs are made.
    """
    source_profiles = profiles if source_profiles is None else source_profiles
    names = [c for c in source_profiles.columns if c not in ("series_id", "dataset", *keep)]
    t = profiles.select(F.col("series_id").alias("target"), F.col("dataset").alias("t_dataset"), *[F.col(c).alias(f"t_{c}") for c in names], *keep)
    s = source_profiles.select(F.col("series_id").alias("source"), F.col("dataset").alias("s_dataset"), *[F.col(c).alias(f"s_{c}") for c in names])
    both = blocked(t, s) if only is None else only.select("target", "source").where("target <> source").join(t, "target").join(s, "source")
    one = lambda c: sim(F.col(f"t_{c}"), F.col(f"s_{c}"))
    mean = lambda *cs: sum(one(c) for c in cs) / len(cs)
    timed = (F.col("t_n_events") > 0) | (F.col("s_n_events") > 0)
    parts = {
        "shape": mean("mean", "std", "median", "iqr"),
        "amplitude": mean("robust_amplitude", "min", "max", "std"),
        "duration": F.when(timed, mean("length", "median_duration", "mean_duration", "anomaly_ratio")).otherwise(one("length")),
        "context": mean("pre_mean", "pre_std", "post_mean", "post_std"),
        "frequency": (2 * one("spectral") + one("autocorr_lag1")) / 3,
        "trend": one("trend_strength"),
        "group": F.lit(0.5),  # until ``donors.group_overlap`` fills it in
    }
    return both.select("target", "source", "t_dataset", "s_dataset", *[c.alias(k) for k, c in parts.items()], *keep)


def scored(pair_rows: DataFrame, weights: dict[str, float] | None = None, bonus: float = SAME_DATASET_BONUS, min_score: float = MIN_SCORE) -> DataFrame:
    """Adds score, decision and the weakest component as the reason of a rejection."""
    weights = weights or WEIGHTS
    total = sum(weights.values())
    plain = sum(F.col(k) * w for k, w in weights.items()) / total if total > 0 else sum(F.col(k) for k in weights) / len(weights)
    same = F.coalesce(F.col("t_dataset") == F.col("s_dataset"), F.lit(False))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), plain + F.when(same, bonus).otherwise(0.0)))
    weakest = F.array_min(F.array(*[F.struct(F.round(k, 12).alias("v"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(weights)]))["k"]
    rows = pair_rows.withColumns({"score": score, "same_dataset": same})
    kept = F.col("score") >= min_score
    return rows.withColumns({"kept": kept, "reason": F.when(kept, "").otherwise(F.concat(F.lit("below_min_score:"), weakest))})


def ranked(scored_pairs: DataFrame) -> DataFrame:
    """Adds the rank of each source for its target, best first."""
    return scored_pairs.withColumn("rank", F.row_number().over(W.partitionBy("target").orderBy(F.desc(F.round("score", 12)), "source")))


def filtered(scored_pairs: DataFrame, top_k: int | None = None, quantile: float | None = None) -> DataFrame:
    """Sources kept for each target: by the least score, then the best k, then the best share, by rank."""
    rows = ranked(scored_pairs.where("kept"))
    if top_k is not None:
        rows = rows.where(F.col("rank") <= top_k)
    if quantile is not None:
        n = F.count("*").over(W.partitionBy("target"))
        rows = rows.withColumn("n", n).where(F.col("rank") <= F.ceil(F.col("n") * quantile)).drop("n")
    return rows


#: The profile's numbers in the order of the blocked scores, and the most series in a block of these.
FEATURES = (
    "mean std median iqr robust_amplitude min max length median_duration mean_duration anomaly_ratio pre_mean pre_std post_mean post_std spectral autocorr_lag1 trend_strength n_events"
).split()
_AT = {c: i for i, c in enumerate(FEATURES)}
TILE, ROUGH = 16384, 1e-5


def _parts(t: np.ndarray, s: np.ndarray) -> dict[str, Callable[[], np.ndarray]]:
    """The components of ``pairs``, operation by operation; the first axis of both sides has the features."""

    def one(c: str) -> np.ndarray:
        a, b = t[_AT[c]], s[_AT[c]]
        return 1 / (1 + np.abs(a - b) / np.maximum(np.maximum(np.abs(a), np.abs(b)), EPS))

    std, length = one("std"), one("length")
    return {
        "shape": lambda: (one("mean") + std + one("median") + one("iqr")) / 4,
        "amplitude": lambda: (one("robust_amplitude") + one("min") + one("max") + std) / 4,
        "duration": lambda: np.where((t[_AT["n_events"]] > 0) | (s[_AT["n_events"]] > 0), (length + one("median_duration") + one("mean_duration") + one("anomaly_ratio")) / 4, length),
        "context": lambda: (one("pre_mean") + one("pre_std") + one("post_mean") + one("post_std")) / 4,
        "frequency": lambda: (2 * one("spectral") + one("autocorr_lag1")) / 3,
        "trend": lambda: one("trend_strength"),
        "group": lambda: 0.5,
    }


def _total(parts: dict[str, Callable[[], np.ndarray]], same: np.ndarray, weights: dict[str, float], bonus: float) -> np.ndarray:
    """The score of ``scored``, operation by operation. NaN stands for null."""
    total = sum(weights.values())
    plain = sum(parts[c]() * w for c, w in weights.items()) / total if total > 0 else sum(parts[c]() for c in weights) / len(weights)
    return np.fmax(0.0, np.fmin(1.0, plain + np.where(same, bonus, 0.0)))


def _exact(t: np.ndarray, s: np.ndarray, same: np.ndarray, weights: dict[str, float], bonus: float) -> np.ndarray:
    """The score of ``pairs`` and ``scored``; the first axis of both sides has the features. NaN stands for null."""
    with np.errstate(all="ignore"):
        return _total(_parts(t, s), same, weights, bonus)


def _shares(weights: dict[str, float]) -> np.ndarray:
    """The weight of each feature's similarity in the score, where an event is in either series."""
    total = sum(weights.values())
    w = {c: x / total if total > 0 else 1 / len(weights) for c, x in weights.items()}
    out = np.zeros(len(FEATURES), np.float32)
    for part, of in {
        "shape": {"mean": 1 / 4, "std": 1 / 4, "median": 1 / 4, "iqr": 1 / 4}, "amplitude": {"robust_amplitude": 1 / 4, "min": 1 / 4, "max": 1 / 4, "std": 1 / 4},
        "duration": {"length": 1 / 4, "median_duration": 1 / 4, "mean_duration": 1 / 4, "anomaly_ratio": 1 / 4}, "context": {"pre_mean": 1 / 4, "pre_std": 1 / 4, "post_mean": 1 / 4, "post_std": 1 / 4},
        "frequency": {"spectral": 2 / 3, "autocorr_lag1": 1 / 3}, "trend": {"trend_strength": 1}, "group": {"n_events": 0.5},
    }.items():
        for c, x in of.items():
            out[_AT[c]] += w.get(part, 0.0) * x
    return out


def _rough(t: np.ndarray, s: np.ndarray, same: np.ndarray, shares: np.ndarray, bonus: float) -> np.ndarray:
    """Scores of all rows of ``t`` with all of ``s`` (features by rows, 32 bits), right to ``ROUGH``, not above 1; NaN where a number is missing."""
    out = np.full((t.shape[1], s.shape[1]), shares[_AT["n_events"]], np.float32)
    d, m = np.empty_like(out), np.empty_like(out)
    eventless = ~((t[_AT["n_events"]] > 0)[:, None] | (s[_AT["n_events"]] > 0))
    some, own = eventless.any(), np.float32(4 * shares[_AT["length"]])
    with np.errstate(all="ignore"):
        for i, c in enumerate(FEATURES):
            if c == "n_events" or not shares[i]:
                continue
            a, b = t[i][:, None], s[i]
            np.subtract(a, b, out=d)
            np.abs(d, out=d)
            np.maximum(np.maximum(np.abs(a), np.float32(EPS)), np.abs(b), out=m)
            np.add(d, m, out=d)
            np.divide(m, d, out=m)
            if some and c in ("length", "median_duration", "mean_duration", "anomaly_ratio"):
                m = np.where(eventless, m * own if c == "length" else np.float32(0), m * shares[i])
            else:
                m *= shares[i]
            out += m
        out += np.where(same, np.float32(bonus), np.float32(0))
        return np.minimum(out, np.float32(1), out=out)


def _tile_side(table: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """Features by rows, names and dataset codes (-1 for none) of some rows of a tile."""
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    codes = pc.fill_null(table.column("dataset").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    names = table.column("series_id").take(pa.array(rows)).to_pylist()
    return np.ascontiguousarray(x[rows].T), names, codes[rows]


def _firsts(row: np.ndarray, column: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: the highest rank, then the smallest column; by row."""
    order = np.lexsort((column, -rank, row))
    start = np.r_[0, np.flatnonzero(np.diff(row[order])) + 1] if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[place < k]


def _tile_best(k: int, least: float | None, among: str, weights: dict[str, float], bonus: float):
    """For a tile of targets (side 0) and sources (side 1): of each target the k best sources of equal or higher score than ``least``."""
    shares = _shares(weights)

    def best(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids = np.array(table.column("series_id").to_pylist(), dtype=object)
        t_rows, s_rows = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        s_rows = s_rows[np.argsort(ids[s_rows], kind="stable")]
        (t, t_ids, t_set), (s, s_ids, s_set) = _tile_side(table, t_rows), _tile_side(table, s_rows)
        t32, s32 = t.astype(np.float32), s.astype(np.float32)
        targets, sources, scores = [], [], []
        for a in range(0, t.shape[1], 64):
            rows = slice(a, a + 64)
            low = np.full(t32[:, rows].shape[1], -1.0 if least is None else least - ROUGH)
            row = column = np.zeros(0, np.int64)
            score = np.zeros(0)
            for b in range(0, s.shape[1], 1024):
                columns = slice(b, b + 1024)
                same = (t_set[rows][:, None] == s_set[columns]) & (s_set[columns] >= 0)
                near = _rough(t32[:, rows], s32[:, columns], same, shares, bonus)
                if among != "all":
                    near[same if among == "other" else ~same] = -2
                if b == 0 and near.shape[1] > k:
                    low = np.maximum(low, np.fmin(np.partition(near, -k, axis=1)[:, -k], 1.0) - 2 * ROUGH)
                i, j = np.nonzero(~(near < low[:, None]))
                if not len(i):
                    continue
                found = _exact(t[:, a + i], s[:, b + j], same[i, j], weights, bonus)
                good = np.ones(len(i), bool) if least is None else found >= least
                row, column, score = np.r_[row, i[good]], np.r_[column, b + j[good]], np.r_[score, found[good]]
                rank = np.rint(score * 1e12)
                kept = _firsts(row, column, rank, k)
                row, column, score = row[kept], column[kept], score[kept]
                last = np.flatnonzero(np.r_[row[1:] != row[:-1], True]) if len(row) else np.zeros(0, int)
                full = last[np.bincount(row, minlength=len(low))[row[last]] >= k]
                low[row[full]] = np.maximum(low[row[full]], score[full] - 2 * ROUGH)
            targets += [t_ids[a + i] for i in row]
            sources += [s_ids[j] for j in column]
            scores.append(score)
        return pa.table({"class": pa.array(targets, pa.string()), "source": pa.array(sources, pa.string()), "score": np.concatenate(scores) if scores else np.zeros(0)})

    return best


def _classes(profiles: DataFrame) -> DataFrame:
    """Profiles as an array ``x``, with the class of equal ones of a dataset: its smallest series, its size, and the series' place in it."""
    names = [F.col(c).cast("double") for c in FEATURES]
    rows = profiles.where(F.col("series_id").isNotNull()).select("series_id", "dataset", F.array(*names).alias("x"))
    by = W.partitionBy("dataset", "x")
    place = F.row_number().over(by.orderBy("series_id"))
    first = F.first("series_id").over(by.orderBy("series_id"))
    return stored(rows.select("*", place.alias("place"), first.alias("class"), F.count("*").over(by).alias("size")))


def _blocks(n: int, most: int = TILE) -> int:
    """Blocks of n rows: a dozen, or more where they would have over ``most`` rows, fewer under 256."""
    return max(1, -(-n // min(most, max(256, -(-n // 12)))))


def best_pairs(profiles: DataFrame, k: int, min_score: float | None = MIN_SCORE, among: str = "all", weights: dict[str, float] | None = None, bonus: float = SAME_DATASET_BONUS) -> DataFrame:
    """target, source, t_dataset, s_dataset, score, rank: what ``filtered(scored(pairs(profiles)), k)`` keeps, without a row a pair.

    ``min_score`` None keeps any score; ``among`` takes sources of "all" datasets, of the "same" or of an "other" one.
    Targets and sources are dealt to blocks, and each pair of blocks is one task's work in numpy: scores in 32 bits first,
    then the exact ones of those that may be among the k best, of which only these leave it. Equal profiles of a dataset
    have equal scores, so they are one target, and of each class k + 1 sources by name are enough (one may be the target).
    """
    spark = profiles.sparkSession
    rows = _classes(profiles)
    n = rows.agg(F.count_if(F.col("place") == 1).alias("t"), F.count_if(F.col("place") <= k + 1).alias("s")).first()
    blocks = (_blocks(n["t"]), _blocks(n["s"]))
    place = lambda b: F.pmod(F.xxhash64("series_id"), F.lit(b))
    spread = lambda b: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b - 1).cast("long")))
    own = ("series_id", "dataset", "x")
    t = rows.where("place = 1").select(*own, place(blocks[0]).alias("tb"), spread(blocks[1]).alias("sb"), F.lit(0).alias("side"))
    s = rows.where(F.col("place") <= k + 1).select(*own, spread(blocks[0]).alias("tb"), place(blocks[1]).alias("sb"), F.lit(1).alias("side"))
    tiles = t.unionByName(s).repartition(max(blocks[0] * blocks[1], spark.sparkContext.defaultParallelism), "tb", "sb")
    found = tiles.groupBy("tb", "sb").applyInArrow(_tile_best(k + 1, min_score, among, dict(weights or WEIGHTS), bonus), "class string, source string, score double")
    order = (F.desc(F.round("score", 12)), "source")
    found = found.withColumn("place", F.row_number().over(W.partitionBy("class").orderBy(*order))).where(F.col("place") <= k + 1).drop("place")
    members = rows.select(F.col("series_id").alias("target"), F.col("dataset").alias("t_dataset"), "class")
    both = members.join(found, "class").where(F.col("target") != F.col("source")).drop("class")
    best = both.withColumn("rank", F.row_number().over(W.partitionBy("target").orderBy(*order))).where(F.col("rank") <= k)
    datasets = rows.select(F.col("series_id").alias("source"), F.col("dataset").alias("s_dataset"))
    return best.join(datasets, "source").select("target", "source", "t_dataset", "s_dataset", "score", "rank")


def _tile_totals(least: float, weights: dict[str, float], bonus: float):
    """For a tile of classes with sizes: of each row of either side, and each dataset of the other side, count, kept ones and sums of scores."""

    def totals(table: pa.Table) -> pa.Table:
        side, size = table.column("side").to_numpy(), table.column("size").to_numpy().astype(float)
        names = table.column("dataset").combine_chunks()
        codes = pc.fill_null(names.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        low, high = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
        low, high = (r[np.argsort(codes[r], kind="stable")] for r in (low, high))
        out = []  # row, dataset's row, n, kept, sum, kept sum
        if not len(low) or not len(high):
            low = low[:0]
        (t, _, t_set), (s, _, s_set) = _tile_side(table, low), _tile_side(table, high)
        alone = bool((side == 0).all())  # one block with itself

        def add(values: list[np.ndarray], rows: np.ndarray, others: np.ndarray, starts: np.ndarray) -> None:
            where = np.repeat(rows, len(starts)), np.tile(others[starts], len(rows))
            out.append((*where, *[v.ravel() for v in values]))

        s_starts = np.flatnonzero(np.r_[True, s_set[1:] != s_set[:-1]]) if len(s_set) else np.zeros(0, int)
        t_starts = np.flatnonzero(np.r_[True, t_set[1:] != t_set[:-1]]) if len(t_set) else np.zeros(0, int)
        down = np.zeros((3, len(t_starts), len(high)))
        block_of = np.repeat(np.arange(len(t_starts)), np.diff(np.r_[t_starts, len(low)])) if len(low) else np.zeros(0, int)
        for a in range(0, len(low), 32):
            rows = slice(a, a + 32)
            across = np.zeros((3, len(low[rows]), len(s_starts)))
            for b in range(0, len(high), 1024):
                columns = slice(b, b + 1024)
                same = (t_set[rows][:, None] == s_set[columns]) & (s_set[columns] >= 0)
                score = _exact(t[:, rows, None], s[:, None, columns], same, weights, bonus)
                kept = score >= least
                first = np.searchsorted(s_starts, b, "right") - 1
                last = np.searchsorted(s_starts, min(b + 1024, len(high)), "left")
                cuts = np.maximum(s_starts[first:last] - b, 0)
                groups = np.flatnonzero(np.r_[True, np.diff(block_of[rows]) > 0])
                for q, v in enumerate((kept.astype(float), score, score * kept)):
                    across[q, :, first:last] += np.add.reduceat(v * size[high[columns]], cuts, axis=1)
                    if not alone:
                        down[q, block_of[rows][groups], columns] += np.add.reduceat(v * size[low[rows]][:, None], groups, axis=0)
            n = np.broadcast_to(np.add.reduceat(size[high], s_starts), across.shape[1:])
            add([n, *across], low[rows], high, s_starts)
        if alone and len(low):
            own = _exact(t, t, t_set >= 0, weights, bonus)
            out.append((low, low, np.full(len(low), -1.0), -(own >= least).astype(float), -own, -own * (own >= least)))
        elif len(low):
            n = np.broadcast_to(np.add.reduceat(size[low], t_starts)[:, None], down.shape[1:])
            add([v.T for v in (n, *down)], high, low, t_starts)
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, int)] * 2 + [np.zeros(0)] * 4
        ids = table.column("series_id").take(pa.array(columns[0], pa.int64()))
        return pa.table([ids, names.take(pa.array(columns[1], pa.int64())), *columns[2:]], names=["class", "s_dataset", "n", "n_kept", "score", "score_kept"])

    return totals


def pair_totals(profiles: DataFrame, min_score: float = MIN_SCORE, weights: dict[str, float] | None = None, bonus: float = SAME_DATASET_BONUS) -> DataFrame:
    """target, t_dataset, s_dataset, n, n_kept, score, score_kept: of each series and each dataset of its sources the counts of all and of kept pairs and the sums of their scores.

    Every pair is scored, but no row a pair is made. A pair has one score in both directions, so each two blocks meet once;
    equal profiles of a dataset are scored once and count with their number.
    """
    rows = _classes(profiles)
    classes = rows.where("place = 1").select("series_id", "dataset", "x", "size")
    blocks = _blocks(classes.count())
    own = F.pmod(F.xxhash64("series_id"), F.lit(blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    dealt = classes.withColumn("own", own).withColumn("other", other)
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    tiles = dealt.select("series_id", "dataset", "x", "size", F.least("own", "other").alias("tb"), F.greatest("own", "other").alias("sb"), side.alias("side"))
    tiles = tiles.repartition(max(blocks * (blocks + 1) // 2, rows.sparkSession.sparkContext.defaultParallelism), "tb", "sb")
    names = ("n", "n_kept", "score", "score_kept")
    found = tiles.groupBy("tb", "sb").applyInArrow(_tile_totals(min_score, dict(weights or WEIGHTS), bonus), "class string, s_dataset string, n double, n_kept double, score double, score_kept double")
    sums = found.groupBy("class", "s_dataset").agg(*[F.sum(c).alias(c) for c in names]).where("n > 0.5")
    members = rows.select(F.col("series_id").alias("target"), F.col("dataset").alias("t_dataset"), "class")
    whole = [F.round(c).cast("long").alias(c) for c in names[:2]]
    return members.join(sums, "class").select("target", "t_dataset", "s_dataset", *whole, "score", "score_kept")


#: The most members of a class in one row of ``expanded``, and about so many names in a batch that leaves its Python.
MEMBERS, NAMES = 64, 1 << 18


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Numbers rounded as Spark's round does it: by their shortest decimal form, halves away from zero."""
    scaled = np.abs(x) * 10.0**digits
    out = np.copysign(np.floor(scaled + 0.5) / 10.0**digits, x)
    for i in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6), strict=True):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def members(rows: DataFrame, *own: str) -> DataFrame:
    """names, own: the column ``name`` of rows with equal columns ``own``, at most ``MEMBERS`` names in a row, and those columns as a struct."""
    place = F.row_number().over(W.partitionBy(*own).orderBy("name")) - 1
    parts = rows.where(F.col("name").isNotNull()).select("name", *own).withColumn("part", F.floor(place / MEMBERS))
    return parts.groupBy(*own, "part").agg(F.sort_array(F.collect_list("name")).alias("names")).select("names", F.struct(*own).alias("own"))


def expanded(t: DataFrame, s: DataFrame, tile: Callable, values: str) -> DataFrame:
    """target, source and ``values``: every name of ``t`` with every one of ``s`` (rows of ``members``), a name with itself too.

    ``tile`` gets the structs of two blocks and returns a function that gives the columns of a slice of the first block with
    all of the second, each a matrix or one with a mask of nulls. Each pair of blocks is one task's work, a pair of classes
    is worked out once, and the JVM makes the rows of their members: nothing of these is shuffled or kept.
    """
    lists, blocks = [], []
    for rows, block in ((t, "tb"), (s, "sb")):
        n = rows.count()
        blocks.append(max(1, min(12, -(-n // 64)), -(-n // BLOCK)))
        own = rows.withColumn(block, F.pmod(F.xxhash64("names"), F.lit(blocks[-1])))
        lists.append(own.groupBy(block).agg(F.collect_list(F.struct("names", "own")).alias(block[0])))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    parts = max(3 * blocks[0] * blocks[1], t.sparkSession.sparkContext.defaultParallelism)
    left, right = lists[0].withColumn("sb", spread(blocks[1])), lists[1].withColumn("tb", spread(blocks[0]))
    tiles = left.repartition(parts, "tb", "sb").join(right.repartition(parts, "tb", "sb"), ["tb", "sb"]).select("t", "s")
    names, most = [c.split()[0] for c in values.split(", ")], NAMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = (batch.column(side)[r].values for side in ("t", "s"))
                a_names, b_names = a.field("names"), b.field("names")
                columns = tile(a.field("own"), b.field("own"))
                pair = len(a_names.flatten()) / len(a) + len(b_names.flatten()) / len(b)
                step = max(1, int(most / (len(b) * pair)))
                for i in range(0, len(a), step):
                    found = columns(slice(i, i + step))
                    k = min(step, len(a) - i)
                    rows = [a_names.take(pa.array(np.repeat(np.arange(i, i + k), len(b)))), b_names.take(pa.array(np.tile(np.arange(len(b)), k)))]
                    for name in names:
                        x, null = found[name] if isinstance(found[name], tuple) else (found[name], None)
                        rows.append(pa.array(x.ravel(), mask=None if null is None else null.ravel()))
                    yield pa.RecordBatch.from_arrays(rows, names=["targets", "sources", *names])

    kinds = [next(f.dataType.simpleString() for f in rows.schema if f.name == "names") for rows in (t, s)]
    made = tiles.mapInArrow(run, f"targets {kinds[0]}, sources {kinds[1]}, {values}")
    made = made.select("sources", *names, F.explode("targets").alias("target"))
    return made.select("target", F.explode("sources").alias("source"), *names)


#: The features of each component; ``duration`` needs the first alone where neither series has events.
_OF = {
    "shape": "mean std median iqr", "amplitude": "robust_amplitude min max std", "duration": "length median_duration mean_duration anomaly_ratio", "context": "pre_mean pre_std post_mean post_std",
    "frequency": "spectral autocorr_lag1", "trend": "trend_strength", "group": "",
}


def _pair_tile(columns: tuple[str, ...], min_score: float, weights: Mapping[str, float], bonus: float, digits: int):
    """For ``expanded``: components and ``score`` to so many digits, ``kept`` and ``same_dataset``, as ``pairs`` and ``scored`` have them."""

    def tile(t_own: pa.StructArray, s_own: pa.StructArray) -> Callable:
        flat = [own.field("x").flatten() for own in (t_own, s_own)]
        t, s = (np.ascontiguousarray(x.to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).T) for x in flat)
        t_null, s_null = (x.is_null().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).T if x.null_count else None for x in flat)
        codes = pa.concat_arrays([own.field("dataset") for own in (t_own, s_own)]).dictionary_encode().indices
        codes = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False)
        t_set, s_set = codes[: len(t_own)], codes[len(t_own) :]

        def null(c: str, rows: slice) -> np.ndarray | None:
            if t_null is None and s_null is None:
                return None
            gone = np.zeros((len(t_set[rows]), len(s_set)), bool)
            for i in (_AT[f] for f in _OF[c].split()):
                if t_null is not None:
                    gone |= t_null[i][rows, None]
                if s_null is not None:
                    gone |= s_null[i]
                if c == "duration" and i == _AT["length"]:
                    alone = gone.copy()
            if c != "duration":
                return gone
            return np.where((t[_AT["n_events"]][rows, None] > 0) | (s[_AT["n_events"]] > 0), gone, alone)

        def values(rows: slice) -> dict:
            shape = len(t_set[rows]), len(s_set)
            same = (t_set[rows, None] == s_set) & (s_set >= 0)
            out = {"same_dataset": same}
            with np.errstate(all="ignore"):
                parts = {c: np.broadcast_to(f(), shape) for c, f in _parts(t[:, rows, None], s[:, None, :]).items() if c in columns or c in weights}
                if "score" in columns or "kept" in columns:
                    score = _total({c: lambda x=x: x for c, x in parts.items()}, same, dict(weights), bonus)
                    out |= {"score": half_up(score, digits), "kept": score >= min_score}
                return out | {c: (half_up(parts[c], digits), null(c, rows)) for c in columns if c in parts}

        return values

    return tile


def pair_rows(targets: DataFrame, columns: tuple[str, ...], sources: DataFrame | None = None, digits: int = 6, min_score: float = MIN_SCORE, weights: Mapping[str, float] | None = None, bonus: float = SAME_DATASET_BONUS) -> DataFrame:
    """target, source and some columns of ``scored(pairs(...))``, numbers rounded: the way to make all rows of many series.

    Both tables are profiles with a column ``name``, which stands in the row for its series; a row a pair, that of a name with itself
    too. Series with equal profiles of a dataset are scored once.
    """
    tables = []
    for rows in (targets, sources):
        if rows is not None:
            tables.append(stored(members(rows.select("name", "dataset", F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("x")), "dataset", "x")))
    kinds = {"kept": "boolean", "same_dataset": "boolean"}
    tile = _pair_tile(columns, min_score, dict(weights or WEIGHTS), bonus, digits)
    return expanded(tables[0], tables[-1], tile, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns))


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays of equal length, the denominator at least 1e-8."""
    return dot(x, y) / F.greatest(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(1e-8))


def dot(x: Column, y: Column) -> Column:
    """Inner product of arrays of equal length."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def unit(x: Column) -> Column:
    """An array over its norm, at least 1e-8: done once a row, it leaves one inner product a pair."""
    return F.transform(F.array(F.greatest(F.sqrt(dot(x, x)), F.lit(1e-8))), lambda norm: F.transform(x, lambda v: v / norm))[0]


def resampled(values: Column, size: int) -> Column:
    """An array linearly resampled to ``size`` equally spaced places."""
    n = F.size(values)

    def at(j: Column) -> Column:
        place = j * (n - 1) / F.lit(max(size - 1, 1)).cast("double")
        low = F.least(F.floor(place).cast("int"), F.greatest(n - 2, F.lit(0)))
        return F.get(values, low) + F.coalesce((F.get(values, low + 1) - F.get(values, low)) * (place - low), F.lit(0.0))

    return F.when(n == size, values).otherwise(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at))


def embedding(segments: DataFrame, side_rows: DataFrame, points: DataFrame, grid: int = 64) -> DataFrame:
    """series_id, event_id, x: the resampled shape, its mean, std, largest and least number, and the eight context numbers.

    ``segments`` has values, ``side_rows`` the sides of each event. A side without points has the series' mean, and std 0.
    """
    whole = points.groupBy("series_id").agg(F.avg("v").alias("m"))
    shape = F.col("shape")
    mean = F.aggregate(shape, F.lit(0.0), lambda s, v: s + v) / grid
    std = F.sqrt(F.aggregate(shape, F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean"))) / grid)
    rows = segments.select("series_id", "event_id", F.size("values").cast("double").alias("n"), resampled(F.col("values"), grid).alias("shape"))
    rows = rows.join(side_rows, ["series_id", "event_id"]).join(whole, "series_id").withColumn("mean", mean).withColumn("std", std)
    side = [F.coalesce("pre_mean", "m"), F.coalesce("pre_std", F.lit(0.0)), F.coalesce("post_mean", "m"), F.coalesce("post_std", F.lit(0.0)), F.col("event_range"), F.col("pre_slope"), F.col("post_slope")]
    return rows.select("series_id", "event_id", F.concat("shape", F.array("mean", "std", F.array_max("shape"), F.array_min("shape"), "n", *side)).alias("x"))


def nearest_within(vectors: DataFrame, key: str, group: str, k: int, block: int = 2048) -> DataFrame:
    """target, source, rank, cosine: of each vector ``x`` the k nearest others of its group, ties by the smaller key.

    A group is dealt to blocks by a hash; each pair of blocks is one task's matrix product, of which only the k best a
    target leave it, so a hot group costs many even tasks and no row a pair. Nulls in group or vector meet nothing.
    """
    rows = checkpointed(vectors.where(F.col(group).isNotNull() & F.col("x").isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(group).cast("string").alias("g"), "x"))
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    placed = rows.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    targets = placed.withColumn("other", other).select("g", F.col("own").alias("tb"), F.col("other").alias("sb"), F.lit(0).alias("side"), "id", "x")
    sources = placed.withColumn("other", other).select("g", F.col("other").alias("tb"), F.col("own").alias("sb"), F.lit(1).alias("side"), "id", "x")

    def best(table: pa.Table) -> pa.Table:
        side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
        width = len(table.column("x")[0])
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
        t, s = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        s = s[np.argsort(ids[s], kind="stable")]
        out = []
        for a in range(0, len(t), 256):
            part = t[a : a + 256]
            exact = x[part] @ x[s].T
            score = np.round(exact, 9)
            score[ids[part][:, None] == ids[s][None, :]] = -np.inf
            first = np.argsort(-score, axis=1, kind="stable")[:, :k]
            row, column = np.nonzero(np.isfinite(np.take_along_axis(score, first, axis=1)))
            out.append((ids[part][row], ids[s][first[row, column]], exact[row, first[row, column]]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(columns, names=["target", "source", "cosine"])

    found = targets.unionByName(sources).groupBy("g", "tb", "sb").applyInArrow(best, "target long, source long, cosine double")
    rank = F.row_number().over(W.partitionBy("target").orderBy(F.desc(F.round("cosine", 9)), "source"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
