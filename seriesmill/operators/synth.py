"""Synthesis of event windows from donors, its confidence, filters and audit rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.operators.compat import cosine, resampled
from seriesmill.operators.donors import meetings, nearest_group
from seriesmill.session import stored

GRID = 8
#: Prior weight of each synthesis method; other methods have the last.
PRIOR = {"mean": 0.85, "dtw": 0.80, "prototype": 0.90}
OTHER_PRIOR = 0.75


def mean_of(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def std_of(x: Column) -> Column:
    m = mean_of(x)
    return F.sqrt(mean_of(F.transform(x, lambda v: (v - m) * (v - m))))


def candidates(segments: DataFrame, sources: DataFrame, top_k: int = 3, grid: int = GRID, pool: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Donor events of each target event: one a source series, the top k by cosine of the resampled shapes.

    ``sources`` (target, source) are the series that passed the compatibility filter, so events meet only
    within accepted series pairs. Of a source's events the best is taken first, then the best sources.
    Donor events come from ``pool``, or from the segments themselves. With ``groups`` (series_id, event_id,
    event_group, x), a target uses the donors of one group, that whose mean embedding is nearest to its own.
    """
    shape_of = lambda rows: rows.select("series_id", "event_id", resampled(F.col("values"), grid).alias("x"))
    segments = stored(segments.select("series_id", "event_id", "values"))
    pool = segments if pool is None else stored(pool.select("series_id", "event_id", "values"))
    named = lambda rows, *more: rows.select(F.col("series_id").alias("source"), F.col("event_id").alias("donor_id"), *more)
    keys = ("series_id", "event_id")
    shaped, donor = shape_of(segments), named(shape_of(pool), F.col("x").alias("y"))
    if groups is None:
        pairs = meetings(shaped, donor, sources, 1)
    else:
        of = named(groups, "event_group", F.col("x").alias("z"))
        near = nearest_group(shaped.select(*keys).join(groups.select(*keys, "x"), list(keys)), donor.join(of, ["source", "donor_id"]).select("source", "event_group", F.col("z").alias("y")), sources)
        pairs = meetings(shaped, donor.join(of.drop("z"), ["source", "donor_id"]), sources, 1, by_group=True).join(near.select(*keys, "event_group"), [*keys, "event_group"])
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("sim"), "source", "donor_id"))
    best = pairs.withColumn("rank", rank).where(F.col("rank") <= top_k).join(segments, list(keys)).join(named(pool, F.col("values").alias("donor")), ["source", "donor_id"])
    return best.select("series_id", "event_id", "values", "source", "donor_id", "donor", "sim", "rank")


def donors(cands: DataFrame) -> DataFrame:
    """A row a target event: its values and its donors (rank, sim, source, donor_id, x resampled to the target), best first."""
    n = F.size("values")
    place = F.transform(F.sequence(F.lit(0), n - 1), lambda j: j * (F.size("donor") - 1) / F.greatest(n - 1, F.lit(1)).cast("double"))
    low = lambda p: F.least(F.floor(p).cast("int"), F.greatest(F.size("donor") - 2, F.lit(0)))
    fit = F.transform(place, lambda p: F.get("donor", low(p)) + F.coalesce((F.get("donor", low(p) + 1) - F.get("donor", low(p))) * (p - low(p)), F.lit(0.0)))
    row = F.struct("rank", "sim", "source", "donor_id", F.when(n == F.size("donor"), F.col("donor")).otherwise(fit).alias("x"))
    rows = cands.select("series_id", "event_id", "values", row.alias("d")).groupBy("series_id", "event_id")
    return rows.agg(F.first("values").alias("values"), F.sort_array(F.collect_list("d")).alias("donors"))


def blended(ds: Column, n: Column, weight) -> Column:
    """Weighted mean of the donors at each place; uniform where the weights are not positive."""
    total = F.aggregate(ds, F.lit(0.0), lambda s, d: s + weight(d))
    share = lambda d: F.when(total > 0, weight(d) / total).otherwise(1.0 / F.size(ds))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.aggregate(ds, F.lit(0.0), lambda s, d: s + share(d) * F.get(d["x"], j)))


def synthesized(rows: DataFrame) -> DataFrame:
    """Adds the mean, similarity-weighted and first-donor syntheses."""
    n = F.size("values")
    return rows.withColumns({
        "by_mean": blended(F.col("donors"), n, lambda d: F.lit(1.0)), "by_weight": blended(F.col("donors"), n, lambda d: F.greatest(d["sim"], F.lit(0.0))), "by_first": F.get("donors", F.lit(0))["x"],
    })


def shifted(x: Column, mean: Column) -> Column:
    """Baseline shift: the synthesis moved to a mean."""
    m = mean_of(x)
    return F.transform(x, lambda v: v + mean - m)


def robust_shifted(x: Column, mean: Column, scale: Column) -> Column:
    """The synthesis scaled from its own spread to ``scale`` and moved to a mean."""
    m = mean_of(x)
    spread = F.greatest(std_of(x), F.lit(1e-6))
    return F.transform(x, lambda v: (v - m) * scale / spread + mean)


def confidence(rows: DataFrame, synthetic: str = "by_mean", grid: int = GRID) -> DataFrame:
    """similarity, consistency, agreement, amplitude and their mean, each in [0, 1]."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    ds, s, v = F.col("donors"), F.col(synthetic), F.col("values")
    similarity = mean_of(F.transform(ds, lambda d: (d["sim"] + 1) / 2))
    shape, centre = resampled(s, grid), resampled(F.col("by_mean"), grid)
    consistency = F.exp(-mean_of(F.zip_with(shape, centre, lambda a, b: (a - b) * (a - b))))
    pairs = F.flatten(F.transform(ds, lambda a, i: F.transform(F.filter(ds, lambda b, j: j > i), lambda b: (cosine(a["x"], b["x"]) + 1) / 2)))
    agreement = F.when(F.size(ds) == 0, 0.0).when(F.size(ds) == 1, 1.0).otherwise(mean_of(pairs))
    gap = F.abs(mean_of(v) - mean_of(s)) + F.abs(std_of(v) - std_of(s))
    amplitude = F.exp(-gap / F.greatest(std_of(v), std_of(s), F.lit(1e-6)))
    parts = rows.withColumns({"similarity": clip(similarity), "consistency": clip(consistency), "agreement": clip(agreement), "amplitude": clip(amplitude)})
    return parts.withColumn("confidence", (F.col("similarity") + F.col("consistency") + F.col("agreement") + F.col("amplitude")) / 4)


def prior(n_donors: Column, method: Column, single_source: Column) -> Column:
    """Prior weight: the method's, grown with the donors, less for a single source series."""
    base = F.lit(OTHER_PRIOR)
    for name, value in PRIOR.items():
        base = F.when(method == name, value).otherwise(base)
    return base * F.least(F.lit(1.0), 0.6 + 0.1 * n_donors) * F.when(single_source, 0.85).otherwise(1.0)


#: The parts that the strict policy tests, by their names in its reasons.
STRICT = {
    "similarity": "donor_similarity_confidence", "consistency": "reconstruction_consistency_confidence", "agreement": "donor_agreement_confidence", "amplitude": "amplitude_compatibility_score",
    "confidence": "aggregate_confidence",
}


def filtered(rows: DataFrame, policy: str, value: float = 0.5, strict: dict[str, float] | None = None) -> DataFrame:
    """Adds accepted and rejection_reason by no_filter, top_quantile, min_confidence or strict, which has a threshold a part (``value`` where none is given).

    The reason of the quantile has one name at any level, and that of the least confidence likewise.
    """
    if policy == "no_filter":
        return rows.withColumns({"accepted": F.lit(True), "rejection_reason": F.lit("")})
    if policy == "top_quantile":
        cut = rows.agg(F.percentile("confidence", value).alias("cut"))
        out = rows.crossJoin(F.broadcast(cut))  # one row
        kept = F.round("confidence", 9) >= F.round("cut", 9)
        return out.withColumns({"accepted": kept, "rejection_reason": F.when(kept, "").otherwise("below_top_quantile_0.5")}).drop("cut")
    if policy == "min_confidence":
        kept = F.col("confidence") >= value
        return rows.withColumns({"accepted": kept, "rejection_reason": F.when(kept, "").otherwise("below_quality_threshold")})
    if policy != "strict":
        raise ValueError(f"no such filter policy: {policy}")
    failed = F.array_compact(F.array(*[F.when(F.col(c) < (strict or {}).get(c, value), name) for c, name in STRICT.items()]))
    return rows.withColumns({"accepted": F.size(failed) == 0, "rejection_reason": F.when(F.size(failed) > 0, F.concat(F.lit("strict_filter_failed:"), F.array_join(failed, ","))).otherwise("")})


def dtw_totals(cost: np.ndarray) -> np.ndarray:
    """Summed costs of the best way to each cell, with a border of infinity before: one step an anti-diagonal."""
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        j = d - i
        total[i + 1, j + 1] = cost[i, j] + np.minimum(np.minimum(total[i, j + 1], total[i + 1, j]), total[i, j])
    return total


def dtw_path(a: np.ndarray, b: np.ndarray) -> tuple[list[tuple[int, int]], float]:
    """Full dynamic time warping of two sequences: path and summed cost along it; ties go up, then left, then diagonal."""
    cost = np.abs(a[:, None] - b[None, :])
    total = dtw_totals(cost)
    path, (i, j) = [], (len(a), len(b))
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        steps = (total[i - 1, j], total[i, j - 1], total[i - 1, j - 1])
        i, j = ((i - 1, j), (i, j - 1), (i - 1, j - 1))[int(np.argmin(steps))]
    path.reverse()
    return path, float(sum(cost[p] for p in path))


def warp(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The source on the target's time: mean of the points matched to each place, the place before where there are none."""
    sums, n = np.zeros(len(target)), np.zeros(len(target))
    for i, j in dtw_path(source, target)[0]:
        sums[j] += source[i]
        n[j] += 1
    out, last = np.empty(len(target)), source[0]
    for j in range(len(target)):
        last = sums[j] / n[j] if n[j] else last
        out[j] = last
    return out


def prototype(target: np.ndarray, donor_values: list[np.ndarray], grid: int = 32) -> np.ndarray:
    """Donors warped to their mean shape on a grid, averaged there, and pulled back along the target's own warp."""
    at = lambda x: np.interp(np.linspace(0, 1, grid), np.linspace(0, 1, len(x)), x) if len(x) > 1 else np.full(grid, x[0])
    mean = np.mean([at(d) for d in donor_values], axis=0)
    return warp(np.mean([warp(d, mean) for d in donor_values], axis=0), target)


def warped(cands: DataFrame, method: str = "dtw") -> DataFrame:
    """Synthesis by warping, in Arrow batches over target rows (series_id, event_id, values, donors)."""
    rows = cands.groupBy("series_id", "event_id").agg(F.first("values").alias("values"), F.sort_array(F.collect_list(F.struct("rank", "donor"))).alias("d"))
    rows = rows.select("series_id", "event_id", "values", F.transform("d", lambda x: x["donor"]).alias("donors"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for target, own in zip(batch["values"], batch["donors"], strict=True):
                target, own = np.asarray(target, float), [np.asarray(d, float) for d in own]
                out.append(prototype(target, own) if method == "prototype" else np.mean([warp(d, target) for d in own], axis=0))
            yield pd.DataFrame({"series_id": batch["series_id"], "event_id": batch["event_id"], "synthetic": [x.tolist() for x in out]})

    return rows.mapInPandas(run, "series_id string, event_id long, synthetic array<double>")


def dtw_distances(pairs: DataFrame) -> DataFrame:
    """Summed warping cost of each pair of arrays (columns a, b; other columns are kept)."""
    schema = pairs.drop("a", "b").withColumn("distance", F.lit(0.0)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = [dtw_path(np.asarray(a, float), np.asarray(b, float))[1] for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield batch.drop(columns=["a", "b"]).assign(distance=d)

    return pairs.mapInPandas(run, schema)


def event_groups(donors: DataFrame, groups: int, seed: int = 42, starts: int = 10):
    """K-means over the embeddings ``x`` of donor windows: of ``starts`` seeded runs the one of least cost; at most as many groups as windows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = donors.select(array_to_vector("x").alias("features")).cache()
    k = min(groups, rows.count())
    if k < 2:
        rows.unpersist()
        return None
    runs = [KMeans(k=k, seed=seed + i, maxIter=20).fit(rows) for i in range(starts)]
    rows.unpersist()
    return min(runs, key=lambda m: m.summary.trainingCost)


def grouped(windows: DataFrame, model) -> DataFrame:
    """``windows`` with the group of the nearest centre; all in one group without a model."""
    from pyspark.ml.functions import array_to_vector

    if model is None:
        return windows.withColumn("event_group", F.lit(0).cast("long"))
    rows = model.transform(windows.withColumn("features", array_to_vector("x")))
    return rows.withColumn("event_group", F.col("prediction").cast("long")).drop("features", "prediction")


#: The components whose weights are learned.
LEARNED = ("shape", "amplitude", "context", "group")


def learned_weights(pairs: DataFrame, weights: dict[str, float], components: tuple[str, ...] = LEARNED, threshold: float = 0.2, most: int = 5000, least: int = 4, rate: float = 0.2, heat: float = 0.15, pull: float = 0.02, epochs: int = 250) -> tuple[dict[str, float], str]:
    """Weights that tell pairs with overlapping event groups (``group`` at least ``threshold``) from others, and why they are the old ones, or ''.

    ``pairs`` has the components of all ordered pairs. Classes and guards are counted over all of them; the descent takes at
    most ``most`` pairs, in hash order, as the method has it. The softmax starts at the old weights, is pulled to them, and
    keeps the mass that the learned components had.
    """
    components = tuple(c for c in components if c in weights)
    if not components:
        return dict(weights), "no_component_keys"
    n = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("group") >= threshold).alias("positive")).first()
    if not n["n"]:
        return dict(weights), "no_training_pairs"
    if min(n["positive"], n["n"] - n["positive"]) < least:
        return dict(weights), "insufficient_positive_or_negative_pairs"
    named = list(dict.fromkeys([*components, "group"]))
    rows = pairs.orderBy(F.md5(F.concat_ws("|", "target", "source"))).limit(most).select(*named).toPandas()
    x, y = rows[list(components)].to_numpy(float), (rows["group"] >= threshold).to_numpy(float)
    known = [weights[c] for c in components if weights[c] > 0]
    prior = np.array([weights[c] if weights[c] > 0 else (np.mean(known) if known else 1.0) for c in components])
    prior /= prior.sum()
    theta = np.log(prior)
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    soft = lambda t: np.exp(t - t.max()) / np.exp(t - t.max()).sum()
    for _ in range(epochs):
        alpha = soft(theta)
        p = 1 / (1 + np.exp(-np.clip((x @ alpha - 0.5) / heat, -40, 40)))
        g = x.T @ (share * (p - y)) / heat / len(y) + pull * (alpha - prior)
        theta -= rate * alpha * (g - alpha @ g)
    mass = sum(max(weights[c], 0.0) for c in components) or 1.0
    return dict(weights) | dict(zip(components, (soft(theta) * mass).tolist(), strict=True)), ""
