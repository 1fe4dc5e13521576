"""Which donors a target may use: policies, candidate pairs, decisions with reasons, groups, retrieval with caps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.operators.compat import MIN_SCORE, SAME_DATASET_BONUS, WEIGHTS, cosine, expanded, half_up, members, scored
from seriesmill.session import stored


@dataclass(frozen=True)
class Compatibility:
    """Settings of one run's donor selection."""

    enabled: bool = True
    min_score: float = MIN_SCORE
    top_k: int | None = None
    top_quantile: float | None = None
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    same_dataset_bonus: float = SAME_DATASET_BONUS
    allow_cross_dataset: bool = True
    restrict_same_dataset: bool = False
    require_cross_dataset: bool = False
    require_same_dataset: bool = False
    fallback_when_no_compatible_donor: str = "skip"
    allow_incompatible_donors: bool = False
    donor_policy: str | None = None


#: What each named donor policy sets.
PRESETS: dict[str, dict] = {
    "all_donors_no_filter": {"enabled": False},
    "same_dataset_only": {"enabled": False, "allow_cross_dataset": False, "restrict_same_dataset": True, "require_same_dataset": True},
    "cross_dataset_all": {"enabled": False, "require_cross_dataset": True},
    "cross_dataset_compatible": {"require_cross_dataset": True},
    "compatibility_top50": {"top_quantile": 0.5},
    "compatibility_strict": {"min_score": 0.7},
}
#: What a preset sets where it names nothing.
_PLAIN = {"enabled": True, "allow_cross_dataset": True, "restrict_same_dataset": False, "require_cross_dataset": False, "require_same_dataset": False}


def across(policy: str | None) -> bool:
    """Only donors of other datasets."""
    return (policy or "").startswith("cross_dataset") or PRESETS.get(policy or "", {}).get("require_cross_dataset", False)


def within(policy: str | None) -> bool:
    """Only donors of the target's dataset."""
    return PRESETS.get(policy or "", {}).get("require_same_dataset", False)


def resolved(synthesis: Mapping | None = None, run: Mapping | None = None) -> Compatibility:
    """Defaults, then the synthesis settings, then the preset, then the run's own; weights merge key by key from the preset on.

    A run's top_k fills in where nothing else has set one.
    """
    synthesis, run = synthesis or {}, run or {}
    policy = run.get("donor_policy") or synthesis.get("donor_policy")
    out = replace(Compatibility(), **(synthesis.get("compatibility") or {}))
    for layer in ((_PLAIN | PRESETS[policy]) if policy in PRESETS else {}, run.get("compatibility") or {}):
        layer = dict(layer)
        if "weights" in layer:
            layer["weights"] = dict(out.weights) | dict(layer["weights"])
        out = replace(out, **layer)
    if out.top_k is None and run.get("top_k") is not None:
        out = replace(out, top_k=int(run["top_k"]))
    return replace(out, donor_policy=policy) if policy else out


def candidates(pairs: DataFrame, policy: str | None) -> DataFrame:
    """The pairs (target, source, t_dataset, s_dataset) that a policy looks at; a target without a dataset sees all."""
    known, same = F.col("t_dataset").isNotNull(), F.coalesce(F.col("t_dataset") == F.col("s_dataset"), F.lit(False))
    if within(policy):
        return pairs.where(~known | same)
    return pairs.where(~known | ~same) if across(policy) else pairs


def judged(pairs: DataFrame, config: Compatibility) -> DataFrame:
    """Candidate pairs with score, rank, ``kept`` and the reason of each rejection; no pair goes missing.

    A target's pairs must pass the least score, then the best k of those, then the best share. What these two drop
    has one reason. Without compatibility all candidates are kept.
    """
    rows = scored(candidates(pairs, config.donor_policy), dict(config.weights), config.same_dataset_bonus, config.min_score)
    if not config.enabled:
        rows = rows.withColumns({"kept": F.lit(True), "reason": F.lit("")})
    elif not config.allow_cross_dataset:
        veto = F.col("t_dataset").isNotNull() & F.col("s_dataset").isNotNull() & ~F.col("same_dataset")
        rows = rows.withColumns({"score": F.when(veto, 0.0).otherwise(F.col("score")), "kept": F.col("kept") & ~veto, "reason": F.when(veto, "cross_dataset_disallowed").otherwise(F.col("reason"))})
    by = W.partitionBy("target")
    rows = rows.withColumn("rank", F.row_number().over(by.orderBy(F.desc(F.round("score", 12)), "source")))
    if not config.enabled or config.top_k is None and config.top_quantile is None:
        return rows
    place = F.row_number().over(W.partitionBy("target", "kept").orderBy("rank"))
    n = F.count_if("kept").over(by)
    most = F.least(n, F.lit(config.top_k)) if config.top_k is not None else n
    if config.top_quantile is not None:
        most = F.greatest(F.ceil(most * config.top_quantile), F.lit(1))
    rows = rows.withColumns({"place": place, "most": most})
    dropped = F.col("kept") & (F.col("place") > F.col("most"))
    return rows.withColumns({"reason": F.when(dropped, "below_top_quantile_0.5").otherwise(F.col("reason")), "kept": F.col("kept") & ~dropped}).drop("place", "most")


def accepted(judged_pairs: DataFrame, config: Compatibility) -> DataFrame:
    """The pairs whose donors are used: the kept ones, or all of a target without any where the fallback lets them in."""
    if config.enabled and config.fallback_when_no_compatible_donor == "all_donors" and config.allow_incompatible_donors:
        some = F.max("kept").over(W.partitionBy("target"))
        return judged_pairs.withColumn("some", some).where(F.col("kept") | ~F.col("some")).drop("some")
    return judged_pairs.where("kept")


def rule(cross: Column, same: Column) -> Column:
    """Which rule counted pairs break under a policy across datasets, or within one; '' for none."""
    return (
        F.when(cross & (F.col("cross_pairs") == 0), "no_cross_dataset_pairs").when(cross & (F.col("same_pairs") > 0), "same_dataset_pairs_considered")
        .when(same & (F.col("same_pairs") == 0), "no_same_dataset_pairs").when(same & (F.col("cross_pairs") > 0), "cross_dataset_pairs_considered").otherwise("")
    )


def pair_violations(judged_pairs: DataFrame, policies: Mapping[str, str] | None = None) -> DataFrame:
    """Per donor_policy: pairs looked at and used within and across datasets, and which rule they break.

    A policy across datasets must look at some such pair and at no other; one within a dataset likewise.
    ``policies`` gives the policy whose rules hold for a name that is no preset.
    """
    names = {p: p for p in PRESETS} | dict(policies or {})
    counts = judged_pairs.groupBy("donor_policy").agg(
        F.count_if(F.col("same_dataset")).alias("same_pairs"), F.count_if(~F.col("same_dataset")).alias("cross_pairs"), F.count_if(F.col("same_dataset") & F.col("kept")).alias("same_used"),
    )
    of = lambda test: F.col("donor_policy").isin(*[n for n, p in names.items() if test(p)])
    return counts.withColumn("violation", rule(of(across), of(within)))


def group_shares(grouped_events: DataFrame) -> DataFrame:
    """series_id, event_group and its share of the series' events (columns series_id, event_group; one row an event)."""
    n = grouped_events.groupBy("series_id", "event_group").agg(F.count("*").alias("n"))
    return n.select("series_id", "event_group", (F.col("n") / F.sum("n").over(W.partitionBy("series_id"))).alias("share"))


def group_maps(shares: DataFrame) -> DataFrame:
    """series_id, m: a series' group shares as one map."""
    return shares.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("event_group", "share"))).alias("m"))


def common_mass(a: Column, b: Column) -> Column:
    """The common mass of two maps of group shares, 0.5 where either is null."""
    common = F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, g: s + F.least(g["value"], F.coalesce(F.element_at(b, g["key"]), F.lit(0.0))))
    return F.when(a.isNotNull() & b.isNotNull(), common).otherwise(0.5)


def group_overlap(pairs: DataFrame, shares: DataFrame) -> DataFrame:
    """``pairs`` with the component ``group``: the common mass of both series' group shares, 0.5 where either has none.

    A series has few groups, so they travel as one map a series and no join by group multiplies the pairs.
    """
    maps = group_maps(shares)
    for end in ("target", "source"):
        pairs = pairs.join(maps.select(F.col("series_id").alias(end), F.col("m").alias(f"{end}_groups")), end, "left")
    return pairs.withColumn("group", common_mass(F.col("target_groups"), F.col("source_groups"))).drop("target_groups", "source_groups")


def _mass_tile(digits: int):
    """For ``compat.expanded``: the common mass of two lists of groups and shares, 0.5 where either is null."""

    def tile(t_own: pa.StructArray, s_own: pa.StructArray) -> Callable:
        lists = [own.field("m") for own in (t_own, s_own)]
        flat = [m.flatten() for m in lists]
        codes = pa.concat_arrays([x.field("event_group") for x in flat]).dictionary_encode()
        at = np.split(codes.indices.to_numpy(zero_copy_only=False), [len(flat[0])])
        dense = []
        for m, x, code in zip(lists, flat, at, strict=True):
            rows = np.repeat(np.arange(len(m)), m.value_lengths().fill_null(0).to_numpy())
            shares = np.zeros((len(codes.dictionary), len(m)))
            shares[code, rows] = x.field("share").to_numpy()
            dense.append((shares, m.is_null().to_numpy(zero_copy_only=False)))
        (t, t_null), (s, s_null) = dense

        def values(rows: slice) -> dict:
            mass = np.zeros((len(t_null[rows]), len(s_null)))
            for a, b in zip(t, s, strict=True):
                mass += np.minimum(a[rows, None], b)
            return {"overlap": half_up(np.where(t_null[rows, None] | s_null, 0.5, mass), digits)}

        return values

    return tile


def group_rows(series: DataFrame, shares: DataFrame, digits: int = 6) -> DataFrame:
    """target, source, overlap: what ``group_overlap`` gives for all ordered pairs of different ``series``, rounded.

    Series with equal shares are worked out once.
    """
    lists = shares.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("event_group", "share"))).alias("m"))
    rows = stored(members(series.select("series_id").join(lists, "series_id", "left").withColumnRenamed("series_id", "name"), "m"))
    return expanded(rows, rows, _mass_tile(digits), "overlap double").where("target <> source")


def nearest_group(targets: DataFrame, donors: DataFrame, sources: DataFrame) -> DataFrame:
    """series_id, event_id, event_group, near: of the groups of a target's donors the one whose mean embedding has the highest cosine with its own; the first name of equal ones.

    ``targets`` has series_id, event_id and x, ``donors`` source, event_group and y, ``sources`` the accepted (target,
    source). The donors of a series' events are those of its sources, so means are sums a source and place, added up for
    each target series; no row a target and donor is made.
    """
    places = donors.select("source", "event_group", F.posexplode("y").alias("i", "y")).groupBy("source", "event_group", "i").agg(F.sum("y").alias("total"), F.count("y").alias("n"))
    mean = (F.sum("total") / F.sum("n")).alias("y")
    places = sources.select("target", "source").join(places, "source").groupBy("target", "event_group", "i").agg(mean)
    centres = places.groupBy("target", "event_group").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "y"))), lambda p: p["y"]).alias("centre"))
    near = targets.select(F.col("series_id").alias("target"), "event_id", "x").join(centres, "target").withColumn("near", F.round(cosine(F.col("x"), F.col("centre")), 9))
    best = F.row_number().over(W.partitionBy("target", "event_id").orderBy(F.desc("near"), "event_group"))
    return near.withColumn("k", best).where("k = 1").select(F.col("target").alias("series_id"), "event_id", "event_group", "near")


#: The most events of a series in a row of ``meetings``.
CHUNK = 128


def _met(most: int, by_group: bool):
    """Of each target event in a row of two lists the ``most`` donors of highest cosine, the first of equal ones; of each group so many with ``by_group``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {}
            for side in ("t", "d"):
                column = batch.column(batch.schema.get_field_index(side))
                flat = column.flatten()
                x = flat.field("x")
                width = len(x[0]) if len(x) else 0
                x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), width)
                lists[side] = np.r_[0, np.cumsum(column.value_lengths().to_numpy())], x, np.linalg.norm(x, axis=1), flat
            (t_at, t, t_norm, t_flat), (d_at, d, d_norm, d_flat) = lists["t"], lists["d"]
            groups = d_flat.field("event_group").to_numpy(zero_copy_only=False)
            rows, targets, donors, sims = [], [], [], []
            for r in range(batch.num_rows):
                a, b = slice(t_at[r], t_at[r + 1]), slice(d_at[r], d_at[r + 1])
                with np.errstate(invalid="ignore"):
                    sim = np.round(t[a] @ d[b].T / np.maximum(t_norm[a][:, None] * d_norm[b], 1e-8), 9)
                rank = np.where(np.isnan(sim), np.inf, -sim)
                for g in np.unique(groups[b]) if by_group else (None,):
                    own = np.arange(rank.shape[1]) if g is None else np.flatnonzero(groups[b] == g)
                    part = rank[:, own]
                    first = np.argmin(part, axis=1)[:, None] if most == 1 else np.argsort(part, axis=1, kind="stable")[:, :most]
                    at = own[first]
                    rows.append(np.full(at.size, r))
                    targets.append(np.repeat(np.arange(a.start, a.stop), at.shape[1]))
                    donors.append(at.ravel() + b.start)
                    sims.append(np.take_along_axis(sim, at, axis=1).ravel())
            pick = lambda parts, kind=np.int64: np.concatenate(parts) if parts else np.zeros(0, kind)
            rows, targets, donors, sims = pa.array(pick(rows)), pa.array(pick(targets)), pa.array(pick(donors)), pick(sims, float)
            of = lambda name: batch.column(batch.schema.get_field_index(name)).take(rows)
            yield pa.RecordBatch.from_arrays(
                [of("target"), t_flat.field("id").take(targets), of("source"), d_flat.field("id").take(donors), d_flat.field("event_group").take(donors), pa.array(sims, mask=np.isnan(sims))],
                names=["series_id", "event_id", "source", "donor_id", "event_group", "sim"],
            )

    return run


def meetings(targets: DataFrame, donors: DataFrame, sources: DataFrame, most: int, by_group: bool = False) -> DataFrame:
    """series_id, event_id, source, donor_id, event_group, sim: of each target event and accepted source the ``most`` donor events of highest cosine, ties by the smaller donor_id.

    ``targets`` has series_id, event_id and x, ``donors`` source, donor_id, y and perhaps event_group, ``sources`` the accepted
    (target, source). With ``by_group`` so many of each group. The events of a series travel as lists of at most ``CHUNK``
    and two lists meet in one matrix product, so no row a target and donor is made, and no list holds a whole hot series.
    """
    group = F.col("event_group").cast("long") if "event_group" in donors.columns else F.lit(0).cast("long")

    def lists(rows: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy("key").orderBy("id"))
        chunk = rows.withColumn("chunk", F.floor((place - 1) / CHUNK))
        return chunk.groupBy("key", "chunk").agg(F.sort_array(F.collect_list(F.struct("id", "x", "event_group"))).alias(name))

    t = lists(targets.select(F.col("series_id").alias("key"), F.col("event_id").alias("id"), "x", F.lit(0).cast("long").alias("event_group")), "t")
    d = lists(donors.select(F.col("source").alias("key"), F.col("donor_id").alias("id"), F.col("y").alias("x"), group.alias("event_group")), "d")
    rows = sources.select("target", "source").join(t, F.col("target") == t["key"]).drop("key", "chunk").join(d, F.col("source") == d["key"]).select("target", "source", "t", "d")
    found = rows.mapInArrow(_met(most, by_group), "series_id string, event_id long, source string, donor_id long, event_group long, sim double")
    keys = ("series_id", "event_id")
    found = found.repartition(*keys)  # windows by these and more need no other exchange
    more = ("source", "event_group") if by_group else ("source",)
    place = F.row_number().over(W.partitionBy(*keys, *more).orderBy(F.desc("sim"), "donor_id"))
    return found.withColumn("place", place).where(F.col("place") <= most).drop("place")


def retrieved(meetings: DataFrame, keys: tuple[str, ...], k: int = 5, per_source: int | None = None, per_group: int | None = None, spread: bool = True) -> DataFrame:
    """The k best donors of each target, best first, with rank: columns keys, source, donor_id, event_group, sim.

    ``per_source`` and ``per_group`` are the most donors of one series and of one group. With ``spread``, the next best
    of the only series chosen so far is passed over once. The choice depends on what was chosen before, so it is a fold
    over a target's donors; of these, only as many of a series, of a group and in all come into a row as k choices, and
    the series and groups that these fill, can pass over.
    """
    by = lambda *more: W.partitionBy(*keys, *more).orderBy(F.desc("sim"), "source", "donor_id")
    rows = meetings.select(*keys, "source", "donor_id", "event_group", "sim")
    first = lambda rows, most, *more: rows.withColumn("place", F.row_number().over(by(*more))).where(F.col("place") <= most)
    of_source = of_group = 0
    if per_source is not None:
        of_source = per_source + 1
    if per_group is not None:
        of_group = per_group + 2
    if per_source is not None and per_group is not None:  # rows of a series in full groups, and of a group in full series, are passed over
        rows = first(rows, per_source + 1, "source", "event_group")
        of_source, of_group = of_source + k * (per_source + 1), of_group + k * (per_source + 1)
    if of_source:
        rows = first(rows, of_source, "source")
    if of_group:
        rows = first(rows, of_group, "event_group")
    rows = first(rows, k * (1 + of_source + of_group) + 2)
    offer = F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "source", "donor_id", "event_group")))
    lists = rows.groupBy(*keys).agg(offer.alias("offer"))
    none = F.struct(F.filter("offer", lambda d: F.lit(False)).alias("chosen"), F.lit(False).alias("skipped"))

    def step(state: Column, d: Column) -> Column:
        chosen = state["chosen"]
        full = F.size(chosen) >= k
        of = lambda name: F.size(F.filter(chosen, lambda c: c[name] == d[name]))
        if per_source is not None:
            full = full | (of("source") >= per_source)
        if per_group is not None:
            full = full | (of("event_group") >= per_group)
        alone = F.lit(spread) & ~full & (F.size(chosen) > 0) & (of("source") == F.size(chosen)) & ~state["skipped"]
        return F.struct(F.when(full | alone, chosen).otherwise(F.concat(chosen, F.array(d))).alias("chosen"), (state["skipped"] | alone).alias("skipped"))

    picked = lists.select(*keys, F.posexplode(F.aggregate("offer", none, step, lambda s: s["chosen"])).alias("i", "d"))
    return picked.select(*keys, (F.col("i") + 1).alias("rank"), "d.source", "d.donor_id", "d.event_group", (-F.col("d.far")).alias("sim"))
