"""The detector × policy × seed experiment, and the runners around it, as functions of a POINTS table.

Each cell is a plan: split by series, mask training labels, pick donors by the
policy, synthesize, filter, splice the windows into copies of their series, fit,
score, calibrate on validation, evaluate on test. The driver holds fitted models,
thresholds and one metric row a cell. What cells share is made once: the parts of a
split, and the augmentation of a policy (of a policy and detector for the adaptive
one), each written to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.operators import audit, compat, detectors, donors, evaluate, events, partial, splits, synth, windows
from seriesmill.session import checkpointed
from seriesmill.sources import sinks

FEATURES = ["v", "mean", "std", "diff", "min", "max", "lag1", "lag2"]
CONTEXT = 32

#: The donor preset of each named policy; whether its donors come from one group; the adaptive policy's routes (first choice, fallback) and families.
PRESET_OF = {
    "real_only": None, "random_event_oversampling": None, "all_donors_no_filter": "all_donors_no_filter", "same_dataset_only": "same_dataset_only", "cross_dataset_all": "cross_dataset_all",
    "cross_dataset_compatible": "cross_dataset_compatible", "compatibility_top50": "compatibility_top50", "compatibility_strict": "compatibility_strict", "groupwise_cross_dataset_all": "cross_dataset_all",
    "groupwise_cross_dataset_compatible": "cross_dataset_compatible", "groupwise_compatibility_strict": "compatibility_strict", "adaptive_groupwise_transfer": None,
}
ROUTES = {"density": ("groupwise_cross_dataset_compatible", "groupwise_cross_dataset_all"), "broad": ("groupwise_cross_dataset_all", "groupwise_cross_dataset_compatible")}
ROUTES["default"] = ROUTES["density"]
FAMILIES = {"density": ("iforest", "lof", "ocsvm"), "broad": ("internal_classifier", "current_internal_classifier", "cnn", "timesnet", "autoencoder")}
#: Synthesis methods by their names, those of the context-calibrated ones, and the masks of a completion.
METHODS = {"normalized_time_mean_donor": "mean", "random_donor": "first", "weighted_donor": "weight", "dtw_aligned_donor": "dtw", "learned_prototype_event_time": "prototype"}
CALIBRATED = {"normalized_time_context_calibrated": "normalized_time_mean_donor", "dtw_context_calibrated": "dtw_aligned_donor", "learned_prototype_context_calibrated": "learned_prototype_event_time"}
MASKS = ("prefix", "middle", "suffix", "random")
COMPLETIONS = ("linear_interpolation", "random_donor", "normalized_time_mean_donor", "weighted_donor", "dtw_aligned_donor", "learned_prototype_event_time")


@dataclass(frozen=True)
class Synthesis:
    """How windows are made and filtered."""

    method: str = "normalized_time_mean_donor"
    top_k: int = 3
    filter_policy: str = "no_filter"
    filter_value: float = 0.5
    calibration: str = "none"
    partial_mode: str = "full_replacement"
    event_groups: int = 4
    learn_weights: bool = False
    settings: Mapping = field(default_factory=dict)


@dataclass(frozen=True)
class Augmentation:
    """Synthetic series beside the training series, their audit, and which policy made them."""

    points: DataFrame
    audit: DataFrame | None
    policy: str
    selected: str
    reason: str = "fixed_policy"
    fallback: bool = False
    n_windows: int = 0
    n_points: int = 0
    n_rejected: int = 0


def route(detector: str) -> tuple[str, str, str]:
    """Family of a detector, and the adaptive policy's first choice and fallback for it."""
    family = next((f for f, names in FAMILIES.items() if detector.strip().lower() in names), "default")
    return family, *ROUTES[family]


def load_config(path: str | Path, root: str | Path = ".") -> dict:
    """A YAML file over the files it inherits from, in order; mappings merge one level down, deeper ones are replaced."""
    import yaml

    own = yaml.safe_load(Path(path).read_text()) or {}
    parents = own.pop("inherits", None) or []
    layers = [load_config(Path(root) / p, root) for p in ([parents] if isinstance(parents, str) else parents)]
    merged: dict = {}
    for layer in [*layers, own]:
        for key, value in layer.items():
            both = isinstance(value, dict) and isinstance(merged.get(key), dict)
            merged[key] = merged[key] | value if both else value
    return merged


def synthesized(train: DataFrame, preset: str, how: Synthesis, groupwise: bool = False, method_name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Windows (series_id, event_id, s, x, y, accepted) and audit of one donor preset on labelled training points."""
    truth = checkpointed(events.labelled(train))
    cut = checkpointed(events.segments(train, truth))
    near = checkpointed(compat.sides(train, truth))
    some = truth.select("series_id").distinct()
    profiles = compat.profile(train, truth).join(compat.context(train, truth), "series_id").join(compat.spectral_share_long(train), "series_id")
    pairs = compat.pairs(checkpointed(profiles.join(some, "series_id", "left_semi")))
    groups, config = None, donors.resolved({"compatibility": dict(how.settings)}, {"donor_policy": preset})
    if groupwise or how.learn_weights:
        embedded = checkpointed(compat.embedding(cut, near, train))
        groups = checkpointed(synth.grouped(embedded, synth.event_groups(embedded, how.event_groups)).select("series_id", "event_id", "event_group", "x"))
        pairs = checkpointed(donors.group_overlap(pairs, donors.group_shares(groups)))
        if how.learn_weights:
            config = replace(config, weights=synth.learned_weights(pairs, dict(config.weights))[0])
    judged = checkpointed(donors.judged(pairs, config))
    sources = donors.accepted(judged, config).select("target", "source")
    cands = checkpointed(synth.candidates(cut.select("series_id", "event_id", "values"), sources, how.top_k, groups=groups if groupwise else None))
    rows = synth.synthesized(synth.donors(cands))
    kind = METHODS[CALIBRATED.get(how.method, how.method)]
    if kind in ("dtw", "prototype"):
        rows = rows.join(synth.warped(cands, kind), ["series_id", "event_id"]).withColumn("x", F.col("synthetic"))
    else:
        rows = rows.withColumn("x", F.col(f"by_{kind}"))
    observed = F.transform("values", lambda v: F.lit(0))  # training events are replaced whole; completion has its own masks
    whole = train.groupBy("series_id").agg(F.avg("v").alias("whole"))
    rows = rows.join(near.select("series_id", "event_id", "pre_mean", "pre_std"), ["series_id", "event_id"]).join(whole, "series_id")
    mode = "robust_scale_shift" if how.method in CALIBRATED and how.calibration == "none" else how.calibration
    moved = partial.calibrated(partial.blended(F.col("x"), F.col("values"), observed, how.partial_mode), F.col("values"), F.coalesce("pre_mean", "whole"), F.coalesce("pre_std", F.lit(0.0)), mode)
    rows = rows.withColumn("c", moved).withColumn("x", F.col("c.x"))
    made = checkpointed(synth.filtered(synth.confidence(rows, "x"), how.filter_policy, how.filter_value))
    name = method_name or how.method
    more = {"synthesis_method": how.method, "filter_method": how.filter_policy}
    pair_rows = audit.donor_pairs(truth, judged, name, preset, config.enabled, **more)
    audits = pair_rows.unionByName(audit.synthesis_candidates(truth, made, truth, judged, name, preset, calibration_method=mode, **more))
    return made.join(cut.select("series_id", "event_id", "s"), ["series_id", "event_id"]).select("series_id", "event_id", "s", "x", "accepted"), checkpointed(audits)


def _spliced(train: DataFrame, made: DataFrame, tag: str) -> DataFrame:
    """Copies of the series of accepted windows with these in their place, under a name of their own."""
    placed = made.where("accepted").select("series_id", "s", F.posexplode("x").alias("k", "sv"))
    windows_ = placed.select("series_id", (F.col("s") + F.col("k")).alias("t"), "sv", F.lit(1).alias("sy"))
    copies = windows.spliced(train.join(windows_.select("series_id").distinct(), "series_id", "left_semi").drop("dataset"), windows_)
    return copies.join(train.select("series_id", "dataset").distinct(), "series_id").select(F.concat("series_id", F.lit(f"#{tag}")).alias("series_id"), "dataset", "t", "v", "y")


def augmented(train: DataFrame, policy: str, detector: str = "", how: Synthesis = Synthesis(), least: int = 1) -> Augmentation:
    """What a named policy adds to masked training points; the adaptive one falls back where its first choice gives fewer than ``least`` windows."""
    if policy not in PRESET_OF:
        raise ValueError(f"no such policy: {policy}")
    if policy == "real_only":
        return Augmentation(train.limit(0), None, policy, policy)
    if policy == "random_event_oversampling":
        copies = splits.oversampled(events.labelled(train), 2.0).where("copy > 0")
        inside = train.join(copies.withColumnRenamed("series_id", "k"), (F.col("series_id") == F.col("k")) & F.col("t").between(F.col("s"), F.col("e") - 1))
        extra = checkpointed(inside.select(F.concat_ws("#", "series_id", F.lit("over"), "event_id", "copy").alias("series_id"), "dataset", (F.col("t") - F.col("s")).alias("t"), "v", "y"))
        n = extra.agg(F.count_distinct("series_id").alias("w"), F.count("*").alias("p")).first()
        return Augmentation(extra, None, policy, policy, n_windows=n["w"], n_points=n["p"])
    if policy == "adaptive_groupwise_transfer":
        family, first, second = route(detector)
        got = augmented(train, first, detector, how)
        if got.n_windows >= least:
            return replace(got, policy=policy, reason=f"detector_family:{family}")
        return replace(augmented(train, second, detector, how), policy=policy, reason=f"detector_family:{family};fallback", fallback=True)
    made, audits = synthesized(train, PRESET_OF[policy], how, policy.startswith("groupwise_"), policy)
    n = made.agg(F.count_if("accepted").alias("w"), F.coalesce(F.sum(F.when(F.col("accepted"), F.size("x"))), F.lit(0)).alias("p"), F.count_if(~F.col("accepted")).alias("r")).first()
    return Augmentation(checkpointed(_spliced(train, made, "syn")), audits, policy, policy, n_windows=n["w"], n_points=n["p"], n_rejected=n["r"])


def featured(points: DataFrame) -> DataFrame:
    return windows.point_features(points).join(points.select("series_id", "dataset", "t", "y"), ["series_id", "t"])


def scorer(detector: str, rows: DataFrame):
    """A function of feature rows to rows with a score, fitted on training rows."""
    if detector in ("forest", "logistic", "internal_classifier"):
        return windows.score_column(rows, FEATURES, "forest" if detector == "internal_classifier" else detector)
    if detector == "zscore":
        return lambda other: windows.z_scores(other, ("v", "std", "diff"))
    if detector in ("cnn", "timesnet"):
        return _forecasting(detector, rows)
    fit = {"iforest": detectors.IsolationForest, "ocsvm": detectors.OneClassBoundary, "lof": lambda x: detectors.LocalOutlierFactor(x[:4000]), "autoencoder": detectors.AutoEncoder}[detector]
    model = fit(detectors.sampled(rows, FEATURES))
    return lambda other: other.join(detectors.applied(other, FEATURES, model), ["series_id", "t"])


def _forecasting(detector: str, rows: DataFrame):
    """Forecast errors of context windows; points before a series' first target have that one's score."""
    columns = [f"c{i}" for i in range(CONTEXT + 1)]

    def flat(points: DataFrame) -> DataFrame:
        found = windows.forecast_pairs(points.select("series_id", "t", "v", "y"), CONTEXT)
        return found.select("series_id", F.col("at").alias("t"), *[F.get(F.concat("context", "target"), F.lit(i)).alias(c) for i, c in enumerate(columns)])

    model = {"cnn": detectors.ConvForecaster, "timesnet": detectors.PeriodForecaster}[detector](detectors.sampled(flat(rows), columns))

    def score(points: DataFrame) -> DataFrame:
        made = points.join(detectors.applied(flat(points), columns, model), ["series_id", "t"], "left")
        first = F.first("score", ignorenulls=True).over(W.partitionBy("series_id").orderBy("t").rowsBetween(0, W.unboundedFollowing))
        return made.withColumn("score", F.coalesce("score", first, F.lit(0.0)))

    return score


@dataclass(frozen=True)
class Parts:
    """One seed's split: masked training points, validation and test points, feature rows of both."""

    seed: int
    fraction: float
    train: DataFrame
    real: DataFrame
    val: DataFrame
    test: DataFrame


def prepared(points: DataFrame, seed: int, fraction: float = 0.2) -> Parts:
    """The parts of a seed, each made once; every dataset has a test series."""
    split = checkpointed(splits.cover_tests(splits.split(splits.series(points), seed)).select("series_id", "split"))
    part = lambda name: points.join(split.where(F.col("split") == name).select("series_id"), "series_id", "left_semi")
    real = checkpointed(part("train"))
    train = checkpointed(splits.masked_labels(real, events.labelled(real), fraction, seed))
    return Parts(seed, fraction, train, real, checkpointed(featured(part("val"))), checkpointed(featured(part("test"))))


def evaluated(parts: Parts, detector: str, extra: Augmentation, mode: str = "fixed_quantile", quantile: float = 0.95) -> DataFrame:
    """One row of METRICS: fitted on training and synthetic points, threshold from validation (or from normal against synthetic scores), measured on test."""
    fitted = checkpointed(featured(parts.train.unionByName(extra.points)))
    score = scorer(detector, fitted)
    val = checkpointed(score(parts.val).select("series_id", "dataset", "t", "y", "score"))
    test = checkpointed(score(parts.test).select("series_id", "dataset", "t", "y", "score"))
    normal = val if not val.isEmpty() else test  # no validation series: the test scores' own quantile
    synthetic = checkpointed(score(featured(extra.points)).where("y = 1").select("score")) if extra.n_windows else None
    means = normal.where("y = 0").agg(F.avg("score")).first()[0], synthetic.agg(F.avg("score")).first()[0] if synthetic is not None else None
    method, f1 = mode, None
    if mode == "synthetic_separation" and synthetic is not None and means[0] is not None and means[1] > means[0]:
        found = evaluate.separation(normal.where("y = 0").select(F.col("score").alias("v")), synthetic.select(F.col("score").alias("v"))).first()
        threshold, f1 = found["threshold"], found["f1"]
    elif mode in ("fixed_quantile", "synthetic_separation"):  # a gap the wrong way round falls back too
        threshold, method = normal.where("y = 0").agg(F.percentile("score", quantile)).first()[0], "fixed_quantile"
    else:
        threshold = evaluate.selected_threshold(normal, events.labelled(normal), mode, quantile=quantile).first()[0]
    threshold = 0.5 if threshold is None else float(threshold)
    truth, preds = events.labelled(test), events.predicted(test, threshold, score="score")
    total = events.matched_counts(truth, preds).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_truth", "n_pred", "n_match")])
    row = events.prf(total).select(F.col("precision").alias("event_precision"), F.col("recall").alias("event_recall"), F.col("f").alias("event_f1"), F.col("false_positives").alias("false_positive_events"))
    area = evaluate.auroc(test, score="score").crossJoin(evaluate.average_precision(test, score="score")).toDF("auroc", "auprc")  # one row each
    best = evaluate.best_f1_reference(test.withColumn("v", F.col("score")), shifted=False).select(F.col("f1").alias("best_point_f1"))
    valid = evaluate.validity(test.withColumn("v", F.col("score")).withColumn("one", F.lit(1)), ("one",)).drop("one")
    preset = PRESET_OF.get(extra.selected)
    none = lambda kind: F.lit(None).cast(kind)
    named = {
        "split_seed": F.lit(parts.seed), "dataset": F.lit("all"), "detector_backbone": F.lit(detector), "augmentation_policy": F.lit(extra.policy), "selected_policy_name": F.lit(extra.selected),
        "selection_reason": F.lit(extra.reason), "fallback_used": F.lit(extra.fallback), "donor_policy": F.lit(preset) if preset else none("string"), "compatibility_enabled": F.lit(bool(preset) and donors.resolved({"donor_policy": preset}).enabled),
        "labeled_fraction": F.lit(parts.fraction), "threshold": F.lit(threshold), "threshold_mode": F.lit(mode), "threshold_calibration_method": F.lit(method), "calibration_f1": F.lit(f1).cast("double"),
        "synthetic_score_mean": F.lit(means[1]).cast("double"), "normal_score_mean": F.lit(means[0]).cast("double"), "synthetic_normal_score_gap": F.lit(means[1] - means[0] if None not in means else None).cast("double"),
        "num_synthetic_windows": F.lit(extra.n_windows), "num_synthetic_points": F.lit(extra.n_points), "num_rejected_synthetic_windows": F.lit(extra.n_rejected),
    }
    return row.crossJoin(area).crossJoin(best).crossJoin(valid).withColumns(named)  # one row each


def _union(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row, allowMissingColumns=True)
    return out


def run(points: DataFrame, seeds: list[int], detector_names: list[str], policies: list[str], fraction: float = 0.2, how: Synthesis = Synthesis(), mode: str = "fixed_quantile") -> DataFrame:
    """The METRICS table of the whole grid; a policy's augmentation is made once a seed, the adaptive one's once a detector."""
    rows = []
    for seed in seeds:
        parts, known = prepared(points, seed, fraction), {}
        for detector in detector_names:
            for policy in policies:
                key = policy, detector if policy == "adaptive_groupwise_transfer" else ""
                if key not in known:
                    known[key] = augmented(parts.train, policy, detector, how)
                rows.append(checkpointed(evaluated(parts, detector, known[key], mode)))
    return _union(rows)


def run_real_only(points: DataFrame, detector: str = "logistic", seed: int = 42) -> DataFrame:
    """The baseline: all training labels, no synthesis."""
    return run(points, [seed], [detector], ["real_only"], fraction=1.0)


def method_specs(strict: bool = False) -> dict[str, tuple[str, Synthesis]]:
    """Methods of a low-label run by name: policy and synthesis; with ``strict``, an ablation's strict filters too."""
    specs = {"real_only": ("real_only", Synthesis()), "random_event_oversampling": ("random_event_oversampling", Synthesis())}
    for method in ("normalized_time_mean_donor", "dtw_aligned_donor", "learned_prototype_event_time"):
        specs[method] = ("all_donors_no_filter", Synthesis(method))
    filters = {"top50": "top_quantile", "minconf": "min_confidence"} | ({"strict": "strict"} if strict else {})
    for tag, policy in filters.items():
        for name, method in (("normalized_time", "normalized_time_mean_donor"), ("learned_prototype_event_time", "learned_prototype_event_time")):
            specs[f"{name}_{tag}_filter"] = ("all_donors_no_filter", Synthesis(method, filter_policy=policy))
    for name in CALIBRATED:
        specs[name] = ("all_donors_no_filter", Synthesis(name))
    for preset in donors.PRESETS:
        specs[preset] = (preset, Synthesis())
    return specs


def run_low_label(points: DataFrame, detector: str = "logistic", seed: int = 42, fraction: float = 0.2, methods: list[str] | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """METRICS with a column ``method``, a row a method, and the audit of all methods."""
    specs, parts, rows, audits = method_specs(strict), prepared(points, seed, fraction), [], []
    for name in methods or list(specs):
        policy, how = specs[name]
        extra = augmented(parts.train, policy, detector, how)
        rows.append(checkpointed(evaluated(parts, detector, extra).withColumns({"method": F.lit(name), "synthesis_method": F.lit(how.method), "filter_policy": F.lit(how.filter_policy)})))
        if extra.audit is not None:
            audits.append(extra.audit.withColumns({"method": F.lit(name), "labeled_fraction": F.lit(fraction)}))
    return _union(rows), _union(audits) if audits else None


def run_ablation(points: DataFrame, detector: str = "logistic", seed: int = 42, fraction: float = 0.2, methods: list[str] | None = None) -> DataFrame:
    """The low-label methods and the strict filters, each against the real data alone (columns delta_*)."""
    metrics, _ = run_low_label(points, detector, seed, fraction, list(dict.fromkeys(["real_only", *(methods or method_specs(True))])), strict=True)
    base = metrics.where("method = 'real_only'").select(*[F.col(c).alias(f"base_{c}") for c in ("event_f1", "auroc", "false_positive_events")])
    rows = metrics.crossJoin(F.broadcast(base))  # one row
    return rows.withColumns({f"delta_{c}": F.col(c) - F.col(f"base_{c}") for c in ("event_f1", "auroc", "false_positive_events")}).drop(*base.columns)


def run_sweep(points: DataFrame, fractions: list[float], detector: str = "logistic", seed: int = 42, methods: list[str] | None = None) -> DataFrame:
    """Low-label runs over label fractions on one split, a row a fraction and method."""
    return _union([run_low_label(points, detector, seed, f, methods)[0] for f in fractions])


def completion(points: DataFrame, donors_from: DataFrame, sources: DataFrame, masks: tuple[str, ...] = MASKS, methods: tuple[str, ...] = COMPLETIONS, fraction: float = 0.4, top_k: int = 3) -> DataFrame:
    """A row an event of ``points`` (three points or more), mask and method: reconstruction metrics and the number of donors.

    ``donors_from`` holds the donor series, ``sources`` the accepted pairs (target, source).
    """
    truth = events.labelled(points)
    own = events.segments(points, truth).where(F.size("values") >= 3).select("series_id", "event_id", "values")
    pool = events.segments(donors_from, events.labelled(donors_from)).select("series_id", "event_id", "values")
    cands = checkpointed(synth.candidates(own, sources, top_k, pool=pool))
    rows = synth.synthesized(synth.donors(cands))
    for kind in ("dtw", "prototype"):
        if any(METHODS.get(m) == kind for m in methods):
            rows = rows.join(synth.warped(cands, kind).withColumnRenamed("synthetic", f"by_{kind}"), ["series_id", "event_id"])
    rows = own.join(checkpointed(rows.drop("values")), ["series_id", "event_id"], "left")
    n = F.size("values").cast("long")
    spans = {m: evaluate.mask_interval(n, fraction, m, F.concat_ws("|", "series_id", "event_id")) for m in masks}
    kinds = F.array(*[F.struct(F.lit(k).alias("mask_policy"), a.cast("long").alias("start"), b.cast("long").alias("stop")) for k, (a, b) in spans.items()])
    masked = checkpointed(rows.withColumn("m", F.explode(kinds)).select("*", "m.*").drop("m"))
    observed = F.transform("values", lambda v, i: ((i < F.col("start")) | (i >= F.col("stop"))).cast("int"))
    out = []
    for method in methods:
        if method == "linear_interpolation":
            filled = evaluate.linear_fill(F.col("values"), F.col("start"), F.col("stop"))
        else:
            shape = F.get(F.transform("donors", lambda d: d["x"]), F.pmod(F.crc32(F.concat_ws("|", "series_id", "event_id")), F.size("donors")).cast("int")) if method == "random_donor" else F.col(f"by_{METHODS[method]}")
            filled = partial.completed(shape, F.col("values"), observed)
        made = masked.withColumn("filled", filled).where("filled is not null").withColumns({"method": F.lit(method), "num_donors": F.coalesce(F.size("donors"), F.lit(0))})
        out.append(evaluate.reconstruction(made, ("series_id", "event_id", "mask_policy", "method", "start", "stop", "num_donors")))
    return _union(out)


def run_completion(points: DataFrame, seed: int = 42, policy: str = "all_donors_no_filter", masks: tuple[str, ...] = MASKS, methods: tuple[str, ...] = COMPLETIONS, fraction: float = 0.4) -> DataFrame:
    """Masked completion of the test series' events with donors of training series."""
    split = checkpointed(splits.cover_tests(splits.split(splits.series(points), seed)).select("series_id", "split"))
    part = lambda name: points.join(split.where(F.col("split") == name).select("series_id"), "series_id", "left_semi")
    test, train = checkpointed(part("test")), checkpointed(part("train"))
    both = test.unionByName(train)
    truth = checkpointed(events.labelled(both))
    profiles = checkpointed(compat.profile(both, truth).join(compat.context(both, truth), "series_id").join(compat.spectral_share_long(both), "series_id"))
    is_test = profiles.join(test.select("series_id").distinct(), "series_id", "left_semi")
    has_event = profiles.join(train.select("series_id").distinct(), "series_id", "left_semi").where("n_events > 0")
    config = donors.resolved({"donor_policy": policy})
    sources = donors.accepted(donors.judged(compat.pairs(is_test, has_event), config), config).select("target", "source")
    return completion(test, train, checkpointed(sources), masks, methods, fraction)


def run_transfer(points: DataFrame, policies: list[str], detector: str = "logistic", seed: int = 42, fraction: float = 0.2) -> dict[str, DataFrame]:
    """Donor policies side by side: metrics, audit, invariants broken (none in a sound run), pair summary, completion errors by policy."""
    parts, rows, audits, errors = prepared(points, seed, fraction), [], [], []
    for policy in policies:
        extra = augmented(parts.train, policy, detector)
        rows.append(checkpointed(evaluated(parts, detector, extra)))
        if extra.audit is not None:
            audits.append(extra.audit)
            done = run_completion(points, seed, PRESET_OF[policy], masks=("middle",), methods=("normalized_time_mean_donor",))
            errors.append(checkpointed(done.groupBy("method").agg(F.avg("mae").alias("masked_region_MAE"), F.count("*").alias("n")).withColumn("augmentation_policy", F.lit(policy))))
    out = {"metrics": _union(rows)}
    if audits:
        every = _union(audits)
        out |= {"audit": every, "violations": audit.violations(every), "summary": audit.pair_summary(every), "completion": _union(errors)}
    return out


def inspect(points: DataFrame) -> DataFrame:
    """One row of dataset statistics."""
    return events.stats(points, events.labelled(points))


def run_suite(spark: SparkSession, streams: Mapping[str, Callable[[], DataFrame]], out: str, fail: bool = False) -> DataFrame:
    """Runs each stream, writes its table under ``out``, and gives the manifest: stream, success, path, error. One that fails doesn't stop the others, unless ``fail``."""
    rows = []
    for name, stream in streams.items():
        try:
            sinks.save_table(stream(), f"{out}/{name}/metrics")
            rows.append((name, True, f"{out}/{name}/metrics", None))
        except Exception as error:
            if fail:
                raise
            rows.append((name, False, None, f"{type(error).__name__}: {error}"[:500]))
    return spark.createDataFrame(rows, "stream string, success boolean, path string, error string")


def collect_results(spark: SparkSession, root: str) -> DataFrame:
    """The metric rows of all runs under a folder, with their run's name; equal rows once, sorted."""
    rows = spark.read.option("recursiveFileLookup", True).option("header", True).option("enforceSchema", False)
    runs = sorted({f.path.rsplit("/metrics/", 1)[0] for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path").toLocalIterator() if "/metrics/" in f.path})
    found = [rows.csv(f"{run_}/metrics").withColumn("run", F.lit(run_.rsplit("/", 1)[-1])) for run_ in runs]
    if not found:
        raise ValueError(f"no runs under {root}")
    every = _union(found).distinct()
    order = [c for c in ("run", "method", "augmentation_policy", "detector_backbone", "split_seed") if c in every.columns]
    return every.orderBy(*order)
