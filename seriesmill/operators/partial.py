"""Partly observed targets: blending, calibration to the context, completion, monotone event time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesmill.operators.synth import mean_of, std_of

EPS = 1e-6


def quantile_of(x: Column, q: float) -> Column:
    """The linear quantile of an array."""
    ordered, last = F.sort_array(x), F.size(x) - 1
    low = F.floor(last * q).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, last))
    return a + (b - a) * (last * q - low)


def robust_std_of(x: Column, eps: float = EPS) -> Column:
    """The quartile range over 1.349, or the population std where that is 0, at least ``eps``."""
    span = quantile_of(x, 0.75) - quantile_of(x, 0.25)
    return F.greatest(F.when(span > 0, span / 1.349).otherwise(std_of(x)), F.lit(eps))


def anchored(values: Column, observed: Column) -> Column:
    """The values of observed places, null elsewhere; ``observed`` is an array of 0/1."""
    return F.zip_with(values, observed, lambda v, o: F.when(o > 0, v))


def interpolated(anchors: Column, otherwise: Column) -> Column:
    """Nulls filled along lines between the anchors, held beyond the outer ones; ``otherwise`` without any anchor."""
    places = F.array_compact(F.transform(anchors, lambda v, i: F.when(v.isNotNull(), i)))

    def at(v: Column, i: Column) -> Column:
        left = F.array_max(F.filter(places, lambda p: p <= i))
        right = F.array_min(F.filter(places, lambda p: p >= i))
        a, b = F.get(anchors, left), F.get(anchors, right)
        return F.coalesce(v, a + (b - a) * (i - left) / (right - left), a, b)

    return F.when(F.size(places) > 0, F.transform(anchors, at)).otherwise(otherwise)


def blended(donor: Column, values: Column, observed: Column, mode: str = "full_replacement") -> Column:
    """A donor shape of the target's length blended with its observed places.

    full_replacement: the donor alone. residual_baseline: the donor's shape around the mean of the unobserved values
    (all values where none is unobserved). anchor_interpolate: lines between observed places. Without an observed
    place, the donor alone in any mode.
    """
    if mode == "full_replacement":
        return donor
    known = F.exists(observed, lambda o: o > 0)
    keep = lambda base: F.zip_with(anchored(values, observed), base, lambda v, b: F.coalesce(v, b))
    if mode == "residual_baseline":
        hidden = F.array_compact(F.zip_with(values, observed, lambda v, o: F.when(o <= 0, v)))
        baseline = F.when(F.size(hidden) > 0, mean_of(hidden)).otherwise(mean_of(values))
        level = baseline - mean_of(donor)
        return F.when(known, keep(F.transform(donor, lambda d: d + level))).otherwise(donor)
    if mode == "anchor_interpolate":
        return F.when(known, interpolated(anchored(values, observed), donor)).otherwise(donor)
    raise ValueError(f"no such mode of partial targets: {mode}")


def completed(donor: Column, values: Column, observed: Column) -> Column:
    """Observed places keep their value, the others take the donor's."""
    return F.zip_with(anchored(values, observed), donor, lambda v, d: F.coalesce(v, d))


def calibrated(synthetic: Column, values: Column, context_mean: Column, context_std: Column, mode: str = "none", observed: Column | None = None) -> Column:
    """A struct (x, scale, shift) of a synthesis moved to its target's context.

    none: as it is. baseline_shift, and any other name: to the context's mean. robust_scale_shift: also scaled from its
    robust std to the context's std, or the target's robust std where that is 0; with observed places, to the larger
    robust std of these and of the target.
    """
    as_struct = lambda x, scale, shift: F.struct(x.alias("x"), scale.cast("double").alias("scale"), shift.cast("double").alias("shift"))
    if mode == "none":
        return as_struct(synthetic, F.lit(1.0), F.lit(0.0))
    mean = F.transform(F.array(mean_of(synthetic)), lambda m: m)[0]
    if mode != "robust_scale_shift":
        return as_struct(F.transform(synthetic, lambda v: v + context_mean - mean), F.lit(1.0), context_mean - mean)
    own = F.when(context_std > 0, context_std).otherwise(robust_std_of(values))
    if observed is not None:
        seen = F.array_compact(anchored(values, observed))
        own = F.when(F.size(seen) > 0, F.greatest(robust_std_of(seen), robust_std_of(values))).otherwise(own)
    scale = own / robust_std_of(synthetic)
    return as_struct(F.transform(synthetic, lambda v: (v - mean) * scale + context_mean), scale, context_mean - mean * scale)


def training_labels(values: Column, observed: Column, mode: str) -> Column:
    """The labels of a synthetic window's points: all 1, but only the observed places where these were kept."""
    return F.transform(values, lambda v: F.lit(1)) if mode == "full_replacement" else F.transform(observed, lambda o: (o > 0).cast("int"))


def control_points(n: int) -> list[float]:
    """Evenly spaced points of event time, two at least."""
    if n < 2:
        raise ValueError("an event time map needs two control points")
    return [i / (n - 1) for i in range(n)]


def monotone_map(times: Column, step_logits: Column, points: list[float]) -> Column:
    """Local times (0 to 1) on a monotone map: steps are the softmax of the logits, lines between the control points.

    ``step_logits`` is an array of one number less than ``points``.
    """
    weights = F.transform(step_logits, lambda x: F.exp(x - F.array_max(step_logits)))
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    heights = F.aggregate(weights, F.array(F.lit(0.0)), lambda s, w: F.concat(s, F.array(F.element_at(s, -1) + w / total)))
    xs = F.array(*map(F.lit, points))

    def at(t: Column) -> Column:
        i = F.least(F.greatest(F.size(F.filter(xs, lambda p: p <= t)) - 1, F.lit(0)), F.lit(len(points) - 2))
        a, b = F.get(xs, i), F.get(xs, i + 1)
        part = F.least(F.greatest((t - a) / (b - a), F.lit(0.0)), F.lit(1.0))
        return F.get(heights, i) + (F.get(heights, i + 1) - F.get(heights, i)) * part

    return F.transform(times, at)
