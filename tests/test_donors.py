import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import audit, compat, donors, partial, report, splits, synth

PARTS = ("shape", "amplitude", "duration", "context", "frequency", "trend", "group")


def pair_rows(spark, seed=3, n=9):
    r = random.Random(seed)
    rows = []
    for t, s in itertools.permutations(range(n), 2):
        rows.append((f"d{t % 3}/s{t}", f"d{s % 3}/s{s}", f"d{t % 3}" if t else None, f"d{s % 3}", *[round(r.uniform(0.2, 0.95), 3) for _ in PARTS]))
    return rows, spark.createDataFrame(rows, "target string, source string, t_dataset string, s_dataset string, " + ", ".join(f"{p} double" for p in PARTS))


def plain_judged(rows, cfg):
    """kept and reason of each candidate pair, one target after the other."""
    out = {}
    for target in {r[0] for r in rows}:
        own = []
        for r in rows:
            same = r[2] is not None and r[2] == r[3]
            if r[0] != target or r[2] is not None and (donors.within(cfg.donor_policy) and not same or donors.across(cfg.donor_policy) and same):
                continue
            score = sum(w * r[4 + PARTS.index(p)] for p, w in cfg.weights.items()) / sum(cfg.weights.values()) + (cfg.same_dataset_bonus if same else 0)
            weakest = min(PARTS, key=lambda p: (r[4 + PARTS.index(p)], PARTS.index(p)))
            own.append([-round(min(score, 1), 12), r[1], "" if not cfg.enabled or score >= cfg.min_score else f"below_min_score:{weakest}"])
        passing = [x for x in sorted(own) if not x[2]]
        left = passing[: cfg.top_k] if cfg.top_k is not None else passing
        if cfg.top_quantile is not None and left:
            left = left[: max(1, math.ceil(len(left) * cfg.top_quantile))]
        for x in passing[len(left) :]:
            x[2] = "below_top_quantile_0.5"
        out |= {(target, x[1]): x[2] for x in own}
    return out


@pytest.mark.parametrize("policy, run", [(p, {}) for p in donors.PRESETS] + [("compatibility_top50", {"top_k": 3}), (None, {"compatibility": {"top_k": 2, "min_score": 0.55}})])
def test_judged_pairs_against_a_plain_loop(spark, policy, run):
    rows, pairs = pair_rows(spark)
    cfg = donors.resolved({"donor_policy": policy}, run)
    got = {(r.target, r.source): r.reason for r in donors.judged(pairs, cfg).collect()}
    assert got == plain_judged(rows, cfg)
    assert {(r.target, r.source) for r in donors.accepted(donors.judged(pairs, cfg), cfg).collect()} == {k for k, reason in got.items() if not reason}


def test_fallback_lets_all_in(spark):
    _, pairs = pair_rows(spark)
    strict = {"compatibility": {"min_score": 0.99, "fallback_when_no_compatible_donor": "all_donors"}}
    cfg = donors.resolved(strict)
    assert donors.accepted(donors.judged(pairs, cfg), cfg).count() == 0  # only with the second permission
    cfg = donors.resolved(strict, {"compatibility": {"allow_incompatible_donors": True}})
    assert donors.accepted(donors.judged(pairs, cfg), cfg).count() == pairs.count()


def test_settings_merge_in_order():
    cfg = donors.resolved({"compatibility": {"min_score": 0.2, "weights": {"shape": 1.0}}, "donor_policy": "compatibility_strict"}, {"compatibility": {"weights": {"trend": 0.5}}, "top_k": 4})
    assert (cfg.min_score, cfg.top_k, dict(cfg.weights), cfg.donor_policy) == (0.7, 4, {"shape": 1.0, "trend": 0.5}, "compatibility_strict")
    assert donors.resolved({"donor_policy": "compatibility_strict"}, {"donor_policy": "cross_dataset_all"}).require_cross_dataset
    assert donors.resolved({"compatibility": {"top_k": 2}}, {"top_k": 4}).top_k == 2


def test_violations_of_a_policy(spark):
    _, pairs = pair_rows(spark)
    scored = compat.scored(pairs).where("t_dataset is not null")
    claimed = scored.withColumn("donor_policy", F.lit("cross_dataset_all")).unionByName(scored.where("same_dataset").withColumn("donor_policy", F.lit("same_dataset_only")))
    claimed = claimed.unionByName(scored.where("same_dataset").withColumn("donor_policy", F.lit("planted")))
    got = {r.donor_policy: r.violation for r in donors.pair_violations(claimed, {"planted": "cross_dataset_compatible"}).collect()}
    assert got == {"cross_dataset_all": "same_dataset_pairs_considered", "same_dataset_only": "", "planted": "no_cross_dataset_pairs"}


def plain_retrieved(rows, k, per_source, per_group, spread):
    chosen, blocked = [], set()
    for sim, source, donor, group in sorted(rows, key=lambda x: (-x[0], x[1], x[2])):
        if per_source is not None and sum(c[1] == source for c in chosen) >= per_source or per_group is not None and sum(c[3] == group for c in chosen) >= per_group:
            continue
        if spread and chosen and {c[1] for c in chosen} == {source} and source not in blocked:
            blocked.add(source)
            continue
        chosen.append((sim, source, donor, group))
        if len(chosen) == k:
            break
    return chosen


@pytest.mark.parametrize("per_source, per_group, spread", list(itertools.product((None, 1, 2), (None, 1, 3), (False, True))))
def test_retrieval_against_a_plain_loop(spark, per_source, per_group, spread):
    r = random.Random(5)
    rows = [(t, f"s{r.randrange(1 + t)}", i, r.randrange(1 + t // 2), round(r.choice([r.random(), 0.5]), 3)) for t in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, source string, donor_id long, event_group long, sim double")
    got = {t: [] for t in range(6)}
    for x in donors.retrieved(df, ("event_id",), 4, per_source, per_group, spread).orderBy("event_id", "rank").collect():
        got[x.event_id].append((x.sim, x.source, x.donor_id, x.event_group))
    for t in range(6):
        assert got[t] == plain_retrieved([(x[4], x[1], x[2], x[3]) for x in rows if x[0] == t], 4, per_source, per_group, spread)


def test_group_overlap_without_groups(spark):
    e = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2), ("c", 3)], "series_id string, event_group int")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "x"), ("x", "x")], "target string, source string")
    got = {(r.target, r.source): r.group for r in donors.group_overlap(pairs, donors.group_shares(e)).collect()}
    assert got == {("a", "b"): pytest.approx(1 / 3), ("a", "c"): 0.0, ("a", "x"): 0.5, ("x", "x"): 0.5}


def test_donor_pool_refuses_held_out_labels(spark):
    rows = [(f"d0/s{k}", "d0", t, float(t), int(t % 4 == 0)) for k in range(4) for t in range(20)]
    p = spark.createDataFrame(rows, "series_id string, dataset string, t long, v double, y int")
    split = spark.createDataFrame([("d0/s0", "train"), ("d0/s1", "train"), ("d0/s2", "val"), ("d0/s3", "test")], "series_id string, split string")
    pool = splits.donor_pool(p, split, 0.4, 1)
    assert {r.series_id for r in pool.collect()} == {"d0/s0", "d0/s1"} and pool.count() == 4  # two of five events each stay visible
    for parts in (("train", "val"), ("train", "test")):
        with pytest.raises(ValueError):
            splits.donor_pool(p, split, 0.4, 1, parts)
    assert splits.donor_pool(p, split, 0.4, 1, ("train", "val"), allow_validation=True).select("series_id").distinct().count() == 3


def test_learned_weights_guards_and_mass(spark):
    r = random.Random(1)
    rows = [(f"t{i}", f"s{i}", r.random(), r.random(), r.random(), r.random() * 0.4) for i in range(200)]
    rows = [(t, s, 0.9 if g >= 0.2 else 0.1, b, c, g) for t, s, _, b, c, g in rows]
    df = spark.createDataFrame(rows, "target string, source string, shape double, amplitude double, context double, `group` double")
    weights, reason = synth.learned_weights(df, dict(compat.WEIGHTS))
    assert reason == "" and weights["shape"] > weights["amplitude"] and weights["duration"] == compat.WEIGHTS["duration"]
    learned = ("shape", "amplitude", "context", "group")
    assert sum(weights[c] for c in learned) == pytest.approx(sum(compat.WEIGHTS[c] for c in learned))
    assert synth.learned_weights(df.limit(5), dict(compat.WEIGHTS)) == (dict(compat.WEIGHTS), "insufficient_positive_or_negative_pairs")
    assert synth.learned_weights(df.limit(0), dict(compat.WEIGHTS))[1] == "no_training_pairs"
    assert synth.learned_weights(df, dict(compat.WEIGHTS), ("odd",))[1] == "no_component_keys"


def test_warping_against_a_plain_table():
    r = np.random.default_rng(0)
    for n, m in ((1, 1), (1, 5), (6, 3), (9, 9)):
        a, b = r.normal(size=n), r.normal(size=m)
        best = {}
        for i in range(n):
            for j in range(m):
                before = [best[p] for p in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if p in best]
                best[i, j] = abs(a[i] - b[j]) + (min(before) if before else 0.0)
        path, distance = synth.dtw_path(a, b)
        assert distance == pytest.approx(best[n - 1, m - 1]) and path[0] == (0, 0) and path[-1] == (n - 1, m - 1)
        assert all((c - a_, d - b_) in ((1, 0), (0, 1), (1, 1)) for (a_, b_), (c, d) in zip(path, path[1:]))


def test_partial_targets(spark):
    donor, values = [1.0, 2.0, 4.0, 1.0, 2.0], [10.0, 11.0, 12.0, 13.0, 14.0]
    rows = spark.createDataFrame([(0, donor, values, o) for o in ([0, 1, 0, 1, 0], [0, 0, 1, 0, 0], [0, 0, 0, 0, 0], [1, 1, 1, 1, 1])], "k int, donor array<double>, values array<double>, o array<int>")
    cols = [F.col(c) for c in ("donor", "values", "o")]
    anchors = [r[0] for r in rows.select(partial.blended(*cols, "anchor_interpolate")).collect()]
    assert anchors == [[11.0, 11.0, 12.0, 13.0, 13.0], [12.0] * 5, donor, values]
    residual = [r[0] for r in rows.select(partial.blended(*cols, "residual_baseline")).collect()]
    assert residual[0] == [11.0, 11.0, 14.0, 13.0, 12.0] and residual[2] == donor and residual[3] == values
    assert rows.select(partial.completed(*cols)).first()[0] == [1.0, 11.0, 4.0, 13.0, 2.0]
    with pytest.raises(ValueError):
        partial.blended(*cols, "odd")
    x = np.array(values + [40.0])
    got = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(partial.quantile_of(F.col("x"), 0.25), partial.robust_std_of(F.col("x"))).first()
    assert got[0] == pytest.approx(np.quantile(x, 0.25)) and got[1] == pytest.approx((np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.349)


def test_monotone_map(spark):
    t, logits, points = [0.0, 0.1, 0.5, 0.77, 1.0], [0.3, -1.0, 2.0], partial.control_points(4)
    got = spark.createDataFrame([(t, logits)], "t array<double>, l array<double>").select(partial.monotone_map(F.col("t"), F.col("l"), points)).first()[0]
    p = np.exp(logits) / np.exp(logits).sum()
    assert got == pytest.approx(np.interp(t, points, np.r_[0, np.cumsum(p)]).tolist())
    with pytest.raises(ValueError):
        partial.control_points(1)


def test_flat_audit_has_every_column(spark):
    rows = audit.flat(spark.createDataFrame([("c", [1, 2], True, 9)], "candidate_id string, donor_starts array<int>, accepted boolean, extra int"))
    assert rows.columns == [*audit.COLUMNS, "extra"] and len(audit.COLUMNS) == 48
    row = rows.first()
    assert (row.candidate_id, row.donor_starts, row.accepted, row.method) == ("c", "1|2", True, None)


def test_point_budget_against_a_plain_loop(spark):
    r = random.Random(7)
    rows = [(f"d{i % 3}/s{i}", f"d{i % 3}", r.randrange(5, 60), 0, r.randrange(2)) for i in range(40)] + [("d9/long", "d9", 1000, 0, 0)]
    df = spark.createDataFrame(rows, "series_id string, dataset string, n int, n_pos int, has_event int")
    order = {x.series_id: x.h for x in df.select("series_id", splits.hash_order(3, "series_id").alias("h")).collect()}
    want = set()
    for d in {x[1] for x in rows}:
        used, own = 0, sorted((1 - x[4], order[x[0]], x[0], x[2]) for x in rows if x[1] == d)
        kept = []
        for _, _, name, n in own:
            if used + n <= 100:
                used += n
                kept.append(name)
        want |= set(kept or [own[0][2]])
    assert {x.series_id for x in splits.within_point_budget(df, 100, 3).collect()} == want


def test_report_pages(spark):
    rows = [(0.1, "real_only", 0.2, 0), (0.1, "mean", 0.3, 4), (0.5, "real_only", 0.5, 0), (0.5, "mean", 0.4, 0)]
    page = report.sweep_page(spark.createDataFrame(rows, "labeled_fraction double, method string, event_f1 double, num_synthetic_windows int"))
    assert "At 0.1 of the labels mean is best, +0.1000 against real_only." in page and "At 0.5 of the labels real_only is best." in page and "Without any synthetic window: mean." in page
    assert report.markdown(spark.createDataFrame([("a|b", None, 0.5)], "x string, y int, z double")) == "| x | y | z |\n| --- | --- | --- |\n| a\\|b | - | 0.5000 |\n"
    p = spark.createDataFrame([("s", t, float(t)) for t in range(10)], "series_id string, t long, v double")
    w = spark.createDataFrame([("s", 0, 4, 6)], "series_id string, event_id long, s long, e long")
    got = report.snippet(p, w, 2).orderBy("t").collect()
    assert [x.t for x in got] == [2, 3, 4, 5, 6, 7] and [x.inside for x in got] == [False, False, True, True, False, False] and sum(x.z for x in got) == pytest.approx(0)


def test_meetings_against_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(donors, "CHUNK", 3)
    r = random.Random(8)
    events = [(f"s{i}", j, [r.choice([0.0, 1.0, r.random()]) for _ in range(4)], r.randrange(3)) for i in range(5) for j in range(7 if i else 11)] + [("s1", 7, [None, 1.0, 1.0, 1.0], 0)]
    sources = [("s0", "s1"), ("s0", "s2"), ("s1", "s0"), ("s4", "s3"), ("s9", "s0"), ("s2", "s9")]
    t = spark.createDataFrame([e[:3] for e in events], "series_id string, event_id long, x array<double>")
    d = spark.createDataFrame(events, "source string, donor_id long, y array<double>, event_group long")
    s = spark.createDataFrame(sources, "target string, source string")
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    cos = lambda x, y: None if None in x or None in y else round(sum(a * b for a, b in zip(x, y)) / max(norm(x) * norm(y), 1e-8), 9)
    for most, by_group in ((1, False), (2, True)):
        want = []
        for a, i, x, _ in events:
            for b in (q for p, q in sources if p == a):
                for g in range(3) if by_group else (None,):
                    own = [(cos(x, y), j, k) for c, j, y, k in events if c == b and g in (None, k)]
                    want += [(a, i, b, j, k, c) for c, j, k in sorted(own, key=lambda m: (m[0] is None, -(m[0] or 0), m[1]))[:most]]
        assert sorted(map(str, map(tuple, donors.meetings(t, d, s, most, by_group).collect()))) == sorted(map(str, want))
    near = {(x.series_id, x.event_id): (x.event_group, x.near) for x in donors.nearest_group(t.where("x[0] is not null"), d.where("y[0] is not null"), s).collect()}
    for a, i, x, _ in events:
        own = [(y, k) for b, _, y, k in events if (a, b) in sources and None not in y]
        centres = {g: [sum(v) / len(v) for v in zip(*[y for y, k in own if k == g])] for g in {k for _, k in own}}
        if None not in x and centres:
            score, group = min((-cos(x, c), g) for g, c in centres.items())
            assert near[a, i][0] == group and abs(near[a, i][1] + score) < 1e-8
    assert {a for a, _ in near} == {"s0", "s1", "s4"}


def test_group_rows_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(compat, "MEMBERS", 2)
    monkeypatch.setattr(compat, "BLOCK", 10)
    r = random.Random(9)
    e = spark.createDataFrame([(f"s{i}", r.randrange(1 + i % 6) - 2) for i in range(40) for _ in range(1 + i % 9)], "series_id string, event_group int")
    series = spark.createDataFrame([(f"s{i}",) for i in range(44)] + [(None,)], "series_id string")
    shares = donors.group_shares(e)
    pairs = series.selectExpr("series_id as target").join(series.selectExpr("series_id as source")).where("target <> source")
    want = donors.group_overlap(pairs, shares).select("target", "source", F.round("group", 6))
    got = donors.group_rows(series, shares).select("target", "source", "overlap")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 44 * 43
    assert {x.overlap for x in donors.group_rows(series, shares.limit(0)).collect()} == {0.5}


def test_all_donor_pairs_are_those_of_judged_pairs(spark):
    r = random.Random(6)
    rows = [(f"s{i}", ["d0", "d1", None][i % 3], *[r.random() if i < 6 else float(i % 2) for _ in compat.FEATURES]) for i in range(14)]
    profiles = spark.createDataFrame(rows, "series_id string, dataset string, " + ", ".join(f"{c} double" for c in compat.FEATURES))
    windows = spark.createDataFrame([(f"s{i}", k, 5 * k, 5 * k + 2) for i in range(12) for k in range(i % 3)], "series_id string, event_id long, s long, e long")
    cfg = donors.resolved({"donor_policy": "compatibility_strict"})
    got = audit.all_donor_pairs(windows, profiles, "m", cfg.min_score, cfg.weights, cfg.same_dataset_bonus)
    want = audit.donor_pairs(windows, donors.judged(compat.pairs(profiles), cfg), "m", "compatibility_strict")
    kinds = dict(got.dtypes)
    want = want.select(*[F.round(c, 6) if kinds[c] == "double" else F.col(c) for c in got.columns])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect()))) and got.count() == 12 * 13
    assert {x.rejection_reason for x in got.collect()} == {"", "below_compatibility_threshold"}
