import random

import pytest
from pyspark.sql import functions as F

from seriesmill.operators import compat, events, splits, synth, windows
from seriesmill.operators import evaluate as me
from seriesmill.operators import report as re


def points(spark, labels, values=None, series="d0/a"):
    values = values or [float(y) for y in labels]
    rows = [(series, series.split("/")[0], i, float(v), y) for i, (y, v) in enumerate(zip(labels, values, strict=True))]
    return spark.createDataFrame(rows, "series_id string, dataset string, t long, v double, y int")


def windows_of(df):
    return [(r.s, r.e) for r in df.orderBy("s").collect()]


def plain_runs(labels, least=1, gap=0):
    """Windows by definition: collect the positive places, join near ones, drop short ones."""
    out = []
    for i, y in enumerate(labels):
        if y and out and i - out[-1][1] <= gap:
            out[-1][1] = i + 1
        elif y:
            out.append([i, i + 1])
    return [tuple(w) for w in out if w[1] - w[0] >= least]


def random_labels(seed, n=40, share=0.45):
    r = random.Random(seed)
    return [int(r.random() < share) for _ in range(n)]


@pytest.mark.parametrize("gap, least", [(0, 1), (1, 1), (2, 3), (0, 4)])
def test_runs(spark, gap, least):
    series = {f"d0/s{k}": random_labels(k, share=0.2 + 0.15 * k) for k in range(5)} | {"d0/none": [0] * 6, "d0/all": [1] * 6}
    rows = [(name, "d0", i, float(y), y) for name, labels in series.items() for i, y in enumerate(labels)]
    p = spark.createDataFrame(rows, "series_id string, dataset string, t long, v double, y int")
    found = {}
    for r in events.labelled(p, least, gap).orderBy("s").collect():
        found.setdefault(r.series_id, []).append((r.s, r.e))
    assert all(found.get(name, []) == plain_runs(labels, least, gap) for name, labels in series.items())


def test_score_runs(spark):
    p = points(spark, [0] * 7, [0, 0.9, 0, 0.9, 0.9, 0.9, 0])
    assert windows_of(events.predicted(p, 0.5, 1, 0)) == [(1, 2), (3, 6)]
    assert windows_of(events.predicted(p, 0.5, 3, 0)) == [(3, 6)]


def test_mask(spark):
    labels = random_labels(11)
    p = points(spark, labels)
    merged = plain_runs(labels, 2, 1)
    want = [int(any(a <= i < b for a, b in merged)) for i in range(len(labels))]
    assert [r.m for r in events.mask(p, events.labelled(p, 2, 1)).orderBy("t").collect()] == want


def test_greedy_match_uses_each_truth_once(spark):
    truth = spark.createDataFrame([("s", "d", 0, 0, 10)], "series_id string, dataset string, event_id long, s long, e long")
    preds = spark.createDataFrame([("s", "d", 0, 0, 4), ("s", "d", 1, 2, 10)], "series_id string, dataset string, event_id long, s long, e long")
    got = events.matches(truth, preds).collect()
    assert [(r.pred, r.truth) for r in got] == [(0, 0)]
    counts = events.prf(events.matched_counts(truth, preds)).first()
    assert (counts.precision, counts.recall, counts.false_positives) == (0.5, 1.0, 1)


def test_no_predictions(spark):
    truth = spark.createDataFrame([("s", "d", 0, 0, 10)], "series_id string, dataset string, event_id long, s long, e long")
    row = events.prf(events.matched_counts(truth, truth.limit(0))).first()
    assert (row.precision, row.recall, row.f) == (0.0, 0.0, 0.0)


def test_split_is_a_partition(spark):
    rows = spark.createDataFrame([(f"d{i % 2}/s{i}", f"d{i % 2}", 50, 3, i % 2) for i in range(23)], "series_id string, dataset string, n long, n_pos long, has_event int")
    got = splits.split(rows, 42).collect()
    assert len({r.series_id for r in got}) == 23
    for d in ("d0", "d1"):
        assert {r.split for r in got if r.dataset == d} == {"train", "val", "test"}


def test_cover_tests_moves_one(spark):
    rows = spark.createDataFrame([("a/1", "a", "train"), ("a/2", "a", "val"), ("b/1", "b", "test")], "series_id string, dataset string, split string")
    got = {r.series_id: r.split for r in splits.cover_tests(rows).collect()}
    assert got == {"a/1": "test", "a/2": "val", "b/1": "test"}


def test_masked_labels_keep_a_lone_event(spark):
    p = points(spark, [0, 1, 1, 0])
    got = splits.masked_labels(p, events.labelled(p), 0.1, 1)
    assert got.agg(F.sum("y")).first()[0] == 2


def test_resample(spark):
    df = spark.createDataFrame([([1.0, 4.0, 2.0, 8.0],)], "x array<double>")
    assert df.select(compat.resampled(F.col("x"), 7)).first()[0] == pytest.approx([1, 2.5, 4, 3, 2, 5, 8])
    one = spark.createDataFrame([([3.0],)], "x array<double>")
    assert one.select(compat.resampled(F.col("x"), 3)).first()[0] == [3.0, 3.0, 3.0]


def test_similarity_bounds(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, -1.0), (0.0, 0.0)], "a double, b double")
    assert [round(r[0], 4) for r in df.select(compat.sim(F.col("a"), F.col("b"))).collect()] == [1.0, 0.3333, 1.0]


def test_linear_fill(spark):
    df = spark.createDataFrame([([0.0, 9.0, 9.0, 9.0, 4.0], 1, 4), ([9.0, 9.0, 2.0], 0, 2)], "values array<double>, start long, stop long")
    got = [r[0] for r in df.select(me.linear_fill(F.col("values"), F.col("start"), F.col("stop"))).collect()]
    assert got == [[0.0, 1.0, 2.0, 3.0, 4.0], [2.0, 2.0, 2.0]]


def test_auroc_and_ap(spark):
    p = points(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    assert me.auroc(p, ("dataset",)).first().auroc == pytest.approx(0.75)
    assert me.average_precision(p, ("dataset",)).first().auprc == pytest.approx(0.8333333)
    assert me.auroc(points(spark, [1, 1], [0.1, 0.2]), ("dataset",)).first().auroc is None


def test_separation(spark):
    normal = spark.createDataFrame([(x,) for x in (0.05, 0.1, 0.12, 0.18)], "v double")
    synthetic = spark.createDataFrame([(x,) for x in (0.7, 0.75, 0.9)], "v double")
    row = me.separation(normal, synthetic).first()
    assert 0.18 <= row.threshold < 0.9
    assert row.f1 == 1.0


def test_windows_pad_and_tail(spark):
    got = windows.windows(points(spark, [0] * 3, [1, 2, 3]), 5, 2).first()
    assert (got.s, got.e, list(got["values"])) == (0, 3, [1, 2, 3, 3, 3])
    w = windows.windows(points(spark, [0] * 8), 3, 2).orderBy("s").collect()
    assert [(r.s, r.e) for r in w] == [(0, 3), (2, 5), (4, 7), (5, 8)]


def test_max_projection_starts_at_zero(spark):
    p = points(spark, [0] * 4)
    s = spark.createDataFrame([("d0/a", 0, 2, -1.0), ("d0/a", 1, 3, 2.0)], "series_id string, s long, e long, score double")
    assert [r.score for r in windows.to_points(p, s).orderBy("t").collect()] == [0.0, 2.0, 2.0, 0.0]


def test_dtw():
    import numpy as np

    path, cost = synth.dtw_path(np.array([1.0, 2.0, 3.0]), np.array([1.0, 2.0, 2.0, 3.0]))
    assert path[0] == (0, 0) and path[-1] == (2, 3) and cost == 0
    assert all(b[0] >= a[0] and b[1] >= a[1] for a, b in zip(path, path[1:], strict=False))
    assert list(synth.warp(np.array([1.0, 3.0]), np.array([1.0, 1.0, 3.0]))) == [1.0, 1.0, 3.0]


def test_p_values():
    assert re.wilcoxon_p_value([0.1, 0.1, 0.1]) == 1.0
    assert re.wilcoxon_p_value([1, 2, 3, 4, 5]) == pytest.approx(0.0625)
    assert re.t_p_value(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)


def test_valid_rows(spark):
    rows = spark.createDataFrame([(True,), (None,), (False,)], "metrics_valid boolean")
    assert re.valid(rows).count() == 1


def test_trade_off(spark):
    curve = spark.createDataFrame([("c", 0.1, 0.4, 20, 2), ("c", 0.8, 0.3, 0, 2)], "k string, threshold double, f double, fp long, n_truth long")
    row = re.trade_off(curve, ("k",)).first()
    assert (row.best_threshold, row.limited_threshold) == (0.1, 0.8)
