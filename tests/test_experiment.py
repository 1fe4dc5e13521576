import pytest

from seriesmill.operators import events
from seriesmill.plans import experiment
from seriesmill.session import checkpointed
from seriesmill.sources.synthetic import benchmark


def test_benchmark_shape(spark):
    p = benchmark(spark, 6, 4)
    assert p.count() == 6 * 120 and p.select("dataset").distinct().count() == 3
    e = events.labelled(p)
    assert e.groupBy("series_id").count().where("count = 4").count() == 6
    assert e.selectExpr("min(e - s) as a", "max(e - s) as b").first().asDict() == {"a": 5, "b": 8}
    assert sorted(map(tuple, p.collect())) == sorted(map(tuple, benchmark(spark, 6, 4).repartition(3).collect()))


@pytest.fixture(scope="module")
def small(spark):
    return checkpointed(benchmark(spark, 12, 4))


def test_grid(spark, small):
    got = experiment.run(small, [1], ["zscore"], ["real_only", "random_event_oversampling", "adaptive_groupwise_transfer"]).collect()
    assert [(r.augmentation_policy, r.selected_policy_name, r.selection_reason) for r in got] == [
        ("real_only", "real_only", "fixed_policy"), ("random_event_oversampling", "random_event_oversampling", "fixed_policy"),
        ("adaptive_groupwise_transfer", "groupwise_cross_dataset_compatible", "detector_family:default"),
    ]
    assert all(0 <= r.event_f1 <= 1 and r.auroc > 0.7 and r.metrics_valid for r in got)
    assert got[0].num_synthetic_windows == 0 and got[1].num_synthetic_windows > 0 and got[2].num_synthetic_windows > 0
    assert got[2].donor_policy == "cross_dataset_compatible" and got[2].compatibility_enabled


def test_adaptive_policy_falls_back(small):
    train = experiment.prepared(small, 1).train
    got = experiment.augmented(train, "adaptive_groupwise_transfer", "lof", least=10**6)
    assert (got.policy, got.selected, got.fallback) == ("adaptive_groupwise_transfer", "groupwise_cross_dataset_all", True)
    with pytest.raises(ValueError):
        experiment.augmented(train, "odd")


def test_low_label_and_ablation(small):
    names = ["real_only", "normalized_time_context_calibrated", "normalized_time_strict_filter", "compatibility_top50"]
    got = {r.method: r for r in experiment.run_ablation(small, "zscore", 2, 0.5, names).collect()}
    assert set(got) == set(names) and got["real_only"].delta_event_f1 == 0
    assert got["normalized_time_strict_filter"].num_rejected_synthetic_windows > 0


def test_transfer_keeps_its_invariants(small):
    got = experiment.run_transfer(small, ["real_only", "cross_dataset_compatible"], "zscore")
    assert got["violations"].count() == 0 and got["metrics"].count() == 2
    row = got["summary"].first()
    assert row.same_dataset_pairs_considered == 0 and row.cross_dataset_pairs_considered > 0
    assert got["completion"].first().n > 0 and got["audit"].columns[:2] == ["candidate_id", "method"]


def test_completion_grid(spark, small):
    got = experiment.run_completion(small, 3, masks=("middle", "random"), methods=("linear_interpolation", "random_donor", "learned_prototype_event_time"))
    rows = got.groupBy("mask_policy", "method").agg({"*": "count", "mae": "avg"}).collect()
    assert len(rows) == 6 and len({r["count(1)"] for r in rows}) == 1
    assert got.where("stop - start < 1 or mae < 0 or abs(shape_correlation) > 1.000001").count() == 0


def test_suite_and_collector(spark, tmp_path):
    streams = {"a": lambda: spark.createDataFrame([(1, 0.5)], "split_seed int, event_f1 double"), "b": lambda: spark.createDataFrame([(2, "x")], "split_seed int, method string"), "c": lambda: 1 / 0}
    manifest = experiment.run_suite(spark, streams, str(tmp_path)).collect()
    assert [(r.stream, r.success) for r in manifest] == [("a", True), ("b", True), ("c", False)] and "ZeroDivisionError" in manifest[2].error
    with pytest.raises(ZeroDivisionError):
        experiment.run_suite(spark, streams, str(tmp_path / "again"), fail=True)
    got = experiment.collect_results(spark, str(tmp_path)).collect()
    assert {(r.run, r.split_seed, r.event_f1, r.method) for r in got} == {("a", "1", "0.5", None), ("b", "2", None, "x")}


def test_config_merges_one_level(tmp_path):
    (tmp_path / "base.yaml").write_text("a: {x: 1, deep: {p: 1, q: 2}}\nb: 1\n")
    (tmp_path / "own.yaml").write_text("inherits: base.yaml\na: {deep: {p: 9}}\nc: 3\n")
    assert experiment.load_config(tmp_path / "own.yaml", tmp_path) == {"a": {"x": 1, "deep": {"p": 9}}, "b": 1, "c": 3}


def test_routing():
    assert experiment.route("lof")[:2] == ("density", "groupwise_cross_dataset_compatible")
    assert experiment.route("CNN ")[:2] == ("broad", "groupwise_cross_dataset_all")
    assert experiment.route("forest")[0] == "default"
    assert len(experiment.PRESET_OF) == 12
