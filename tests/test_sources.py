import pytest
from pyspark.sql import functions as F

from seriesmill.functions.labels import normalized
from seriesmill.sources import csv_tree, sinks
from seriesmill.streaming.points import window_stats


def test_headerless_tree(spark, tmp_path):
    (tmp_path / "root/ECG").mkdir(parents=True)
    (tmp_path / "root/ECG/series_a.out").write_text("1.0,0\n2.0,0\n3.0,1\n4.0,0\n")
    (tmp_path / "root/ECG/series_b.out").write_text("5 1\n6 0\n7 0\n")
    got = csv_tree.read_headerless(spark, str(tmp_path / "root")).orderBy("series_id", "t").collect()
    assert [(r.series_id, r.t, r.v, r.y) for r in got] == [
        ("ECG/series_a", 0, 1.0, 0), ("ECG/series_a", 1, 2.0, 0), ("ECG/series_a", 2, 3.0, 1), ("ECG/series_a", 3, 4.0, 0),
        ("ECG/series_b", 0, 5.0, 1), ("ECG/series_b", 1, 6.0, 0), ("ECG/series_b", 2, 7.0, 0),
    ]
    assert {r.dataset for r in got} == {"ECG"}


def test_named_columns(spark, tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root/one.csv").write_text("timestamp,signal,is_anomaly\n2,3.0,anomaly\n0,1.0,normal\n1,2.0,normal\n3,4.0,anomaly\n")
    got = csv_tree.read_named(spark, str(tmp_path / "root")).orderBy("t").collect()
    assert [(r.series_id, r.v, r.y) for r in got] == [("one", 1.0, 0), ("one", 2.0, 0), ("one", 3.0, 1), ("one", 4.0, 1)]


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_tree_of_mixed_files(spark, tmp_path):
    path = write(tmp_path / "root", {
        "ECG/a.out": "1,0\n2,1\n3,0\n", "ECG/b.csv": "0,5.5,1.5\n1,6.5,2.5\n", "IO/c.tsv": "time\tcpu\tmem\tis_anomaly\n2\t1\t10\tanomaly\n1\t3\t30\tnormal\n",
        "IO/d.txt": "series_id,reading,extra,gt\nm1,1.5,7,0\nm2,2.5,8,1\nm1,3.5,9,1\n", "IO/.hidden.csv": "1,0\n", "results/x.csv": "1,0\n", "IO/e.json": "{}", "IO/one.csv": "1\n2\n", "IO/words.csv": "a,label\nq,0\nr,1\n",
    })
    got = csv_tree.load(spark, path)
    rows = sorted((r.series_id, r.t, r.v, r["values"], r.y, r.dataset) for r in got.points.collect())
    assert rows == [
        ("ECG/a", 0, 1.0, [1.0], 0, "ECG"), ("ECG/a", 1, 2.0, [2.0], 1, "ECG"), ("ECG/a", 2, 3.0, [3.0], 0, "ECG"), ("ECG/b", 0, 5.5, [5.5, 1.5], 0, "ECG"), ("ECG/b", 1, 6.5, [6.5, 2.5], 1, "ECG"),
        ("IO/c", 0, 3.0, [3.0, 30.0], 0, "IO"), ("IO/c", 1, 1.0, [1.0, 10.0], 1, "IO"), ("m1", 0, 1.5, [1.5], 0, "IO"), ("m1", 1, 3.5, [3.5], 1, "IO"), ("m2", 0, 2.5, [2.5], 1, "IO"),
    ]
    assert sorted((r.file.split("/")[-1], r.error) for r in got.errors.collect()) == [("one.csv", "fewer than two columns"), ("words.csv", "no numeric value column")]
    assert {(r.series_id, tuple(r["values"]), tuple(r.labels)) for r in csv_tree.timelines(got.points.where("dataset = 'ECG'")).collect()} == {("ECG/a", (1.0, 2.0, 3.0), (0, 1, 0)), ("ECG/b", (5.5, 6.5), (0, 1))}


def test_tree_filters_in_order(spark, tmp_path):
    labels = {"g/a": "0110", "g/b": "0000", "g/c": "0100", "h/d": "01", "h/e": "1111", "h/f": "010010"}
    path = write(tmp_path / "root", {f"{name}.out": "".join(f"{i},{y}\n" for i, y in enumerate(text)) for name, text in labels.items()})
    got = csv_tree.load(spark, path, csv_tree.LoadOptions(exclude=("*/f",), min_length=3, min_event_windows=1, max_event_ratio=0.5))
    assert {r.series_id: r.drop_reason for r in got.series.collect()} == {"g/a": None, "g/b": "few_events", "g/c": None, "h/d": "too_short", "h/e": "event_ratio", "h/f": "pattern"}
    assert got.summary().first().asDict() == {"num_series_loaded": 6, "num_series_kept": 2, "dropped_pattern": 1, "dropped_too_short": 1, "dropped_few_events": 1, "dropped_event_ratio": 1, "dropped_over_cap": 0, "num_files_failed": 0}
    capped = csv_tree.load(spark, path, csv_tree.LoadOptions(max_series=2))
    assert {r.dataset for r in capped.series.where("drop_reason is null").collect()} == {"g", "h"}
    with pytest.raises(ValueError, match="filtered out"):
        csv_tree.load(spark, path, csv_tree.LoadOptions(include=("none",)))


def test_option_precedence():
    config = {"data": {"load_options": {"min_length": 5, "max_series": 9, "seed": 1}}, "dataset": {"max_series": 7, "include": ["a*"]}}
    got = csv_tree.options_from(config, {"max_series": 3, "seed": None})
    assert (got.min_length, got.max_series, got.seed, got.include, got.merge_gap) == (5, 3, 1, ("a*",), 0)


def test_label_encodings(spark):
    df = spark.createDataFrame([("normal",), ("anomaly",), (" Normal",), ("ANOMALY",), ("2.5",), ("0",), ("what",), (None,)], "x string")
    assert [r[0] for r in df.select(normalized(F.col("x"))).collect()] == [0, 1, 0, 1, 1, 0, 0, 0]
    assert [r[0] for r in spark.createDataFrame([(True,), (False,)], "x boolean").select(normalized(F.col("x"))).collect()] == [1, 0]


@pytest.mark.parametrize("pattern, name, hit", [("ECG/*", "ECG/a/b", True), ("*b", "ECG/a/b", True), ("ecg/*", "ECG/a", False), ("a?c", "abc", True)])
def test_globs(spark, pattern, name, hit):
    row = spark.createDataFrame([(name,)], "s string").select(csv_tree.matches(F.col("s"), csv_tree.LoadOptions(include=(pattern,))))
    assert row.first()[0] is hit


def test_bundle(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "k int, donors array<string>")
    sinks.save_bundle(spark, str(tmp_path / "run"), {"audit": df}, sinks.run_metadata("smoke", 1))
    row = spark.read.option("header", True).csv(str(tmp_path / "run/audit")).first()
    assert (row.k, row.donors) == ("1", "a|b")
    assert '"experiment": "smoke"' in spark.read.text(str(tmp_path / "run/metadata")).first()[0]


def test_stream_stats(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:{m:02d}:00", float(m), m % 2) for m in range(0, 60, 10)]
    spark.createDataFrame(rows, "series_id string, ts string, v double, y int").select("series_id", F.to_timestamp("ts").alias("ts"), "v", "y").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, ts timestamp, v double, y int").parquet(str(tmp_path / "in"))
    query = window_stats(stream).writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("stats").collect()
    assert [(r.series_id, r.n, r.mean, r.max) for r in got] == [("a", 6, 25.0, 50.0)]
