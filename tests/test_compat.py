import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from seriesmill.operators import compat


def test_cosine_pairs_has_every_label(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, i % 5 if i % 7 else 9, [r.gauss(0, 1) for _ in range(8)]) for i in range(40)] + [(40, None, [1.0] * 8)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(x.a, x.b): x.cosine for x in entry.queries()["cosine_pairs"](spark, str(tmp_path)).collect()}
    want = {(i, j): sum(p * q for p, q in zip(x, y)) / math.hypot(*x) / math.hypot(*y) for (i, k, x), (j, m, y) in itertools.combinations(rows, 2) if k is not None and k == m}
    assert got.keys() == want.keys() and all(abs(got[p] - c) < 1e-5 for p, c in want.items())


def test_nearest_within_against_a_plain_loop(spark):
    r = random.Random(6)
    rows = [(i, "hot" if i % 3 else f"g{i % 4}", [r.gauss(0, 1) for _ in range(5)]) for i in range(90)] + [(90, None, [1.0] * 5), (91, "hot", None), (92, "alone", [1.0] * 5), (93, "hot", [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, label string, x array<double>")
    got = {}
    for x in compat.nearest_within(df, "id", "label", 4, block=16).orderBy("target", "rank").collect():
        got.setdefault(x.target, []).append((x.source, round(x.cosine, 9)))
    norm = lambda v: max(math.hypot(*v), 1e-8)
    for i, g, v in rows:
        own = [(-round(sum(p * q for p, q in zip(v, w)) / norm(v) / norm(w), 9), j) for j, h, w in rows if g is not None and h == g and j != i and v and w] if v else []
        assert [j for j, _ in got.get(i, [])] == [j for _, j in sorted(own)[:4]]


def test_pairs_of_blocks_miss_none(spark, monkeypatch):
    monkeypatch.setattr(compat, "BLOCK", 3)
    names = "length mean std median iqr min max robust_amplitude trend_strength autocorr_lag1 anomaly_ratio n_events median_duration mean_duration pre_mean pre_std post_mean post_std spectral".split()
    r = random.Random(2)
    rows = [(f"s{i}", f"d{i % 2}", *[r.random() for _ in names]) for i in range(10)]
    df = spark.createDataFrame(rows, "series_id string, dataset string, " + ", ".join(f"{n} double" for n in names))
    got = compat.pairs(df)
    assert sorted((x.target, x.source) for x in got.collect()) == sorted((f"s{i}", f"s{j}") for i, j in itertools.permutations(range(10), 2))
    assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.target, x.source) for x in compat.pairs(df.limit(4), df.where("dataset = 'd1'")).select("target", "source").distinct().collect()) == sorted({(x[0], y[0]) for x in rows[:4] for y in rows if y[1] == "d1" and x[0] != y[0]})


def odd_profiles(spark, n=70):
    """Series of two datasets and of none: random ones, copies, numbers missing, without events."""
    r = random.Random(5)
    rows = []
    for i in range(n):
        x = [r.choice([0.0, r.random(), -r.random(), 9 * r.random()]) for _ in compat.FEATURES]
        x[-1] = float(i % 3)
        if i % 5 == 0 and i:
            x = list(rows[i - 1 if i % 2 else 0][2:])
        if i % 23 == 7:
            x[r.randrange(len(x) - 1)] = None
        rows.append((f"s{r.random()}", [None, "d0", "d1", "d1"][i % 4] if i % 10 else rows[0][1] if rows else "d0", *x))
    return spark.createDataFrame(rows, "series_id string, dataset string, " + ", ".join(f"{c} double" for c in compat.FEATURES))


def test_best_pairs_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(compat, "_blocks", lambda n, most=0: -(-n // 20))
    df = odd_profiles(spark)
    scored = compat.scored(compat.pairs(df)).localCheckpoint()
    named = lambda rows: sorted((x.target, x.source, x.rank, round(x.score, 9)) for x in rows.collect())
    for k, least, among in ((3, 0.5, "all"), (5, None, "all"), (2, None, "same"), (4, None, "other"), (3, 0.99, "all")):
        rows = scored if among == "all" else scored.where(("" if among == "same" else "not ") + "same_dataset")
        want = compat.ranked(rows if least is None else rows.where(f"score >= {least}")).where(f"rank <= {k}")
        assert named(compat.best_pairs(df, k, least, among)) == named(want)


def test_pair_totals_are_those_of_all_pairs(spark, monkeypatch):
    df = odd_profiles(spark)
    kept = compat.F.col("score") >= 0.6
    rows = compat.scored(compat.pairs(df)).groupBy("target", "s_dataset").agg(compat.F.count("*").alias("n"), compat.F.count_if(kept).alias("n_kept"), compat.F.sum("score").alias("score"), compat.F.sum(compat.F.when(kept, compat.F.col("score")).otherwise(0)).alias("score_kept"))
    named = lambda rows: sorted((x.target, str(x.s_dataset), x.n, x.n_kept, round(x.score, 6), round(x.score_kept, 6)) for x in rows.collect())
    want = named(rows)
    for size in (20, 1000):
        monkeypatch.setattr(compat, "_blocks", lambda n, most=0, size=size: -(-n // size))
        assert named(compat.pair_totals(df, 0.6)) == want


@pytest.mark.parametrize("size", (1, 3, 64))
def test_pair_rows_are_those_of_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(compat, "MEMBERS", size)
    monkeypatch.setattr(compat, "BLOCK", 20)
    monkeypatch.setattr(compat, "NAMES", 40)
    F, parts = compat.F, ("shape", "amplitude", "duration", "context", "frequency", "trend", "group")
    df = odd_profiles(spark)
    df = df.unionByName(df.limit(2).withColumn("series_id", F.concat(F.lit("nan"), "series_id")).withColumn("mean", F.lit(float("nan"))).withColumn("n_events", F.lit(0.0)).withColumn("median_duration", F.lit(None).cast("double")))
    df = df.unionByName(df.limit(1).withColumn("series_id", F.lit(None).cast("string"))).localCheckpoint()
    columns = ("target", "source", *parts, "score", "kept", "same_dataset")
    rounded = lambda rows: sorted(str(tuple(x)) for x in rows.select(*[F.round(c, 6).alias(c) if c in (*parts, "score") else F.col(c) for c in columns]).collect())
    for sources in (None, df.where("dataset = 'd1'")):
        got = compat.pair_rows(df.withColumn("name", F.col("series_id")), columns[2:], None if sources is None else sources.withColumn("name", F.col("series_id")))
        got = sorted(str(tuple(x)) for x in got.where("target <> source").select(*columns).collect())
        assert len(got) > 1000 and got == rounded(compat.scored(compat.pairs(df, sources)))


def test_copies_are_worked_out_once(spark):
    F = compat.F
    rows = compat.members(spark.range(300).select(F.col("id").cast("string").alias("name"), (F.col("id") % 6).alias("x")), "x")
    worked = spark.sparkContext.accumulator(0)

    def tile(t, s):
        def values(part):
            a, b = t.field("x").to_numpy()[part, None], s.field("x").to_numpy()
            worked.add(a.size * b.size)
            return {"apart": (abs(a - b).astype(float), np.broadcast_to(a == 5, (len(a), len(b))))}

        return values

    got = {(x.target, x.source): x.apart for x in compat.expanded(rows, rows, tile, "apart double").collect()}
    assert got == {(str(i), str(j)): None if i % 6 == 5 else float(abs(i % 6 - j % 6)) for i in range(300) for j in range(300)}
    assert worked.value == 36


def test_half_up_is_round(spark):
    x = [k / 128 for k in range(-128, 129)] + [k / 2e6 for k in range(0, 2000, 7)] + [0.4999995, 1.0049999999999999e-6, 4.9999999999999998e-7, 2.5e-6, float("nan"), -0.0, 1.0]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(compat.F.round("x", 6)).collect()]
    assert np.array_equal(compat.half_up(np.array(x), 6), want, equal_nan=True)


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """A folder with events of which each user has three copies, and DuckDB on it."""
    folder, con = tmp_path_factory.mktemp("copied"), duckdb.connect()
    con.execute(f"copy (select e.* replace (user_id + 3000 * k as user_id, event_id + 100000 * k as event_id) from '/root/testdata/sf0.001/events.parquet' e, range(3) r(k)) to '{folder}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ("pair_score", "pair_components", "group_component", "audit_donor_pairs"))
def test_rows_of_pairs_are_made_last(spark, copied, name):
    """All pairs of series with copies equal the SQL, and no join or exchange handles a row a pair."""
    folder, con = copied
    got = entry.queries()[name](spark, folder)
    last = got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert last.count("Generate explode") == 2 and not re.findall(r"Join|Exchange|round\(", last)
    rows, want = got.toPandas(), con.execute(entry.oracle_sql()[name]).df()
    plain = lambda df: sorted(map(str, df[sorted(got.columns)].round(6).itertuples(index=False, name=None)))
    assert len(rows) > 1000 and plain(rows) == plain(want)
