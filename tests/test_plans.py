"""Skew-safe plans against plain windows and brute force on small frames."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skywharf.operators import cleaning, features, labels, metrics
from skywharf.plans.asof import around, interval_match, nearest_join, segments
from skywharf.plans.ranks import exact_quantiles
from skywharf.plans.timeline import BLOCK_CELLS, cell_of, fitting_cell, neighbours, number_rows, over_chunks

START = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def series(spark):
    """One hot key with two thirds of the rows, irregular times, nulls."""
    rng = random.Random(7)
    rows, seq = [], 0
    for key, count in (("hot", 120), ("mild", 45), ("one", 1)):
        at = START
        for _ in range(count):
            at += dt.timedelta(minutes=rng.choice([1, 7, 10, 45, 200, 1500]))
            rows.append((key, at, seq, None if rng.random() < 0.3 else round(rng.uniform(0, 20), 1)))
            seq += 1
    return spark.createDataFrame(rows, "station_id string, obs_time timestamp, seq long, v double").cache()


def same(left, right, keys=("station_id", "obs_time")):
    a, b = left.toPandas().sort_values(list(keys)).reset_index(drop=True), right.toPandas().sort_values(list(keys)).reset_index(drop=True)
    assert list(a.columns) == list(b.columns)
    for column in a.columns:
        if a[column].dtype == float:
            np.testing.assert_allclose(a[column].to_numpy(), b[column].to_numpy(), rtol=1e-9, atol=1e-9, equal_nan=True)
        else:
            assert a[column].tolist() == b[column].tolist(), column


def test_number_rows_is_global_position(series):
    plain = series.withColumn("_rn", F.row_number().over(Window.partitionBy("station_id").orderBy("obs_time", "seq")).cast("long"))
    same(number_rows(series, ["station_id"], "obs_time", ["seq"], cell_seconds=600).select(*plain.columns), plain)


@pytest.mark.parametrize("chunk", [1, 4, 7, 1000])
def test_chunked_frames_equal_plain_windows(series, chunk):
    def stage(w):
        return {
            "lag3": F.lag("v", 3).over(w), "mean5": F.avg("v").over(w.rowsBetween(-4, 0)), "lead2": F.lead("v", 2).over(w),
            "around": F.sum("v").over(w.rowsBetween(-2, 2)),
        }

    chunked = over_chunks(series, ["station_id"], "obs_time", [stage], reach_back=4, reach_ahead=2, tie=["seq"], chunk_rows=chunk, cell_seconds=3600)
    plain = series.withColumns(stage(Window.partitionBy("station_id").orderBy("obs_time", "seq")))
    same(chunked.select(*plain.columns), plain)


@pytest.mark.parametrize("cell, block", [(1, 4096), (600, 7), (60, 1), (None, 4096)])
def test_neighbours_reach_across_empty_cells(series, cell, block):
    mark = F.when(F.col("v") > 12, F.col("v"))
    got = neighbours(series, ["station_id"], "obs_time", {"m": mark}, tie=["seq"], cell_seconds=cell, block_cells=block)
    w = Window.partitionBy("station_id").orderBy("obs_time", "seq")
    plain = series.withColumns(
        {"m_prev": F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "m_next": F.first(mark, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}
    )
    same(got, plain)


def test_nearest_join_matches_brute_force(spark):
    rng = random.Random(3)
    source = sorted({START + dt.timedelta(minutes=rng.randrange(0, 3000, 15)) for _ in range(60)})
    targets = [START + dt.timedelta(minutes=rng.randrange(0, 3200, 5)) for _ in range(80)]
    left = spark.createDataFrame([("a", i, t) for i, t in enumerate(targets)], "k string, id int, at timestamp")
    right = spark.createDataFrame([("a", t, float(i)) for i, t in enumerate(source)], "k string, obs_time timestamp, v double")
    got = {r.id: (r._match.obs_time if r._match else None) for r in nearest_join(left, right, ["k"], "at", "obs_time", ["v"], 1800).collect()}
    for i, t in enumerate(targets):
        best = min(source, key=lambda s: (abs((s - t).total_seconds()), -s.timestamp()))
        expected = best if abs((best - t).total_seconds()) <= 1800 else None
        assert got[i] == expected


def test_interval_match_takes_first_period(spark):
    points = spark.createDataFrame([("a", 1, START + dt.timedelta(hours=1)), ("a", 2, START + dt.timedelta(hours=50)), ("a", 3, START + dt.timedelta(hours=3))], "k string, id int, at timestamp")
    periods = spark.createDataFrame(
        [("a", 2, START, START + dt.timedelta(hours=3), "late"), ("a", 1, START, START + dt.timedelta(hours=3), "early"), ("a", 3, START + dt.timedelta(hours=3), START + dt.timedelta(hours=40), "next"),
         ("a", 0, START, START, "empty")], "k string, seq int, s timestamp, e timestamp, v string")
    got = {r.id: (r._period.v if r._period else None) for r in interval_match(points, periods, ["k"], "at", "s", "e", ["seq"], ["v"]).collect()}
    assert got == {1: "early", 2: None, 3: "next"}


def test_segments_of_many_overlapping_periods(spark):
    """Thousands of releases of one key and periods over several cells, against every period tested for every point; two winners in one pass."""
    rng = random.Random(9)
    listed = []
    for k in range(3000):
        start = START + dt.timedelta(minutes=rng.randrange(0, 4000))
        listed.append(("hot", rng.randrange(10**9), start, start + dt.timedelta(minutes=rng.choice([0, 1, 30, 180, 720, 3000])), k, None if rng.random() < 0.5 else float(k)))
    listed += [("mild", k, START + dt.timedelta(days=k), START + dt.timedelta(days=k + 1), k, None) for k in range(3)]
    at = [START + dt.timedelta(minutes=rng.randrange(-100, 8000)) for _ in range(200)] + [listed[k][2] for k in range(50)] + [listed[k][3] for k in range(50)]
    points = [(key, i, t) for i, t in enumerate(at) for key in ("hot", "mild", "none")] + [("hot", -1, None)]
    periods = spark.createDataFrame(listed, "k string, seq long, s timestamp, e timestamp, v long, w double")
    cut = segments(periods, ["k"], "s", "e", ["seq"], {"any": (F.lit(True), F.struct("v")), "some": (F.col("w").isNotNull(), F.struct("w"))})
    rows = {"cut": cut.select("k", "_at", F.struct("any", "some").alias("_value"))}
    got = {(r.k, r.id): (r.cut_prev.any and r.cut_prev.any.v, r.cut_prev.some and r.cut_prev.some.w) if r.cut_prev else (None, None)
           for r in around(spark.createDataFrame(points, "k string, id int, at timestamp"), rows, ["k"], "at").collect()}
    assert len(got) == len(points) and cut.count() <= 2 * len(listed) + 20
    for key, i, t in points:
        inside = sorted((p for p in listed if t and p[0] == key and p[2] <= t < p[3]), key=lambda p: p[1])
        assert got[key, i] == (inside[0][4] if inside else None, next((p[5] for p in inside if p[5] is not None), None)), (key, i, t)


def test_a_crowded_hour_has_bounded_windows(spark):
    """Nine tenths of a key's rows in one hour: a window of any of the three steps holds few rows, and results stay those of plain windows."""
    rng = random.Random(12)
    rows = [("hot", START + dt.timedelta(milliseconds=rng.randrange(3_600_000)), k) for k in range(9000)] + [("hot", START + dt.timedelta(hours=1 + k), 9000 + k) for k in range(1000)]
    frame = spark.createDataFrame([(*r, float(r[2]) if r[2] % 97 == 0 else None) for r in rows], "station_id string, obs_time timestamp, seq long, v double")
    got = neighbours(frame, ["station_id"], "obs_time", {"m": F.col("v")}, tie=["seq"], cell_seconds=1)
    same(got, neighbours(frame, ["station_id"], "obs_time", {"m": F.col("v")}, tie=["seq"]), ("station_id", "obs_time", "seq"))
    assert fitting_cell(frame, ["station_id"], "obs_time", 86400, most_rows=20) <= 8 and fitting_cell(frame, ["station_id"], "obs_time", 86400) == 86400
    w = Window.partitionBy("station_id").orderBy("obs_time", "seq")
    plain = frame.withColumns({
        "m_prev": F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "m_next": F.first("v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    })
    same(got, plain, ("station_id", "obs_time", "seq"))
    cell, block = cell_of("obs_time", 1), F.floor(cell_of("obs_time", 1) / BLOCK_CELLS)
    per_cell = frame.groupBy(cell).count().agg(F.max("count")).first()[0]
    per_block = frame.select(cell.alias("c"), block.alias("b")).distinct().groupBy("b").count().agg(F.max("count")).first()[0]
    assert per_cell < 20 and per_block <= BLOCK_CELLS and frame.select(block).distinct().count() < 1100
    targets = frame.filter("seq % 7 = 0").select("station_id", "seq", F.col("obs_time").alias("at"))
    matched = nearest_join(targets, frame.filter("v IS NOT NULL"), ["station_id"], "at", "obs_time", ["v"], direction="backward")
    expected = {r.seq: r.m_prev for r in plain.collect()}
    assert all((r._match.v if r._match else None) == expected[r.seq] for r in matched.collect())


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    values = {"a": rng.exponential(3, 301).round(2), "b": np.r_[np.full(200, 1.5), rng.normal(size=50)], "c": np.array([4.0])}
    frame = spark.createDataFrame([(g, float(x)) for g, xs in values.items() for x in xs], "g string, v double")
    for row in exact_quantiles(frame, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect():
        np.testing.assert_allclose([row.p10, row.p50, row.p99], np.quantile(values[row.g], [0.1, 0.5, 0.99]), rtol=1e-12)


def test_interpolation_equals_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(11)
    index = pd.date_range("2024-01-01", periods=80, freq="10min")
    values = pd.Series(rng.normal(size=80), index=index)
    values[rng.random(80) < 0.6] = np.nan
    frame = spark.createDataFrame([("s", t.to_pydatetime(), None if np.isnan(x) else float(x)) for t, x in values.items()], "station_id string, obs_time timestamp, v double")
    for limit in (1, 2, 3):
        got = cleaning.interpolate_limited(frame, ["station_id"], "obs_time", {"v": limit}).orderBy("obs_time").toPandas()["v"]
        expected = values.interpolate(method="time", limit=limit, limit_direction="both")
        np.testing.assert_allclose(got.astype(float).to_numpy(), expected.to_numpy(), rtol=1e-9, equal_nan=True)


def test_features_do_not_depend_on_chunk_size(series):
    base = series.withColumnRenamed("v", "wind_speed")
    whole = features.feature_pipeline(base, ["station_id"], "obs_time", ["wind_speed"], tie=["seq"])
    cut = features.feature_pipeline(base, ["station_id"], "obs_time", ["wind_speed"], tie=["seq"], chunk_rows=13)
    same(cut.select(*[f"`{c}`" for c in whole.columns]), whole)


def test_sequence_windows_shapes(spark):
    rows = [("s", START + dt.timedelta(minutes=10 * i), float(i), i == 100) for i in range(120)]
    frame = spark.createDataFrame(rows, "station_id string, obs_time timestamp, x double, invalid boolean")
    out = labels.sequence_windows(frame, ["station_id"], "obs_time", ["x"], ["x"], chunk_rows=31).orderBy("obs_time").collect()
    assert len(out) == 100 - 72 - 12 + 1
    first = out[0]
    assert len(first.history) == 72 and len(first.future) == 12
    assert [a[0] for a in first.anchors] == [74.0, 77.0, 80.0, 83.0]
    assert first.persistence == [[71.0]] * 4


def test_auc_with_ties(spark):
    frame = spark.createDataFrame([("a", y, p) for y, p in [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.1), (0, 0.7)]], "g string, y int, p double")
    row = metrics.event_scores(frame, ["g"], "y", "p").first()
    wins = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in (0.9, 0.5, 0.1) for b in (0.5, 0.1, 0.7))
    assert row.auc == pytest.approx(wins / 9)
    single = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.8)], "g string, y int, p double")
    assert metrics.event_scores(single, ["g"], "y", "p").first().auc is None


def test_rolling_plan_has_no_python_and_prunes_columns(spark):
    from skywharf.catalog.views import Views

    view = Views(spark, "/root/testdata/sf0.001")
    plan = view.clean.select("seq", "wind_speed")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "user_id" not in plan.split("ReadSchema")[1]


def test_cells_narrow_to_a_crowded_hour(spark):
    """One key with nine tenths of its rows in one hour: no cell holds more than the bound, positions stay exact."""
    rows = [("hot", START + dt.timedelta(seconds=(k * 7) % 3600), k) for k in range(1800)] + [("hot", START + dt.timedelta(hours=k), k) for k in range(1800, 2000)]
    frame = spark.createDataFrame(rows, "station_id string, obs_time timestamp, seq long")
    width = fitting_cell(frame, ["station_id"], "obs_time", most_rows=100)
    counts = frame.groupBy("station_id", cell_of("obs_time", width)).count().agg(F.max("count")).first()[0]
    assert width < 3600 and counts <= 100
    plain = frame.withColumn("_rn", F.row_number().over(Window.partitionBy("station_id").orderBy("obs_time", "seq")).cast("long"))
    same(number_rows(frame, ["station_id"], "obs_time", ["seq"], cell_seconds=width), plain, ("station_id", "obs_time", "seq"))
    assert fitting_cell(frame, ["station_id"], "obs_time") == 3600
