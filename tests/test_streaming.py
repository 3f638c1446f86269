"""Streaming over many batches: wrong order, restarts, repeated batches, late rows and broken files."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from skywharf.operators import cleaning
from skywharf.streaming import jobs
from skywharf.streaming.parts import keyed_sink, keyed_table, live_parts, part_sink, read_parts

SCHEMA = "station_id string, device_type string, obs_time timestamp, seq long, wind_speed double"
START = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for seq in range(400):
        # Up to ten days back and forth: far beyond any watermark.
        at = START + dt.timedelta(minutes=rng.randrange(0, 14_400))
        out.append((rng.choice(["A", "A", "A", "B"]), "WIND", at.replace(minute=at.minute // 5 * 5), seq, rng.choice([None, *map(float, range(20))])))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def land(spark, rows, folder, parts):
    """Files in an order that has nothing to do with time; each is a batch of its own."""
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return jobs.landing_streams(spark, {"one": folder}, spark.createDataFrame([], SCHEMA).schema, max_files=1)["one"].drop("landing_source")


def run_twice(spark, rows, tmp_path, sink):
    """Half the files, a restart, the other half, and a repeat of the last batch."""
    folder, path = str(tmp_path / "landing"), str(tmp_path / "table")
    land(spark, rows[:200], folder, 3)
    jobs.run(stream(spark, folder), str(tmp_path / "state"), sink(path)).awaitTermination()
    land(spark, rows[200:], folder, 4)
    last = {}

    def remembered(batch, batch_id):
        last["rows"], last["id"] = batch.collect(), batch_id
        sink(path)(batch, batch_id)

    jobs.run(stream(spark, folder), str(tmp_path / "state"), remembered).awaitTermination()
    assert last["id"] >= 6
    sink(path)(spark.createDataFrame(last["rows"], SCHEMA), last["id"])
    return spark.read.option("recursiveFileLookup", not any(tmp_path.glob("table/*=*"))).parquet(path)


def table(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


def test_tumbling_means_count_late_rows(spark, rows, frame, tmp_path):
    parts = run_twice(spark, rows, tmp_path, lambda path: jobs.batch_sink(path, lambda b: jobs.tumbling_parts(b, ["wind_speed"])))
    names = ["station_id", "obs_time", "wind_speed"]
    assert table(jobs.tumbling_mean(parts, ["wind_speed"]), *names) == table(jobs.tumbling_mean(jobs.tumbling_parts(frame, ["wind_speed"]), ["wind_speed"]), *names)


def test_trend_merges_over_batches(spark, rows, frame, tmp_path):
    parts = run_twice(spark, rows, tmp_path, lambda path: jobs.batch_sink(path, jobs.trend_parts))
    names = [*jobs.TREND_KEYS, "offset_minutes", "wind_speed"]
    assert table(jobs.sliding_trend(parts), *names) == table(jobs.sliding_trend(jobs.trend_parts(frame)), *names)


def test_last_and_first_version_of_a_key(spark, rows, frame, tmp_path):
    keys, names = ["station_id", "obs_time"], ["station_id", "obs_time", "seq", "wind_speed"]
    order = list(range(200)) + list(range(200, 400))
    last = run_twice(spark, rows, tmp_path / "a", lambda path: jobs.append_last_sink(path, keys, ["seq"]))
    first = run_twice(spark, rows, tmp_path / "b", lambda path: jobs.first_sink(path, keys, ["seq"]))
    arrived = {}
    for k, part in enumerate([rows[:200][j::3] for j in range(3)] + [rows[200:][j::4] for j in range(4)]):
        arrived |= {row[3]: k for row in part}
    assert sorted(arrived) == order
    by = {}
    for row in rows:
        by.setdefault((row[0], row[2]), []).append(row)
    newest = [max(v, key=lambda x: (arrived[x[3]], x[3])) for v in by.values()]
    oldest = [min(v, key=lambda x: (arrived[x[3]], x[3])) for v in by.values()]
    assert table(last, *names) == sorted([(r[0], r[2], r[3], r[4]) for r in newest], key=repr)
    assert table(first, *names) == sorted([(r[0], r[2], r[3], r[4]) for r in oldest], key=repr)


def test_latest_state_is_carried_over_batches(spark, rows, frame, tmp_path):
    folder, path = str(tmp_path / "landing"), str(tmp_path / "table")
    land(spark, rows[:200], folder, 3)
    live = lambda df: jobs.latest_state(df.withColumn("is_forecast", F.lit(False)), ["station_id"], ["seq"])
    jobs.run(live(stream(spark, folder)), str(tmp_path / "state"), jobs.batch_sink(path), mode="update").awaitTermination()
    land(spark, rows[200:], folder, 4)
    jobs.run(live(stream(spark, folder)), str(tmp_path / "state"), jobs.batch_sink(path), mode="update").awaitTermination()
    newest = cleaning.keep_last(spark.read.parquet(path), ["station_id"], ["_batch"])
    assert table(newest, "station_id", "obs_time", "seq") == table(live(frame), "station_id", "obs_time", "seq")


def test_a_broken_file_fails_its_source_alone(spark, rows, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    land(spark, rows, good, 2)
    land(spark, rows[:10], bad, 1)
    (tmp_path / "bad" / "part-broken.parquet").write_bytes(b"PAR1 not a parquet file")
    schema = spark.createDataFrame([], SCHEMA).schema
    status = {r["source"]: r for r in jobs.run_sources(jobs.landing_streams(spark, {"good": good, "bad": bad}, schema), str(tmp_path / "state"), lambda b, k: b.write.mode("append").parquet(f"{tmp_path}/out/{b.select('landing_source').first()[0]}/{k}")).collect()}
    assert not status["good"]["failed"] and status["bad"]["failed"] and status["bad"]["error"] and not status["good"]["all_failed"]
    assert spark.read.parquet(f"{tmp_path}/out/good/*").count() == len(rows)
    only = jobs.run_sources(jobs.landing_streams(spark, {"bad": bad}, schema), str(tmp_path / "again"), lambda b, k: b.count()).collect()
    assert [r["all_failed"] for r in only] == [True]


def test_parts_stay_few_over_many_batches(spark, tmp_path):
    """100 batches with late rows, a repeat of a merged batch and of a new one: few folders, and the means of all rows."""
    path, rng, rows = str(tmp_path / "parts"), random.Random(3), []
    sink = part_sink(path, lambda b: jobs.tumbling_parts(b, ["wind_speed"]), lambda p: jobs.tumbling_merged(p, ["wind_speed"]), fold=4)
    for k in range(100):
        batch = [("A", "WIND", START + dt.timedelta(minutes=10 * rng.randrange(6)), k, float(rng.randrange(20)))]
        frame = spark.createDataFrame(batch, SCHEMA).coalesce(1)
        sink(frame, k)
        rows += batch
        if k in (37, 98):
            sink(frame, k)
        if k == 60:
            sink(spark.createDataFrame(rows[3:4], SCHEMA), 3)
        assert len(live_parts(spark, path)) <= 3 * 4
    assert len(list((tmp_path / "parts").iterdir())) <= 2 * 3 * 4
    (tmp_path / "parts" / "part-3-0-99").mkdir()
    merged, whole = read_parts(spark, path), jobs.tumbling_parts(spark.createDataFrame(rows, SCHEMA), ["wind_speed"])
    names = ["station_id", "obs_time", "wind_speed"]
    assert table(jobs.tumbling_mean(merged, ["wind_speed"]), *names) == table(jobs.tumbling_mean(whole, ["wind_speed"]), *names)
    assert merged.agg(F.sum("wind_speed_n")).first()[0] == 100


def test_a_silent_station_is_reported_without_an_event(spark, tmp_path):
    """The clock passes the limit and the outage row appears by itself; the next row of the station ends it."""
    folder, out = str(tmp_path / "landing"), []
    land(spark, [("A", "WIND", START, 1, 1.0), ("A", "WIND", START + dt.timedelta(hours=1), 2, 1.0), (None, "WIND", START, 3, 1.0)], folder, 1)
    query = jobs.run(jobs.silence(stream(spark, folder), 5), str(tmp_path / "state"), lambda b, k: out.extend(map(tuple, b.collect())), every="1 second")

    def wait(count):
        until = time.time() + 90
        while len(out) < count and time.time() < until:
            assert query.exception() is None
            time.sleep(0.5)

    try:
        wait(1)
        assert out == [("A", START + dt.timedelta(hours=1), "outage")]
        land(spark, [("A", "WIND", START + dt.timedelta(hours=2), 4, 1.0)], folder, 1)
        wait(2)
        assert out[1] == ("A", START + dt.timedelta(hours=2), "recovered")
    finally:
        query.stop()


def test_deltas_equal_rewritten_days(spark, rows, frame, tmp_path):
    """Last and first versions by deltas, over batches, a restart and a repeat, against the sinks that rewrite days."""
    keys, names = ["station_id", "obs_time"], ["station_id", "obs_time", "seq", "wind_speed"]
    run_twice(spark, rows, tmp_path / "a", lambda path: keyed_sink(path, keys, ["seq"], fold=3))
    days = run_twice(spark, rows, tmp_path / "b", lambda path: jobs.append_last_sink(path, keys, ["seq"]))
    assert table(keyed_table(spark, str(tmp_path / "a" / "table"), keys), *names) == table(days, *names)
    rest = ["device_type", "seq", "wind_speed"]
    run_twice(spark, rows, tmp_path / "c", lambda path: keyed_sink(path, keys, ["seq"], rest[:1] + rest[2:], fold=3))
    first = run_twice(spark, rows, tmp_path / "d", lambda path: jobs.first_sink(path, keys, ["seq"]))
    kept = keyed_table(spark, str(tmp_path / "c" / "table"), keys, ["wind_speed"])
    assert table(kept, "station_id", "obs_time", "wind_speed") == table(first, "station_id", "obs_time", "wind_speed")


def test_bytes_of_a_delta_follow_its_batch(spark, tmp_path):
    """A batch of one row writes a few kilobytes, however full its day is."""
    path, keys = tmp_path / "table", ["station_id", "obs_time"]
    day = spark.range(200_000).select(F.lit("A").alias("station_id"), F.lit("WIND").alias("device_type"), F.timestamp_millis(F.col("id") * 400).alias("obs_time"), F.col("id").alias("seq"), F.rand(1).alias("wind_speed"))
    sink = keyed_sink(str(path), keys, ["seq"])
    sink(day, 0)
    sink(day.limit(1).withColumn("wind_speed", F.lit(-5.0)), 1)
    size = {k: sum(f.stat().st_size for f in (path / f"part-0-{k}-{k}").glob("*.parquet")) for k in (0, 1)}
    assert size[0] > 1_000_000 and size[1] < 20_000
    out = keyed_table(spark, str(path), keys)
    assert out.count() == 200_000 and out.filter("wind_speed = -5").count() == 1
