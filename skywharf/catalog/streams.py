"""Streaming jobs run over the whole event table and read back as tables.

The event file is the landing source; every query drains it with an
``availableNow`` trigger into the shared folder, then returns the table.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from skywharf.catalog.aggregates import threshold_sql
from skywharf.catalog.registry import query
from skywharf.catalog.scalar import gust_sql, speed_sql
from skywharf.catalog.views import Views, rounded, ts, tsql, with_views
from skywharf.operators import cleaning
from skywharf.session import checkpoint_dir
from skywharf.streaming import jobs
from skywharf.streaming.parts import keyed_sink, keyed_table, part_sink, read_parts

AS_OF = "2024-01-31 00:00:00"


class StreamViews(Views):
    """The same observation view, with the event file read as a stream."""

    @property
    def events(self):
        schema = self.spark.read.parquet(f"{self.sf_dir}/events.parquet").schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(self.sf_dir)


def drained(v, build, sink=None, mode="append", read=lambda spark, path: spark.read.parquet(path)):
    """Run a streaming plan to the end and return what it wrote."""
    spark = v.spark
    folder = os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    target = f"{folder}/table"
    stream = build(StreamViews(spark, v.sf_dir))

    jobs.run(stream, f"{folder}/state", sink(target) if sink else jobs.batch_sink(target), mode=mode).awaitTermination()
    return read(spark, target)


def masked(sv):
    return cleaning.mask_ranges(sv.obs)


@query("str01_landing_rows", with_views("SELECT source, COUNT(*) AS n_rows, COUNT(wind_speed) AS with_wind FROM clean GROUP BY source", "clean"))
def _(v):
    out = drained(v, lambda sv: masked(sv).select("source", "seq", "wind_speed"))
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count("wind_speed").alias("with_wind"))


@query(
    "str02_append_last_wins",
    with_views(f"SELECT station_id, {tsql('obs_hour')} AS obs_time, seq, wind_speed FROM (SELECT *, row_number() OVER (PARTITION BY station_id, obs_hour ORDER BY seq DESC) AS rn FROM clean) WHERE rn = 1", "clean"),
)
def _(v):
    def build(sv):
        return masked(sv).select("station_id", F.col("obs_hour").alias("obs_time"), "seq", "wind_speed")

    keys = ["station_id", "obs_time"]
    out = drained(v, build, lambda path: keyed_sink(path, keys, ["seq"]), read=lambda spark, path: keyed_table(spark, path, keys))
    return out.select("station_id", ts("obs_time").alias("obs_time"), "seq", "wind_speed")


@query("str02_first_wins_keys", with_views("SELECT COUNT(*) AS n_rows, COUNT(DISTINCT station_id) AS n_stations FROM (SELECT DISTINCT station_id, obs_hour FROM obs)", "obs"))
def _(v):
    def build(sv):
        return sv.obs.select("station_id", F.col("obs_hour").alias("obs_time"), "seq", "k")

    keys, rest = ["station_id", "obs_time"], ["k"]
    out = drained(v, build, lambda path: keyed_sink(path, keys, ["seq"], rest), read=lambda spark, path: keyed_table(spark, path, keys, rest))
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("station_id").alias("n_stations"))


@query(
    "str03_upsert_state",
    with_views(f"SELECT source, station_id, {tsql('obs_hour')} AS obs_time, arg_max(seq, seq) AS seq, arg_max(coalesce(wind_speed, -1), seq) AS wind_speed, arg_min(k, seq) AS port_code FROM clean GROUP BY ALL", "clean"),
)
def _(v):
    keys = ["source", "station_id", "obs_time"]

    def build(sv):
        return masked(sv).select("source", "station_id", F.col("obs_hour").alias("obs_time"), "seq", F.coalesce("wind_speed", F.lit(-1.0)).alias("wind_speed"), F.col("k").alias("port_code"))

    kept = ["port_code"]
    out = drained(v, build, lambda path: keyed_sink(path, keys, ["seq"], kept), read=lambda spark, path: keyed_table(spark, path, keys, kept))
    return out.select("source", "station_id", ts("obs_time").alias("obs_time"), "seq", "wind_speed", "port_code")


LATEST_SQL = "SELECT source, device_type, station_id, MAX(obs_time) AS obs_time, arg_max(seq, (obs_time, seq)) AS seq FROM obs WHERE NOT is_forecast GROUP BY ALL"


def latest_table(v):
    def build(sv):
        return jobs.latest_state(sv.obs, ["source", "device_type", "station_id"], ["seq"])

    out = drained(v, build, mode="update")
    return cleaning.keep_last(out.withColumn("_t", F.col("obs_time")), ["source", "device_type", "station_id"], ["_t", "seq"]).drop("_t", "_batch")


@query("str04_latest_state", with_views(f"SELECT source, device_type, station_id, {tsql('obs_time')} AS obs_time, seq FROM ({LATEST_SQL})", "obs"))
def _(v):
    return latest_table(v).withColumn("obs_time", ts("obs_time"))


@query(
    "str05_freshness",
    with_views(
        f"""SELECT source, device_type, station_id, CAST(age AS BIGINT) AS age_minutes, CASE WHEN age > 1440 THEN 'outage' WHEN age > threshold THEN 'stale' ELSE 'current' END AS status FROM (
            SELECT *, {threshold_sql()} AS threshold, greatest(0, floor((epoch(TIMESTAMP '{AS_OF}') - epoch(obs_time)) / 60)) AS age FROM ({LATEST_SQL}))""",
        "obs",
    ),
)
def _(v):
    out = jobs.freshness(latest_table(v), F.lit(AS_OF).cast("timestamp"))
    return out.select("source", "device_type", "station_id", "age_minutes", "status")


@query(
    "str06_tumbling_resample",
    with_views(
        f"""SELECT station_id, {tsql("time_bucket(INTERVAL 10 MINUTE, obs_time, TIMESTAMP '2000-01-01')")} AS obs_time, round(AVG(wind_speed), 9) AS wind_speed, round(AVG(wind_gust), 9) AS wind_gust FROM clean GROUP BY ALL""",
        "clean",
    ),
)
def _(v):
    measures = ["wind_speed", "wind_gust"]
    sink = lambda path: part_sink(path, lambda batch: jobs.tumbling_parts(batch, measures), lambda parts: jobs.tumbling_merged(parts, measures))
    parts = drained(v, masked, sink, read=read_parts)
    return rounded(jobs.tumbling_mean(parts, measures), *measures).withColumn("obs_time", ts("obs_time"))


@query(
    "str07_sliding_trend",
    with_views(
        f"""SELECT station_id, device_type, {tsql('window_end')} AS window_end, o AS offset_minutes, CASE WHEN points < 2 THEN v1 ELSE round(v1 + (v1 - v0) / greatest((epoch_us(t1) - epoch_us(t0)) / 60e6, 1.0) * o, 3) END AS wind_speed FROM (
            SELECT *, unnest([10, 30, 60, 90]) AS o FROM (
              SELECT station_id, device_type, window_end, COUNT(*) AS points, arg_min(wind_speed, (obs_time, seq)) AS v0, arg_max(wind_speed, (obs_time, seq)) AS v1, MIN(obs_time) AS t0, MAX(obs_time) AS t1 FROM (
                SELECT *, time_bucket(INTERVAL 10 MINUTE, obs_time, TIMESTAMP '2000-01-01') + to_minutes(i * 10) AS window_end FROM clean, (SELECT CAST(range AS INT) AS i FROM range(1, 13)) g WHERE wind_speed IS NOT NULL) GROUP BY ALL))""",
        "clean",
    ),
)
def _(v):
    parts = drained(v, masked, lambda path: part_sink(path, jobs.trend_parts, jobs.trend_merged), read=read_parts)
    return jobs.sliding_trend(parts).withColumn("window_end", ts("window_end"))


@query(
    "str08_alerts",
    with_views(
        f"""SELECT seq, station_id, wind_speed, wind_level, gust_level, CASE WHEN wind_speed >= 17.2 THEN 'severe' WHEN wind_speed >= 13.8 THEN 'strong' END AS alert FROM (SELECT *, {speed_sql('wind_speed')} AS wind_level, {gust_sql('wind_gust')} AS gust_level FROM clean)
            WHERE wind_speed >= 13.8 OR wind_level IN ('warning', 'high_risk', 'stop') OR gust_level IN ('warning', 'high_risk', 'stop')""",
        "clean",
    ),
)
def _(v):
    return drained(v, lambda sv: jobs.alerts(masked(sv).select("seq", "station_id", "wind_speed", "wind_gust"))).select("seq", "station_id", "wind_speed", "wind_level", "gust_level", "alert")
