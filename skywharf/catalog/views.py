"""Observation views derived from the given tables, in Spark and in SQL.

``events`` rows become station observations with missing values, sentinels
and duplicates; every view reads the whole table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skywharf.operators import aggregates, cleaning
from skywharf.plans.dims import dimension
from skywharf.session import pin_session

# station_id, name, longitude, latitude, priority, role, group, enabled
STATIONS = [
    ("S00", "Inner Pier", 120.283, 22.617, 1, "wind", "port_local", True),
    ("S01", "Fishing Port", 120.304, 22.574, 1, "wind", "port_local", True),
    ("S02", "Second Gate", 120.340, 22.552, 1, "tide", "port_local", True),
    ("S03", "Container Yard", 120.300, 22.600, 1, "wind", "port_local", True),
    ("S04", "Hillside", 120.320, 22.640, 2, "weather", "nearby", True),
    ("S05", "River Mouth", 120.290, 22.650, 2, "weather", "nearby", True),
    ("S06", "Old Town", 120.310, 22.670, 2, "weather", "nearby", True),
    ("S07", "East Ridge", 120.380, 22.630, 3, "weather", "nearby", True),
    ("S08", "Airfield", 120.350, 22.577, 3, "weather", "nearby", True),
    ("S09", "South Cape", 120.410, 22.490, 4, "wave", "marine", True),
    ("S10", "Outer Buoy", 120.150, 22.450, 4, "wave", "marine", False),
    ("S11", "Baseline", 120.430, 22.730, 9, "weather", "fallback", True),
]
BASELINE_STATION = "S11"
STATION_SCHEMA = (
    "station_id string, name string, longitude double, latitude double, priority int, role string, "
    "priority_group string, enabled boolean"
)


def _literal(value) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    return repr(value)


def values_sql(rows, columns: str) -> str:
    """A ``VALUES`` relation with named columns."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


VIEW_SQL = {
    "obs": """
        SELECT event_id AS seq,
               'S' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS station_id,
               CASE WHEN user_id % 12 < 8 THEN 'north' ELSE 'south' END AS target_area,
               event_type AS source,
               CASE user_id % 3 WHEN 0 THEN 'WIND' WHEN 1 THEN 'TIDE' ELSE 'WEATHER' END AS device_type,
               ts AS obs_time,
               date_trunc('hour', ts) AS obs_hour,
               ts + to_minutes(k % 30) AS fetched_at,
               k % 50 = 7 AS is_forecast,
               k % 4 = 1 AS stale,
               k,
               CASE WHEN k % 17 = 0 THEN NULL WHEN k % 29 = 1 THEN -99.0::DOUBLE ELSE value / 10 END AS wind_speed,
               CASE WHEN k % 19 = 0 THEN NULL ELSE value / 10 * 1.3::DOUBLE END AS wind_gust,
               k * 3.6::DOUBLE AS wind_direction,
               CASE WHEN k % 11 = 0 THEN NULL ELSE CAST((k * 7) % 360 AS DOUBLE) END AS wind_gust_direction,
               CASE WHEN k < 80 THEN 0.0 ELSE (k - 80) * 0.6::DOUBLE END AS precipitation_1hr,
               CAST(1000 + k % 20 AS DOUBLE) AS station_pressure,
               CAST(60 + k % 40 AS DOUBLE) AS relative_humidity,
               CAST(20 + k % 12 AS DOUBLE) AS temperature,
               CASE WHEN k % 13 = 0 THEN NULL ELSE k * 300.0::DOUBLE END AS visibility,
               CASE WHEN k % 7 = 0 THEN NULL ELSE 100.0::DOUBLE + k * 3 END AS tide_level,
               props, value
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
    """,
    "clean": """
        SELECT * REPLACE (
            CASE WHEN wind_speed BETWEEN 0 AND 100 THEN wind_speed END AS wind_speed,
            CASE WHEN wind_gust BETWEEN 0 AND 120 THEN wind_gust END AS wind_gust,
            CASE WHEN precipitation_1hr BETWEEN 0 AND 500 THEN precipitation_1hr END AS precipitation_1hr)
        FROM obs
    """,
    "station": values_sql(STATIONS, "station_id, name, longitude, latitude, priority, role, priority_group, enabled"),
    # One row per (station, hour): the fullest observation, later rows break ties.
    "station_hour": """
        SELECT * EXCLUDE (rn, n_valid) FROM (
            SELECT *, row_number() OVER (PARTITION BY station_id, obs_hour ORDER BY n_valid DESC, seq DESC) AS rn
            FROM (SELECT station_id, target_area, obs_hour AS obs_time, obs_hour, seq, k, source, device_type,
                         wind_speed, wind_gust, wind_direction, wind_gust_direction, precipitation_1hr,
                         station_pressure, relative_humidity, temperature, visibility, tide_level,
                         CAST(wind_speed IS NOT NULL AS INT) + CAST(wind_gust IS NOT NULL AS INT)
                         + CAST(wind_gust_direction IS NOT NULL AS INT)
                         + CAST(visibility IS NOT NULL AS INT) + CAST(tide_level IS NOT NULL AS INT) AS n_valid
                  FROM clean))
        WHERE rn = 1
    """,
    "area_hour": """
        SELECT target_area, obs_hour AS obs_time,
               COUNT(DISTINCT station_id) AS nearby_cwa_station_count,
               AVG(wind_speed) AS nearby_cwa_wind_speed_mean, MAX(wind_speed) AS nearby_cwa_wind_speed_max,
               MIN(wind_speed) AS nearby_cwa_wind_speed_min,
               COALESCE(STDDEV_POP(wind_speed), 0) AS nearby_cwa_wind_speed_std,
               COUNT(wind_speed) AS nearby_cwa_valid_wind_station_count,
               AVG(wind_gust) AS nearby_cwa_wind_gust_mean, MAX(wind_gust) AS nearby_cwa_wind_gust_max,
               MIN(wind_gust) AS nearby_cwa_wind_gust_min,
               COALESCE(STDDEV_POP(wind_gust), 0) AS nearby_cwa_wind_gust_std,
               COUNT(wind_gust) AS nearby_cwa_valid_gust_station_count,
               AVG(precipitation_1hr) AS nearby_cwa_precipitation_1hr_mean,
               MAX(precipitation_1hr) AS nearby_cwa_precipitation_1hr_max,
               COUNT(*) FILTER (WHERE COALESCE(precipitation_1hr, 0) > 0.5) AS nearby_cwa_rainy_station_count,
               COUNT(*) FILTER (WHERE COALESCE(precipitation_1hr, 0) > 0.5)
                 / CAST(COUNT(DISTINCT station_id) AS DOUBLE) AS nearby_cwa_rainy_station_ratio
        FROM clean GROUP BY target_area, obs_hour
    """,
    # Half-hour area series used where times must be unique per area.
    "area_half": """
        SELECT target_area, time_bucket(INTERVAL 30 MINUTE, obs_time, TIMESTAMP '2000-01-01') AS obs_time,
               MAX(wind_speed) AS nearby_cwa_wind_speed_max, MAX(wind_gust) AS nearby_cwa_wind_gust_max,
               MAX(precipitation_1hr) AS nearby_cwa_precipitation_1hr_max,
               AVG(wind_speed) AS wind_mean
        FROM clean GROUP BY ALL
    """,
}
_DEPENDS = {
    "obs": [], "clean": ["obs"], "station": [], "station_hour": ["clean"], "area_hour": ["clean"],
    "area_half": ["clean"],
}


def define_view(name: str, sql: str, depends: list[str]) -> None:
    """Add a derived SQL view that query texts can name."""
    VIEW_SQL[name] = sql
    _DEPENDS[name] = depends


def with_views(body: str, *names: str) -> str:
    """Prefix a SQL body with the definitions of the views it uses."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in _DEPENDS[name]:
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in ordered) + "\n" + body


def ts(column: str | Column) -> Column:
    """Timestamp as text, so results do not depend on a reader's zone."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def tsql(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


def r(column: str | Column, places: int = 9) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, places)


def rounded(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


class Views:
    """Lazy access to the given tables and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = pin_session(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def obs(self) -> DataFrame:
        k = F.col("k")
        station = F.col("user_id") % 12
        return (
            self.events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
            .select(
                F.col("event_id").alias("seq"),
                F.concat(F.lit("S"), F.lpad(station.cast("string"), 2, "0")).alias("station_id"),
                F.when(station < 8, "north").otherwise("south").alias("target_area"),
                F.col("event_type").alias("source"),
                F.when(F.col("user_id") % 3 == 0, "WIND").when(F.col("user_id") % 3 == 1, "TIDE")
                .otherwise("WEATHER").alias("device_type"),
                F.col("ts").cast("timestamp").alias("obs_time"),
                F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("obs_hour"),
                (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=(k % 30).cast("int"))).alias("fetched_at"),
                (k % 50 == 7).alias("is_forecast"),
                (k % 4 == 1).alias("stale"),
                k,
                F.when(k % 17 == 0, None).when(k % 29 == 1, F.lit(-99.0)).otherwise(F.col("value") / 10).alias("wind_speed"),
                F.when(k % 19 != 0, F.col("value") / 10 * F.lit(1.3)).alias("wind_gust"),
                (k * F.lit(3.6)).alias("wind_direction"),
                F.when(k % 11 != 0, ((k * 7) % 360).cast("double")).alias("wind_gust_direction"),
                F.when(k < 80, F.lit(0.0)).otherwise((k - 80) * F.lit(0.6)).alias("precipitation_1hr"),
                (1000 + k % 20).cast("double").alias("station_pressure"),
                (60 + k % 40).cast("double").alias("relative_humidity"),
                (20 + k % 12).cast("double").alias("temperature"),
                F.when(k % 13 != 0, k * F.lit(300.0)).alias("visibility"),
                F.when(k % 7 != 0, F.lit(100.0) + k * 3).alias("tide_level"),
                "props",
                "value",
            )
        )

    @cached_property
    def clean(self) -> DataFrame:
        return cleaning.mask_ranges(self.obs)

    @cached_property
    def station(self) -> DataFrame:
        return dimension(self.spark, STATIONS, STATION_SCHEMA)

    @cached_property
    def station_hour(self) -> DataFrame:
        columns = ["station_id", "target_area", "obs_hour", "seq", "k", "source", "device_type", "wind_speed",
                   "wind_gust", "wind_direction", "wind_gust_direction", "precipitation_1hr", "station_pressure",
                   "relative_humidity", "temperature", "visibility", "tide_level"]
        fullest = cleaning.deduplicate_fullest(self.clean.select(*columns), ["station_id", "obs_hour"], "seq")
        return fullest.withColumn("obs_time", F.col("obs_hour"))

    @cached_property
    def area_hour(self) -> DataFrame:
        return aggregates.area_wind_rain(
            self.clean.withColumn("obs_time", F.col("obs_hour")), ["target_area", "obs_time"]
        )

    @cached_property
    def area_half(self) -> DataFrame:
        slot = F.timestamp_seconds((F.floor(F.unix_seconds("obs_time") / 1800) * 1800).cast("long"))
        return self.clean.groupBy("target_area", slot.alias("obs_time")).agg(
            F.max("wind_speed").alias("nearby_cwa_wind_speed_max"),
            F.max("wind_gust").alias("nearby_cwa_wind_gust_max"),
            F.max("precipitation_1hr").alias("nearby_cwa_precipitation_1hr_max"),
            F.avg("wind_speed").alias("wind_mean"),
        )
