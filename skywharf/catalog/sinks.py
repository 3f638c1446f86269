"""Round trips through files, and the guards of model inputs, over the given tables.

A query writes its rows to a folder of its own below the shared folder, reads them back the way a user would, and SQL
checks what comes back against the rows themselves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skywharf.catalog.cleaning import mask_sql
from skywharf.catalog.registry import query
from skywharf.catalog.views import ts, tsql, with_views
from skywharf.operators import cleaning
from skywharf.schema import ARCHIVE_LIMITS, RAIN_AMOUNT_FEATURES, RAIN_FEATURE_WORDS
from skywharf.session import checkpoint_dir
from skywharf.sources import files

# The four encodings that archives come in; the second is UTF-8 with a mark before the first name.
LANDED = {"utf8": ("UTF-8", ""), "utf8_mark": ("UTF-8", "﻿"), "big5": ("Big5", ""), "cp950": ("MS950", "")}


def folder(v, name: str) -> str:
    return f"{checkpoint_dir(v.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "src03_archive_files",
    with_views(
        f"SELECT seq, {tsql('obs_time')} AS obs_time, station_id, {mask_sql(ARCHIVE_LIMITS, ['wind_speed', 'precipitation_1hr', 'temperature', 'visibility'])} FROM obs",
        "obs",
    ),
)
def _(v):
    """Archives of all stations in four encodings, a folder for each station, read back and stacked."""
    root = folder(v, "archives")
    whole = F.date_format("obs_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    for k, (name, (encoding, mark)) in enumerate(LANDED.items()):
        rows = v.obs.filter(F.pmod(F.col("seq"), F.lit(len(LANDED))) == k).select(
            "station_id", whole.alias(f"{mark}ObsTime"), F.col("wind_speed").cast("string").alias("WS "), F.col("precipitation_1hr").cast("string").alias("降水量(mm)"),
            F.col("temperature").cast("string").alias("氣溫(℃)"), F.col("visibility").cast("string").alias("Visb"), (F.col("seq") % 360).cast("string").alias("WD"), "seq",
        )
        files.write_archive_csv(rows, f"{root}/{name}", encoding)
    parts = [files.load_archive_csv(v.spark, f"{root}/{name}", encoding, carry=["seq"]) for name, (encoding, _) in LANDED.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(F.col("seq").cast("long").alias("seq"), ts("obs_time").alias("obs_time"), "station_id", "wind_speed", "precipitation_1hr", "temperature", "visibility")


@query(
    "src06_daily_table",
    with_views(
        """SELECT CAST(CAST(obs_time AS DATE) AS VARCHAR) AS day, COUNT(*) AS n_rows, COUNT(wind_speed) AS with_wind, MIN(wind_speed) AS lowest, MAX(wind_speed) AS highest, COUNT(DISTINCT station_id) AS n_stations
           FROM clean GROUP BY ALL""",
        "clean",
    ),
)
def _(v):
    """Observations written by day and read back; the days come from the folders."""
    path = f"{folder(v, 'observations')}/table.parquet"
    files.write_observations(v.clean.select("station_id", "obs_time", "wind_speed"), path)
    back = files.load_observations(v.spark, path)
    return back.groupBy(F.col("obs_date").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("wind_speed").alias("with_wind"), F.min("wind_speed").alias("lowest"), F.max("wind_speed").alias("highest"),
        F.countDistinct("station_id").alias("n_stations"),
    )


@query(
    "src07_report_replaced",
    with_views("SELECT station_id, COUNT(*) AS n_rows, COUNT(wind_speed) AS with_wind, MAX(wind_speed) AS highest FROM clean GROUP BY station_id", "clean"),
)
def _(v):
    """A report is replaced as a whole: the rows of a first, larger one are gone."""
    path = folder(v, "report")
    rows = v.clean.groupBy("station_id", "device_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count("wind_speed").alias("with_wind"), F.max("wind_speed").alias("highest"))
    files.write_report(rows, path)
    final = v.clean.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("wind_speed").alias("with_wind"), F.max("wind_speed").alias("highest"))
    files.write_report(final, path)
    return v.spark.read.schema("station_id string, n_rows long, with_wind long, highest double").json(path)


@query(
    "src24_metric_summary",
    with_views(
        """SELECT run, device_type, metric, value FROM (
             SELECT 1 AS run, device_type, 'rows' AS metric, CAST(COUNT(*) AS DOUBLE) AS value FROM clean GROUP BY device_type UNION ALL
             SELECT 1, device_type, 'highest', MAX(wind_speed) FROM clean GROUP BY device_type UNION ALL
             SELECT 2, device_type, 'rows', CAST(COUNT(*) AS DOUBLE) FROM clean WHERE wind_speed IS NOT NULL GROUP BY device_type UNION ALL
             SELECT 2, device_type, 'highest', MAX(wind_speed) FROM clean WHERE wind_speed IS NOT NULL GROUP BY device_type)""",
        "clean",
    ),
)
def _(v):
    """Two runs appended to one summary of long metric rows."""
    path = folder(v, "metrics")
    for run, rows in ((1, v.clean), (2, v.clean.filter("wind_speed IS NOT NULL"))):
        wide = rows.groupBy("device_type").agg(F.count(F.lit(1)).cast("double").alias("rows"), F.max("wind_speed").alias("highest"))
        files.append_metrics(wide.unpivot(["device_type"], ["rows", "highest"], "metric", "value").withColumn("run", F.lit(run)), path)
    return v.spark.read.parquet(path).select("run", "device_type", "metric", "value")


GUARDED = [
    "nearby_cwa_station_count", "nearby_cwa_wind_speed_mean", "nearby_cwa_wind_speed_max", "nearby_cwa_wind_gust_max", "nearby_cwa_valid_wind_station_count", "nearby_cwa_precipitation_1hr_mean",
    "nearby_cwa_precipitation_1hr_max", "nearby_cwa_rainy_station_count", "nearby_cwa_rainy_station_ratio", "wind_speed_max", "hour_rain", "target_rain_event_H1", "qpe_rain",
]


def _guard_sql(name: str) -> str:
    column = name if name.startswith("nearby_") else "nearby_cwa_precipitation_1hr_max"
    words = " OR ".join(f"contains('{name}', '{word}')" for word in RAIN_FEATURE_WORDS)
    return (
        f"SELECT '{name}' AS feature, COUNT({column}) AS n_values, '{name}' LIKE 'nearby\\_%' ESCAPE '\\' OR '{name}' LIKE 'cwa\\_%' ESCAPE '\\' OR '{name}' LIKE 'qpe\\_%' ESCAPE '\\' AS forbidden, "
        f"'{name}' IN ({', '.join(repr(x) for x in RAIN_AMOUNT_FEATURES)}) AS for_amounts, "
        f"({words}) AND NOT starts_with('{name}', 'target_') AND NOT contains('{name}', 'wind_speed') AND NOT contains('{name}', 'wind_gust') AS for_benchmark FROM area_hour"
    )


@query("cln19_leakage_guards", with_views(" UNION ALL ".join(_guard_sql(x) for x in GUARDED), "area_hour"))
def _(v):
    """Which columns of the area series each guard lets through, with the number of values behind them."""
    named = v.area_hour.withColumns({x: F.col("nearby_cwa_precipitation_1hr_max") for x in GUARDED if not x.startswith("nearby_")})
    counts = named.agg(*[F.count(x).alias(x) for x in GUARDED]).unpivot([], GUARDED, "feature", "n_values")
    passing = {"for_amounts": cleaning.rain_amount_features(GUARDED), "for_benchmark": cleaning.rain_benchmark_features(GUARDED)}
    return counts.withColumn("forbidden", F.col("feature").isin(cleaning.forbidden(GUARDED))).withColumns({k: F.col("feature").isin(x) for k, x in passing.items()})
