"""Readers, store semantics and payload flatteners over the given tables.

Payload texts are built by Spark from the observation rows, then flattened
back, so the work grows with the tables and SQL can check the values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skywharf.catalog.aggregates import latest
from skywharf.catalog.joins import periods
from skywharf.catalog.registry import query
from skywharf.catalog.scalar import haversine_sql
from skywharf.catalog.views import define_view, r, rounded, ts, tsql, with_views
from skywharf.functions import text
from skywharf.operators import cleaning, ranking
from skywharf.plans.dims import dimension
from skywharf.sources import files, payloads, stations, store

EVENT_ALIASES = {"ts": "obs_time", "value": "wind_speed", "event_type": "source"}


@query(
    "src01_load_observations",
    f"SELECT event_id, {tsql('ts')} AS obs_time, event_type AS source, value AS wind_speed FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'",
)
def _(v):
    out = files.load_observations(v.spark, f"{v.sf_dir}/events.parquet", aliases=EVENT_ALIASES, start="2024-01-05 00:00:00", end="2024-01-20 00:00:00")
    return out.select("event_id", ts("obs_time").alias("obs_time"), "source", "wind_speed")


@query(
    "src02_collect_data",
    f"""SELECT source, station_id, COUNT(*) AS n_rows, COUNT(wind_speed) AS with_wind, {tsql('MIN(obs_time)')} AS first_time, {tsql('MAX(obs_time)')} AS last_time FROM (
        SELECT 'events' AS source, 'events' AS station_id, ts AS obs_time, value AS wind_speed FROM events UNION ALL SELECT 'orders', 'orders', o_orderdate, NULL FROM orders)
        WHERE obs_time BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL""",
)
def _(v):
    paths = {"events": f"{v.sf_dir}/events.parquet", "orders": f"{v.sf_dir}/orders.parquet"}
    aliases = {"ts": "obs_time", "o_orderdate": "obs_time", "value": "wind_speed"}
    out = files.collect_data(v.spark, paths, start="1997-01-01 00:00:00", end="2024-01-15 00:00:00", aliases=aliases)
    return out.groupBy("source", "station_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("wind_speed").alias("with_wind"), ts(F.min("obs_time")).alias("first_time"), ts(F.max("obs_time")).alias("last_time")
    )


@query(
    "src04_station_availability",
    with_views(
        """SELECT COUNT(o.station_id) AS input_station_count, string_agg(o.station_id, ',' ORDER BY o.station_id) AS available_ids, coalesce(string_agg(CASE WHEN o.station_id IS NULL THEN s.station_id END, ',' ORDER BY s.station_id), '') AS missing_ids,
           bool_or(o.station_id = 'S00') AS target_available, COUNT(CASE WHEN o.station_id <> 'S00' THEN 1 END) = 0 AS fallback_to_single_station
           FROM (SELECT station_id FROM station UNION ALL VALUES ('S97'), ('S98')) s LEFT JOIN (SELECT DISTINCT station_id FROM obs) o ON s.station_id = o.station_id""",
        "obs", "station",
    ),
)
def _(v):
    silent = dimension(v.spark, [("S97",), ("S98",)], "station_id string")
    return stations.load_summary(v.station.select("station_id").unionByName(silent), v.obs, "S00")


@query(
    "src05_priority_pool",
    with_views(
        """SELECT priority_group, COUNT(*) AS configured, COUNT(o.station_id) AS available_count, coalesce(string_agg(o.station_id, ',' ORDER BY o.station_id), '') AS available_ids,
           coalesce(string_agg(CASE WHEN o.station_id IS NULL THEN s.station_id END, ',' ORDER BY s.station_id), '') AS missing_ids,
           CASE WHEN priority_group = 'port_local' THEN CASE WHEN COUNT(o.station_id) >= 4 THEN 'port_local_postprocess' ELSE 'fallback_baseline' END END AS prediction_mode,
           CASE WHEN priority_group = 'port_local' AND COUNT(o.station_id) < 4 THEN 'Only ' || COUNT(o.station_id) || ' valid KHWD wind station(s) available; require 4.' END AS fallback_reason
           FROM (SELECT station_id, priority_group FROM station UNION ALL VALUES ('S97', 'port_local'), ('S98', 'outer')) s
           LEFT JOIN (SELECT DISTINCT station_id FROM obs) o ON s.station_id = o.station_id GROUP BY priority_group""",
        "obs", "station",
    ),
)
def _(v):
    silent = dimension(v.spark, [("S97", "port_local"), ("S98", "outer")], "station_id string, priority_group string")
    return stations.priority_summary(v.station.select("station_id", "priority_group").unionByName(silent), v.obs, "port_local", minimum=4)


@query(
    "src08_append_dedupe",
    with_views(
        f"""SELECT station_id, {tsql('obs_hour')} AS obs_hour, seq, batch, wind_speed FROM (SELECT *, k % 2 AS batch, row_number() OVER (PARTITION BY station_id, obs_hour ORDER BY k % 2 DESC, seq DESC) AS rn FROM clean) WHERE rn = 1""",
        "clean",
    ),
)
def _(v):
    base = v.clean.select("station_id", "obs_hour", "seq", (F.col("k") % 2).alias("batch"), "wind_speed")
    out = files.append_dedupe(base.filter("batch = 0"), base.filter("batch = 1"), ["station_id", "obs_hour"], ["batch", "seq"])
    return out.withColumn("obs_hour", ts("obs_hour"))


UPSERT_KEYS = ["source", "station_id", "device_type", "obs_hour", "is_forecast"]


@query(
    "src09_upsert",
    with_views(
        f"""SELECT source, station_id, device_type, {tsql('obs_hour')} AS obs_hour, is_forecast, arg_max(seq, (age, seq)) AS seq, arg_max(coalesce(wind_speed, -1), (age, seq)) AS wind_speed, arg_max(stale, (age, seq)) AS stale,
            arg_min(port, (age, seq)) AS port_code FROM (SELECT *, CAST(seq % 3 = 0 AS INT) AS age, 'P' || k AS port FROM clean) GROUP BY ALL""",
        "clean",
    ),
)
def _(v):
    base = v.clean.select(*UPSERT_KEYS, "seq", F.coalesce("wind_speed", F.lit(-1.0)).alias("wind_speed"), "stale", F.concat(F.lit("P"), F.col("k").cast("string")).alias("port_code"))
    out = store.upsert(base.filter("seq % 3 <> 0"), base.filter("seq % 3 = 0"), ["seq"], UPSERT_KEYS)
    return out.withColumn("obs_hour", ts("obs_hour"))


def agency_text(column):
    """Value as payload text, with a sentinel for missing ones."""
    return F.coalesce(F.col(column).cast("string"), F.lit("-99"))


FETCHED = "2024-01-31 00:00:00"
UTC = "UTC"


@query(
    "src10_current_weather",
    with_views(
        f"""SELECT station_id, name AS station_name, {tsql('obs_time')} AS obs_time, wind_speed, wind_gust, wind_direction, precipitation_1hr, temperature AS air_temperature, visibility,
            epoch(TIMESTAMP '{FETCHED}') - epoch(obs_time) > 1200 AS stale, seq FROM clean JOIN station USING (station_id) WHERE name NOT LIKE '%Buoy%'""",
        "clean", "station",
    ),
)
def _(v):
    named = v.clean.join(v.station.select("station_id", "name", "latitude", "longitude"), "station_id")
    stamp = F.date_format("obs_time", "yyyy-MM-dd'T'HH:mm:ss")
    modern = F.struct(
        F.col("name").alias("StationName"), F.col("station_id").alias("StationId"), F.struct(stamp.alias("DateTime")).alias("ObsTime"),
        F.struct(F.lit("A").alias("CountyName"), F.array(F.struct(F.col("latitude").cast("string").alias("StationLatitude"), F.col("seq").cast("string").alias("StationLongitude"))).alias("Coordinates")).alias("GeoInfo"),
        F.struct(agency_text("wind_speed").alias("WindSpeed"), agency_text("wind_direction").alias("WindDirection"), agency_text("temperature").alias("AirTemperature"), agency_text("visibility").alias("Visibility"),
                 F.struct(agency_text("precipitation_1hr").alias("Precipitation")).alias("Now"), F.struct(agency_text("wind_gust").alias("PeakGustSpeed")).alias("GustInfo")).alias("WeatherElement"),
    )

    def item(name, column):
        return F.struct(F.lit(name).alias("elementName"), agency_text(column).alias("elementValue"))

    legacy = F.struct(
        F.col("name").alias("locationName"), F.col("station_id").alias("stationId"), stamp.alias("obsTime"), F.col("seq").cast("string").alias("longitude"),
        F.array(item("風速", "wind_speed"), item("風向", "wind_direction"), item("最大陣風", "wind_gust"), item("1小時雨量", "precipitation_1hr"), item("氣溫", "temperature"), item("能見度", "visibility")).alias("weatherElement"),
    )
    body = F.when(
        F.col("k") % 2 == 0, F.to_json(F.struct(F.struct(F.array(modern).alias("Station")).alias("records")))
    ).otherwise(F.to_json(F.struct(F.struct(F.array(legacy).alias("location")).alias("records"))))
    sent = named.select(body.alias("body"), F.lit(FETCHED).cast("timestamp").alias("fetched_at"))
    out = payloads.flatten_current(sent, "body", "fetched_at", names=["Pier", "Port", "Gate", "Yard", "side", "Mouth", "Town", "Ridge", "Airfield", "Cape", "Baseline"], zone=UTC)
    return out.select("station_id", "station_name", ts("obs_time").alias("obs_time"), "wind_speed", "wind_gust", "wind_direction", "precipitation_1hr", "air_temperature", "visibility", "stale",
                      F.col("longitude").cast("long").alias("seq"))


@query(
    "src11_history_xml",
    with_views(
        f"""SELECT station_id, {tsql('obs_time')} AS obs_time, wind_speed, wind_gust, wind_direction, wind_gust_direction, precipitation_1hr, temperature AS air_temperature, CAST(seq AS DOUBLE) AS longitude FROM clean""",
        "clean",
    ),
)
def _(v):
    def tag(name, column):
        return F.concat(F.lit(f"<{name}>"), column, F.lit(f"</{name}>"))

    stamp = F.date_format("obs_time", "yyyy-MM-dd'T'HH:mm:ss")
    xml = F.concat(
        F.lit("<Station>"), tag("StationName", F.col("station_id")), tag("StationId", F.col("station_id")), tag("ObsTime", tag("DateTime", stamp)),
        F.lit("<GeoInfo><CountyName>A</CountyName><Coordinates><CoordinateName>TWD67</CoordinateName><StationLatitude>1</StationLatitude><StationLongitude>1</StationLongitude></Coordinates><Coordinates><CoordinateName>WGS84</CoordinateName><StationLatitude>2</StationLatitude>"),
        tag("StationLongitude", F.col("seq").cast("string")), F.lit("</Coordinates></GeoInfo><WeatherElement>"), tag("WindSpeed", agency_text("wind_speed")), tag("WindDirection", agency_text("wind_direction")),
        tag("AirTemperature", agency_text("temperature")), tag("Now", tag("Precipitation", agency_text("precipitation_1hr"))),
        tag("GustInfo", F.concat(tag("PeakGustSpeed", agency_text("wind_gust")), tag("WindDirection", agency_text("wind_gust_direction")))), F.lit("</WeatherElement></Station>"),
    )
    parsed = payloads.parse_history_xml(v.clean.select(xml.alias("body")), "body")
    out = payloads.flatten_history(parsed, zone=UTC)
    return out.select("station_id", ts("obs_time").alias("obs_time"), "wind_speed", "wind_gust", "wind_direction", "wind_gust_direction", "precipitation_1hr", "air_temperature", "longitude")


@query(
    "src12_dedupe_observations",
    with_views(f"SELECT station_id, {tsql('obs_hour')} AS obs_time, seq, wind_speed FROM (SELECT *, row_number() OVER (PARTITION BY station_id, obs_hour ORDER BY seq DESC) AS rn FROM clean) WHERE rn = 1", "clean"),
)
def _(v):
    base = v.clean.select("station_id", F.col("obs_hour").alias("obs_time"), "seq", "wind_speed")
    return cleaning.keep_last(base, ["station_id", "obs_time"], "seq").withColumn("obs_time", ts("obs_time"))


@query(
    "src13_marine_payload",
    with_views(
        f"""SELECT station_id, name, {tsql('obs_time')} AS obs_time, wind_speed, wind_gust, tide_level, wave, k * 1.0::DOUBLE AS current_speed FROM (
            SELECT station_id, obs_time, wind_speed, wind_gust, tide_level, k, value AS wave FROM clean WHERE obs_time >= TIMESTAMP '2024-01-10 00:00:00' AND station_id IN ('S00', 'S01', 'S09', 'S10')) JOIN station USING (station_id)""",
        "clean", "station",
    ),
)
def _(v):
    element = F.struct(
        agency_text("tide_level").alias("TideHeight"), F.col("value").cast("string").alias("WaveHeight"),
        F.struct(agency_text("wind_speed").alias("WindSpeed"), agency_text("wind_gust").alias("MaximumWindSpeed")).alias("PrimaryAnemometer"),
        F.struct(F.array(F.struct(F.col("k").cast("string").alias("CurrentSpeed")), F.struct(F.lit("9999").alias("CurrentSpeed"))).alias("Layer")).alias("SeaCurrents"),
    )
    time = F.struct(F.date_format("obs_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("DateTime"), element.alias("WeatherElements"))
    # One payload per observation, as a landing folder of small messages would hold.
    location = F.struct(F.struct(F.col("station_id").alias("StationID")).alias("Station"), F.struct(F.array(time).alias("StationObsTime")).alias("StationObsTimes"))
    body = F.to_json(F.struct(F.struct(F.struct(F.array(location).alias("Location")).alias("SeaSurfaceObs")).alias("Records")))
    out = payloads.flatten_marine(v.clean.select(body.alias("body")), "body", v.station.select("station_id", "name"), ["S00", "S01", "S09", "S10"], start=F.lit("2024-01-10 00:00:00").cast("timestamp"), zone=UTC)
    return out.select("station_id", "name", ts("obs_time").alias("obs_time"), "wind_speed", "wind_gust", "tide_level", F.col("wave_height").alias("wave"), "current_speed")


@query(
    "src14_climate_archive",
    with_views(
        f"""SELECT station_id, {tsql('obs_hour')} AS obs_time, wind_speed, wind_gust, precipitation_1hr, CASE WHEN k % 13 <> 0 THEN k * 1000.0::DOUBLE END AS visibility FROM station_hour""",
        "station_hour",
    ),
)
def _(v):
    kilometres = F.when(F.col("k") % 13 != 0, F.col("k").cast("string"))
    def row(time):
        return F.struct(
            time.alias("DataTime"), F.struct(agency_text("wind_speed").alias("Mean")).alias("WindSpeed"), F.struct(agency_text("wind_gust").alias("Maximum")).alias("PeakGust"),
            F.struct(agency_text("precipitation_1hr").alias("Accumulation")).alias("Precipitation"),
            F.struct(F.when(F.col("k") % 2 == 0, kilometres).alias("AutoMean"), kilometres.alias("Instantaneous")).alias("Visibility"),
        )

    full = F.date_format("obs_hour", "yyyy-MM-dd'T'HH:mm:ss")
    half = F.date_format(F.col("obs_hour") + F.expr("interval 30 minutes"), "yyyy-MM-dd'T'HH:mm:ss")
    body = F.to_json(F.struct(F.array(F.struct(F.array(row(full), row(half)).alias("dts"))).alias("data")))
    out = payloads.flatten_climate_archive(v.station_hour.select("station_id", body.alias("body")), "body", "station_id", zone=UTC)
    return out.select("station_id", ts("obs_time").alias("obs_time"), "wind_speed", "wind_gust", "precipitation_1hr", "visibility")


@query(
    "src15_key_values",
    with_views(
        """SELECT seq, wind_speed AS ws_avg, CASE WHEN k % 5 = 0 THEN NULL ELSE wind_direction END AS wd_avg, 3 AS n_keys FROM clean""",
        "clean",
    ),
)
def _(v):
    raw = F.concat(
        F.lit("[WS_AVG]="), F.coalesce(F.col("wind_speed").cast("string"), F.lit("-")), F.lit(",broken,WD_AVG="),
        F.coalesce(F.when(F.col("k") % 5 != 0, F.col("wind_direction").cast("string")), F.lit("-")),
        F.lit(",=orphan,[MAX_T]=2024/1/1 08:00=x"),
    )
    parsed = v.clean.select("seq", text.key_values(raw).alias("m"))
    return parsed.select(
        "seq", F.element_at("m", "WS_AVG").try_cast("double").alias("ws_avg"), F.element_at("m", "WD_AVG").try_cast("double").alias("wd_avg"), F.size(F.map_keys("m")).alias("n_keys")
    )


@query(
    "src16_panel_rows",
    with_views(
        f"""SELECT station_id, device_type, {tsql("CASE WHEN device_type = 'WIND' OR k % 2 = 0 THEN date_trunc('second', obs_time) ELSE date_trunc('second', obs_time) + INTERVAL 10 MINUTE END")} AS obs_time, CASE WHEN device_type = 'WIND' OR k % 2 = 0 THEN wind_speed ELSE 77.0::DOUBLE END AS wind_speed,
            CASE WHEN device_type = 'WIND' OR k % 2 = 0 THEN tide_level END AS tide_level, seq FROM clean""",
        "clean",
    ),
)
def _(v):
    at = F.col("obs_time")
    later = F.date_format(at + F.expr("interval 10 minutes"), "yyyy/MM/dd HH:mm:ss")
    rows = v.clean.select(
        F.lit("KHH").alias("PortCode"), F.col("device_type").alias("DeviceType"), F.lit(None).cast("string").alias("DataType"), F.col("station_id").alias("OriginalStationID9"),
        F.lit("T").alias("TableName"), F.lit("I").alias("ID"), F.lit("-").alias("StationName"), F.col("seq").cast("string").alias("LocationMemo"),
        F.date_format(at, "yyyy/MM/dd HH:mm:ss").alias("LastData_DT"),
        F.concat(
            F.lit("[WS_AVG]="), F.coalesce(F.col("wind_speed").cast("string"), F.lit("-")), F.lit(",Tide_Value="), F.coalesce(F.col("tide_level").cast("string"), F.lit("-"))
        ).alias("LastData_Str"),
        later.alias("Y112_LastData_DT"), F.when(F.col("k") % 2 == 1, "WS_AVG=77.0").otherwise("-").alias("Y112_LastData_Str"),
        F.lit("").alias("Y113_Wind15minData_DT"), F.lit("WS_AVG=99.0").alias("Y113_Wind15minData_Str"), F.lit(FETCHED).cast("timestamp").alias("fetched_at"),
    )
    out = payloads.normalize_panel(rows, "fetched_at")
    return out.select("station_id", "device_type", ts("obs_time").alias("obs_time"), "wind_speed", "tide_level", F.col("location").cast("long").alias("seq"))


@query(
    "src17_panel_text",
    with_views(
        f"""SELECT seq, 'KHWD0' || (k % 5) AS station_id, 'KHWD0' || (k % 5) || CASE WHEN silent THEN 'M10' ELSE 'M01' END AS raw_station_ref,
              CASE WHEN silent THEN '2020-01-01 00:00:00' ELSE {tsql('obs_time')} END AS obs_time, CASE WHEN silent THEN 1.0::DOUBLE ELSE wind_speed END AS wind_speed, wind_gust, wind_gust IS NULL AS missing_gust
            FROM (SELECT *, wind_speed IS NULL AND wind_gust IS NULL AS silent FROM clean)
            UNION ALL SELECT seq, 'KHWD07', 'KHWD07', {tsql('obs_time')}, 5.5::DOUBLE, 8.5::DOUBLE, FALSE FROM clean""",
        "clean",
    ),
)
def _(v):
    station = F.concat(F.lit("KHWD0"), (F.col("k") % 5).cast("string"))
    stamp = F.date_format("obs_time", "yyyy/MM/dd HH:mm:ss")
    gust = F.when(F.col("wind_gust").isNotNull(), F.concat(F.lit("; WS_MAX="), F.format_string("%.6f", F.col("wind_gust")))).otherwise("")
    page = F.concat(
        F.lit("<td>Panel</td><b>"), station, F.lit("M01</b><i>WS_AVG="), F.when(F.col("wind_speed").isNull(), "-").otherwise(F.format_string("%.6f", F.col("wind_speed"))), gust, F.lit("; MAX_T="), stamp, F.lit("</i> "),
        station, F.lit("M10 WS_AVG=1.0; MAX_T=2020/01/01 00:00:00 KHWD07 WS_AVG = 5.5 WS_MAX = 8.5 "), stamp,
    )
    docs = v.clean.select("seq", page.alias("page"))
    out = payloads.parse_panel_text(docs, "page", [f"KHWD0{i}" for i in (0, 1, 2, 3, 4, 7)], "seq")
    exact = v.clean.select("seq", F.col("wind_speed").alias("_s"), F.col("wind_gust").alias("_g"))
    joined = out.join(exact, "seq")

    def near(found, told):
        """The text has six decimals: a value that close is the one told, and a missing one stays missing."""
        return F.coalesce(F.abs(F.col(found) - F.col(told)) < 1e-6, F.col(found).isNull() & F.col(told).isNull()) & (F.col("station_id") != "KHWD07")

    return joined.select(
        "seq", "station_id", "raw_station_ref", F.date_format("obs_time", "yyyy-MM-dd HH:mm:ss").alias("obs_time"), F.when(near("wind_speed", "_s"), F.col("_s")).otherwise(F.col("wind_speed")).alias("wind_speed"),
        F.when(near("wind_gust", "_g"), F.col("_g")).otherwise(F.col("wind_gust")).alias("wind_gust"), (F.col("quality_flag") == "missing_gust").alias("missing_gust"),
    )


@query(
    "src18_forecast_payload",
    with_views(
        f"""SELECT target_area AS location_name, {tsql('start_ts')} AS start_ts, {tsql('end_ts')} AS end_ts, pop, CAST(seq % 11 AS DOUBLE) AS wind_speed_mps, CAST(seq % 9 AS INT) AS beaufort_scale_min FROM periods""",
        "periods",
    ),
)
def _(v):
    def fmt(c):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")

    def element(name, value):
        return F.struct(F.lit(name).alias("ElementName"), F.array(F.struct(fmt("start_ts").alias("StartTime"), fmt("end_ts").alias("EndTime"), F.array(value).alias("ElementValue"))).alias("Time"))

    rain = F.struct(F.nullif(F.regexp_replace("raw_value", "%", ""), F.lit("")).alias("ProbabilityOfPrecipitation"), F.lit(None).cast("string").alias("WindSpeed"), F.lit(None).cast("string").alias("BeaufortScale"))
    wind = F.struct(F.lit(None).cast("string").alias("ProbabilityOfPrecipitation"), (F.col("seq") % 11).cast("string").alias("WindSpeed"), F.concat(F.lit(">= "), (F.col("seq") % 9).cast("string")).alias("BeaufortScale"))
    located = F.struct(F.col("target_area").alias("LocationName"), F.array(element("PoP3h", rain), element("風速", wind)).alias("WeatherElement"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(located).alias("Location"))).alias("Locations")).alias("records")))
    out = payloads.flatten_forecast(periods(v).select(body.alias("body")), "body", zone=UTC)
    return out.select("location_name", ts("start_ts").alias("start_ts"), ts("end_ts").alias("end_ts"), "pop", "wind_speed_mps", "beaufort_scale_min")


@query(
    "src19_latest_release",
    with_views(
        f"""SELECT a.target_area, {tsql('a.obs_time')} AS obs_time, {tsql('r.fetched_at')} AS released_at, r.pop FROM area_half a ASOF LEFT JOIN (
            SELECT target_area, start_ts + INTERVAL 90 MINUTE AS fetched_at, pop FROM periods) r ON a.target_area = r.target_area AND a.obs_time >= r.fetched_at""",
        "area_half", "periods",
    ),
)
def _(v):
    releases = periods(v).select("target_area", (F.col("start_ts") + F.expr("interval 90 minutes")).alias("fetched_at"), "pop")
    out = store.latest_release(v.area_half.select("target_area", "obs_time"), releases, ["target_area"], "obs_time", ["pop"])
    return out.select("target_area", ts("obs_time").alias("obs_time"), ts("released_at").alias("released_at"), "pop")


POOL = {
    "priority_groups": {
        "nearby": {"priority": 2, "stations": [{"station_id": "S04", "name": "Hillside"}, {"station_id": "S05", "name": "River Mouth", "enabled": False}]},
        "port_local": {"priority": 1, "stations": [{"station_id": "S00", "name": "Inner Pier", "is_port_local": True}, {"station_id": "S01", "name": "Fishing Port", "is_port_local": True}]},
        "cwa_forecast_auxiliary": {"priority": 0, "stations": [{"station_id": "S02", "name": "Second Gate"}]},
    }
}


@query(
    "src20_station_pool",
    with_views(
        """SELECT station_id, p.name, p.priority_group, p.priority, p.is_port_local, COUNT(*) AS n_rows FROM obs JOIN (SELECT * FROM (VALUES ('S00', 'Inner Pier', 'port_local', 1, TRUE), ('S01', 'Fishing Port', 'port_local', 1, TRUE), ('S04', 'Hillside', 'nearby', 2, FALSE))
           t(station_id, name, priority_group, priority, is_port_local)) p USING (station_id) GROUP BY ALL""",
        "obs",
    ),
)
def _(v):
    pool = stations.station_pool(v.spark, POOL).select("station_id", "name", "priority_group", "priority", "is_port_local")
    counts = v.obs.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(pool, "station_id").select("station_id", "name", "priority_group", "priority", "is_port_local", "n_rows")


@query(
    "src21_nearest_vector",
    with_views(
        f"""SELECT day, """
        + ", ".join(f"coalesce(MAX(CASE WHEN rn = {i} THEN p END), 0) AS nearby_precip_{i}" for i in (1, 2, 3))
        + f""", 1.0::DOUBLE AS nearby_available FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY km, station_id) AS rn FROM (
            SELECT strftime(obs_time, '%Y-%m-%d') AS day, station_id, MAX(precipitation_1hr) AS p, round(MIN({haversine_sql('22.6', '120.3', 'latitude', 'longitude', 6371.0)}), 2) AS km FROM clean JOIN station USING (station_id) GROUP BY ALL) WHERE km <= 12) GROUP BY day""",
        "clean", "station",
    ),
)
def _(v):
    from skywharf.functions.geo import haversine_km

    km = F.round(haversine_km(F.lit(22.6), F.lit(120.3), F.col("latitude"), F.col("longitude")), 2)
    near = v.station.select("station_id", km.alias("km")).filter("km <= 12")
    daily = v.clean.groupBy(F.date_format("obs_time", "yyyy-MM-dd").alias("day"), "station_id").agg(F.max("precipitation_1hr").alias("p"))
    return ranking.nearest_vector(daily.join(near, "station_id"), ["day"], ["km", "station_id"], "p")


@query(
    "src22_history_union",
    with_views(
        f"""SELECT source, station_id, {tsql('obs_time')} AS obs_time, wind_speed, tide_level FROM (SELECT 'land' AS source, station_id, obs_time, wind_speed, NULL::DOUBLE AS tide_level FROM clean
            UNION ALL SELECT 'marine', station_id, obs_time, NULL, tide_level FROM clean) WHERE obs_time >= TIMESTAMP '2024-01-12 00:00:00'""",
        "clean",
    ),
)
def _(v):
    land, marine = v.clean.select("station_id", "obs_time", "wind_speed"), v.clean.select("station_id", "obs_time", "tide_level")
    return store.history({"land": land, "marine": marine}, "2024-01-12 00:00:00").withColumn("obs_time", ts("obs_time")).select("source", "station_id", "obs_time", "wind_speed", "tide_level")


@query(
    "src23_qpe_series",
    with_views(
        f"""SELECT station_id, {tsql('obs_time - to_hours(h)')} AS obs_time, coalesce(precipitation_1hr, 0) AS qpe_1hr_mm FROM latest, (SELECT CAST(range AS INT) AS h FROM range(1, 13)) g""",
        "latest",
    ),
)
def _(v):
    newest = latest(v).select("station_id", "obs_time", F.col("precipitation_1hr").alias("qpe_1hr_mm"))
    return payloads.qpe_series(newest, ["station_id"]).withColumn("obs_time", ts("obs_time"))


@query(
    "src23_qpf_anchors",
    with_views(
        "SELECT station_id, day, " + ", ".join(f"coalesce(MAX(CASE WHEN o = {m} THEN p END), 0) AS qpf_{m}min_mm" for m in (30, 60, 90, 120))
        + " FROM (SELECT station_id, strftime(obs_time, '%Y-%m-%d') AS day, (k % 5) * 30 AS o, precipitation_1hr AS p FROM clean) GROUP BY station_id, day",
        "clean",
    ),
)
def _(v):
    forecasts = v.clean.select("station_id", F.date_format("obs_time", "yyyy-MM-dd").alias("day"), ((F.col("k") % 5) * 30).alias("offset_minutes"), F.col("precipitation_1hr").alias("precipitation"))
    return payloads.qpf_anchors(forecasts, ["station_id", "day"])
