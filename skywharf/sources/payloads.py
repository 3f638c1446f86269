"""Flattening of service payloads: JSON, XML, key-value rows and panel text.

Each reader takes a DataFrame of payload texts, parses them with a superset
schema and explodes the nested arrays; nothing runs row by row in Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywharf.functions.text import key_values, local_time, meridiem_time, number_or_null
from skywharf.functions.wind import beaufort_from_text
from skywharf.schema import PANEL_SENTINELS

STALE_SECONDS = 20 * 60


def present(*columns: Column) -> Column:
    """First text that is neither empty nor a dash."""
    return F.coalesce(*[F.when(~c.isin("", "-"), c) for c in columns])


def first_number(*columns: Column) -> Column:
    return F.coalesce(*[number_or_null(c) for c in columns])


# --- current weather JSON -------------------------------------------------

# Where each measure may be found, and its label in list form.
CURRENT_FIELDS = {
    "wind_speed": (["WindSpeed", "WeatherElement.WindSpeed"], ["WindSpeed", "風速"]),
    "wind_direction": (["WindDirection", "WeatherElement.WindDirection"], ["WindDirection", "風向"]),
    "wind_gust": (["GustInfo.PeakGustSpeed", "WeatherElement.GustInfo.PeakGustSpeed", "WeatherElement.PeakGustSpeed"], ["PeakGustSpeed", "GustSpeed", "最大陣風"]),
    "precipitation_10min": (["Precipitation10Min", "WeatherElement.Past10Min.Precipitation"], ["Precipitation10Min", "Past10Min", "10分鐘雨量"]),
    "precipitation_1hr": (["Precipitation1hr", "WeatherElement.Now.Precipitation", "WeatherElement.Past1hr.Precipitation"], ["Precipitation1hr", "Past1hr", "Precipitation", "1小時雨量", "降水量"]),
    "precipitation_24hr": (["Precipitation24hr", "WeatherElement.Past24hr.Precipitation"], ["Precipitation24hr", "Past24hr", "24小時雨量"]),
    "air_temperature": (["AirTemperature", "WeatherElement.AirTemperature"], ["AirTemperature", "Temperature", "氣溫"]),
    "relative_humidity": (["RelativeHumidity", "WeatherElement.RelativeHumidity"], ["RelativeHumidity", "Humidity", "相對濕度"]),
    "air_pressure": (["AirPressure", "WeatherElement.AirPressure"], ["AirPressure", "Pressure", "測站氣壓"]),
    "visibility": (["Visibility", "WeatherElement.Visibility"], ["Visibility", "能見度"]),
}


def flatten_current(df: DataFrame, payload: str, fetched_at: str, names: Sequence[str] = (), counties: Sequence[str] = (), zone: str = "Asia/Taipei") -> DataFrame:
    """One row per station of current-weather payloads.

    The text is parsed once into a variant and fields are read by path, so
    spellings that differ only in case stay apart. Substring filters on name
    and county; stale when older than 20 minutes at fetch.
    """
    document = F.try_parse_json(F.col(payload))
    paths = ["$.records.Station", "$.records.station", "$.records.location", "$.records.Location", "$.Station", "$.data"]
    items = F.explode(F.coalesce(*[F.try_variant_get(F.col("_doc"), p, "array<variant>") for p in paths]))

    def text(*fields: str) -> Column:
        return present(*[F.try_variant_get("_s", f"$.{f}", "string") for f in fields])

    def listed(*labels: str) -> Column:
        """Value of a named entry when elements come as a list of name and value."""
        return present(*[F.element_at("_listed", label) for label in labels])

    parsed = df.select(F.col(fetched_at).alias("fetched_at"), document.alias("_doc"))
    entries = F.try_variant_get("_s", "$.weatherElement", "array<struct<elementName:string,elementValue:string>>")
    rows = parsed.select("fetched_at", items.alias("_s")).withColumn(
        "_listed", F.map_from_entries(F.coalesce(entries, F.array().cast("array<struct<elementName:string,elementValue:string>>")))
    )
    # Texts first, conversions second: each text is located once.
    texts = rows.select(
        "fetched_at",
        text("StationId", "StationID", "stationId", "locationId", "LocationId").alias("station"),
        text("StationName", "stationName", "locationName", "LocationName").alias("name"),
        text("GeoInfo.CountyName", "CountyName", "countyName").alias("_county"),
        text("GeoInfo.TownName", "TownName", "townName").alias("town"),
        text("ObsTime.DateTime", "obsTime.DateTime", "obsTime", "time", "DateTime").alias("time"),
        text("StationLongitude", "longitude", "GeoInfo.StationLongitude", "GeoInfo.Coordinates[0].StationLongitude").alias("longitude"),
        text("StationLatitude", "latitude", "GeoInfo.StationLatitude", "GeoInfo.Coordinates[0].StationLatitude").alias("latitude"),
        *[F.coalesce(text(*fields), listed(*labels)).alias(measure) for measure, (fields, labels) in CURRENT_FIELDS.items()],
    )
    out = texts.select(
        F.lit("cwa").alias("source"), F.coalesce("station", "name").alias("station_id"), F.coalesce("name", "station").alias("station_name"),
        F.coalesce("town", "_county").alias("location"), "_county", F.lit("WEATHER").alias("device_type"),
        F.coalesce(local_time(F.col("time"), zone), F.col("fetched_at")).alias("obs_time"),
        number_or_null(F.col("longitude")).alias("longitude"), number_or_null(F.col("latitude")).alias("latitude"),
        *[number_or_null(F.col(measure)).alias(measure) for measure in CURRENT_FIELDS], "fetched_at",
    ).filter(F.col("station_id").isNotNull())
    for wanted, column in ((names, "station_name"), (counties, "_county")):
        if wanted:
            hit = F.lit(False)
            for w in wanted:
                hit = hit | F.col(column).contains(w)
            out = out.filter(F.col(column).isNull() | hit)
    age = F.col("fetched_at").cast("double") - F.col("obs_time").cast("double")
    return out.withColumn("stale", age > STALE_SECONDS).drop("_county")


# --- history XML ----------------------------------------------------------

HISTORY_STATION_SCHEMA = (
    "StationName string, StationId string, ObsTime struct<DateTime:string>, GeoInfo struct<CountyName:string,TownName:string,StationAltitude:string,"
    "Coordinates:array<struct<CoordinateName:string,StationLatitude:string,StationLongitude:string>>>, WeatherElement struct<WindSpeed:string,WindDirection:string,"
    "AirTemperature:string,RelativeHumidity:string,AirPressure:string,Visibility:string,Now:struct<Precipitation:string>,GustInfo:struct<PeakGustSpeed:string,WindDirection:string>>"
)


def read_history_xml(spark, path: str) -> DataFrame:
    """Station elements of history files, read in parallel by row tag."""
    return spark.read.format("xml").option("rowTag", "Station").schema(HISTORY_STATION_SCHEMA).load(path)


def parse_history_xml(df: DataFrame, payload: str) -> DataFrame:
    """Station elements held as one XML text per row."""
    return df.select(F.from_xml(F.col(payload), HISTORY_STATION_SCHEMA).alias("_x")).select("_x.*")


def flatten_history(stations: DataFrame, names: Sequence[str] = (), zone: str = "Asia/Taipei") -> DataFrame:
    """Canonical rows of history stations; a WGS84 coordinate is preferred."""
    element, geo = F.col("WeatherElement"), F.col("GeoInfo")
    wgs = F.filter(geo["Coordinates"], lambda c: c["CoordinateName"] == "WGS84")

    def coordinate(field: str) -> Column:
        return F.coalesce(number_or_null(F.get(wgs, 0)[field]), number_or_null(F.get(geo["Coordinates"], 0)[field]))

    out = stations.select(
        F.lit("cwa_historyapi").alias("source"), F.coalesce("StationId", "StationName").alias("station_id"), F.coalesce("StationName", "StationId").alias("station_name"),
        F.coalesce(geo["TownName"], geo["CountyName"]).alias("location"), local_time(F.col("ObsTime.DateTime"), zone).alias("obs_time"),
        coordinate("StationLongitude").alias("longitude"), coordinate("StationLatitude").alias("latitude"), number_or_null(geo["StationAltitude"]).alias("elevation"),
        number_or_null(element["WindSpeed"]).alias("wind_speed"), number_or_null(element["GustInfo"]["PeakGustSpeed"]).alias("wind_gust"),
        number_or_null(element["WindDirection"]).alias("wind_direction"), number_or_null(element["GustInfo"]["WindDirection"]).alias("wind_gust_direction"),
        number_or_null(element["Now"]["Precipitation"]).alias("precipitation_1hr"), number_or_null(element["AirTemperature"]).alias("air_temperature"),
        number_or_null(element["RelativeHumidity"]).alias("relative_humidity"), number_or_null(element["AirPressure"]).alias("air_pressure"),
        number_or_null(element["Visibility"]).alias("visibility"),
    ).filter(F.col("station_id").isNotNull())
    if names:
        hit = F.lit(False)
        for n in names:
            hit = hit | F.col("station_name").contains(n)
        out = out.filter(hit)
    return out


# --- marine and climate-archive JSON --------------------------------------

MARINE_SCHEMA = (
    "Records struct<SeaSurfaceObs:struct<Location:array<struct<Station:struct<StationID:string,StationName:string>,StationObsTimes:struct<StationObsTime:array<struct<DateTime:string,"
    "WeatherElements:struct<TideHeight:string,WaveHeight:string,WavePeriod:string,Temperature:string,StationPressure:string,PrimaryAnemometer:struct<WindSpeed:string,MaximumWindSpeed:string,WindDirection:string>,"
    "SeaCurrents:struct<Layer:array<struct<CurrentSpeed:string,CurrentDirection:string>>>>>>>>>>>"
)


def flatten_marine(df: DataFrame, payload: str, stations: DataFrame | None = None, wanted: Sequence[str] = (), start: Column | None = None, end: Column | None = None,
                   zone: str = "Asia/Taipei") -> DataFrame:
    """Location x time rows of marine payloads; first current layer; optional station names."""
    parsed = df.select(F.from_json(F.col(payload), MARINE_SCHEMA).alias("_m"))
    located = parsed.select(F.explode("_m.Records.SeaSurfaceObs.Location").alias("_l"))
    if wanted:
        located = located.filter(F.col("_l.Station.StationID").isin(list(wanted)))
    timed = located.select(F.col("_l.Station").alias("_st"), F.explode("_l.StationObsTimes.StationObsTime").alias("_t"))
    element = F.col("_t.WeatherElements")
    wind, layer = element["PrimaryAnemometer"], F.get(element["SeaCurrents"]["Layer"], 0)
    out = timed.select(
        F.lit("cwa_marine_history").alias("source"), F.col("_st.StationID").alias("station_id"), local_time(F.col("_t.DateTime"), zone).alias("obs_time"),
        number_or_null(wind["WindSpeed"]).alias("wind_speed"), number_or_null(wind["MaximumWindSpeed"]).alias("wind_gust"), number_or_null(wind["WindDirection"]).alias("wind_direction"),
        number_or_null(element["TideHeight"]).alias("tide_level"), F.lit("m").alias("tide_level_unit"), number_or_null(element["WaveHeight"]).alias("wave_height"),
        number_or_null(element["WavePeriod"]).alias("wave_period"), number_or_null(layer["CurrentSpeed"]).alias("current_speed"), number_or_null(layer["CurrentDirection"]).alias("current_direction"),
        number_or_null(element["StationPressure"]).alias("air_pressure"),
    ).filter(F.col("obs_time").isNotNull())
    if start is not None:
        out = out.filter(F.col("obs_time") >= start)
    if end is not None:
        out = out.filter(F.col("obs_time") <= end)
    return out if stations is None else out.join(stations, "station_id", "left")


ARCHIVE_PAYLOAD_SCHEMA = (
    "data array<struct<dts:array<struct<DataTime:string,WindSpeed:struct<Mean:string>,WindDirection:struct<Mean:string>,PeakGust:struct<Maximum:string,Direction:string>,"
    "Precipitation:struct<Accumulation:string>,AirTemperature:struct<Instantaneous:string>,RelativeHumidity:struct<Instantaneous:string>,StationPressure:struct<Instantaneous:string>,"
    "Visibility:struct<AutoMean:string,Instantaneous:string>>>>>"
)


def flatten_climate_archive(df: DataFrame, payload: str, station: str, full_hours_only: bool = True, zone: str = "Asia/Taipei") -> DataFrame:
    """data[].dts[] rows, visibility in metres, one row per (station, time): the first of its payload wins."""
    parsed = df.select(F.col(station).alias("station_id"), F.xxhash64(payload).alias("_text"), F.from_json(F.col(payload), ARCHIVE_PAYLOAD_SCHEMA).alias("_p"))
    groups = parsed.select("station_id", "_text", F.posexplode("_p.data").alias("_i", "_d"))
    rows = groups.select("station_id", "_text", "_i", F.posexplode("_d.dts").alias("_j", "_r"))
    kilometres = F.coalesce(number_or_null(F.col("_r.Visibility.AutoMean")), number_or_null(F.col("_r.Visibility.Instantaneous")))
    out = rows.select(
        "station_id", F.struct("_text", "_i", "_j").alias("_place"), local_time(F.col("_r.DataTime"), zone).alias("obs_time"), number_or_null(F.col("_r.WindSpeed.Mean")).alias("wind_speed"),
        number_or_null(F.col("_r.PeakGust.Maximum")).alias("wind_gust"), number_or_null(F.col("_r.WindDirection.Mean")).alias("wind_direction"),
        number_or_null(F.col("_r.Precipitation.Accumulation")).alias("precipitation_1hr"), number_or_null(F.col("_r.AirTemperature.Instantaneous")).alias("air_temperature"),
        number_or_null(F.col("_r.RelativeHumidity.Instantaneous")).alias("relative_humidity"), number_or_null(F.col("_r.StationPressure.Instantaneous")).alias("air_pressure"),
        (kilometres * 1000).alias("visibility"),
    ).filter(F.col("obs_time").isNotNull())
    if full_hours_only:
        out = out.filter(F.minute("obs_time") == 0)
    keys = ["station_id", "obs_time"]
    values = [c for c in out.columns if c not in (*keys, "_place")]
    return out.groupBy(*keys).agg(F.min_by(F.struct(*values), "_place").alias("_v")).select(*keys, "_v.*")


# --- harbour panel rows ---------------------------------------------------

# The three (time, data) column pairs, and metric keys in order of preference.
PANEL_PAIRS = {
    "last": ("LastData_DT", "LastData_Str"),
    "ten": ("Y112_LastData_DT", "Y112_LastData_Str"),
    "fifteen": ("Y113_Wind15minData_DT", "Y113_Wind15minData_Str"),
}
PANEL_METRICS = {
    "wind_speed": ["WS_AVG"],
    "wind_gust": ["WS_MAX"],
    "wind_direction": ["WD_AVG"],
    "wind_gust_direction": ["WD_MAX"],
    "tide_level": ["TideValue", "Tide_Value"],
    "visibility": ["Visibility_Value"],
    "wave_height": ["Hs"],
    "wave_period": ["Tp"],
    "wave_max_height": ["Hmax"],
    "current_speed": ["Velocity", "ADCP_Velocity"],
    "current_direction": ["Vmdir", "ADCP_Vmdir"],
}


def normalize_panel(df: DataFrame, fetched_at: str, wind_mode: int = 1) -> DataFrame:
    """Harbour panel rows with the right (time, data) pair chosen and metrics picked.

    Wind devices prefer the pair of their mode; other devices the newest pair.
    Times are zone-less wall-clock times.
    """
    def text(name: str) -> Column:
        value = F.trim(F.col(name))
        return F.when(~value.isin(PANEL_SENTINELS), value)

    device = F.coalesce(text("DeviceType"), text("DataType"), F.lit("UNKNOWN"))
    is_wind = F.upper(device).contains("WIND")
    preferred = {15: "fifteen", 0: "ten", 10: "ten"}.get(wind_mode, "last")

    def candidate(name: str, rank: Column) -> Column:
        time, data = PANEL_PAIRS[name]
        values = key_values(text(data))
        usable = text(time).isNotNull() & text(data).isNotNull() & (F.size(F.map_keys(values)) > 0)
        return F.when(
            usable,
            F.struct(rank.alias("rank"), meridiem_time(text(time)).alias("time"), F.col(data).alias("raw")),
        )

    oldest = F.lit(0).cast("timestamp").cast("timestamp_ntz")

    def newest_rank(name: str, position: int) -> Column:
        time = F.coalesce(meridiem_time(text(PANEL_PAIRS[name][0])), oldest).cast("timestamp")
        return F.struct((-time.cast("double")).alias("t"), F.lit(position).alias("p"))

    def wind_rank(position: int) -> Column:
        return F.struct(F.lit(0.0).alias("t"), F.lit(position).alias("p"))

    by_wind = F.array(candidate(preferred, wind_rank(0)), candidate("last", wind_rank(1)))
    by_time = F.array(*[candidate(n, newest_rank(n, i)) for i, n in enumerate(PANEL_PAIRS)])
    chosen = F.when(is_wind, F.array_min(F.array_compact(by_wind))).otherwise(F.array_min(F.array_compact(by_time)))
    staged = df.withColumn("_device", device).withColumn("_c", chosen).withColumn("_values", key_values(F.col("_c.raw")))
    station = F.coalesce(text("OriginalStationID9"), text("TableName"), text("ID"), text("StationName"), F.lit("unknown"))
    time = F.coalesce(F.col("_c.time").cast("timestamp"), F.col(fetched_at))
    age = F.col(fetched_at).cast("double") - time.cast("double")

    def metric(keys: list[str]) -> Column:
        return F.coalesce(*[F.element_at("_values", k).try_cast("double") for k in keys])

    return staged.select(
        F.lit("twport").alias("source"), text("PortCode").alias("port_code"), station.alias("station_id"), F.coalesce(text("StationName"), station).alias("station_name"),
        text("LocationMemo").alias("location"), F.col("_device").alias("device_type"), time.alias("obs_time"), *[metric(k).alias(m) for m, k in PANEL_METRICS.items()],
        F.col("_values").alias("raw_data"), F.coalesce("_c.raw", F.lit("")).alias("raw_last_data_str"), (age > STALE_SECONDS).alias("stale"),
    )


# Patterns of the realtime panel text.
PANEL_VALUE = r"\s*=\s*(-?\d+(?:\.\d+)?)"
PANEL_TIME = r"(\d{4}[/-]\d{1,2}[/-]\d{1,2}(?:\s*[^\d\s]{0,4}\s*)?\d{1,2}:\d{2}(?::\d{2})?)"


def parse_panel_text(df: DataFrame, document: str, station_ids: Sequence[str], doc_id: str | None = None, station_pattern: str = r"KHWD\d{2}[A-Z0-9]*") -> DataFrame:
    """Best record per station (and document) in free panel text.

    Text is cut at every station reference; each piece holds one reference
    and its values, however long. The newest, then the most complete record
    wins, and of equal ones the first. A small file of many texts is dealt out
    first: reading a text costs far more than moving it.
    """
    groups = [doc_id] if doc_id else []
    spread = df.select(*groups, F.col(document).alias("_text")).repartition(*groups, "_text")
    plain = F.regexp_replace("_text", r"<[^>]+>|[\r;\t]+", "\n")
    # No tab is left in the text, so a tab can stand before every reference; what precedes the first is no record.
    pieces = F.split(F.regexp_replace(plain, rf"\b(?:{station_pattern})", "\t$0"), "\t")
    cut = spread.select(*groups, F.posexplode(pieces).alias("_place", "_piece")).filter("_place > 0")
    reference = F.regexp_extract("_piece", rf"^({station_pattern})", 1)

    def number(key: str) -> Column:
        return F.regexp_extract("_piece", key + PANEL_VALUE, 1).try_cast("double")

    named = F.regexp_extract("_piece", r"MAX_T\s*=\s*" + PANEL_TIME, 1)
    stamp = F.when(named != "", named).otherwise(F.regexp_extract("_piece", PANEL_TIME, 1))
    station = F.coalesce(*[F.when(F.col("raw_station_ref").startswith(s), F.lit(s)) for s in station_ids])
    read = cut.select(*groups, "_place", "_piece", reference.alias("raw_station_ref"), number("WS_AVG").alias("wind_speed"), number("WS_MAX").alias("wind_gust"))
    rows = read.select("*", station.alias("station_id"), stamp.alias("_stamp")).select(
        *groups, "_place", "station_id", "raw_station_ref", meridiem_time(F.col("_stamp")).alias("obs_time"), "wind_speed",
        number("WD_AVG").alias("wind_direction"), "wind_gust", number("WD_MAX").alias("wind_gust_direction"),
    ).filter(F.col("station_id").isNotNull() & (F.col("wind_speed").isNotNull() | F.col("wind_gust").isNotNull()))
    flagged = rows.withColumn(
        "quality_flag", F.when(F.col("wind_gust").isNull(), "missing_gust").when(F.col("obs_time").isNull(), "degraded").otherwise("ok")
    )
    measures = ["wind_speed", "wind_direction", "wind_gust", "wind_gust_direction"]
    complete = sum((F.col(m).isNotNull().cast("int") for m in measures), F.lit(0))
    suffix = F.when(F.col("raw_station_ref").endswith("M01"), 2).when(F.col("raw_station_ref").endswith("M10"), 1).otherwise(0)
    rank = F.struct(F.coalesce(F.col("obs_time").cast("timestamp").cast("double"), F.lit(-1.0)).alias("t"), complete.alias("n"), suffix.alias("s"), (-F.col("_place")).alias("p"))
    best = flagged.groupBy(*groups, "station_id").agg(F.max_by(F.struct("raw_station_ref", "obs_time", *measures, "quality_flag"), rank).alias("_b"))
    return best.select(*groups, "station_id", "_b.*")


# --- forecasts ------------------------------------------------------------

# Element names of the two forecast quantities.
POP_ELEMENTS = ["PoP3h", "ProbabilityOfPrecipitation", "3小時降雨機率"]
WIND_ELEMENTS = ["WindSpeed", "風速"]
FORECAST_SCHEMA = (
    "records struct<Locations:array<struct<Location:array<struct<LocationName:string,WeatherElement:array<struct<ElementName:string,Time:array<struct<StartTime:string,EndTime:string,DataTime:string,"
    "ElementValue:array<struct<ProbabilityOfPrecipitation:string,PoP3h:string,Value:string,WindSpeed:string,BeaufortScale:string>>>>>>>>>>>"
)


def flatten_forecast(df: DataFrame, payload: str, carry: Sequence[str] = (), zone: str = "Asia/Taipei") -> DataFrame:
    """One row per (location, period) with probability and wind text.

    Location, element and time arrays are exploded in turn; items with only a
    DataTime cover one hour. Quantities of one period meet in one aggregation:
    of a period listed more than once the last item wins, the last one with a
    number for the probability, with all values of that item.
    """
    parsed = df.select(*carry, F.xxhash64(payload).alias("_text"), F.from_json(F.col(payload), FORECAST_SCHEMA).alias("_f"))
    located = parsed.select(*carry, "_text", F.posexplode("_f.records.Locations").alias("_i", "_g")).select(*carry, "_text", "_i", F.posexplode("_g.Location").alias("_j", "_l"))
    elements = located.select(*carry, "_text", "_i", "_j", F.col("_l.LocationName").alias("location_name"), F.posexplode("_l.WeatherElement").alias("_k", "_e"))
    items = elements.select(
        *carry, "_text", "_i", "_j", "_k", "location_name", F.col("_e.ElementName").alias("_name"), F.posexplode("_e.Time").alias("_n", "_t")
    ).withColumn("_place", F.struct("_text", "_i", "_j", "_k", "_n"))
    start = local_time(F.coalesce("_t.StartTime", "_t.DataTime"), zone)
    end = F.coalesce(local_time(F.col("_t.EndTime"), zone), start + F.expr("interval 1 hour"))
    value = F.get(F.col("_t.ElementValue"), 0)
    raw_pop = F.coalesce(value["ProbabilityOfPrecipitation"], value["PoP3h"], value["Value"])
    percent = F.trim(F.regexp_replace(raw_pop, "%", "")).try_cast("double")
    pop = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(percent > 1, percent / 100).otherwise(percent)))
    wind_text = F.coalesce(value["WindSpeed"], value["Value"])
    is_pop, is_wind = F.col("_name").isin(POP_ELEMENTS), F.col("_name").isin(WIND_ELEMENTS)
    flat = items.select(
        *carry, "location_name", "_place", start.alias("start_ts"), end.alias("end_ts"), is_pop.alias("_is_pop"), is_wind.alias("_is_wind"),
        F.struct(raw_pop.alias("raw_value"), F.when(percent.isNotNull(), pop).alias("pop")).alias("_pop"),
        F.struct(
            wind_text.alias("wind_speed_text"), F.trim(wind_text).try_cast("double").alias("wind_speed_mps"), value["BeaufortScale"].alias("beaufort_scale_text"),
            beaufort_from_text(F.coalesce(value["BeaufortScale"], wind_text)).alias("beaufort_scale_min"),
        ).alias("_wind"),
    ).filter(F.col("start_ts").isNotNull())
    numbered = F.struct(F.col("_pop.pop").isNotNull(), "_place")
    return flat.groupBy(*carry, "location_name", "start_ts", "end_ts").agg(
        F.max_by("_pop", F.when(F.col("_is_pop"), numbered)).alias("_pop"), F.max_by("_wind", F.when(F.col("_is_wind"), F.col("_place"))).alias("_wind"),
    ).select(*carry, "location_name", "start_ts", "end_ts", "_pop.*", "_wind.*")


# Rain forecast offsets in minutes.
QPF_OFFSETS = [30, 60, 90, 120]


def qpe_series(latest: DataFrame, keys: Sequence[str], hours: int = 12, at: str = "obs_time") -> DataFrame:
    """Hourly grid before the latest estimate, filled with it; missing amounts are 0."""
    steps = F.sequence(F.lit(hours), F.lit(1), F.lit(-1))
    grid = latest.withColumn("_h", F.explode(steps))
    return grid.select(
        *keys, (F.col(at) - F.make_dt_interval(hours=F.col("_h"))).alias(at),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("qpe_1hr_mm", "qpe_3hr_mm") if c in latest.columns],
    )


def qpf_anchors(forecasts: DataFrame, keys: Sequence[str], offset: str = "offset_minutes", amount: str = "precipitation") -> DataFrame:
    """Forecast amounts at the four anchor offsets as columns."""
    return forecasts.groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col(offset) == m, F.col(amount))), F.lit(0.0)).alias(f"qpf_{m}min_mm") for m in QPF_OFFSETS]
    )
