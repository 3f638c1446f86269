"""Scalar rules applied to every observation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skywharf.catalog.registry import query
from skywharf.catalog.views import r, ts, tsql, with_views
from skywharf.functions import clock, geo, text, weather, wind
from skywharf.plans.dims import lookup
from skywharf.schema import (
    ACTION_BY_LEVEL_HIGH_RELIABILITY,
    ACTION_BY_LEVEL_LOW_RELIABILITY,
    ACTION_LABELS,
    ACTION_TEXTS,
    BEAUFORT_LOWER,
    BEAUFORT_NAMES,
    LOW_RELIABILITY,
    OPERATION_LABELS,
    RELIABILITY,
)
from skywharf.operators import decisions

TWO_PI = repr(2 * math.pi)


def case_levels(value: str, thresholds: dict[str, float]) -> str:
    """SQL for the strongest threshold reached; null stays null."""
    arms = " ".join(
        f"WHEN {value} >= {limit} THEN '{name}'"
        for name, limit in sorted(thresholds.items(), key=lambda kv: -kv[1])
    )
    return f"CASE {arms} WHEN {value} IS NOT NULL THEN 'normal' END"


SPEED_T = {"watch": 8.0, "warning": 10.8, "high_risk": 13.9, "stop": 17.2}
GUST_T = {"watch": 10.8, "warning": 13.9, "high_risk": 17.2, "stop": 30.0}
RAIN_T = {"watch": 0.3, "warning": 0.5, "high_risk": 0.7}


def speed_sql(value: str) -> str:
    return case_levels(value, SPEED_T)


def gust_sql(value: str, buffer: float = 1.2) -> str:
    return case_levels(f"({value} + {buffer})", GUST_T)


def rain_sql(value: str) -> str:
    return case_levels(f"greatest(0.0, least(1.0, {value}))", RAIN_T)


def map_sql(key: str, mapping: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {key} = '{k}' THEN {v if not isinstance(v, str) else chr(39) + v + chr(39)}" for k, v in mapping.items())
    return f"CASE {arms} ELSE {default} END"


def beaufort_sql(value: str) -> str:
    arms = " ".join(f"WHEN {value} >= {BEAUFORT_LOWER[n]} THEN {n}" for n in range(12, 0, -1))
    return f"CASE WHEN {value} IS NULL THEN NULL {arms} ELSE 0 END"


def cycle_sql(position: str, period: float, prefix: str) -> str:
    angle = f"{TWO_PI} * ({position}) / {period}"
    return f"round(sin({angle}), 9) AS {prefix}_sin, round(cos({angle}), 9) AS {prefix}_cos"


HOUR_SQL = "(hour(obs_time) + minute(obs_time) / 60.0)"


@query(
    "fn01_cyclic_time",
    with_views(
        f"""SELECT seq, {cycle_sql(HOUR_SQL, 24.0, 'hour')}, {cycle_sql('dayofyear(obs_time)', 365.0, 'doy')},
            {cycle_sql('month(obs_time)', 12.0, 'month')},
            {cycle_sql('dayofyear(obs_time)', 366.0, 'doy366')}, {cycle_sql('hour(obs_time)', 24.0, 'whole_hour')}
            FROM obs""",
        "obs",
    ),
)
def _(v):
    at = F.col("obs_time")
    cols = clock.cyclic_time(at)
    area = clock.cyclic_time(at, 366.0, month=False)
    cols |= {"doy366_sin": area["doy_sin"], "doy366_cos": area["doy_cos"]}
    whole = clock.cyclic_time(at, with_minutes=False)
    cols |= {"whole_hour_sin": whole["hour_sin"], "whole_hour_cos": whole["hour_cos"]}
    return v.obs.select("seq", *[r(c).alias(n) for n, c in cols.items()])


@query(
    "fn02_tidal_phase",
    with_views(f"SELECT seq, {cycle_sql('hour(obs_time) * 60 + minute(obs_time)', 745.0, 'tide')} FROM obs", "obs"),
)
def _(v):
    return v.obs.select("seq", *[r(c).alias(n) for n, c in clock.tidal_phase(F.col("obs_time")).items()])


@query(
    "fn03_special_periods",
    with_views(
        """SELECT seq, CAST(hour(obs_time) >= 18 OR hour(obs_time) < 6 AS INT) AS is_night,
           CAST(hour(obs_time) >= 4 AND hour(obs_time) < 8 AS INT) AS is_dawn,
           CAST(hour(obs_time) >= 13 AND hour(obs_time) < 17 AS INT) AS is_afternoon,
           CAST(month(obs_time) >= 5 AND month(obs_time) <= 11 AS INT) AS is_typhoon_season FROM obs""",
        "obs",
    ),
)
def _(v):
    return v.obs.select("seq", *[c.alias(n) for n, c in clock.special_periods(F.col("obs_time")).items()])


@query(
    "fn04_season",
    """SELECT o_orderkey, season, CASE season WHEN 'spring' THEN 1.0 WHEN 'summer' THEN 2.0 WHEN 'autumn' THEN 3.0
              WHEN 'winter' THEN 4.0 WHEN 'typhoon' THEN 5.0 END::DOUBLE AS season_code, calendar_season
       FROM (SELECT o_orderkey,
              CASE WHEN month(o_orderdate) BETWEEN 6 AND 10 THEN 'typhoon'
                   WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring' WHEN month(o_orderdate) = 11 THEN 'autumn'
                   ELSE 'winter' END AS season,
              CASE WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer'
                   WHEN month(o_orderdate) IN (9, 10, 11) THEN 'autumn' ELSE 'winter' END AS calendar_season
             FROM orders)""",
)
def _(v):
    at = F.col("o_orderdate")
    name = clock.season(at, typhoon_months=[6, 7, 8, 9, 10])
    return v.table("orders").select(
        "o_orderkey", name.alias("season"), clock.season_code(name).alias("season_code"),
        clock.season(at).alias("calendar_season"),
    )


@query(
    "fn05_wind_vector",
    with_views(
        """SELECT seq, round(-wind_speed * sin(radians(wind_direction)), 9) AS wind_u,
           round(-wind_speed * cos(radians(wind_direction)), 9) AS wind_v FROM clean""",
        "clean",
    ),
)
def _(v):
    s, d = F.col("wind_speed"), F.col("wind_direction")
    return v.clean.select("seq", r(wind.wind_u(s, d)).alias("wind_u"), r(wind.wind_v(s, d)).alias("wind_v"))


@query(
    "fn06_angle_wrap",
    with_views(
        """SELECT seq, round((wind_gust_direction - wind_direction + 180)
             - 360 * floor((wind_gust_direction - wind_direction + 180) / 360) - 180, 9) AS turn FROM obs""",
        "obs",
    ),
)
def _(v):
    return v.obs.select("seq", r(wind.wrap_angle(F.col("wind_gust_direction") - F.col("wind_direction"))).alias("turn"))


DEW_GAMMA = "(ln(greatest(1e-6, least(100.0, relative_humidity)) / 100.0) + 17.625 * temperature / (243.04 + temperature))"


@query(
    "fn07_dew_point",
    with_views(f"SELECT seq, round(243.04 * {DEW_GAMMA} / (17.625 - {DEW_GAMMA}), 9) AS dew_point FROM obs", "obs"),
)
def _(v):
    return v.obs.select("seq", r(weather.dew_point(F.col("temperature"), F.col("relative_humidity"))).alias("dew_point"))


def haversine_sql(lat1, lon1, lat2, lon2, radius):
    return (
        f"{2 * radius} * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2)))"
    )


@query(
    "fn08_haversine",
    with_views(
        f"""SELECT seq, station_id, round({haversine_sql('latitude', 'longitude', '22.6', '120.3', 6371.0)}, 6) AS km,
            round({haversine_sql('latitude', 'longitude', '22.6', '120.3', 6371.0088)}, 6) AS km_mean_radius
            FROM obs JOIN station USING (station_id)""",
        "obs", "station",
    ),
)
def _(v):
    args = [F.col("latitude"), F.col("longitude"), F.lit(22.6), F.lit(120.3)]
    return v.obs.select("seq", "station_id").join(v.station, "station_id").select(
        "seq", "station_id", r(geo.haversine_km(*args), 6).alias("km"),
        r(geo.haversine_km(*args, radius=geo.EARTH_RADIUS_KM + 0.0088), 6).alias("km_mean_radius"),
    )


BEAUFORT_NAME_SQL = "list_extract([" + ", ".join(f"'{n}'" for n in BEAUFORT_NAMES) + "], beaufort + 1)"


@query(
    "fn09_beaufort",
    with_views(
        f"""SELECT seq, CAST(beaufort AS INT) AS beaufort, {BEAUFORT_NAME_SQL} AS beaufort_name,
            CAST(CASE WHEN k % 3 = 0 THEN k % 13 WHEN k % 3 = 1 THEN k % 9 ELSE k % 10 END AS INT) AS text_scale,
            {case_levels('CASE WHEN k % 3 = 0 THEN k % 13 WHEN k % 3 = 1 THEN k % 9 ELSE k % 10 END',
                         {'stop': 8, 'high_risk': 7, 'warning': 6, 'watch': 5})} AS text_level
            FROM (SELECT *, {beaufort_sql('wind_speed')} AS beaufort FROM obs)""",
        "obs",
    ),
)
def _(v):
    k = F.col("k")
    label = (
        F.when(k % 3 == 0, F.concat(F.lit(">="), (k % 13).cast("string")))
        .when(k % 3 == 1, F.concat((k % 9).cast("string"), F.lit("-"), (k % 9 + 1).cast("string"), F.lit("級")))
        .otherwise(F.concat((k % 10).cast("string"), F.lit(" 級")))
    )
    number = wind.beaufort(F.col("wind_speed"))
    scale = wind.beaufort_from_text(label)
    return v.obs.select(
        "seq", number.alias("beaufort"), wind.beaufort_name(number).alias("beaufort_name"),
        scale.alias("text_scale"), wind.level_from_beaufort(scale).alias("text_level"),
    )


@query(
    "fn10_wind_levels",
    with_views(
        f"""SELECT seq, {speed_sql('wind_speed')} AS wind_level, {gust_sql('wind_gust')} AS gust_level,
            {gust_sql('wind_gust', 0.0)} AS gust_level_plain, {rain_sql('(k / 80.0 - 0.1)')} AS rain_level,
            {case_levels('wind_speed', {**SPEED_T, 'watch': 5.0})} AS wind_level_custom FROM clean""",
        "clean",
    ),
)
def _(v):
    return v.clean.select(
        "seq", wind.wind_speed_level(F.col("wind_speed")).alias("wind_level"),
        wind.wind_gust_level(F.col("wind_gust")).alias("gust_level"),
        wind.wind_gust_level(F.col("wind_gust"), buffer=0.0).alias("gust_level_plain"),
        weather.rain_probability_level(F.col("k") / 80.0 - 0.1).alias("rain_level"),
        wind.wind_speed_level(F.col("wind_speed"), {"watch": 5.0}).alias("wind_level_custom"),
    )


def amount_sql(value: str, hours: int) -> str:
    arms = ""
    if hours >= 3:
        arms = f"WHEN {value} >= 200 THEN '大豪雨' WHEN {value} >= 100 THEN '豪雨' "
    return f"CASE {arms}WHEN {value} >= 40 THEN '大雨' WHEN {value} >= 1 THEN '小雨' WHEN {value} IS NOT NULL THEN '無' END"


@query(
    "fn11_rain_amount_level",
    with_views(
        f"""SELECT seq, {amount_sql('value', 1)} AS level_1h, {amount_sql('value', 3)} AS level_3h,
            'not_applicable' AS level_24h FROM obs""",
        "obs",
    ),
)
def _(v):
    amount = F.col("value")
    return v.obs.select("seq", *[weather.rain_amount_level(amount, h).alias(f"level_{h}h") for h in (1, 3, 24)])


@query(
    "fn12_operation_detail",
    with_views(
        f"""SELECT seq, speed_level, {map_sql('speed_level', OPERATION_LABELS)} AS speed_label,
            CAST({beaufort_sql('wind_speed')} AS INT) AS speed_beaufort,
            gust_level, {map_sql('gust_level', OPERATION_LABELS)} AS gust_label,
            gust_level <> gust_plain AS buffer_applied, gust_plain AS level_without_buffer
            FROM (SELECT *, {speed_sql('wind_speed')} AS speed_level, {gust_sql('wind_gust')} AS gust_level,
                  {gust_sql('wind_gust', 0.0)} AS gust_plain FROM clean)""",
        "clean",
    ),
)
def _(v):
    both = v.clean.select(
        "seq", wind.speed_operation(F.col("wind_speed")).alias("s"), wind.gust_operation(F.col("wind_gust")).alias("g")
    )
    return both.select(
        "seq", F.col("s.operation_level").alias("speed_level"), F.col("s.operation_label").alias("speed_label"),
        F.col("s.beaufort").alias("speed_beaufort"), F.col("g.operation_level").alias("gust_level"),
        F.col("g.operation_label").alias("gust_label"), F.col("g.buffer_applied").alias("buffer_applied"),
        F.col("g.original_level_without_buffer").alias("level_without_buffer"),
    )


@query(
    "fn13_warning_level",
    with_views(
        f"""SELECT seq, {case_levels('k / 100.0', {'watch': 0.3, 'warning': 0.5, 'stop': 0.7})} AS warning_level,
            {map_sql('level', weather.PROBABILITY_LABELS, "'無'")} AS level_label
            FROM (SELECT *, {rain_sql('k / 100.0')} AS level FROM obs)""",
        "obs",
    ),
)
def _(v):
    p = F.col("k") / 100.0
    return v.obs.select(
        "seq", weather.rain_warning_level(p).alias("warning_level"),
        lookup(weather.PROBABILITY_LABELS, weather.rain_probability_level(p), "無").alias("level_label"),
    )


LOW_SQL = ", ".join(f"'{x}'" for x in LOW_RELIABILITY)
ACTION_SQL = (
    f"CASE WHEN reliability IN ({LOW_SQL}) THEN {map_sql('level', ACTION_BY_LEVEL_LOW_RELIABILITY)}"
    f" ELSE {map_sql('level', ACTION_BY_LEVEL_HIGH_RELIABILITY)} END"
)


@query(
    "fn14_action_mapping",
    with_views(
        f"""SELECT seq, action, {map_sql('action', ACTION_LABELS)} AS action_label, {map_sql('action', ACTION_TEXTS)} AS action_text
            FROM (SELECT *, {ACTION_SQL} AS action FROM (
              SELECT seq, {gust_sql('wind_gust')} AS level, CASE WHEN k % 3 = 0 THEN 'low_to_medium' WHEN k % 3 = 1
                     THEN 'high' ELSE 'unavailable' END AS reliability FROM clean) WHERE level IS NOT NULL)""",
        "clean",
    ),
)
def _(v):
    k = F.col("k")
    reliability = F.when(k % 3 == 0, "low_to_medium").when(k % 3 == 1, "high").otherwise("unavailable")
    level = wind.wind_gust_level(F.col("wind_gust"))
    action = decisions.action_for(level, reliability)
    return v.clean.filter(level.isNotNull()).select(
        "seq", action.alias("action"), lookup(ACTION_LABELS, action).alias("action_label"),
        lookup(ACTION_TEXTS, action).alias("action_text"),
    )


@query(
    "fn15_reliability",
    with_views(
        f"""SELECT source, device_type, COUNT(*) AS n,
            CASE WHEN source = 'error' THEN 'low' ELSE {map_sql("CASE device_type WHEN 'WIND' THEN 'wind_speed' WHEN 'TIDE' THEN 'tide' ELSE 'rain_probability' END", RELIABILITY, "'unknown'")} END AS confidence
            FROM obs GROUP BY ALL""",
        "obs",
    ),
)
def _(v):
    family = F.when(F.col("device_type") == "WIND", "wind_speed").when(F.col("device_type") == "TIDE", "tide").otherwise("rain_probability")
    override = F.when(F.col("source") == "error", "low")
    return v.obs.groupBy("source", "device_type").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "confidence", decisions.confidence_for(family, override)
    )


@query(
    "fn16_interactions",
    with_views(
        f"""SELECT seq, round((station_pressure - 1010) * relative_humidity / 100, 9) AS pressure_humidity_interaction,
            round((temperature - dew) / (wind_speed + 0.1), 9) AS dewpoint_wind_interaction,
            round((station_pressure - 1010) * (temperature - 25), 9) AS pressure_temp_interaction
            FROM (SELECT *, 243.04 * {DEW_GAMMA} / (17.625 - {DEW_GAMMA}) AS dew FROM clean)""",
        "clean",
    ),
)
def _(v):
    from skywharf.operators.features import interactions

    dew = weather.dew_point(F.col("temperature"), F.col("relative_humidity"))
    frame = v.clean.select(
        "seq", (F.col("station_pressure") - 1010).alias("pressure_change_3h"), F.col("relative_humidity").alias("humidity"),
        (F.col("temperature") - dew).alias("temp_dewpoint_diff"), "wind_speed",
        (F.col("station_pressure") - 1010).alias("pressure_change_1h"), (F.col("temperature") - 25).alias("temp_change_1h"),
    )
    cols = interactions(frame.columns)
    return frame.select("seq", *[r(c).alias(n) for n, c in cols.items()])


@query(
    "fn17_record_ids",
    with_views(
        f"""SELECT seq, source || ':' || device_type || ':' || station_id || ':' || CASE WHEN is_forecast THEN 'forecast'
            ELSE 'observed' END || ':' || {tsql('obs_time')} AS record_id,
            'https://host/x?Authorization=***&k=' || k AS redacted FROM obs""",
        "obs",
    ),
)
def _(v):
    url = F.concat(F.lit("https://host/x?Authorization=key"), F.col("seq").cast("string"), F.lit("&k="), F.col("k").cast("string"))
    return v.obs.select(
        "seq",
        text.record_id(F.col("source"), F.col("device_type"), F.col("station_id"), F.col("is_forecast"), ts("obs_time")).alias("record_id"),
        text.redact_authorization(url).alias("redacted"),
    )


AS_OF = "2024-01-31 00:00:00"


@query(
    "fn18_age_and_status",
    with_views(
        f"""SELECT seq, CAST(age AS BIGINT) AS age_minutes,
            CASE WHEN age > 1440 THEN 'outage' WHEN age > 75 THEN 'stale' ELSE 'current' END AS status
            FROM (SELECT seq, greatest(0, floor((epoch(TIMESTAMP '{AS_OF}') - epoch(obs_time)) / 60)) AS age FROM obs)""",
        "obs",
    ),
)
def _(v):
    age = clock.age_minutes(F.col("obs_time"), F.lit(AS_OF).cast("timestamp"))
    return v.obs.select("seq", age.alias("age_minutes"), clock.status_level(age, F.lit(75)).alias("status"))


@query(
    "fn19_canonical_record",
    with_views(
        f"""SELECT seq, source || ':' || device_type || ':' || station_id || ':' || CASE WHEN is_forecast THEN 'forecast'
            ELSE 'observed' END || ':' || {tsql('obs_time')} AS record_id, station_id AS station, name AS station_name,
            {tsql('obs_time')} AS observed_at, wind_speed AS wind_speed_mps, wind_gust AS wind_gust_mps,
            wind_direction AS wind_direction_deg, precipitation_1hr AS precipitation_1hr_mm, stale AS stale_at_fetch
            FROM clean JOIN station USING (station_id)""",
        "clean", "station",
    ),
)
def _(v):
    joined = v.clean.join(v.station.select("station_id", F.col("name").alias("station_name"), "longitude", "latitude"), "station_id")
    shaped = joined.withColumn("observed_at", ts("obs_time")).withColumn("fetched_at", ts("fetched_at"))
    available = set(shaped.columns)

    def column(name):
        return F.col(name) if name in available else F.lit(None).cast("string")

    record = text.canonical_record(column)
    return shaped.select("seq", record.alias("rec")).select(
        "seq", F.col("rec.record_id").alias("record_id"), F.col("rec.station.station_id").alias("station"),
        F.col("rec.station.station_name").alias("station_name"), F.col("rec.time.observed_at").alias("observed_at"),
        F.col("rec.metrics.wind_speed_mps"), F.col("rec.metrics.wind_gust_mps"), F.col("rec.metrics.wind_direction_deg"),
        F.col("rec.metrics.precipitation_1hr_mm"), F.col("rec.quality.stale_at_fetch"),
    )


@query(
    "fn20_forecast_age",
    with_views(
        f"""SELECT seq, round(least(1.0, greatest(0.0, CASE WHEN h >= 23.5 THEN h - 23.5 WHEN h >= 17.5 THEN h - 17.5
            WHEN h >= 11.5 THEN h - 11.5 WHEN h >= 5.5 THEN h - 5.5 ELSE h + 0.5 END / 6)), 4) AS forecast_age
            FROM (SELECT seq, {HOUR_SQL} AS h FROM obs)""",
        "obs",
    ),
)
def _(v):
    return v.obs.select("seq", r(clock.forecast_age(F.col("obs_time")), 4).alias("forecast_age"))


@query(
    "fn21_canonical_station",
    with_views(
        """SELECT seq, CASE WHEN station_id IN ('S00', 'S01', 'S04', 'S07') THEN station_id END AS canonical
           FROM obs""",
        "obs",
    ),
)
def _(v):
    raw = F.concat(F.col("station_id"), F.when(F.col("k") % 2 == 0, "M01").otherwise("M10"))
    return v.obs.select("seq", text.canonical_id(raw, ["S00", "S01", "S04", "S07"]).alias("canonical"))


@query(
    "fn22_prediction_clipping",
    with_views(
        """SELECT seq, CASE WHEN rain < 0.5 THEN 0.0 ELSE rain END AS rain_clipped, wind AS wind_clipped,
           greatest(gust, wind) AS gust_clipped, vis AS visibility_clipped,
           CASE WHEN vis >= 10000 THEN 'excellent' WHEN vis >= 5000 THEN 'good' WHEN vis >= 1000 THEN 'moderate'
                WHEN vis >= 500 THEN 'poor' WHEN vis IS NOT NULL THEN 'very_poor' END AS visibility_grade
           FROM (SELECT seq, greatest(0.0, least(200.0, value - 5)) AS rain,
                 CASE WHEN wind_speed IS NOT NULL THEN greatest(0.0, least(50.0, wind_speed * 2)) END AS wind,
                 CASE WHEN wind_gust IS NOT NULL THEN greatest(0.0, least(60.0, wind_gust)) END AS gust,
                 CASE WHEN visibility IS NOT NULL THEN greatest(0.0, least(30000.0, visibility * 1.5)) END AS vis
                 FROM clean)""",
        "clean",
    ),
)
def _(v):
    cols = weather.clipped_predictions(
        F.col("value") - 5, F.col("wind_speed") * 2, F.col("wind_gust"), F.col("visibility") * 1.5, small_rain=0.5
    )
    return v.clean.select("seq", *[c.alias(n) for n, c in cols.items()])


@query(
    "fn23_day_pieces",
    f"""SELECT o_orderkey, {tsql('greatest(s, d)')} AS piece_start,
        {tsql("least(e, d + INTERVAL 1 DAY - INTERVAL 1 SECOND)")} AS piece_end
        FROM (SELECT o_orderkey, s, e, unnest(generate_series(date_trunc('day', s), date_trunc('day', e), INTERVAL 1 DAY)) AS d
              FROM (SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) AS s,
                    o_orderdate + to_hours(o_orderkey % 24) + to_hours(o_custkey % 70) AS e FROM orders))""",
)
def _(v):
    start = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    end = start + F.make_dt_interval(hours=(F.col("o_custkey") % 70).cast("int"))
    return v.table("orders").select("o_orderkey", F.inline(clock.day_pieces(start, end))).select(
        "o_orderkey", ts("piece_start").alias("piece_start"), ts("piece_end").alias("piece_end")
    )


@query(
    "fn24_source_freshness",
    with_views(
        f"""SELECT seq, CASE WHEN k % 9 = 0 THEN TRUE
             ELSE epoch(TIMESTAMP '{AS_OF}') - epoch(obs_time) > 3 * 3600 END AS is_stale FROM obs""",
        "obs",
    ),
)
def _(v):
    resolved = F.when(F.col("k") % 9 != 0, F.col("obs_time"))
    return v.obs.select("seq", clock.source_is_stale(resolved, F.lit(AS_OF).cast("timestamp")).alias("is_stale"))
