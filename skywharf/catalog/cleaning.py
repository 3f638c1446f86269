"""Cleaning, deduplication, resampling and gap filling over the observation view."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywharf.catalog.registry import query
from skywharf.catalog.views import define_view, r, rounded, ts, tsql, with_views
from skywharf.functions import text, weather
from skywharf.operators import cleaning
from skywharf.plans.timeline import number_rows
from skywharf.schema import ARCHIVE_LIMITS, SEQUENCE_LIMITS, STATION_TYPE_LIMITS


def mask_sql(limits, names, alias="") -> str:
    return ", ".join(
        f"CASE WHEN {n} BETWEEN {limits[n][0]} AND {limits[n][1]} THEN {n} END AS {alias}{n}" for n in names
    )


@query(
    "cln01_normalize_archive",
    with_views(
        f"""SELECT {tsql('obs_time')} AS obs_time, station_id, {mask_sql(ARCHIVE_LIMITS, ['wind_speed', 'wind_gust', 'precipitation_1hr', 'temperature', 'station_pressure', 'visibility'])},
            wind_direction FROM obs""",
        "obs",
    ),
)
def _(v):
    archive = v.obs.select(
        F.col("obs_time").cast("string").alias("﻿ObsTime "), "station_id",
        F.col("wind_speed").cast("string").alias("WS "), F.col("wind_direction").cast("string").alias("WD"),
        F.col("wind_gust").cast("string").alias("WSGust"), F.col("precipitation_1hr").cast("string").alias("降水量(mm)"),
        F.col("temperature").cast("string").alias("氣溫(℃)"), F.col("station_pressure").cast("string").alias("StnPres"),
        F.col("visibility").cast("string").alias(" Visb"),
    )
    return cleaning.normalize_archive(archive).withColumn("obs_time", ts("obs_time"))


SENTINEL_TEXT = "CASE k % 8 WHEN 0 THEN '-' WHEN 1 THEN '-99' WHEN 2 THEN '-999' WHEN 3 THEN 'NaN' WHEN 4 THEN '' ELSE CAST(k AS VARCHAR) || '.5' END"


@query(
    "cln02_sentinels",
    with_views(
        """SELECT seq, CASE WHEN k % 8 > 4 THEN k + 0.5::DOUBLE END AS agency_value,
           CASE WHEN k % 8 = 1 THEN -99.0 WHEN k % 8 > 4 THEN k + 0.5::DOUBLE END AS panel_value FROM obs""",
        "obs",
    ),
)
def _(v):
    raw = F.expr(SENTINEL_TEXT.replace("VARCHAR", "STRING"))
    return v.obs.select("seq", text.number_or_null(raw).alias("agency_value"), text.panel_number(raw).alias("panel_value"))


@query(
    "cln03_range_masks",
    with_views(
        f"""SELECT seq, {mask_sql(ARCHIVE_LIMITS, ['wind_speed', 'visibility'], 'archive_')},
            {mask_sql(SEQUENCE_LIMITS, ['wind_speed', 'visibility'], 'sequence_')},
            {mask_sql(STATION_TYPE_LIMITS['wind'], ['wind_speed', 'wind_gust'], 'wind_')} FROM obs""",
        "obs",
    ),
)
def _(v):
    base = v.obs.select("seq", "wind_speed", "wind_gust", "visibility")

    def masked(limits, prefix, names):
        return [c.alias(prefix + n) for n in names for c in [F.when(F.col(n).between(*limits[n]), F.col(n))]]

    return base.select(
        "seq", *masked(ARCHIVE_LIMITS, "archive_", ["wind_speed", "visibility"]),
        *masked(SEQUENCE_LIMITS, "sequence_", ["wind_speed", "visibility"]),
        *masked(STATION_TYPE_LIMITS["wind"], "wind_", ["wind_speed", "wind_gust"]),
    )


@query(
    "cln04_range_report",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{n}' AS column_name, COUNT(*) FILTER (WHERE {n} < {ARCHIVE_LIMITS[n][0]} OR {n} > {ARCHIVE_LIMITS[n][1]}) AS invalid_count FROM obs"
            for n in ["wind_speed", "wind_gust", "precipitation_1hr", "relative_humidity", "station_pressure", "temperature", "visibility"]
        ),
        "obs",
    ),
)
def _(v):
    return cleaning.range_report(v.obs)


@query(
    "cln05_deduplicate_fullest",
    with_views(
        f"""SELECT station_id, {tsql('obs_time')} AS obs_time, seq, source, wind_speed, wind_gust, visibility, tide_level
            FROM station_hour""",
        "station_hour",
    ),
)
def _(v):
    return v.station_hour.select("station_id", ts("obs_time").alias("obs_time"), "seq", "source", "wind_speed", "wind_gust", "visibility", "tide_level")


@query(
    "cln05_duplicate_report",
    with_views(
        """SELECT CAST(SUM(n) AS BIGINT) AS row_count, CAST(SUM(CASE WHEN n > 1 THEN n END) AS BIGINT) AS rows_in_duplicate_groups,
           CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows_removed, COUNT(*) AS row_count_after
           FROM (SELECT COUNT(*) AS n FROM obs GROUP BY station_id, obs_hour)""",
        "obs",
    ),
)
def _(v):
    return cleaning.duplicate_report(v.obs, ["station_id", "obs_hour"])


@query(
    "cln06_preprocess",
    with_views(
        f"""SELECT {tsql('obs_time')} AS obs_time, station_id, source,
            CASE WHEN wind_speed BETWEEN 0 AND 60 THEN wind_speed END AS wind_speed, visibility,
            CAST(seq AS DOUBLE) AS seq FROM obs WHERE k % 23 <> 0""",
        "obs",
    ),
)
def _(v):
    raw = v.obs.select(
        F.when(F.col("k") % 23 != 0, F.col("obs_time").cast("string")).otherwise("not a time").alias("obs_time"),
        "station_id", "source", F.col("wind_speed").cast("string").alias("wind_speed_mps"),
        F.col("visibility").cast("string").alias("visibility_m"), F.col("seq").cast("string").alias("seq"),
    )
    out = cleaning.preprocess(raw, {"wind_speed_mps": "wind_speed", "visibility_m": "visibility"}, limits={"wind_speed": (0.0, 60.0)})
    return out.withColumn("obs_time", ts("obs_time"))


UNIT = "CASE k % 4 WHEN 0 THEN 'knots' WHEN 1 THEN 'km/h' WHEN 2 THEN 'KT' ELSE 'm/s' END"
LENGTH_UNIT = "CASE k % 2 WHEN 0 THEN 'm' ELSE 'cm' END"


@query(
    "cln07_unit_conversion",
    with_views(
        f"""SELECT seq, round(CASE WHEN k % 4 IN (0, 2) THEN wind_speed * 0.514444::DOUBLE WHEN k % 4 = 1 THEN wind_speed / 3.6::DOUBLE ELSE wind_speed END, 6) AS wind_speed_mps,
            wind_speed AS raw_wind_speed, wind_speed IS NOT NULL AND k % 4 <> 3 AS unit_conversion_applied,
            CASE WHEN wind_speed IS NOT NULL AND k % 4 <> 3 THEN lower({UNIT}) END AS original_unit,
            round(CASE WHEN k % 2 = 0 THEN tide_level * 100 ELSE tide_level END, 6) AS tide_cm,
            round(CASE WHEN k % 2 = 1 THEN tide_level / 100 ELSE tide_level END, 6) AS wave_m FROM clean""",
        "clean",
    ),
)
def _(v):
    unit, length = F.expr(UNIT), F.expr(LENGTH_UNIT)
    speed, tide = F.col("wind_speed"), F.col("tide_level")
    converted = text.speed_was_converted(speed, unit)
    return v.clean.select(
        "seq", text.speed_mps(speed, unit).alias("wind_speed_mps"), speed.alias("raw_wind_speed"),
        converted.alias("unit_conversion_applied"), F.when(converted, F.lower(unit)).alias("original_unit"),
        text.length_in(tide, length, "cm").alias("tide_cm"), text.length_in(tide, length, "m").alias("wave_m"),
    )


@query(
    "cln07_station_status",
    with_views(
        """SELECT station_id, COUNT(*) AS record_count,
           CASE WHEN COUNT(wind_speed) = 0 OR COUNT(wind_gust) = 0 OR COUNT(wind_gust_direction) = 0 THEN 'degraded' ELSE 'ok' END AS normalization_status
           FROM clean GROUP BY station_id""",
        "clean",
    ),
)
def _(v):
    from skywharf.operators.reports import normalization_status

    return normalization_status(v.clean, ["station_id"], ["wind_speed", "wind_gust", "wind_gust_direction"]).select(
        "station_id", "record_count", "normalization_status"
    )


@query(
    "cln08_time_parsing",
    with_views(
        f"""SELECT seq, {tsql("obs_time - INTERVAL 8 HOUR")} AS from_iso, {tsql("obs_time - INTERVAL 8 HOUR")} AS from_slash,
            {tsql('obs_time')} AS from_zoned, {tsql('obs_time')} AS from_meridiem FROM obs""",
        "obs",
    ),
)
def _(v):
    at = F.col("obs_time")
    half = F.when(F.hour(at) >= 12, "下午").otherwise("上午")
    twelve = F.when(F.hour(at) % 12 == 0, 12).otherwise(F.hour(at) % 12)
    panel = F.concat(F.date_format(at, "yyyy/M/d"), F.lit(" "), half, F.lit(" "), F.lpad(twelve.cast("string"), 2, "0"), F.date_format(at, ":mm:ss"))
    return v.obs.select(
        "seq", ts(text.local_time(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))).alias("from_iso"),
        ts(text.local_time(F.date_format(at, "yyyy/MM/dd HH:mm:ss"))).alias("from_slash"),
        ts(text.local_time(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))).alias("from_zoned"),
        F.date_format(text.meridiem_time(panel), "yyyy-MM-dd HH:mm:ss").alias("from_meridiem"),
    )


# Ten-minute grid of every station, masked by the sequence limits.
define_view(
    "grid",
    """
    SELECT g.station_id, g.obs_time, m.* EXCLUDE (station_id, obs_time)
    FROM (SELECT station_id, unnest(generate_series(lo, hi, INTERVAL 10 MINUTE)) AS obs_time FROM (
            SELECT station_id, MIN(time_bucket(INTERVAL 10 MINUTE, obs_time, TIMESTAMP '2000-01-01')) AS lo,
                   MAX(time_bucket(INTERVAL 10 MINUTE, obs_time, TIMESTAMP '2000-01-01')) AS hi FROM obs GROUP BY station_id)) g
    LEFT JOIN (
        SELECT station_id, time_bucket(INTERVAL 10 MINUTE, obs_time, TIMESTAMP '2000-01-01') AS obs_time,
               AVG(CASE WHEN wind_speed BETWEEN 0 AND 60 THEN wind_speed END) AS wind_speed,
               AVG(CASE WHEN wind_gust BETWEEN 0 AND 80 THEN wind_gust END) AS wind_gust,
               AVG(CASE WHEN wind_direction BETWEEN 0 AND 360 THEN wind_direction END) AS wind_direction,
               AVG(CASE WHEN precipitation_1hr BETWEEN 0 AND 200 THEN precipitation_1hr END) AS precipitation_1hr,
               AVG(CASE WHEN visibility BETWEEN 0 AND 20000 THEN visibility END) AS visibility,
               AVG(CASE WHEN tide_level BETWEEN -200 AND 600 THEN tide_level END) AS tide_level
        FROM obs GROUP BY ALL) m USING (station_id, obs_time)
    """,
    ["obs"],
)
GRID_MEASURES = ["wind_speed", "wind_gust", "wind_direction", "precipitation_1hr", "visibility", "tide_level"]


def grid(v):
    masked = cleaning.mask_ranges(v.obs.select("station_id", "obs_time", *GRID_MEASURES), SEQUENCE_LIMITS)
    return cleaning.resample_mean(masked, ["station_id"], "obs_time", GRID_MEASURES)


@query(
    "cln09_resample_grid",
    with_views(
        f"SELECT station_id, {tsql('obs_time')} AS obs_time, " + ", ".join(f"round({m}, 9) AS {m}" for m in GRID_MEASURES) + " FROM grid",
        "grid",
    ),
)
def _(v):
    return rounded(grid(v), *GRID_MEASURES).withColumn("obs_time", ts("obs_time"))


def interpolate_sql(name: str, limit: int) -> str:
    """SQL expression over columns pt,pv,pr / nt,nv,nr / rn of one measure."""
    p, n = f"{name}_p", f"{name}_n"
    near = f"(coalesce(rn - {p}.r <= {limit}, FALSE) OR coalesce({n}.r - rn <= {limit}, FALSE))"
    line = f"{p}.v + ({n}.v - {p}.v) * (epoch(obs_time) - epoch({p}.t)) / (epoch({n}.t) - epoch({p}.t))"
    return f"CASE WHEN {name} IS NOT NULL THEN {name} WHEN {near} THEN coalesce({line}, {p}.v, {n}.v) END"


def interpolation_view(names: dict[str, int]) -> str:
    marks = ", ".join(
        f"last_value(CASE WHEN {n} IS NOT NULL THEN {{'t': obs_time, 'v': {n}, 'r': rn}} END IGNORE NULLS) OVER back AS {n}_p, "
        f"first_value(CASE WHEN {n} IS NOT NULL THEN {{'t': obs_time, 'v': {n}, 'r': rn}} END IGNORE NULLS) OVER ahead AS {n}_n"
        for n in names
    )
    filled = ", ".join(f"{interpolate_sql(n, lim)} AS {n}_filled" for n, lim in names.items())
    return f"""
    SELECT *, {filled} FROM (
        SELECT *, {marks} FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY obs_time) AS rn FROM grid)
        WINDOW back AS (PARTITION BY station_id ORDER BY obs_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               ahead AS (PARTITION BY station_id ORDER BY obs_time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    """


INTERPOLATED = {"wind_speed": 3, "wind_gust": 3, "tide_level": 18}
define_view("interpolated", interpolation_view(INTERPOLATED), ["grid"])


@query(
    "cln10_interpolate",
    with_views(
        f"SELECT station_id, {tsql('obs_time')} AS obs_time, "
        + ", ".join(f"round({n}_filled, 9) AS {n}, {n}_filled IS NULL AS {n}_gap" for n in INTERPOLATED)
        + " FROM interpolated",
        "interpolated",
    ),
)
def _(v):
    base = grid(v).select("station_id", "obs_time", *INTERPOLATED)
    out = cleaning.interpolate_limited(base, ["station_id"], "obs_time", INTERPOLATED)
    return rounded(out, *INTERPOLATED).withColumn("obs_time", ts("obs_time"))


@query(
    "cln11_bounded_fill",
    with_views(
        f"""SELECT station_id, {tsql('obs_time')} AS obs_time, round(visibility, 9) AS visibility, round(sin(radians(wd)), 9) AS wind_dir_sin FROM (
            SELECT station_id, obs_time, visibility,
                   first_value(wd IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY obs_time ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS wd
            FROM (SELECT station_id, obs_time,
                  last_value(visibility IGNORE NULLS) OVER w AS visibility, last_value(wind_direction IGNORE NULLS) OVER w AS wd FROM grid
                  WINDOW w AS (PARTITION BY station_id ORDER BY obs_time ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)))""",
        "grid",
    ),
)
def _(v):
    base = grid(v).select("station_id", "obs_time", "visibility", "wind_direction")
    out = cleaning.fill_limited(base, ["station_id"], "obs_time", {"visibility": 6, "wind_direction": 6}, {"wind_direction": 6})
    return out.select("station_id", ts("obs_time").alias("obs_time"), r("visibility").alias("visibility"),
                      r(F.sin(F.radians("wind_direction"))).alias("wind_dir_sin"))


@query(
    "cln12_default_fills",
    with_views(
        f"""SELECT station_id, {tsql('obs_time')} AS obs_time, round(coalesce(precipitation_1hr, 0), 9) AS precipitation_1hr,
            0.0::DOUBLE AS nearby_precip_1, 0.0::DOUBLE AS nearby_available, 0.0::DOUBLE AS cwa_pop_current, 1.0::DOUBLE AS cwa_data_age_hr FROM grid""",
        "grid",
    ),
)
def _(v):
    out = cleaning.fill_defaults(grid(v).select("station_id", "obs_time", "precipitation_1hr"))
    return out.select("station_id", ts("obs_time").alias("obs_time"), r("precipitation_1hr").alias("precipitation_1hr"),
                      "nearby_precip_1", "nearby_available", "cwa_pop_current", "cwa_data_age_hr")


@query(
    "cln13_invalid_mask",
    with_views(
        f"""SELECT station_id, {tsql('obs_time')} AS obs_time,
            wind_speed_filled IS NULL OR wind_gust_filled IS NULL OR tide_level_filled IS NULL AS invalid FROM interpolated""",
        "interpolated",
    ),
)
def _(v):
    base = v.obs.select("station_id", "obs_time", *GRID_MEASURES)
    out = cleaning.prepare_grid(base, ["station_id"], "obs_time", ["wind_speed", "wind_gust"])
    return out.select("station_id", ts("obs_time").alias("obs_time"), "invalid")


@query(
    "cln14_valid_ratio",
    with_views(
        " UNION ALL ".join(
            f"SELECT station_id, '{m}' AS variable, COUNT(*) AS total_steps, round(COUNT({m}) / COUNT(*), 6) AS valid_ratio, COUNT({m}) / COUNT(*) >= 0.7 AS passes_gate FROM grid GROUP BY station_id"
            for m in ["wind_speed", "wind_gust", "tide_level"]
        ),
        "grid",
    ),
)
def _(v):
    out = cleaning.valid_ratios(grid(v), ["station_id"], ["wind_speed", "wind_gust", "tide_level"])
    return out.select("station_id", "variable", "total_steps", "valid_ratio", (F.col("valid_ratio") >= 0.70).alias("passes_gate"))


@query(
    "cln15_complete_features",
    with_views(
        """SELECT name AS feature FROM (SELECT unnest(['wind_speed', 'wind_gust', 'precipitation_1hr', 'tide_level', 'visibility']) AS name,
           unnest([bool_and(wind_speed IS NOT NULL), bool_and(wind_gust IS NOT NULL), bool_and(precipitation_1hr IS NOT NULL),
                   bool_and(tide_level IS NOT NULL), bool_and(visibility IS NOT NULL)]) AS keep FROM obs) WHERE keep""",
        "obs",
    ),
)
def _(v):
    return cleaning.feature_completeness(v.obs).filter("null_count = 0").select("feature")


define_view(
    "scaled",
    """
    SELECT a.*, rn <= floor(n * 0.7) AS is_train FROM (
        SELECT *, row_number() OVER (PARTITION BY target_area ORDER BY obs_time) AS rn, COUNT(*) OVER (PARTITION BY target_area) AS n
        FROM area_hour) a
    """,
    ["area_hour"],
)


def trained(v):
    numbered = number_rows(v.area_hour, ["target_area"], "obs_time", total="_n")
    return numbered.withColumn("is_train", F.col("_rn") <= F.floor(F.col("_n") * 0.7))


@query(
    "cln16_min_max_scaling",
    with_views(
        f"""SELECT target_area, {tsql('obs_time')} AS obs_time, round(scaled_value, 9) AS wind_scaled,
            round(scaled_value * span + lo, 9) AS wind_restored FROM (
              SELECT target_area, obs_time, lo, span, (nearby_cwa_wind_speed_max - lo) / span AS scaled_value FROM (
                SELECT s.*, lo, CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS span FROM scaled s JOIN (
                  SELECT target_area, MIN(nearby_cwa_wind_speed_max) FILTER (WHERE is_train) AS lo, MAX(nearby_cwa_wind_speed_max) FILTER (WHERE is_train) AS hi
                  FROM scaled GROUP BY target_area) USING (target_area)))""",
        "scaled",
    ),
)
def _(v):
    name = "nearby_cwa_wind_speed_max"
    out = cleaning.scale_min_max(trained(v), ["target_area"], [name], F.col("is_train"))
    return out.select("target_area", ts("obs_time").alias("obs_time"), r(f"{name}_scaled").alias("wind_scaled"),
                      r(cleaning.unscale(name, F.col(f"{name}_scaled"))).alias("wind_restored"))


@query(
    "cln17_train_median_fill",
    with_views(
        f"""SELECT target_area, {tsql('obs_time')} AS obs_time,
            round(coalesce(CASE WHEN nearby_cwa_station_count % 3 <> 0 THEN nearby_cwa_wind_speed_max END, med, 0), 9) AS wind_filled
            FROM scaled JOIN (SELECT target_area, quantile_cont(nearby_cwa_wind_speed_max, 0.5) FILTER (WHERE is_train AND nearby_cwa_station_count % 3 <> 0) AS med
              FROM scaled GROUP BY target_area) USING (target_area)""",
        "scaled",
    ),
)
def _(v):
    holed = trained(v).withColumn(
        "wind", F.when(F.col("nearby_cwa_station_count") % 3 != 0, F.col("nearby_cwa_wind_speed_max"))
    )
    out = cleaning.fill_train_medians(holed, ["target_area"], ["wind"], F.col("is_train"))
    return out.select("target_area", ts("obs_time").alias("obs_time"), r("wind").alias("wind_filled"))


@query(
    "cln18_align_features",
    with_views("SELECT seq, 0.5::DOUBLE AS qpe_1hr_mm, wind_speed, precipitation_1hr, 0.5::DOUBLE AS soil_moisture FROM clean", "clean"),
)
def _(v):
    return cleaning.align_features(v.clean, ["qpe_1hr_mm", "wind_speed", "precipitation_1hr", "soil_moisture"], keep=["seq"])


POP_TEXT = """CASE k % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'n/a' WHEN 3 THEN CAST(k AS {t}) || '%' WHEN 4 THEN '0' WHEN 5 THEN '1'
WHEN 6 THEN CAST(k + 50 AS {t}) WHEN 7 THEN '0.' || CAST(k AS {t}) ELSE '-3' END"""


@query(
    "cln20_pop_quality",
    with_views(
        f"""SELECT seq, status = 'ok' AS available, status AS parse_status, CASE WHEN status = 'ok' THEN 'valid' ELSE 'invalid' END AS quality_status,
            CASE WHEN status = 'ok' THEN round(CASE WHEN x <= 1 THEN x ELSE x / 100.0 END, 9) END AS normalized_value FROM (
              SELECT seq, x, CASE WHEN raw IS NULL THEN 'not_available' WHEN raw = '' THEN 'missing_field' WHEN x IS NULL THEN 'parse_error'
                     WHEN x < 0 OR x > 100 THEN 'out_of_range' ELSE 'ok' END AS status
              FROM (SELECT seq, raw, TRY_CAST(trim(rtrim(raw, '%')) AS DOUBLE) AS x FROM (SELECT seq, {POP_TEXT.format(t='VARCHAR')} AS raw FROM obs)))""",
        "obs",
    ),
)
def _(v):
    raw = F.expr(POP_TEXT.format(t="STRING"))
    return v.obs.select("seq", weather.pop_quality(raw).alias("q")).select(
        "seq", "q.available", "q.parse_status", "q.quality_status", r("q.normalized_value").alias("normalized_value")
    )


RECENT_AS_OF = "2024-01-20 12:00:00"


@query(
    "cln21_recent_history",
    with_views(
        f"SELECT seq, station_id, wind_speed FROM clean WHERE NOT is_forecast AND obs_time >= TIMESTAMP '{RECENT_AS_OF}' - INTERVAL 48 HOUR",
        "clean",
    ),
)
def _(v):
    return cleaning.recent(v.clean, F.lit(RECENT_AS_OF).cast("timestamp"), 48).select("seq", "station_id", "wind_speed")


@query(
    "cln22_labelled_rows",
    with_views(
        """SELECT seq, wind_speed AS label, TRUE AS event_only FROM clean WHERE wind_speed IS NOT NULL AND precipitation_1hr > 0.5
           UNION ALL SELECT seq, wind_speed, FALSE FROM clean WHERE wind_speed IS NOT NULL""",
        "clean",
    ),
)
def _(v):
    base = v.clean.select("seq", F.col("wind_speed").alias("label"), (F.col("precipitation_1hr") > 0.5).cast("int").alias("event"),
                          F.lit(0).alias("never"))
    events = cleaning.labelled_rows(base, "label", "event").select("seq", "label", F.lit(True).alias("event_only"))
    fallback = cleaning.labelled_rows(base, "label", "never").select("seq", "label", F.lit(False).alias("event_only"))
    return events.unionByName(fallback)
