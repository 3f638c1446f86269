"""Area series, snapshots, status and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywharf.catalog.registry import query
from skywharf.catalog.scalar import haversine_sql
from skywharf.catalog.views import define_view, r, rounded, ts, tsql, with_views
from skywharf.functions import geo
from skywharf.operators import aggregates, cleaning
from skywharf.plans.dims import dimension
from skywharf.schema import FRESHNESS_POLICIES, REFERENCE_POINTS

TARGET = "S00"
AREA_KEYS = ["target_area", "obs_time"]


def round_list(names, places=9):
    return ", ".join(f"round({n}, {places}) AS {n}" for n in names)


AREA_ROUNDED = [
    f"nearby_cwa_{m}_{s}" for m in ("wind_speed", "wind_gust") for s in ("mean", "max", "min", "std")
] + ["nearby_cwa_precipitation_1hr_mean", "nearby_cwa_precipitation_1hr_max", "nearby_cwa_rainy_station_ratio"]
AREA_COUNTS = ["nearby_cwa_station_count", "nearby_cwa_valid_wind_station_count", "nearby_cwa_valid_gust_station_count", "nearby_cwa_rainy_station_count"]


@query(
    "agg01_area_series",
    with_views(f"SELECT target_area, {tsql('obs_time')} AS obs_time, {', '.join(AREA_COUNTS)}, {round_list(AREA_ROUNDED)} FROM area_hour", "area_hour"),
)
def _(v):
    return rounded(v.area_hour, *AREA_ROUNDED).withColumn("obs_time", ts("obs_time"))


def hourly(v):
    return v.clean.withColumn("obs_time", F.col("obs_hour"))


@query(
    "agg02_direction_mean",
    with_views(
        f"""SELECT target_area, {tsql('obs_hour')} AS obs_time, round(AVG(sin(radians(wind_direction))), 9) AS wind_sin_mean,
            round(AVG(cos(radians(wind_direction))), 9) AS wind_cos_mean, round(AVG(sin(radians(wind_gust_direction))), 9) AS gust_sin_mean,
            round(AVG(cos(radians(wind_gust_direction))), 9) AS gust_cos_mean FROM clean GROUP BY target_area, obs_hour""",
        "clean",
    ),
)
def _(v):
    aggs = [*aggregates.direction_means("wind_direction", "wind"), *aggregates.direction_means("wind_gust_direction", "gust")]
    out = hourly(v).groupBy(*AREA_KEYS).agg(*aggs)
    return rounded(out, "wind_sin_mean", "wind_cos_mean", "gust_sin_mean", "gust_cos_mean").withColumn("obs_time", ts("obs_time"))


def port_distance_sql(lat="latitude", lon="longitude"):
    return "least(" + ", ".join(haversine_sql(str(p[2]), str(p[1]), lat, lon, 6371.0088) for p in REFERENCE_POINTS) + ")"


define_view(
    "clean_distance",
    f"""SELECT c.*, CASE WHEN s.station_id NOT IN ('S03', 'S08') THEN {port_distance_sql()} END AS distance_to_port_km
        FROM clean c JOIN station s USING (station_id)""",
    ["clean", "station"],
)


def clean_distance(v):
    km = geo.distance_to_points(F.col("latitude"), F.col("longitude"), radius=geo.EARTH_RADIUS_KM + 0.0088)
    stations = v.station.select("station_id", F.when(~F.col("station_id").isin("S03", "S08"), km).alias("distance_to_port_km"))
    return hourly(v).join(stations, "station_id")


def weighted_sql(measure: str) -> str:
    weight = "(1.0::DOUBLE / (coalesce(distance_to_port_km, dmax, 0) + 1.0))"
    return f"round(SUM({measure} * {weight}) / SUM(CASE WHEN {measure} IS NOT NULL THEN {weight} END), 8)"


@query(
    "agg03_distance_weighted_mean",
    with_views(
        f"""SELECT target_area, {tsql('obs_hour')} AS obs_time, {weighted_sql('wind_speed')} AS distance_weighted_wind_speed,
            {weighted_sql('wind_gust')} AS distance_weighted_wind_gust, {weighted_sql('precipitation_1hr')} AS distance_weighted_precipitation
            FROM (SELECT *, MAX(distance_to_port_km) OVER (PARTITION BY target_area, obs_hour) AS dmax FROM clean_distance)
            GROUP BY target_area, obs_hour""",
        "clean_distance",
    ),
)
def _(v):
    sums = clean_distance(v).groupBy(*AREA_KEYS).agg(*aggregates.distance_weighted_aggs())
    out = aggregates.finish_distance_weighted(sums)
    return rounded(out, *aggregates.DISTANCE_WEIGHTED.values(), places=8).withColumn("obs_time", ts("obs_time"))


PRESSURE = [f"nearby_cwa_{m}_{s}" for m in ("pressure", "relative_humidity", "temperature") for s in ("mean", "max", "min", "std")]
PRESSURE_DERIVED = ["nearby_cwa_pressure_gradient", "nearby_cwa_dew_point_mean", "nearby_cwa_dew_point_spread_mean"]


def dew_sql(t, h):
    gamma = f"(ln(greatest(1e-6, least(100.0, {h})) / 100.0) + 17.625 * {t} / (243.04 + {t}))"
    return f"243.04 * {gamma} / (17.625 - {gamma})"


@query(
    "agg04_pressure_humidity",
    with_views(
        f"""SELECT target_area, {tsql('obs_time')} AS obs_time, {round_list(PRESSURE)},
            round(nearby_cwa_pressure_max - nearby_cwa_pressure_min, 9) AS nearby_cwa_pressure_gradient,
            round(dew, 9) AS nearby_cwa_dew_point_mean, round(nearby_cwa_temperature_mean - dew, 9) AS nearby_cwa_dew_point_spread_mean
            FROM (SELECT *, {dew_sql('nearby_cwa_temperature_mean', 'nearby_cwa_relative_humidity_mean')} AS dew FROM (
              SELECT target_area, obs_hour AS obs_time, """
        + ", ".join(
            f"AVG({c}) AS nearby_cwa_{p}_mean, MAX({c}) AS nearby_cwa_{p}_max, MIN({c}) AS nearby_cwa_{p}_min, COALESCE(STDDEV_POP({c}), 0) AS nearby_cwa_{p}_std"
            for c, p in [("station_pressure", "pressure"), ("relative_humidity", "relative_humidity"), ("temperature", "temperature")]
        )
        + " FROM clean GROUP BY ALL))",
        "clean",
    ),
)
def _(v):
    out = hourly(v).groupBy(*AREA_KEYS).agg(*aggregates.pressure_humidity_aggs()).withColumns(aggregates.pressure_humidity_derived())
    return rounded(out, *PRESSURE, *PRESSURE_DERIVED).withColumn("obs_time", ts("obs_time"))


PORT = [f"khwd_{m}_{s}" for m in ("wind_speed", "wind_gust") for s in ("mean", "max", "min", "std", "range")]


@query(
    "agg05_port_local_series",
    with_views(
        f"""SELECT target_area, {tsql('obs_time')} AS obs_time, {round_list(PORT)}, khwd_station_count, khwd_valid_wind_station_count,
            khwd_valid_gust_station_count, rainy AS port_local_rainy_station_count, round(rainy / khwd_station_count::DOUBLE, 9) AS port_local_rainy_station_ratio,
            rain_max AS port_local_precipitation_1hr_max, round(rain_mean, 9) AS port_local_precipitation_1hr_mean FROM (
              SELECT target_area, obs_hour AS obs_time, """
        + ", ".join(
            f"AVG({m}) AS khwd_{m}_mean, MAX({m}) AS khwd_{m}_max, MIN({m}) AS khwd_{m}_min, COALESCE(STDDEV_POP({m}), 0) AS khwd_{m}_std, MAX({m}) - MIN({m}) AS khwd_{m}_range"
            for m in ("wind_speed", "wind_gust")
        )
        + """, COUNT(DISTINCT station_id) AS khwd_station_count, COUNT(wind_speed) AS khwd_valid_wind_station_count,
              COUNT(wind_gust) AS khwd_valid_gust_station_count, COUNT(*) FILTER (WHERE precipitation_1hr > 0.5) AS rainy,
              MAX(precipitation_1hr) AS rain_max, AVG(precipitation_1hr) AS rain_mean
              FROM clean GROUP BY ALL)""",
        "clean",
    ),
)
def _(v):
    out = aggregates.port_local_by_time(hourly(v), AREA_KEYS)
    out = out.drop("khwd_wind_direction_sin_mean", "khwd_wind_direction_cos_mean", "khwd_gust_direction_sin_mean", "khwd_gust_direction_cos_mean")
    return rounded(out, *PORT, "port_local_rainy_station_ratio", "port_local_precipitation_1hr_mean").withColumn("obs_time", ts("obs_time"))


# Upstream stations per season; months 1 and 2 are winter in the test period.
UPSTREAM = {"winter": ["S01", "S04", "S09"], "summer": ["S02"], "spring": ["S03"]}
UPSTREAM_STATS = [f"upstream_subset_{m}_{s}" for m in ("wind_speed", "wind_gust", "precipitation_1hr") for s in ("mean", "max")]


@query(
    "agg06_upstream_lead",
    with_views(
        f"""SELECT target_area, {tsql('obs_hour')} AS obs_time, 4.0::DOUBLE AS upstream_subset_season_code,
            COUNT(DISTINCT CASE WHEN up THEN station_id END) AS upstream_subset_station_count, """
        + ", ".join(
            f"round({f}(CASE WHEN up THEN {m} END), 9) AS upstream_subset_{m}_{n}"
            for m in ("wind_speed", "wind_gust", "precipitation_1hr") for f, n in (("AVG", "mean"), ("MAX", "max"))
        )
        + " FROM (SELECT *, station_id IN ('S01', 'S04', 'S09') AS up FROM clean) GROUP BY target_area, obs_hour",
        "clean",
    ),
)
def _(v):
    out = aggregates.upstream_lead(hourly(v), AREA_KEYS, "obs_time", UPSTREAM)
    return rounded(out, *UPSTREAM_STATS).withColumn("obs_time", ts("obs_time"))


define_view(
    "latest",
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY obs_time DESC, seq DESC) AS rn FROM clean) WHERE rn = 1",
    ["clean"],
)


def latest(v):
    columns = ["station_id", "target_area", "obs_time", "seq", "k", "source", "device_type", "wind_speed", "wind_gust", "precipitation_1hr", "visibility", "tide_level"]
    return aggregates.latest_per(v.clean.select(*columns).withColumn("_t", F.col("obs_time")), ["station_id"], ["_t", "seq"]).drop("_t")


def near_sql(m):
    near = f"CASE WHEN station_id <> '{TARGET}' THEN {m} END"
    own = f"MAX(CASE WHEN station_id = '{TARGET}' THEN {m} END)"
    return (
        f"round(AVG({near}), 9) AS nearby_{m}_mean, MAX({near}) AS nearby_{m}_max, MIN({near}) AS nearby_{m}_min, round(STDDEV_POP({near}), 9) AS nearby_{m}_std, "
        f"round({own} - AVG({near}), 9) AS target_{m}_minus_nearby_mean, round(MAX({near}) - {own}, 9) AS nearby_{m}_max_minus_target"
    )


@query(
    "agg07_nearby_snapshot",
    with_views(
        f"""SELECT {near_sql('wind_speed')}, {near_sql('wind_gust')}, round(AVG(rain), 9) AS nearby_precipitation_1hr_mean, MAX(rain) AS nearby_precipitation_1hr_max,
            round(SUM(rain), 9) AS nearby_precipitation_1hr_sum, COUNT(*) FILTER (WHERE rain > 0) AS nearby_rainy_station_count,
            round(COUNT(*) FILTER (WHERE rain > 0) / COUNT(rain)::DOUBLE, 9) AS nearby_rainy_station_ratio, COUNT(*) AS input_station_count,
            COUNT(*) FILTER (WHERE station_id <> '{TARGET}') AS nearby_station_count,
            COUNT(CASE WHEN station_id <> '{TARGET}' THEN wind_speed END) AS available_wind_station_count,
            COUNT(CASE WHEN station_id <> '{TARGET}' THEN wind_gust END) AS available_gust_station_count, COUNT(rain) AS available_rain_station_count,
            1 AS multi_station_input_flag, 0 AS fallback_to_single_station_flag
            FROM (SELECT *, CASE WHEN station_id <> '{TARGET}' THEN precipitation_1hr END AS rain FROM latest)""",
        "latest",
    ),
)
def _(v):
    out = aggregates.nearby_snapshot(latest(v), TARGET)
    names = [f"nearby_{m}_{s}" for m in ("wind_speed", "wind_gust") for s in ("mean", "std", "max_minus_target")]
    names += [f"target_{m}_minus_nearby_mean" for m in ("wind_speed", "wind_gust")]
    return rounded(out, *names, "nearby_precipitation_1hr_mean", "nearby_precipitation_1hr_sum", "nearby_rainy_station_ratio")


@query(
    "agg08_port_local_snapshot",
    with_views(
        f"""SELECT target_area, """
        + ", ".join(f"round({f}({m}), 4) AS khwd_{m}_{n}" for m in ("wind_speed", "wind_gust") for f, n in (("AVG", "mean"), ("MAX", "max"), ("MIN", "min"), ("STDDEV_POP", "std")))
        + f""", COUNT(*) AS khwd_station_count, COUNT(wind_speed) AS khwd_valid_wind_station_count, COUNT(wind_gust) AS khwd_valid_gust_station_count,
            {tsql('MAX(obs_time)')} AS khwd_latest_observation_time, CASE WHEN COUNT(wind_speed) < 4 THEN 'degraded' ELSE 'ok' END AS quality_status
            FROM latest GROUP BY target_area""",
        "latest",
    ),
)
def _(v):
    out = aggregates.port_local_snapshot(latest(v), ["target_area"], minimum=4)
    return out.withColumn("khwd_latest_observation_time", ts("khwd_latest_observation_time"))


@query(
    "agg09_multistation_features",
    with_views(
        f"""SELECT target_area, """
        + ", ".join(f"arg_max({m}, (obs_time, seq)) FILTER (WHERE station_id IN ('S00', 'S09') AND {m} IS NOT NULL) AS {m}" for m in ("wind_speed", "tide_level"))
        + ", "
        + ", ".join(f"round({f}(CASE WHEN near THEN {m} END), 8) AS nearby_{m}_{n}" for m in ("wind_gust", "precipitation_1hr") for f, n in (("AVG", "mean"), ("MAX", "max"), ("MIN", "min"), ("STDDEV_POP", "std")))
        + """, COUNT(*) FILTER (WHERE near) AS nearby_active_station_count, COUNT(*) FILTER (WHERE near AND precipitation_1hr > 0) AS nearby_rain_station_count
            FROM (SELECT *, station_id NOT IN ('S00', 'S09') AS near FROM clean) GROUP BY target_area""",
        "clean",
    ),
)
def _(v):
    # One target station per area: its id is replaced by a shared one.
    renamed = v.clean.withColumn("station_id", F.when(F.col("station_id").isin("S00", "S09"), "TARGET").otherwise(F.col("station_id")))
    out = aggregates.multistation_features(renamed, ["target_area"], "TARGET", ["obs_time", "seq"], ["wind_speed", "tide_level"],
                                           ["wind_gust", "precipitation_1hr", "visibility"], forbidden=["visibility"])
    names = [f"nearby_{m}_{s}" for m in ("wind_gust", "precipitation_1hr") for s in ("mean", "max", "min", "std")]
    return rounded(out, *names, places=8)


@query(
    "agg10_rain_summary",
    with_views(
        """SELECT target_area, string_agg(station_id || '=' || CAST(round(precipitation_1hr, 1) AS VARCHAR), ',' ORDER BY station_id) AS stations,
           MAX(precipitation_1hr) AS max_1hr, round(AVG(precipitation_1hr), 9) AS mean_1hr, COUNT(*) FILTER (WHERE precipitation_1hr > 0) AS rainy_station_count,
           COUNT(precipitation_1hr) > 0 AS available FROM latest GROUP BY target_area""",
        "latest",
    ),
)
def _(v):
    out = aggregates.rain_summary(latest(v), ["target_area"])
    entries = F.transform(F.map_entries("station_values_1hr"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 1).cast("string")))
    return out.select("target_area", F.array_join(entries, ",").alias("stations"), "max_1hr", r("mean_1hr").alias("mean_1hr"), "rainy_station_count", "available")


STATUS_AS_OF = "2024-01-31 00:00:00"


def threshold_sql(source="source", device="device_type"):
    arms = " ".join(f"WHEN lower({source}) = '{s}' AND upper({device}) = '{d}' THEN {p[0]}" for (s, d), p in FRESHNESS_POLICIES.items())
    return f"CASE {arms} ELSE 20 END"


# The view's sources renamed so that some rows hit a policy and some the default.
NETWORK_SQL = "CASE WHEN source IN ('view', 'click') THEN 'TWPORT' WHEN source = 'error' THEN 'cwa' ELSE source END"


def network(v):
    renamed = F.when(F.col("source").isin("view", "click"), "TWPORT").when(F.col("source") == "error", "cwa").otherwise(F.col("source"))
    return v.obs.withColumn("source", renamed)


def status_sql(keys: str, scope: str) -> str:
    columns = "source, device_type" if scope == "group" else "NULL AS source, NULL AS device_type"
    return f"""SELECT {columns}, '{scope}' AS scope, CAST(SUM(n) AS BIGINT) AS row_count, COUNT(DISTINCT station_id) AS station_count,
        COUNT(*) AS latest_station_count, {tsql('MAX(latest_obs)')} AS latest_obs_time, {tsql('MAX(latest_fetch)')} AS latest_fetched_at,
        CAST(SUM(stale_n) AS BIGINT) AS stored_stale_count, COUNT(*) FILTER (WHERE age > threshold) AS current_stale_count,
        COUNT(*) FILTER (WHERE age > 1440) AS outage_count,
        CAST(greatest(0, floor((epoch(TIMESTAMP '{STATUS_AS_OF}') - epoch(MAX(latest_obs))) / 60)) AS BIGINT) AS latest_obs_age_minutes,
        COUNT(*) FILTER (WHERE age > threshold) = 0 AS is_current FROM s {keys}"""


@query(
    "agg11_data_status",
    with_views("", "obs").rstrip()
    + f""", s AS (SELECT *, {threshold_sql()} AS threshold, greatest(0, floor((epoch(TIMESTAMP '{STATUS_AS_OF}') - epoch(latest_obs)) / 60)) AS age FROM (
        SELECT source, device_type, station_id, COUNT(*) AS n, MAX(obs_time) AS latest_obs, MAX(fetched_at) AS latest_fetch, SUM(CAST(stale AS INT)) AS stale_n
        FROM (SELECT * REPLACE ({NETWORK_SQL} AS source) FROM obs) WHERE NOT is_forecast GROUP BY ALL))
      {status_sql('GROUP BY source, device_type', 'group')} UNION ALL {status_sql('', 'overall')}""",
)
def _(v):
    out = aggregates.data_status(network(v), F.lit(STATUS_AS_OF).cast("timestamp"))
    return out.withColumns({"latest_obs_time": ts("latest_obs_time"), "latest_fetched_at": ts("latest_fetched_at")})


@query(
    "agg12_nearby_readiness",
    with_views(
        """SELECT station_id, 1 AS station_count, COUNT(*) AS sample_count, CAST(floor((epoch_us(MAX(obs_time)) - epoch_us(MIN(obs_time))) / 86400e6) AS BIGINT) AS training_days,
           COUNT(wind_speed) AS valid_wind_samples, COUNT(wind_gust) AS valid_gust_samples, COUNT(precipitation_1hr) AS valid_rain_samples,
           concat_ws('; ', 'selected station count below threshold', CASE WHEN COUNT(*) < 820 THEN 'sample_count below min_total_samples' END,
             CASE WHEN floor((epoch_us(MAX(obs_time)) - epoch_us(MIN(obs_time))) / 86400e6) < 30 THEN 'training_days below min_training_days' END,
             CASE WHEN COUNT(wind_speed) < 750 THEN 'valid_wind_samples below threshold' END, CASE WHEN COUNT(wind_gust) < 750 THEN 'valid_gust_samples below threshold' END,
             CASE WHEN COUNT(precipitation_1hr) < 750 THEN 'valid_rain_samples below threshold' END) AS failed_reasons, FALSE AS ready
           FROM clean GROUP BY station_id""",
        "clean",
    ),
)
def _(v):
    out = aggregates.nearby_readiness(v.clean, ["station_id"], min_samples=820, min_valid=750)
    return out.withColumn("failed_reasons", F.array_join("failed_reasons", "; "))


@query(
    "agg13_dataset_readiness",
    with_views(
        """SELECT target_area, COUNT(*) AS sample_count, round((epoch_us(MAX(obs_time)) - epoch_us(MIN(obs_time))) / 86400e6, 9) AS training_days,
           round(greatest(AVG(CAST(wind_speed IS NULL AS INT)), AVG(CAST(visibility IS NULL AS INT))), 9) AS feature_missing_ratio,
           round(greatest(AVG(CAST(wind_gust IS NULL AS INT)), AVG(CAST(tide_level IS NULL AS INT))), 9) AS label_missing_ratio,
           COUNT(*) FILTER (WHERE wind_gust IS NOT NULL) AS "valid_H1", COUNT(*) FILTER (WHERE wind_gust IS NOT NULL AND tide_level IS NOT NULL) AS "valid_H2",
           concat_ws('; ', CASE WHEN COUNT(*) < 500 THEN 'sample_count below min_total_samples' END,
             CASE WHEN (epoch_us(MAX(obs_time)) - epoch_us(MIN(obs_time))) / 86400e6 < 30 THEN 'training_days below min_training_days' END,
             CASE WHEN greatest(AVG(CAST(wind_speed IS NULL AS INT)), AVG(CAST(visibility IS NULL AS INT))) > 0.05 THEN 'feature missing ratio above threshold' END,
             CASE WHEN greatest(AVG(CAST(wind_gust IS NULL AS INT)), AVG(CAST(tide_level IS NULL AS INT))) > 0.05 THEN 'label missing ratio above threshold' END) AS failed_reasons
           FROM clean GROUP BY target_area""",
        "clean",
    ),
)
def _(v):
    out = aggregates.dataset_readiness(v.clean, ["target_area"], ["wind_speed", "visibility"], {"H1": ["wind_gust"], "H2": ["wind_gust", "tide_level"]},
                                       min_days=30.0, max_missing=0.05)
    out = rounded(out, "training_days", "feature_missing_ratio", "label_missing_ratio")
    return out.withColumn("failed_reasons", F.array_join("failed_reasons", "; ")).drop("ready")


@query(
    "agg14_surge_readiness",
    with_views(
        """SELECT station_id, COUNT(*) AS rows, round((epoch_us(MAX(obs_time)) - epoch_us(MIN(obs_time))) / 86400e6, 3) AS coverage_days,
           COUNT(tide_level) AS tide_level_non_null, COUNT(wind_speed) AS wind_speed_non_null,
           COUNT(tide_level) >= 700 AND (epoch_us(MAX(obs_time)) - epoch_us(MIN(obs_time))) / 86400e6 >= 21 AS usable,
           concat_ws(',', CASE WHEN COUNT(tide_level) < 700 THEN 'rows' END, CASE WHEN (epoch_us(MAX(obs_time)) - epoch_us(MIN(obs_time))) / 86400e6 < 21 THEN 'coverage_days' END) AS blockers
           FROM clean GROUP BY station_id""",
        "clean",
    ),
)
def _(v):
    out = aggregates.surge_readiness(v.clean, ["tide_level", "wind_speed"], min_rows=700)
    return out.withColumn("blockers", F.array_join("blockers", ","))


@query(
    "agg15_station_quality",
    with_views(
        """SELECT station_id, device_type, COUNT(*) AS record_count, """
        + ", ".join(
            f"round(AVG(CAST({m} IS NULL AS INT)), 4) AS {m}_missing_ratio, COUNT(*) FILTER (WHERE {m} < 0 OR {m} > {hi}) AS {m}_out_of_range"
            for m, hi in (("wind_speed", 60), ("wind_gust", 100), ("wind_direction", 360))
        )
        + """, COUNT(*) FILTER (WHERE wind_gust < wind_speed) AS gust_below_speed,
           CASE WHEN COUNT(*) FILTER (WHERE wind_speed < 0 OR wind_speed > 60 OR wind_gust > 100) > 0 THEN 'degraded' ELSE 'ok' END AS quality_status, TRUE AS valid
           FROM obs GROUP BY station_id, device_type""",
        "obs",
    ),
)
def _(v):
    return aggregates.station_quality(v.obs, ["station_id", "device_type"]).drop("warnings")


@query(
    "agg16_coverage",
    with_views(
        f"""SELECT priority_group, {tsql('MIN(obs_time)')} AS first_time, {tsql('MAX(obs_time)')} AS last_time,
            round((epoch_us(MAX(obs_time)) - epoch_us(MIN(obs_time))) / 86400e6, 3) AS duration_days, COUNT(*) AS row_count,
            COUNT(coalesce(wind_speed, visibility, tide_level)) AS valid_row_count,
            round(COUNT(coalesce(wind_speed, visibility, tide_level)) / COUNT(*)::DOUBLE, 4) AS valid_ratio
            FROM clean JOIN station USING (station_id) GROUP BY priority_group""",
        "clean", "station",
    ),
)
def _(v):
    grouped = v.clean.join(v.station.select("station_id", "priority_group"), "station_id")
    out = aggregates.coverage(grouped, ["priority_group"], ["wind_speed", "visibility", "tide_level"])
    return out.withColumns({"first_time": ts("first_time"), "last_time": ts("last_time")})


@query(
    "agg32_availability",
    with_views(
        """SELECT left(id, 2) AS prefix, COUNT(*) AS requested_count, COUNT(o.station_id) AS available_count, COUNT(*) - COUNT(o.station_id) AS missing_count,
           COUNT(o.station_id) >= 2 AS meets_minimum
           FROM (SELECT 'S' || lpad(CAST(n AS VARCHAR), 2, '0') AS id FROM range(0, 16) t(n)) q LEFT JOIN (SELECT DISTINCT station_id FROM obs) o ON q.id = o.station_id
           GROUP BY ALL""",
        "obs",
    ),
)
def _(v):
    requested = dimension(v.spark, [(f"S{n:02d}", f"S{n:02d}"[:2]) for n in range(16)], "station_id string, prefix string")
    return aggregates.availability_by_prefix(requested, v.obs, 2)


@query(
    "agg33_current_quality",
    with_views(
        f"""SELECT device_type, COUNT(*) AS record_count, COUNT(*) FILTER (WHERE age > threshold) AS stale_count, bool_or(age > threshold) AS contains_stale FROM (
            SELECT device_type, {threshold_sql()} AS threshold, greatest(0, floor((epoch(TIMESTAMP '{STATUS_AS_OF}') - epoch(obs_time)) / 60)) AS age
            FROM (SELECT * REPLACE ({NETWORK_SQL} AS source) FROM obs)) GROUP BY device_type""",
        "obs",
    ),
)
def _(v):
    return aggregates.current_quality(network(v), F.lit(STATUS_AS_OF).cast("timestamp"), ["device_type"])


@query(
    "agg35_station_diagnostics",
    with_views(
        f"""SELECT station_id, name, role, COUNT(*) AS row_count, {tsql('MAX(obs_time)')} AS latest_time FROM obs JOIN station USING (station_id) GROUP BY ALL""",
        "obs", "station",
    ),
)
def _(v):
    from skywharf.operators.reports import station_diagnostics

    return station_diagnostics(v.obs, v.station.select("station_id", "name", "role")).withColumn("latest_time", ts("latest_time"))


@query(
    "agg37_negative_counts",
    with_views(
        """SELECT station_id, COUNT(*) AS row_count, COUNT(*) FILTER (WHERE wind_speed < 0) AS wind_speed_negative_count,
           COUNT(*) FILTER (WHERE wind_gust < 0) AS wind_gust_negative_count, COUNT(*) >= 820 AS enough_rows FROM obs GROUP BY station_id""",
        "obs",
    ),
)
def _(v):
    return aggregates.negative_counts(v.obs, ["wind_speed", "wind_gust"], minimum_rows=820)


@query("agg38_store_totals", with_views(f"SELECT COUNT(*) AS row_count, {tsql('MAX(fetched_at)')} AS latest_fetched_at FROM obs", "obs"))
def _(v):
    return v.obs.agg(F.count(F.lit(1)).alias("row_count"), ts(F.max("fetched_at")).alias("latest_fetched_at"))
