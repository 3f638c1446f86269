"""Spatial, as-of, interval and lookup joins; top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywharf.catalog.aggregates import latest, network, port_distance_sql, threshold_sql
from skywharf.catalog.aggregates import NETWORK_SQL
from skywharf.catalog.registry import query
from skywharf.catalog.scalar import haversine_sql
from skywharf.catalog.views import BASELINE_STATION, define_view, r, rounded, ts, tsql, with_views
from skywharf.functions import geo
from skywharf.operators import aggregates, joins, labels, ranking
from skywharf.plans.dims import dimension
from skywharf.schema import FRESHNESS_POLICIES, HORIZONS

STATS = (("AVG", "mean"), ("MAX", "max"), ("MIN", "min"), ("STDDEV_POP", "std"))


@query(
    "join01_spatial_aggregation",
    with_views(
        f"""SELECT p.station_id, {tsql('p.obs_time')} AS obs_time, p.wind_speed, """
        + ", ".join(f"round(n.{m}_{s}, 9) AS {m}_neighbors_{s}" for m in ("wind_speed", "wind_gust") for _, s in STATS)
        + """, round(p.wind_speed - n.wind_speed_mean, 9) AS wind_speed_spatial_diff, round(p.wind_gust - n.wind_gust_mean, 9) AS wind_gust_spatial_diff
            FROM (SELECT * FROM station_hour WHERE station_id IN ('S00', 'S01')) p LEFT JOIN (SELECT obs_time, """
        + ", ".join(f"{f}({m}) AS {m}_{s}" for m in ("wind_speed", "wind_gust") for f, s in STATS)
        + " FROM station_hour WHERE station_id NOT IN ('S00', 'S01') GROUP BY obs_time) n ON p.obs_time = n.obs_time",
        "station_hour",
    ),
)
def _(v):
    own = F.col("station_id").isin("S00", "S01")
    base = v.station_hour.select("station_id", "obs_time", "wind_speed", "wind_gust")
    out = joins.spatial_aggregation(base.filter(own), base.filter(~own), ["obs_time"], ["wind_speed", "wind_gust"])
    names = [f"{m}_neighbors_{s}" for m in ("wind_speed", "wind_gust") for _, s in STATS] + ["wind_speed_spatial_diff", "wind_gust_spatial_diff"]
    return rounded(out, *names).select("station_id", ts("obs_time").alias("obs_time"), "wind_speed", *names)


FEATURE_STATIONS = ["S04", "S05", "S08"]


@query(
    "join02_station_columns",
    with_views(
        f"SELECT {tsql('t.obs_time')} AS obs_time, t.tide_level, "
        + ", ".join(f"{s}.{m} AS \"{s}_{m}\"" for s in FEATURE_STATIONS for m in ("wind_speed", "station_pressure"))
        + " FROM (SELECT * FROM station_hour WHERE station_id = 'S01') t "
        + " ".join(f"LEFT JOIN (SELECT * FROM station_hour WHERE station_id = '{s}') {s} ON {s}.obs_time = t.obs_time" for s in FEATURE_STATIONS),
        "station_hour",
    ),
)
def _(v):
    base = v.station_hour
    target = base.filter("station_id = 'S01'").select("obs_time", "tide_level")
    out = joins.prefix_stations(target, base.filter(F.col("station_id").isin(FEATURE_STATIONS)), "obs_time", FEATURE_STATIONS, ["wind_speed", "station_pressure"])
    return out.withColumn("obs_time", ts("obs_time"))


@query(
    "join03_upstream_merge",
    with_views(
        f"""SELECT a.target_area, {tsql('a.obs_time')} AS obs_time, round(a.nearby_cwa_wind_speed_mean, 9) AS nearby_cwa_wind_speed_mean, n AS upstream_subset_station_count, m AS upstream_subset_wind_speed_max
            FROM area_hour a LEFT JOIN (SELECT target_area, obs_hour, COUNT(DISTINCT CASE WHEN station_id IN ('S01', 'S04') THEN station_id END) AS n,
              MAX(CASE WHEN station_id IN ('S01', 'S04') THEN wind_speed END) AS m FROM clean GROUP BY ALL) u ON a.target_area = u.target_area AND a.obs_time = u.obs_hour""",
        "area_hour",
    ),
)
def _(v):
    rows = v.clean.withColumn("obs_time", F.col("obs_hour"))
    up = aggregates.upstream_lead(rows, ["target_area", "obs_time"], "obs_time", {"winter": ["S01", "S04"]})
    out = v.area_hour.join(up, ["target_area", "obs_time"], "left")
    return out.select("target_area", ts("obs_time").alias("obs_time"), r("nearby_cwa_wind_speed_mean").alias("nearby_cwa_wind_speed_mean"),
                      "upstream_subset_station_count", "upstream_subset_wind_speed_max")


def nearest_sql(horizon: str, minutes: int, columns: dict[str, str], source: str = "area_half") -> str:
    """Nearest row within 30 minutes by range join and rank; later time wins ties."""
    picks = ", ".join(f"arg_min({c}, (abs(epoch(b.obs_time) - epoch(a.obs_time) - {minutes * 60}), -epoch(b.obs_time))) AS {n}" for n, c in columns.items())
    return f"""SELECT a.target_area, a.obs_time, {picks} FROM {source} a JOIN {source} b ON a.target_area = b.target_area
        AND b.obs_time BETWEEN a.obs_time + to_minutes({minutes - 30}) AND a.obs_time + to_minutes({minutes + 30}) GROUP BY ALL"""


def label_join_sql(columns: dict[str, str], source: str = "area_half") -> str:
    return " ".join(
        f"LEFT JOIN (SELECT target_area, obs_time, {', '.join(f'p.{n} AS {n}' for n in columns)} FROM ({nearest_pick(m, columns, source)})) {h} ON {h}.target_area = f.target_area AND {h}.obs_time = f.obs_time"
        for h, m in HORIZONS.items()
    )


def nearest_pick(minutes: int, columns: dict[str, str], source: str) -> str:
    fields = ", ".join(f"'{n}': b.{c}" for n, c in columns.items())
    return f"""SELECT a.target_area, a.obs_time, {{{fields}}} AS p,
        row_number() OVER (PARTITION BY a.target_area, a.obs_time ORDER BY abs(epoch(b.obs_time) - epoch(a.obs_time) - {minutes * 60}), b.obs_time DESC) AS rn
        FROM {source} a JOIN {source} b ON a.target_area = b.target_area AND b.obs_time BETWEEN a.obs_time + to_minutes({minutes - 30}) AND a.obs_time + to_minutes({minutes + 30})
        QUALIFY rn = 1"""


LABEL_COLUMNS = {"speed": "nearby_cwa_wind_speed_max", "gust": "nearby_cwa_wind_gust_max", "rain": "nearby_cwa_precipitation_1hr_max"}


@query(
    "join04_nearest_labels",
    with_views(
        f"SELECT f.target_area, {tsql('f.obs_time')} AS obs_time, "
        + ", ".join(
            f"{h}.speed AS \"target_nearby_wind_speed_{h}\", {h}.gust AS \"target_nearby_wind_gust_{h}\", {h}.rain AS \"target_nearby_precipitation_1hr_{h}\", "
            f"CAST({h}.rain > 0.5 AS INT) AS \"target_rain_event_{h}\", CAST({h}.rain > 10 AS INT) AS \"target_heavy_rain_event_{h}\"" for h in HORIZONS
        )
        + f" FROM area_half f {label_join_sql(LABEL_COLUMNS)}",
        "area_half",
    ),
)
def _(v):
    out = labels.area_labels(v.area_half, ["target_area"])
    names = [f"target_{n}_{h}" for h in HORIZONS for n in ("nearby_wind_speed", "nearby_wind_gust", "nearby_precipitation_1hr", "rain_event", "heavy_rain_event")]
    return out.select("target_area", ts("obs_time").alias("obs_time"), *names)


# Irregular series: the first observation of every (area, 20 minutes) at its own time.
define_view(
    "area_irregular",
    """SELECT target_area, MIN(obs_time) AS obs_time, MAX(wind_speed) AS khwd_wind_speed_max, MAX(wind_gust) AS khwd_wind_gust_max,
       CASE WHEN COUNT(*) % 3 = 0 THEN NULL ELSE MAX(precipitation_1hr) END AS port_local_precipitation_1hr_max
       FROM clean GROUP BY target_area, time_bucket(INTERVAL 20 MINUTE, obs_time, TIMESTAMP '2000-01-01')""",
    ["clean"],
)


def irregular(v):
    slot = F.floor(F.unix_seconds("obs_time") / 1200)
    return v.clean.groupBy("target_area", slot.alias("_slot")).agg(
        F.min("obs_time").alias("obs_time"), F.max("wind_speed").alias("khwd_wind_speed_max"), F.max("wind_gust").alias("khwd_wind_gust_max"),
        F.when(F.count(F.lit(1)) % 3 != 0, F.max("precipitation_1hr")).alias("port_local_precipitation_1hr_max"),
    ).drop("_slot")


PORT_LABELS = {"speed": "khwd_wind_speed_max", "gust": "khwd_wind_gust_max", "rain": "port_local_precipitation_1hr_max", "at": "obs_time"}


@query(
    "join05_port_labels",
    with_views(
        f"SELECT f.target_area, {tsql('f.obs_time')} AS obs_time, "
        + ", ".join(
            f"{h}.speed AS \"target_wind_speed_{h}\", {h}.gust AS \"target_wind_gust_{h}\", "
            f"CASE WHEN {h}.at IS NOT NULL THEN CAST(coalesce({h}.rain > 0.5, FALSE) AS INT) END AS \"target_rain_event_{h}\"" for h in HORIZONS
        )
        + f" FROM area_irregular f {label_join_sql(PORT_LABELS, 'area_irregular')}",
        "area_irregular",
    ),
)
def _(v):
    out = labels.port_labels(irregular(v), ["target_area"], rain=True)
    names = [f"target_{n}_{h}" for h in HORIZONS for n in ("wind_speed", "wind_gust", "rain_event")]
    return out.select("target_area", ts("obs_time").alias("obs_time"), *names)


# Three-hour forecast periods, some without a value; anchors every hour and horizon.
define_view(
    "periods",
    """SELECT target_area, start_ts, start_ts + INTERVAL 3 HOUR AS end_ts, seq,
         CASE WHEN n % 6 = 0 OR n % 5 = 0 THEN '' WHEN n % 6 = 1 THEN pct || '%' ELSE pct END AS raw_value,
         CASE WHEN n % 6 <> 0 AND n % 5 <> 0 THEN CAST(pct AS INT) / 100.0::DOUBLE END AS pop
       FROM (SELECT target_area, time_bucket(INTERVAL 3 HOUR, obs_time, TIMESTAMP '2000-01-01') AS start_ts, MIN(seq) AS seq, COUNT(*) AS n, CAST(CAST(round(AVG(k)) AS INT) AS VARCHAR) AS pct
             FROM obs GROUP BY ALL)""",
    ["obs"],
)
define_view(
    "anchors",
    """SELECT target_area, obs_time, label, minutes, obs_time + to_minutes(minutes) AS anchor_ts FROM (SELECT DISTINCT target_area, obs_hour AS obs_time FROM obs),
       (VALUES ('H1', 30), ('H2', 60), ('H3', 90), ('H4', 120)) h(label, minutes)""",
    ["obs"],
)
ANCHOR_ID = ["obs_time", "label"]


def periods(v):
    start = F.timestamp_seconds((F.floor(F.unix_seconds("obs_time") / 10800) * 10800).cast("long"))
    grouped = v.obs.groupBy("target_area", start.alias("start_ts")).agg(
        F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.round(F.avg("k")).cast("int").alias("pct")
    )
    text, silent = F.col("pct").cast("string"), (F.col("n") % 6 == 0) | (F.col("n") % 5 == 0)
    return grouped.select(
        "target_area", "start_ts", (F.col("start_ts") + F.expr("interval 3 hours")).alias("end_ts"), "seq",
        F.when(silent, "").when(F.col("n") % 6 == 1, F.concat(text, F.lit("%"))).otherwise(text).alias("raw_value"),
        F.when(~silent, F.col("pct") / 100.0).alias("pop"),
    )


def anchors(v):
    hours = v.obs.select("target_area", F.col("obs_hour").alias("obs_time")).distinct()
    options = F.array(*[F.struct(F.lit(h).alias("label"), F.lit(m).alias("minutes")) for h, m in HORIZONS.items()])
    return hours.withColumn("_h", F.explode(options)).select(
        "target_area", "obs_time", "_h.label", "_h.minutes", (F.col("obs_time") + F.make_dt_interval(mins=F.col("_h.minutes"))).alias("anchor_ts")
    )


@query(
    "join06_anchor_periods",
    with_views(
        f"""SELECT a.target_area, {tsql('a.obs_time')} AS obs_time, a.label, CASE WHEN p.start_ts IS NULL THEN 'no_matching_forecast_period' ELSE 'matched_forecast_period' END AS alignment_status,
            coalesce(p.raw_value <> '', FALSE) AS available, round(CASE WHEN CAST(rtrim(nullif(p.raw_value, ''), '%') AS DOUBLE) <= 1 THEN CAST(rtrim(nullif(p.raw_value, ''), '%') AS DOUBLE) ELSE CAST(rtrim(nullif(p.raw_value, ''), '%') AS DOUBLE) / 100 END, 9) AS pop,
            CASE WHEN p.raw_value IS NULL THEN 'not_available' WHEN p.raw_value = '' THEN 'missing_field' ELSE 'ok' END AS parse_status
            FROM anchors a LEFT JOIN periods p ON a.target_area = p.target_area AND a.anchor_ts >= p.start_ts AND a.anchor_ts < p.end_ts""",
        "anchors", "periods",
    ),
)
def _(v):
    out = joins.align_to_periods(anchors(v), periods(v), ["target_area"], "anchor_ts")
    return out.select("target_area", ts("obs_time").alias("obs_time"), "label", "alignment_status", "available", r("pop").alias("pop"), "parse_status")


@query(
    "join07_period_or_nearest",
    with_views(
        f"""SELECT target_area, {tsql('obs_time')} AS obs_time, label, round(pop, 9) AS pop FROM (
            SELECT a.*, p.pop, row_number() OVER (PARTITION BY a.target_area, a.obs_time, a.label ORDER BY CASE WHEN a.anchor_ts >= p.start_ts AND a.anchor_ts < p.end_ts THEN 0 ELSE 1 END,
              abs(epoch(p.start_ts) - epoch(a.anchor_ts)), p.start_ts) AS rn FROM anchors a JOIN periods p ON a.target_area = p.target_area AND p.pop IS NOT NULL) WHERE rn = 1""",
        "anchors", "periods",
    ),
)
def _(v):
    out = joins.period_or_nearest(anchors(v), periods(v), ["target_area"], "anchor_ts", ["pop"])
    return out.select("target_area", ts("obs_time").alias("obs_time"), "label", r("pop").alias("pop"))


@query(
    "join08_current_and_next",
    with_views(
        f"""SELECT a.target_area, {tsql('a.obs_time')} AS obs_time, a.label, round(CASE WHEN p.start_ts IS NOT NULL THEN p.pop ELSE f.first_pop END, 9) AS current_value,
            round(CASE WHEN p.start_ts IS NOT NULL THEN p.next_pop ELSE f.second_pop END, 9) AS next_value
            FROM anchors a LEFT JOIN (SELECT *, CASE WHEN lead(start_ts) OVER w IS NULL THEN pop ELSE lead(pop) OVER w END AS next_pop FROM periods WINDOW w AS (PARTITION BY target_area ORDER BY start_ts)) p
              ON a.target_area = p.target_area AND a.anchor_ts >= p.start_ts AND a.anchor_ts < p.end_ts
            LEFT JOIN (SELECT target_area, MAX(CASE WHEN rn = 1 THEN pop END) AS first_pop, MAX(CASE WHEN rn = 2 THEN pop END) AS second_pop
                       FROM (SELECT *, row_number() OVER (PARTITION BY target_area ORDER BY start_ts) AS rn FROM periods) GROUP BY target_area) f ON f.target_area = a.target_area""",
        "anchors", "periods",
    ),
)
def _(v):
    out = joins.current_and_next(anchors(v), periods(v), ["target_area"], "anchor_ts", "pop")
    return out.select("target_area", ts("obs_time").alias("obs_time"), "label", r("current_value").alias("current_value"), r("next_value").alias("next_value"))


# Persistence as the model, a damped line as the external forecast.
define_view(
    "scored",
    """SELECT station_id, obs_time, wind_speed, precipitation_1hr, lag(wind_speed) OVER w AS pred_wind_speed, lag(precipitation_1hr) OVER w AS pred_precipitation_1hr,
       CASE WHEN k % 5 <> 0 THEN 0.7::DOUBLE * wind_speed + 1 END AS cwa_wind_speed, k
       FROM station_hour WINDOW w AS (PARTITION BY station_id ORDER BY obs_time)""",
    ["station_hour"],
)


def scored(v):
    from skywharf.plans.timeline import over_chunks

    def stage(w):
        return {"pred_wind_speed": F.lag("wind_speed").over(w), "pred_precipitation_1hr": F.lag("precipitation_1hr").over(w)}

    base = v.station_hour.select("station_id", "obs_time", "wind_speed", "precipitation_1hr", "k")
    lagged = over_chunks(base, ["station_id"], "obs_time", [stage], reach_back=1)
    return lagged.withColumn("cwa_wind_speed", F.when(F.col("k") % 5 != 0, F.lit(0.7) * F.col("wind_speed") + 1))


@query(
    "join09_comparator_merge",
    with_views(
        f"SELECT station_id, {tsql('obs_time')} AS obs_time, wind_speed, pred_wind_speed, cwa_wind_speed FROM scored WHERE wind_speed IS NOT NULL AND pred_wind_speed IS NOT NULL",
        "scored",
    ),
)
def _(v):
    base = scored(v)
    forecast = base.select("station_id", "obs_time", "cwa_wind_speed")
    out = joins.merge_predictions(base.select("station_id", "obs_time", "wind_speed"), base, forecast, ["station_id", "obs_time"], "wind_speed")
    return out.withColumn("obs_time", ts("obs_time"))


LATEST_COLUMNS = "seq, station_id, device_type, source, wind_speed"


def truncated(v):
    return v.obs.select("seq", "station_id", "device_type", "source", "wind_speed", "is_forecast", F.col("obs_hour").alias("obs_time"))


@query(
    "join10_latest_by_device",
    with_views(
        f"""SELECT {LATEST_COLUMNS}, {tsql('obs_hour')} AS obs_time FROM obs JOIN (SELECT device_type, station_id, MAX(obs_hour) AS obs_hour FROM obs WHERE NOT is_forecast GROUP BY ALL)
            USING (device_type, station_id, obs_hour) WHERE NOT is_forecast""",
        "obs",
    ),
)
def _(v):
    out = joins.latest_all_ties(truncated(v), ["device_type", "station_id"])
    return out.drop("is_forecast").withColumn("obs_time", ts("obs_time"))


@query(
    "join11_latest_by_source",
    with_views(
        f"""SELECT {LATEST_COLUMNS}, {tsql('obs_hour')} AS obs_time FROM obs m WHERE NOT is_forecast AND obs_hour = (SELECT MAX(obs_hour) FROM obs o
            WHERE o.source = m.source AND o.device_type = m.device_type AND o.station_id = m.station_id AND NOT o.is_forecast)""",
        "obs",
    ),
)
def _(v):
    out = joins.latest_all_ties(truncated(v), ["source", "device_type", "station_id"])
    return out.drop("is_forecast").withColumn("obs_time", ts("obs_time"))


@query(
    "join12_policy_lookup",
    with_views(
        f"""SELECT source, device_type, {threshold_sql()} AS threshold_minutes, 45 AS override_minutes,
            CASE {' '.join(f"WHEN lower(source) = '{s}' AND device_type = '{d}' THEN '{p[1]}'" for (s, d), p in FRESHNESS_POLICIES.items())} ELSE '約 5-20 分鐘' END AS expected_update_interval,
            COUNT(*) AS n_rows FROM (SELECT * REPLACE ({NETWORK_SQL} AS source) FROM obs) GROUP BY source, device_type""",
        "obs",
    ),
)
def _(v):
    source, device = F.col("source"), F.col("device_type")
    return network(v).groupBy("source", "device_type").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "source", "device_type", aggregates.freshness_threshold(source, device).alias("threshold_minutes"),
        aggregates.freshness_threshold(source, device, 45).alias("override_minutes"), aggregates.freshness_texts(source, device)["expected_update_interval"].alias("expected_update_interval"),
        "n_rows",
    )


@query(
    "join13_station_radius",
    with_views(
        f"""SELECT o.station_id, s.distance_km, COUNT(*) AS n_rows FROM obs o JOIN (
            SELECT station_id, round({haversine_sql('22.6', '120.3', 'latitude', 'longitude', 6371.0)}, 3) AS distance_km FROM station
            WHERE {haversine_sql('22.6', '120.3', 'latitude', 'longitude', 6371.0)} <= 10) s USING (station_id) GROUP BY ALL""",
        "obs", "station",
    ),
)
def _(v):
    pool = joins.within_radius(v.station, 22.6, 120.3, 10.0).select("station_id", "distance_km")
    return v.obs.join(pool, "station_id").groupBy("station_id", "distance_km").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "join14_port_distance",
    with_views(f"SELECT seq, round({port_distance_sql()}, 6) AS distance_to_port_km FROM obs JOIN station USING (station_id)", "obs", "station"),
)
def _(v):
    km = geo.distance_to_points(F.col("latitude"), F.col("longitude"), radius=geo.EARTH_RADIUS_KM + 0.0088)
    stations = v.station.select("station_id", F.round(km, 6).alias("distance_to_port_km"))
    return v.obs.join(stations, "station_id").select("seq", "distance_to_port_km")


@query(
    "join15_nearest_planar",
    with_views(
        f"""SELECT day, station_id, round(d, 9) AS distance_degrees FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY d, station_id) AS rn FROM (
            SELECT DISTINCT strftime(obs_time, '%Y-%m-%d') AS day, station_id, sqrt(pow(latitude - 22.61, 2) + pow(longitude - 120.31, 2)) AS d FROM obs JOIN station USING (station_id)) WHERE d <= 0.05) WHERE rn = 1""",
        "obs", "station",
    ),
)
def _(v):
    seen = v.obs.select(F.date_format("obs_time", "yyyy-MM-dd").alias("day"), "station_id").distinct()
    located = seen.join(v.station.select("station_id", "latitude", "longitude"), "station_id")
    return rounded(joins.nearest_planar(located, F.lit(22.61), F.lit(120.31), 0.05, ["day"]), "distance_degrees")


@query(
    "join16_semi_anti",
    with_views(
        """SELECT 'upstream_selected' AS kind, station_id, COUNT(*) AS n_rows FROM obs WHERE station_id IN ('S01', 'S04') GROUP BY station_id
           UNION ALL SELECT 'unknown', station_id, COUNT(*) FROM obs WHERE station_id NOT IN (SELECT station_id FROM station WHERE enabled) GROUP BY station_id""",
        "obs", "station",
    ),
)
def _(v):
    upstream = dimension(v.spark, [("S01",), ("S04",), ("S99",)], "station_id string")
    known = v.station.filter("enabled").select("station_id")

    def counted(df, kind):
        return df.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(kind).alias("kind"), "station_id", "n_rows")

    return counted(v.obs.join(upstream, "station_id", "left_semi"), "upstream_selected").unionByName(
        counted(v.obs.join(known, "station_id", "left_anti"), "unknown")
    )


@query(
    "join17_merge_sources",
    with_views(
        f"""SELECT {tsql('obs_time')} AS obs_time, station_id, source, wind_speed, NULL::DOUBLE AS tide_level FROM clean UNION ALL
            SELECT {tsql('obs_time')}, station_id, 'marine', NULL, tide_level FROM clean""",
        "clean",
    ),
)
def _(v):
    land, marine = v.clean.select("obs_time", "station_id", "source", "wind_speed"), v.clean.select("obs_time", "station_id", "tide_level")
    return joins.merge_sources({"land": land, "marine": marine}).withColumn("obs_time", ts("obs_time"))


@query(
    "join17_merge_inner",
    with_views(
        f"""SELECT {tsql('obs_time')} AS obs_time, a.station_id, a.w AS land_wind, b.w AS marine_wind FROM
            (SELECT station_id, obs_hour AS obs_time, MAX(wind_speed) AS w FROM clean GROUP BY ALL) a JOIN
            (SELECT station_id, obs_hour + INTERVAL 1 HOUR AS obs_time, MAX(wind_gust) AS w FROM clean GROUP BY ALL) b USING (station_id, obs_time)""",
        "clean",
    ),
)
def _(v):
    def one(time, measure):
        return v.clean.groupBy("station_id", time.alias("obs_time")).agg(F.max(measure).alias("wind"))

    later = F.col("obs_hour") + F.expr("interval 1 hour")
    out = joins.merge_sources({"land": one(F.col("obs_hour"), "wind_speed"), "marine": one(later, "wind_gust")}, how="inner")
    return out.select(ts("obs_time").alias("obs_time"), "station_id", "land_wind", "marine_wind")


@query(
    "join18_attach_latest",
    with_views(
        f"""SELECT station_id, {tsql('obs_time')} AS obs_time, CASE WHEN obs_time = MAX(obs_time) OVER (PARTITION BY station_id) THEN p ELSE 0 END AS nearby_precip_1, q AS qpe_1hr_mm
            FROM station_hour JOIN (SELECT station_id, MAX(precipitation_1hr) AS p, AVG(precipitation_1hr) > 1 AS q FROM station_hour GROUP BY station_id) USING (station_id)""",
        "station_hour",
    ),
)
def _(v):
    base = v.station_hour.select("station_id", "obs_time", "precipitation_1hr")
    stats = base.groupBy("station_id").agg(F.max("precipitation_1hr").alias("nearby_precip_1"), (F.avg("precipitation_1hr") > 1).alias("qpe_1hr_mm"))
    out = joins.attach_to_latest(base.select("station_id", "obs_time"), stats, "station_id", "obs_time", ["nearby_precip_1"])
    return out.join(stats.select("station_id", "qpe_1hr_mm"), "station_id").withColumn("obs_time", ts("obs_time"))


# --- top-k ----------------------------------------------------------------

FIRST_IDS = ["S01", "S05"]


@query(
    "top01_rank_stations",
    with_views(
        f"""SELECT station_id, distance_to_port_km, closer_than_baseline, rank, closer_than_baseline AND SUM(CAST(closer_than_baseline AS INT)) OVER (ORDER BY rank) <= 6 AS selected, ranked_group, n_rows FROM (
            SELECT station_id, round(d, 4) AS distance_to_port_km, d < (SELECT {port_distance_sql()} FROM station WHERE station_id = '{BASELINE_STATION}') AND station_id <> '{BASELINE_STATION}' AS closer_than_baseline,
              row_number() OVER (ORDER BY CASE WHEN station_id IN ('S01', 'S05') THEN 0 ELSE 1 END, round(d, 4), station_id) AS rank,
              CASE WHEN station_id IN ('S01', 'S05') THEN 'priority_1_near_port' ELSE 'priority_2_outer_nearby' END AS ranked_group, n_rows
            FROM (SELECT s.*, {port_distance_sql()} AS d, n_rows FROM station s JOIN (SELECT station_id, COUNT(*) AS n_rows FROM obs GROUP BY ALL) USING (station_id)))""",
        "obs", "station",
    ),
)
def _(v):
    counts = v.obs.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_rows"))
    out = ranking.rank_nearby(counts.join(v.station, "station_id"), BASELINE_STATION, FIRST_IDS)
    return out.select("station_id", "distance_to_port_km", "closer_than_baseline", "rank", "selected", "ranked_group", "n_rows")


@query(
    "top02_nearest_rain_stations",
    with_views(
        f"""SELECT station_id, name, round(km, 2) AS dist_km, precipitation_1hr FROM (SELECT s.*, {haversine_sql('22.6', '120.3', 'latitude', 'longitude', 6371.0)} AS km, precipitation_1hr FROM station s JOIN latest USING (station_id))
            WHERE km <= 12 ORDER BY round(km, 2), station_id LIMIT 3""",
        "latest", "station",
    ),
)
def _(v):
    joined = latest(v).select("station_id", "precipitation_1hr").join(v.station, "station_id")
    return ranking.nearest_stations(joined, 22.6, 120.3, 12.0, 3).select("station_id", "name", "dist_km", "precipitation_1hr")


@query("top03_latest_per_station", with_views(f"SELECT station_id, seq, {tsql('obs_time')} AS obs_time, wind_speed, source FROM latest", "latest"))
def _(v):
    return latest(v).select("station_id", "seq", ts("obs_time").alias("obs_time"), "wind_speed", "source")


define_view(
    "candidates",
    """SELECT strftime(obs_time, '%Y-%m-%d') AS day, source AS dataset_id, CASE source WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS dataset_priority,
       station_id AS location_name, CAST(right(station_id, 2) AS INT) AS location_index, device_type AS element_name, COUNT(*) FILTER (WHERE k > 60) AS record_count,
       CASE WHEN source = 'error' THEN NULL WHEN device_type = 'WIND' THEN 6.0 WHEN device_type = 'TIDE' THEN 3.2 ELSE 5.0 END AS hours FROM obs GROUP BY ALL""",
    ["obs"],
)
RESOLUTION_SQL = "CASE WHEN hours IS NULL THEN 'unknown' WHEN round(hours) = 3 THEN '3h' WHEN round(hours) = 6 THEN '6h' ELSE 'unknown' END"


def candidates(v):
    hours = F.when(F.col("source") == "error", None).when(F.col("device_type") == "WIND", 6.0).when(F.col("device_type") == "TIDE", 3.2).otherwise(5.0)
    return v.obs.groupBy(
        F.date_format("obs_time", "yyyy-MM-dd").alias("day"), F.col("source").alias("dataset_id"),
        F.when(F.col("source") == "view", 1).when(F.col("source") == "click", 2).otherwise(3).alias("dataset_priority"),
        F.col("station_id").alias("location_name"), F.substring("station_id", 2, 2).cast("int").alias("location_index"), F.col("device_type").alias("element_name"),
        ranking.source_resolution(hours, F.col("device_type")).alias("source_resolution"),
    ).agg(F.count_if(F.col("k") > 60).alias("record_count")).withColumns(
        # Candidates are listed by dataset, location and element.
        {"element_index": F.lit(0), "candidate_index": F.concat_ws("/", "dataset_id", "location_name", "element_name")}
    )


@query(
    "top04_best_forecast_source",
    with_views(
        f"""SELECT day, TRUE AS available, dataset_id, location_name, element_name, source_resolution, record_count FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY CASE source_resolution WHEN '3h' THEN 0 WHEN '6h' THEN 1 ELSE 4 END,
              dataset_priority, location_index, dataset_id || '/' || location_name || '/' || element_name) AS rn FROM (SELECT *, {RESOLUTION_SQL} AS source_resolution FROM candidates) WHERE record_count > 0) WHERE rn = 1""",
        "candidates",
    ),
)
def _(v):
    return ranking.best_source(candidates(v), ["day"])


@query(
    "top05_first_location",
    with_views(
        """SELECT day, coalesce(arg_min(location_name, location_index) FILTER (WHERE n > 8), 'S11') AS resolved_location_name FROM
           (SELECT day, location_name, location_index, SUM(record_count) AS n FROM candidates GROUP BY ALL) GROUP BY day""",
        "candidates",
    ),
)
def _(v):
    totals = candidates(v).groupBy("day", "location_name", "location_index").agg(F.sum("record_count").alias("n"))
    busy = totals.withColumn("record_count", F.when(F.col("n") > 8, F.col("n")).otherwise(0))
    return ranking.first_available(busy, "S11", ["day"])


@query(
    "top07_recent_tail",
    with_views(f"SELECT seq, station_id, {tsql('obs_time')} AS obs_time, wind_speed FROM clean ORDER BY obs_time DESC, seq DESC LIMIT 500", "clean"),
)
def _(v):
    return v.clean.orderBy(F.col("obs_time").desc(), F.col("seq").desc()).limit(500).select("seq", "station_id", ts("obs_time").alias("obs_time"), "wind_speed")


# --- set operations -------------------------------------------------------


@query(
    "set01_union_by_name",
    with_views(
        """SELECT source, COUNT(*) AS n_rows, COUNT(wind_speed) AS with_wind, COUNT(tide_level) AS with_tide FROM (
           SELECT source, wind_speed, NULL::DOUBLE AS tide_level FROM clean UNION ALL SELECT source, NULL, tide_level FROM clean) GROUP BY source""",
        "clean",
    ),
)
def _(v):
    both = v.clean.select("source", "wind_speed").unionByName(v.clean.select("source", "tide_level"), allowMissingColumns=True)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count("wind_speed").alias("with_wind"), F.count("tide_level").alias("with_tide"))


@query("set02_distinct", with_views(f"SELECT DISTINCT station_id, {tsql('obs_hour')} AS obs_hour FROM obs", "obs"))
def _(v):
    return v.obs.select("station_id", ts("obs_hour").alias("obs_hour")).dropDuplicates()


@query(
    "set03_intersect_except",
    with_views(
        """SELECT 'both' AS kind, station_id, source, k FROM (SELECT station_id, source, k FROM obs INTERSECT SELECT station_id, source, k + 1 FROM obs)
           UNION ALL SELECT 'only_first', station_id, source, k FROM (SELECT station_id, source, k FROM obs EXCEPT SELECT station_id, source, k + 1 FROM obs)""",
        "obs",
    ),
)
def _(v):
    first, second = v.obs.select("station_id", "source", "k"), v.obs.select("station_id", "source", (F.col("k") + 1).alias("k"))
    both = first.intersect(second).select(F.lit("both").alias("kind"), "*")
    return both.unionByName(first.subtract(second).select(F.lit("only_first").alias("kind"), "*"))
