"""Lag, rolling, change features, labels, sequence windows and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywharf.catalog.aggregates import clean_distance, weighted_sql
from skywharf.catalog.cleaning import grid, interpolation_view
from skywharf.catalog.registry import query
from skywharf.catalog.scalar import DEW_GAMMA, amount_sql, gust_sql, speed_sql
from skywharf.catalog.views import define_view, r, rounded, ts, tsql, with_views
from skywharf.functions import clock, weather
from skywharf.operators import aggregates, cleaning, features, labels
from skywharf.operators.features import ANOMALY_HOURS

STATION = ["station_id"]
W = "WINDOW w AS (PARTITION BY station_id ORDER BY obs_time)"


def frame(rows: str) -> str:
    return f"(PARTITION BY station_id ORDER BY obs_time ROWS BETWEEN {rows} - 1 PRECEDING AND CURRENT ROW)"


def steps(hours: float) -> str:
    """Rows that make up a number of hours at the station's own rate."""
    return f"greatest(1, CAST(round_even({hours} * steps, 0) AS BIGINT))"


def back(measure: str, hours: float, window: str = "w") -> str:
    return f"lag({measure}, {steps(hours)}) OVER {window}"


# The hourly series with the rows per hour that its median gap shows.
define_view(
    "stepped",
    """SELECT h.*, row_number() OVER (PARTITION BY station_id ORDER BY obs_time) AS rn, coalesce(CASE WHEN med > 0 THEN greatest(1, CAST(round_even(60.0 / med, 0) AS INT)) END, 2) AS steps
       FROM station_hour h JOIN (SELECT station_id, quantile_cont(gap, 0.5) AS med FROM (
         SELECT station_id, (epoch_us(obs_time) - epoch_us(lag(obs_time) OVER (PARTITION BY station_id ORDER BY obs_time))) / 60e6 AS gap FROM station_hour) GROUP BY station_id) USING (station_id)""",
    ["station_hour"],
)


def stations(v):
    return v.station_hour


def shown(df, *names, places=9, keys=("station_id",)):
    out = rounded(df, *names, places=places)
    return out.select(*keys, ts("obs_time").alias("obs_time"), *names)


@query(
    "win01_lags",
    with_views(
        f"SELECT station_id, {tsql('obs_time')} AS obs_time, "
        + ", ".join(f"round({back(m, h)}, 9) AS \"{m}_lag_{h:g}h\"" for m in ("wind_speed", "wind_gust") for h in (0.5, 1, 2, 3, 6))
        + f" FROM stepped {W}",
        "stepped",
    ),
)
def _(v):
    out = features.hourly_features(stations(v), STATION, "obs_time", lambda n: [features.lags(["wind_speed", "wind_gust"], steps=n)])
    names = [f"{m}_lag_{h}" for m in ("wind_speed", "wind_gust") for h in ("0.5h", "1h", "2h", "3h", "6h")]
    quoted = {n: F.round(F.col(f"`{n}`"), 9) for n in names}
    return out.select("station_id", ts("obs_time").alias("obs_time"), *[c.alias(n) for n, c in quoted.items()])


@query(
    "win02_steps_per_hour",
    with_views(
        """SELECT station_id, round(med, 6) AS median_gap_minutes, CAST(greatest(1, round_even(60.0 / med, 0)) AS INT) AS steps_per_hour FROM (
           SELECT station_id, quantile_cont(gap, 0.5) AS med FROM (
             SELECT station_id, (epoch_us(obs_time) - epoch_us(lag(obs_time) OVER (PARTITION BY station_id ORDER BY obs_time, seq))) / 60e6 AS gap FROM obs)
           GROUP BY station_id)""",
        "obs",
    ),
)
def _(v):
    return rounded(features.steps_per_hour(v.obs, STATION, "obs_time"), "median_gap_minutes", places=6)


ROLL_NAMES = [f"{m}_roll_{w}_{s}" for m in ("wind_speed",) for w in ("1h", "3h", "6h") for s in ("mean", "max", "min", "std", "sum")]


@query(
    "win03_rolling",
    with_views(
        f"SELECT station_id, {tsql('obs_time')} AS obs_time, "
        + ", ".join(
            f"round({f}(wind_speed) OVER {frame(steps(h))}, 8) AS wind_speed_roll_{h}h_{s}"
            for h in (1, 3, 6) for f, s in (("AVG", "mean"), ("MAX", "max"), ("MIN", "min"), ("STDDEV_POP", "std"), ("SUM", "sum"))
        )
        + " FROM stepped",
        "stepped",
    ),
)
def _(v):
    out = features.hourly_features(stations(v), STATION, "obs_time", lambda n: [features.rolling(["wind_speed"], steps=n)])
    return shown(out, *ROLL_NAMES, places=8)


def trend_sql(measure: str, hours: float) -> str:
    """Least-squares slope over the last rows, by centred positions; needs a full frame."""
    w = frame(steps(hours))
    return (
        f"CASE WHEN COUNT({measure}) OVER {w} = {steps(hours)} THEN regr_slope({measure}, rn) OVER {w} END"
    )


@query(
    "win04_changes",
    with_views(
        f"SELECT station_id, {tsql('obs_time')} AS obs_time, "
        + ", ".join(f"round(tide_level - {back('tide_level', h)}, 9) AS \"tide_level_change_{h:g}h\"" for h in (0.5, 1, 3, 6))
        + f" FROM stepped {W}",
        "stepped",
    ),
)
def _(v):
    out = features.hourly_features(stations(v), STATION, "obs_time", lambda n: [features.changes(["tide_level"], steps=n)])
    names = [f"tide_level_change_{h}" for h in ("0.5h", "1h", "3h", "6h")]
    return out.select("station_id", ts("obs_time").alias("obs_time"), *[F.round(F.col(f"`{n}`"), 9).alias(n) for n in names])


@query(
    "win05_rolling_trend",
    with_views(
        f"SELECT station_id, {tsql('obs_time')} AS obs_time, round({trend_sql('wind_speed', 3)}, 7) AS wind_speed_trend_3h, round({trend_sql('station_pressure', 3)}, 7) AS station_pressure_trend_3h FROM stepped",
        "stepped",
    ),
)
def _(v):
    out = features.hourly_features(stations(v), STATION, "obs_time", lambda n: [features.changes(["wind_speed", "station_pressure"], steps=n)])
    return shown(out, "wind_speed_trend_3h", "station_pressure_trend_3h", places=7)


PRESSURE_NAMES = ["pressure_change_0.5h", "pressure_change_1h", "pressure_change_3h", "pressure_change_6h", "pressure_acceleration_1h"]


@query(
    "win06_pressure_features",
    with_views(
        f"""SELECT * EXCLUDE (c, k), c - lag(c, k) OVER (PARTITION BY station_id ORDER BY obs_time) AS pressure_acceleration_1h FROM (
            SELECT station_id, {tsql('obs_time')} AS obs_time, """
        + ", ".join(f"station_pressure - {back('station_pressure', h)} AS \"pressure_change_{h:g}h\"" for h in (0.5, 1, 3, 6))
        + f""", station_pressure - {back('station_pressure', 1)} AS c, {steps(1)} AS k,
            round({trend_sql('station_pressure', 3)}, 7) AS pressure_trend_3h, station_pressure AS pressure_current,
            round(station_pressure - AVG(station_pressure) OVER {frame(steps(ANOMALY_HOURS))}, 8) AS pressure_anomaly FROM stepped {W})""",
        "stepped",
    ),
)
def _(v):
    out = features.hourly_features(stations(v), STATION, "obs_time", lambda n: [features.pressure_features("station_pressure", n)])
    return out.select(
        "station_id", ts("obs_time").alias("obs_time"), *[F.col(f"`{n}`").alias(n) for n in PRESSURE_NAMES],
        r("pressure_trend_3h", 7).alias("pressure_trend_3h"), "pressure_current", r("pressure_anomaly", 8).alias("pressure_anomaly"),
    )


DEW = f"243.04 * {DEW_GAMMA} / (17.625 - {DEW_GAMMA})"
DEW_NAMES = ["temp_dewpoint_diff", "temp_dewpoint_diff_lag_1h", "temp_dewpoint_diff_lag_2h", "temp_dewpoint_diff_lag_6h", "temp_change_1h", "dewpoint_change_1h", "saturation_ratio"]


@query(
    "win07_dewpoint_features",
    with_views(
        f"""SELECT station_id, {tsql('obs_time')} AS obs_time, round(temperature - dew, 8) AS temp_dewpoint_diff,
            round({back('temperature - dew', 1)}, 8) AS temp_dewpoint_diff_lag_1h, round({back('temperature - dew', 2)}, 8) AS temp_dewpoint_diff_lag_2h,
            round({back('temperature - dew', 6)}, 8) AS temp_dewpoint_diff_lag_6h, round(temperature - {back('temperature', 1)}, 8) AS temp_change_1h,
            round(dew - {back('dew', 1)}, 8) AS dewpoint_change_1h, round(exp(-0.06 * (temperature - dew)), 8) AS saturation_ratio
            FROM (SELECT *, {DEW} AS dew FROM stepped) {W}""",
        "stepped",
    ),
)
def _(v):
    base = stations(v).withColumn("dewpoint", weather.dew_point(F.col("temperature"), F.col("relative_humidity")))
    return shown(features.hourly_features(base, STATION, "obs_time", lambda n: [features.dewpoint_features(steps=n)]), *DEW_NAMES, places=8)


@query(
    "win08_humidity_features",
    with_views(
        f"""SELECT station_id, {tsql('obs_time')} AS obs_time, relative_humidity - {back('relative_humidity', 1)} AS humidity_change_1h,
            relative_humidity - {back('relative_humidity', 3)} AS humidity_change_3h, round(AVG(relative_humidity) OVER {frame(steps(3))}, 9) AS humidity_roll_3h_mean,
            round(COUNT(*) FILTER (WHERE relative_humidity > 85) OVER {frame(steps(6))} / CAST(steps AS DOUBLE), 9) AS high_humidity_hours FROM stepped {W}""",
        "stepped",
    ),
)
def _(v):
    out = features.hourly_features(stations(v), STATION, "obs_time", lambda n: [features.humidity_features("relative_humidity", n)])
    return shown(out, "humidity_change_1h", "humidity_change_3h", "humidity_roll_3h_mean", "high_humidity_hours")


@query(
    "win09_wind_features",
    with_views(
        f"""SELECT station_id, {tsql('obs_time')} AS obs_time, round(u, 8) AS wind_u, round({back('u', 1)}, 8) AS wind_u_lag_1h, round({back('v', 2)}, 8) AS wind_v_lag_2h,
            round({back('u', 6)}, 8) AS wind_u_lag_6h, round(wind_speed - {back('wind_speed', 1)}, 8) AS wind_speed_change_1h,
            round(d + 180 - 360 * floor((d + 180) / 360) - 180, 8) AS wind_direction_change_1h,
            round(STDDEV_POP(wind_speed) OVER {frame(steps(1))}, 8) AS wind_speed_std_1h, round(STDDEV_POP(wind_speed) OVER {frame(steps(3))}, 8) AS wind_speed_std_3h FROM (
              SELECT *, -wind_speed * sin(radians(wind_direction)) AS u, -wind_speed * cos(radians(wind_direction)) AS v,
                     wind_direction - {back('wind_direction', 1, '(PARTITION BY station_id ORDER BY obs_time)')} AS d FROM stepped) {W}""",
        "stepped",
    ),
)
def _(v):
    out = features.hourly_features(stations(v), STATION, "obs_time", lambda n: [features.wind_features(steps=n)])
    return shown(out, "wind_u", "wind_u_lag_1h", "wind_v_lag_2h", "wind_u_lag_6h", "wind_speed_change_1h", "wind_direction_change_1h", "wind_speed_std_1h", "wind_speed_std_3h", places=8)


AREA = ["target_area"]


def area_frame(rows: int) -> str:
    return f"(PARTITION BY target_area ORDER BY obs_time ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


AREA_LAG_NAMES = [f"nearby_cwa_{m}_{s}" for m in ("wind_speed_max", "wind_gust_max", "precipitation_1hr_max") for s in ("lag1", "roll3")] + ["nearby_cwa_precipitation_roll3", "nearby_cwa_precipitation_roll6"]


def area_lag_sql() -> str:
    out = []
    for m in ("wind_speed_max", "wind_gust_max", "precipitation_1hr_max"):
        out.append(f"round(lag(nearby_cwa_{m}) OVER (PARTITION BY target_area ORDER BY obs_time), 8) AS nearby_cwa_{m}_lag1")
        out.append(f"round(AVG(nearby_cwa_{m}) OVER {area_frame(3)}, 8) AS nearby_cwa_{m}_roll3")
    for n in (3, 6):
        out.append(f"round(AVG(nearby_cwa_precipitation_1hr_max) OVER {area_frame(n)}, 8) AS nearby_cwa_precipitation_roll{n}")
    return ", ".join(out)


@query("win10_area_lag_roll", with_views(f"SELECT target_area, {tsql('obs_time')} AS obs_time, {area_lag_sql()} FROM area_hour", "area_hour"))
def _(v):
    out = features.apply_features(v.area_hour, AREA, "obs_time", [features.area_lag_roll(v.area_hour.columns)])
    return shown(out, *AREA_LAG_NAMES, places=8, keys=AREA)


PORT_NAMES = ["khwd_wind_speed_mean_lag1", "khwd_wind_speed_mean_lag2", "khwd_wind_speed_max_lag1", "khwd_wind_gust_max_lag1", "khwd_wind_gust_max_lag2",
              "khwd_wind_speed_mean_roll3", "khwd_wind_speed_max_roll3", "khwd_wind_gust_mean_roll3", "khwd_wind_gust_max_roll3"]


@query(
    "win11_port_lag_roll",
    with_views(
        f"SELECT target_area, {tsql('obs_time')} AS obs_time, "
        + ", ".join(
            f"round(lag({n.rsplit('_lag', 1)[0].replace('khwd', 'nearby_cwa')}, {n[-1]}) OVER (PARTITION BY target_area ORDER BY obs_time), 8) AS {n}" if "_lag" in n
            else f"round(AVG({n[:-6].replace('khwd', 'nearby_cwa')}) OVER {area_frame(3)}, 8) AS {n}" for n in PORT_NAMES
        )
        + " FROM area_hour",
        "area_hour",
    ),
)
def _(v):
    series = aggregates.port_local_by_time(v.clean.withColumn("obs_time", F.col("obs_hour")), ["target_area", "obs_time"])
    out = features.apply_features(series, AREA, "obs_time", [features.port_lag_roll(series.columns)])
    return shown(out, *PORT_NAMES, places=8, keys=AREA)


@query(
    "win12_dispatch_labels",
    with_views(
        f"SELECT station_id, {tsql('obs_time')} AS obs_time, "
        + ", ".join(
            f"CAST(coalesce(lead(precipitation_1hr, {n}) OVER w > 0, FALSE) AS INT) AS \"rain_event_H{i}\", lead(wind_speed, {n}) OVER w AS \"future_wind_speed_mps_H{i}\", "
            f"{speed_sql(f'(lead(wind_speed, {n}) OVER w)')} AS \"future_wind_level_H{i}\", {gust_sql(f'(lead(wind_gust, {n}) OVER w)')} AS \"future_gust_level_H{i}\""
            for i, n in ((1, 3), (2, 6), (3, 9), (4, 12))
        )
        + f" FROM station_hour {W}",
        "station_hour",
    ),
)
def _(v):
    out = labels.dispatch_labels(stations(v), STATION, "obs_time")
    names = [f"{n}_H{i}" for i in range(1, 5) for n in ("rain_event", "future_wind_speed_mps", "future_wind_level", "future_gust_level")]
    return out.select("station_id", ts("obs_time").alias("obs_time"), *names)


@query(
    "win13_sequence_windows",
    with_views("", "grid").rstrip()
    + f""", filled AS ({interpolation_view({'wind_speed': 3, 'wind_gust': 3})}),
      win AS (SELECT station_id, obs_time, lag(a) OVER w AS last_speed, lead(a, 2) OVER w AS h1, lead(a, 5) OVER w AS h2, lead(a, 8) OVER w AS h3, lead(a, 11) OVER w AS h4,
         SUM(CAST(a IS NULL OR b IS NULL AS INT)) OVER span AS bad, COUNT(*) OVER span AS n, SUM(a) OVER hist AS history_sum, SUM(a) OVER fut AS future_sum, COUNT(*) OVER hist AS history_rows
         FROM (SELECT station_id, obs_time, wind_speed_filled AS a, wind_gust_filled AS b FROM filled)
         WINDOW w AS (PARTITION BY station_id ORDER BY obs_time), span AS (PARTITION BY station_id ORDER BY obs_time ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING),
                hist AS (PARTITION BY station_id ORDER BY obs_time ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), fut AS (PARTITION BY station_id ORDER BY obs_time ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING))
      SELECT station_id, {tsql('obs_time')} AS obs_time, history_rows, round(history_sum, 8) AS history_sum, round(future_sum, 8) AS future_sum, round(h1, 8) AS h1, round(h2, 8) AS h2,
             round(h3, 8) AS h3, round(h4, 8) AS h4, round(last_speed, 8) AS persistence FROM win WHERE bad = 0 AND n = 24""",
)
def _(v):
    base = cleaning.interpolate_limited(grid(v).select("station_id", "obs_time", "wind_speed", "wind_gust"), STATION, "obs_time", {"wind_speed": 3, "wind_gust": 3})
    base = base.withColumn("invalid", F.col("wind_speed").isNull() | F.col("wind_gust").isNull())
    out = labels.sequence_windows(base, STATION, "obs_time", ["wind_speed", "wind_gust"], ["wind_speed"], lookback=12, ahead=12)

    def total(column):
        return F.aggregate(F.transform(column, lambda x: x[0]), F.lit(0.0), lambda a, x: a + x)

    return out.select(
        "station_id", ts("obs_time").alias("obs_time"), F.size("history").cast("long").alias("history_rows"), F.round(total(F.col("history")), 8).alias("history_sum"),
        F.round(total(F.col("future")), 8).alias("future_sum"), *[F.round(F.col("anchors")[i][0], 8).alias(f"h{i + 1}") for i in range(4)],
        F.round(F.col("persistence")[0][0], 8).alias("persistence"),
    )


def numbered_sql(order="obs_time, seq", keys="station_id", source="clean"):
    return f"(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn, COUNT(*) OVER (PARTITION BY {keys}) AS n FROM {source})"


@query(
    "win14_chronological_split",
    with_views(
        f"""SELECT seq, station_id, CASE WHEN rn <= train_end THEN 'train' WHEN rn <= val_end THEN 'val' ELSE 'test' END AS split FROM (
            SELECT *, least(greatest(train_end + 1, floor(n * 0.85::DOUBLE)), n - 1) AS val_end FROM (SELECT *, greatest(1, floor(n * 0.7::DOUBLE)) AS train_end FROM {numbered_sql()}))""",
        "clean",
    ),
)
def _(v):
    return labels.chronological_split(v.clean, STATION, "obs_time", tie=["seq"]).select("seq", "station_id", "split")


@query(
    "win15_expanding_folds",
    with_views(
        f"""SELECT station_id, fold, role, COUNT(*) AS n_rows, {tsql('MIN(obs_time)')} AS first_time, {tsql('MAX(obs_time)')} AS last_time FROM (
            SELECT *, CASE WHEN rn - 1 < start - 5 THEN 'train' WHEN rn - 1 >= start AND rn - 1 < start + size THEN 'test' END AS role FROM (
              SELECT *, n - 5 * size + (fold - 1) * size AS start FROM (SELECT *, greatest(1, n // 6) AS size, unnest([1, 2, 3, 4, 5]) AS fold FROM {numbered_sql()})))
            WHERE role IS NOT NULL GROUP BY station_id, fold, role""",
        "clean",
    ),
)
def _(v):
    out = labels.expanding_folds(v.clean.select("station_id", "obs_time", "seq"), STATION, "obs_time", 5, gap=5, tie=["seq"])
    return out.groupBy("station_id", "fold", "role").agg(F.count(F.lit(1)).alias("n_rows"), ts(F.min("obs_time")).alias("first_time"), ts(F.max("obs_time")).alias("last_time"))


@query(
    "win16_rolling_folds",
    with_views(
        f"""SELECT station_id, fold, role, COUNT(*) AS n_rows, {tsql('MIN(obs_time)')} AS first_time, {tsql('MAX(obs_time)')} AS last_time FROM (
            SELECT *, CASE WHEN rn - 1 - (fold - 1) * 60 < 200 THEN 'train' ELSE 'test' END AS role FROM {numbered_sql()} JOIN (SELECT CAST(range + 1 AS BIGINT) AS fold FROM range(0, 100000)) f
              ON (fold - 1) * 60 + 250 <= n AND rn - 1 >= (fold - 1) * 60 AND rn - 1 < (fold - 1) * 60 + 250) GROUP BY station_id, fold, role""",
        "clean",
    ),
)
def _(v):
    out = labels.rolling_folds(v.clean.select("station_id", "obs_time", "seq"), STATION, "obs_time", 200, 50, 60, tie=["seq"])
    return out.groupBy("station_id", "fold", "role").agg(F.count(F.lit(1)).alias("n_rows"), ts(F.min("obs_time")).alias("first_time"), ts(F.max("obs_time")).alias("last_time"))


CANDIDATES = ["wind_direction", "precipitation_1hr", "station_pressure", "relative_humidity", "temperature", "visibility", "tide_level", "wind_speed"]


def importance(v):
    """Absolute correlation with the gust as an importance table."""
    stats = v.clean.agg(*[F.abs(F.corr(F.when(F.col("wind_gust").isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("wind_gust")))).alias(c) for c in CANDIDATES])
    return stats.unpivot([], CANDIDATES, "feature", "importance")


define_view(
    "importance",
    "UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, wind_gust)) AS importance FROM clean " for c in CANDIDATES),
    ["clean"],
)
CUMULATIVE = "SELECT *, importance / SUM(importance) OVER () AS share, SUM(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) / SUM(importance) OVER () AS running FROM importance"


@query(
    "win18_cumulative_importance",
    with_views(f"SELECT feature, round(importance, 8) AS importance, round(share, 8) AS normalized_importance, round(running, 8) AS cumulative_importance, importance >= 0.01 AS above_threshold, running <= 0.95 AS in_cumulative FROM ({CUMULATIVE})", "importance"),
)
def _(v):
    table = aggregates.cumulative_share(importance(v), "importance", "feature")
    out = table.withColumns({"above_threshold": F.col("importance") >= 0.01, "in_cumulative": F.col("cumulative_importance") <= 0.95})
    return rounded(out, "importance", "normalized_importance", "cumulative_importance", places=8)


FORECAST_AS_OF = "2024-01-30 18:00:00"


@query(
    "win19_wind_projection",
    with_views(
        f"""SELECT station_id, device_type, o AS offset_minutes, {tsql(f"TIMESTAMP '{FORECAST_AS_OF}' + to_minutes(o)")} AS forecast_time,
            CASE WHEN points < 2 THEN v1 ELSE round(v1 + (v1 - v0) / greatest((epoch_us(t1) - epoch_us(t0)) / 60e6, 1.0) * o, 3) END AS wind_speed,
            CASE WHEN points >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM (
              SELECT *, unnest([10, 30, 60, 90]) AS o FROM (SELECT station_id, device_type, COUNT(*) AS points, arg_min(wind_speed, (obs_time, seq)) AS v0, arg_max(wind_speed, (obs_time, seq)) AS v1, MIN(obs_time) AS t0, MAX(obs_time) AS t1
              FROM clean WHERE NOT is_forecast AND wind_speed IS NOT NULL AND obs_time BETWEEN TIMESTAMP '{FORECAST_AS_OF}' - INTERVAL 12 HOUR AND TIMESTAMP '{FORECAST_AS_OF}' GROUP BY ALL))""",
        "clean",
    ),
)
def _(v):
    out = labels.wind_projection(v.clean, F.lit(FORECAST_AS_OF).cast("timestamp"), hours=12)
    return out.withColumn("forecast_time", ts("forecast_time"))


@query(
    "win20_three_hour_rain",
    with_views(
        f"""SELECT station_id, day, rain_3h_mm, {amount_sql('rain_3h_mm', 3)} AS rain_3h_level FROM (
            SELECT station_id, strftime(obs_time, '%Y-%m-%d') AS day, CASE WHEN COUNT(CASE WHEN hour(obs_time) IN (1, 2, 3) THEN precipitation_1hr END) = 3
              THEN round(SUM(CASE WHEN hour(obs_time) IN (1, 2, 3) THEN precipitation_1hr * 4 END), 3) END AS rain_3h_mm FROM station_hour GROUP BY ALL)""",
        "station_hour",
    ),
)
def _(v):
    runs = stations(v).select(
        "station_id", F.date_format("obs_time", "yyyy-MM-dd").alias("day"), F.concat(F.lit("H"), F.hour("obs_time").cast("string")).alias("label"),
        (F.col("precipitation_1hr") * 4).alias("predicted_amount_mm"),
    )
    return labels.three_hour_rain(runs, ["station_id", "day"])


@query(
    "win21_lookback_tail",
    with_views(
        f"""SELECT station_id, COUNT(*) AS tail_rows, COUNT(*) FILTER (WHERE tide_level IS NULL) AS invalid_rows, {tsql('MAX(obs_time)')} AS last_time,
            CASE WHEN COUNT(*) < 8 THEN 'not_enough_rows' WHEN COUNT(*) FILTER (WHERE tide_level IS NULL) > 0 THEN 'invalid_gap' END AS reason,
            COUNT(*) >= 8 AND COUNT(*) FILTER (WHERE tide_level IS NULL) = 0 AS usable
            FROM {numbered_sql('obs_time', source='station_hour')} WHERE rn > n - 8 GROUP BY station_id""",
        "station_hour",
    ),
)
def _(v):
    out = labels.lookback_tail(stations(v).withColumn("invalid", F.col("tide_level").isNull()), STATION, "obs_time", 8)
    return out.withColumn("last_time", ts("last_time"))


@query(
    "win22_inference_row",
    with_views(
        f"""SELECT a.target_area, {tsql('a.obs_time')} AS obs_time, a.nearby_cwa_station_count, round(a.nearby_cwa_wind_speed_mean, 8) AS nearby_cwa_wind_speed_mean, round(d.w, 8) AS distance_weighted_wind_speed,
            round(sin(2 * pi() * (hour(a.obs_time) + minute(a.obs_time) / 60.0) / 24.0), 8) AS hour_sin, nearby_cwa_wind_speed_max_lag1, nearby_cwa_precipitation_roll6 FROM (
              SELECT *, {area_lag_sql()}, row_number() OVER (PARTITION BY target_area ORDER BY obs_time DESC) AS back FROM area_hour) a
            JOIN (SELECT target_area, obs_hour, {weighted_sql('wind_speed')} AS w FROM (SELECT *, MAX(distance_to_port_km) OVER (PARTITION BY target_area, obs_hour) AS dmax FROM clean_distance) GROUP BY ALL) d
              ON a.target_area = d.target_area AND a.obs_time = d.obs_hour WHERE back = 1""",
        "area_hour", "clean_distance",
    ),
)
def _(v):
    from skywharf.plans.area import inference_rows

    out = inference_rows(clean_distance(v), ["target_area"], "obs_time")
    names = ["nearby_cwa_wind_speed_mean", "distance_weighted_wind_speed", "hour_sin", "nearby_cwa_wind_speed_max_lag1", "nearby_cwa_precipitation_roll6"]
    return rounded(out, *names, places=8).select("target_area", ts("obs_time").alias("obs_time"), "nearby_cwa_station_count", *names)
