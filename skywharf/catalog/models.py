"""Feature pipeline, datasets, model training and tide fits over the area series.

Trained-model queries have no SQL text: tree fits are not expressible in SQL.
"""

from __future__ import annotations

import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywharf.catalog.aggregates import clean_distance
from skywharf.catalog.joins import irregular
from skywharf.catalog.registry import query
from skywharf.catalog.views import r, rounded, ts, tsql, with_views
from skywharf.catalog.windows import W, back, frame, steps
from skywharf.models import tide, training
from skywharf.models.fits import side_by_side
from skywharf.operators import cleaning, features, joins, metrics
from skywharf.plans.area import area_dataset, dataset_report, port_dataset
from skywharf.schema import HORIZONS
from skywharf.session import checkpoint_dir, cut_lineage

AREA = ["target_area"]
WIND_FEATURES = ["nearby_cwa_wind_speed_mean", "nearby_cwa_wind_speed_max", "nearby_cwa_wind_gust_max", "nearby_cwa_wind_speed_max_lag1", "nearby_cwa_wind_speed_max_roll3",
                 "nearby_cwa_wind_gust_max_lag1", "nearby_cwa_station_count", "hour_sin", "hour_cos"]


def dataset(v):
    return area_dataset(clean_distance(v), AREA, "obs_time")


def stored(v):
    """The dataset for many fits: built once."""
    return cut_lineage(dataset(v))


PIPE = ["wind_speed_lag_1h", "wind_speed_roll_3h_mean", "wind_speed_change_1h", "hour_sin", "is_night", "pressure_change_3h", "pressure_temp"]


@query(
    "ml13_feature_pipeline",
    with_views(
        f"""SELECT station_id, {tsql('obs_time')} AS obs_time, {back('wind_speed', 1)} AS wind_speed_lag_1h, round(AVG(wind_speed) OVER {frame(steps(3))}, 8) AS wind_speed_roll_3h_mean,
            round(wind_speed - {back('wind_speed', 1)}, 8) AS wind_speed_change_1h, round(sin(2 * pi() * hour(obs_time) / 24.0), 8) AS hour_sin, CAST(hour(obs_time) >= 18 OR hour(obs_time) < 6 AS INT) AS is_night,
            station_pressure - {back('station_pressure', 3)} AS pressure_change_3h, round((station_pressure - {back('station_pressure', 3)}) * relative_humidity / 100, 8) AS pressure_humidity_interaction
            FROM stepped {W}""",
        "stepped",
    ),
)
def _(v):
    base = v.station_hour.withColumn("humidity", F.col("relative_humidity"))
    out = features.feature_pipeline(base, ["station_id"], "obs_time", ["wind_speed"], pressure="station_pressure")
    out = rounded(out, "wind_speed_roll_3h_mean", "wind_speed_change_1h", "hour_sin", "pressure_humidity_interaction", places=8)
    return out.select("station_id", ts("obs_time").alias("obs_time"), "wind_speed_lag_1h", "wind_speed_roll_3h_mean", "wind_speed_change_1h", "hour_sin", "is_night", "pressure_change_3h", "pressure_humidity_interaction")


@query(
    "ml13_feature_selection",
    with_views(
        """SELECT feature FROM (SELECT *, bool_or(running <= 0.95) OVER () AS any_inside FROM (SELECT feature, row_number() OVER (ORDER BY importance DESC, feature) AS place,
           SUM(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) / SUM(importance) OVER () AS running FROM importance)) WHERE running <= 0.95 OR (place = 1 AND NOT any_inside)""",
        "importance",
    ),
)
def _(v):
    from skywharf.catalog.windows import importance
    from skywharf.operators.aggregates import cumulative_share

    return features.select_by_cumulative(cumulative_share(importance(v), "importance", "feature"), 0.95).select("feature")


@query(
    "ml15_port_dataset_report",
    with_views(
        f"""SELECT target_area, COUNT(*) AS sample_count, {tsql('MIN(obs_hour)')} AS time_start, {tsql('MAX(obs_hour)')} AS time_end, 34 AS feature_count, 12 AS label_count, 'nearest_with_tolerance' AS label_alignment_method, 30 AS tolerance_minutes
            FROM (SELECT DISTINCT target_area, obs_hour FROM clean) GROUP BY target_area""",
        "clean",
    ),
)
def _(v):
    rows = v.clean.withColumn("obs_time", F.col("obs_hour"))
    out = dataset_report(port_dataset(rows, AREA, "obs_time", rain=True), AREA)
    return out.withColumns({"time_start": ts("time_start"), "time_end": ts("time_end")})


@query(
    "ml15_area_dataset",
    with_views(
        f"""SELECT target_area, {tsql('obs_time')} AS obs_time, round(nearby_cwa_wind_speed_mean, 8) AS nearby_cwa_wind_speed_mean, lag(nearby_cwa_wind_speed_max) OVER w AS nearby_cwa_wind_speed_max_lag1,
            CASE WHEN lead(obs_time) OVER w = obs_time + INTERVAL 1 HOUR THEN lead(nearby_cwa_wind_speed_max) OVER w ELSE nearby_cwa_wind_speed_max END AS "target_nearby_wind_speed_H1",
            CASE WHEN lead(obs_time) OVER w = obs_time + INTERVAL 1 HOUR THEN CAST(lead(nearby_cwa_precipitation_1hr_max) OVER w > 0.5 AS INT) END AS "target_rain_event_H2"
            FROM area_hour WINDOW w AS (PARTITION BY target_area ORDER BY obs_time)""",
        "area_hour",
    ),
)
def _(v):
    out = dataset(v)
    return out.select("target_area", ts("obs_time").alias("obs_time"), r("nearby_cwa_wind_speed_mean", 8).alias("nearby_cwa_wind_speed_mean"), "nearby_cwa_wind_speed_max_lag1",
                      "target_nearby_wind_speed_H1", "target_rain_event_H2")


WIND_TARGETS = {"wind_speed": "nearby_cwa_wind_speed_max", "wind_gust": "nearby_cwa_wind_gust_max"}


def reports(data, names, targets, label):
    """Report of one model for each target and horizon; ``targets`` maps targets to the column that persists."""

    def one(target, persistence):
        _, held_out = training.train_regressors(data, AREA, "obs_time", names, {h: label.format(target, h) for h in HORIZONS}, persistence)
        return training.regression_report(held_out).withColumn("target", F.lit(target))

    return reduce(DataFrame.unionByName, side_by_side(data.sparkSession, [partial(one, *x) for x in targets.items()]))


def each_horizon(spark, build):
    """Rows of every horizon, whose fits run side by side."""
    return reduce(DataFrame.unionByName, side_by_side(spark, [lambda h=h: build(h).withColumn("horizon", F.lit(h)) for h in HORIZONS]))


@query("ml01_wind_regressors")
def _(v):
    return reports(stored(v), WIND_FEATURES, WIND_TARGETS, "target_nearby_{}_{}")


RAIN_FEATURES = ["nearby_cwa_precipitation_1hr_mean", "nearby_cwa_precipitation_1hr_max", "nearby_cwa_precipitation_roll3", "nearby_cwa_rainy_station_count", "hour_sin", "hour_cos"]


def split_rain(data, label):
    return training.prepare(data.filter(F.col(label).isNotNull()), AREA, "obs_time", RAIN_FEATURES)


@query("ml02_rain_event_classifier")
def _(v):
    data = stored(v)

    def one(horizon):
        label = f"target_rain_event_{horizon}"
        rows = split_rain(data, label)
        scored = training.event_probability(training.fit_event_model(rows.filter("is_train"), RAIN_FEATURES, label), rows.filter("NOT is_train"))
        return metrics.event_scores(scored, ["target_area"], label, "event_probability")

    return each_horizon(v.spark, one)


@query("ml03_rain_amount")
def _(v):
    data = stored(v)

    def one(horizon):
        label = f"target_nearby_precipitation_1hr_{horizon}"
        rows = split_rain(data, label)
        model = training.fit_amount_model(rows.filter("is_train"), cleaning.rain_amount_features(RAIN_FEATURES), label)
        return metrics.anchor_scores(training.predicted_amount(model, rows.filter("NOT is_train")), ["target_area"], label, "amount")

    return each_horizon(v.spark, one)


PORT_FEATURES = ["khwd_wind_speed_mean", "khwd_wind_speed_max", "khwd_wind_gust_max", "khwd_wind_speed_max_lag1", "khwd_wind_speed_max_roll3", "hour_sin", "hour_cos"]
PORT_TARGETS = {"wind_speed": "khwd_wind_speed_max", "wind_gust": "khwd_wind_gust_max"}


@query("ml04_port_regressors")
def _(v):
    return reports(port_dataset(irregular_rows(v), AREA, "obs_time"), PORT_FEATURES, PORT_TARGETS, "target_{}_{}")


def irregular_rows(v):
    return v.clean.withColumn("obs_time", F.date_trunc("hour", "obs_time"))


@query("ml05_two_stage_rain")
def _(v):
    data = stored(v)

    def one(horizon):
        label = f"target_nearby_precipitation_1hr_{horizon}"
        rows = split_rain(data, label)
        scored = training.two_stage_rain(rows.filter("is_train"), rows.filter("NOT is_train"), RAIN_FEATURES, label)
        return metrics.categorical_rain(scored, ["target_area"], label, "predicted")

    return each_horizon(v.spark, one)


@query("ml07_stacking")
def _(v):
    data = stored(v)

    def one(horizon):
        label = f"target_nearby_wind_speed_{horizon}"
        rows = training.prepare(data.filter(F.col(label).isNotNull()).select(*AREA, "obs_time", *WIND_FEATURES, label), AREA, "obs_time", WIND_FEATURES)
        return metrics.anchor_scores(training.stacked(rows.filter("is_train"), rows.filter("NOT is_train"), AREA, "obs_time", WIND_FEATURES, label), ["target_area"], label, "predicted")

    return each_horizon(v.spark, one)


ALGORITHMS = ["random_forest", "gradient_boosting", "linear"]


@query("ml08_algorithm_benchmark")
def _(v):
    data = stored(v)
    return each_horizon(v.spark, lambda h: training.benchmark(data, AREA, "obs_time", WIND_FEATURES, f"target_nearby_wind_speed_{h}", ALGORITHMS))


@query("ml09_rain_benchmark")
def _(v):
    names = cleaning.rain_benchmark_features(RAIN_FEATURES)
    return training.rain_benchmark(stored(v), AREA, "obs_time", names, list(HORIZONS), ALGORITHMS[:2])


@query("ml12_batch_scoring")
def _(v):
    """Every row scored by the stored models of all four horizons."""
    data = cut_lineage(dataset(v).select(*AREA, "obs_time", *WIND_FEATURES, *[f"target_nearby_wind_speed_{h}" for h in HORIZONS]))
    folder, paths = f"{checkpoint_dir(v.spark)}/models-{uuid.uuid4().hex}", {}
    for horizon in HORIZONS:
        label = f"target_nearby_wind_speed_{horizon}"
        rows = training.chronological(data.filter(F.col(label).isNotNull()), AREA, "obs_time").filter("is_train")
        fills = cut_lineage(training.train_fills(rows, WIND_FEATURES))
        paths[horizon] = f"{folder}/{horizon}"
        training.save_model(training.fit_pipeline(training.filled(rows, WIND_FEATURES, fills), WIND_FEATURES, training.regressor("random_forest", label)), fills, paths[horizon])
    out = training.score_stored(data, WIND_FEATURES, paths, [*AREA, "obs_time"])
    return out.select("target_area", ts("obs_time").alias("obs_time"), *[f"prediction_{h}" for h in HORIZONS], "available")


@query("ml10_tide_harmonics")
def _(v):
    return rounded(tide.evaluate_harmonic(v.clean.select("station_id", "obs_time", "seq", "tide_level"), ["station_id"], tie=["seq"]), "mae", "rmse", "bias", "r2", places=6)


@query("ml11_surge_residual")
def _(v):
    hourly = v.station_hour

    def one(station):
        target = hourly.filter(F.col("station_id") == station).select("station_id", "obs_time", "tide_level")
        others = [s for s in ("S01", "S04", "S05") if s != station][-2:]
        wide = joins.prefix_stations(target, hourly.filter(F.col("station_id").isin(others)), "obs_time", others, ["station_pressure", "wind_speed"])
        return tide.surge_model(wide, ["station_id"], "obs_time", [f"{s}_{m}" for s in others for m in ("station_pressure", "wind_speed")]).withColumn("station_id", F.lit(station))

    # One model for each station of the dimension table.
    names = sorted(row["station_id"] for row in v.station.select("station_id").collect())
    return reduce(DataFrame.unionByName, side_by_side(v.spark, [partial(one, s) for s in names]))


@query("ml14_staged_ablation")
def _(v):
    clean, raw = stored(v), cut_lineage(area_dataset(v.obs.withColumn("obs_time", F.col("obs_hour")), AREA, "obs_time"))
    return each_horizon(v.spark, lambda h: training.staged_ablation(raw, clean, AREA, "obs_time", RAIN_FEATURES, f"target_nearby_precipitation_1hr_{h}", f"target_rain_event_{h}"))


@query("win17_fold_validation")
def _(v):
    def rmse(truth, predicted):
        return F.sqrt(F.avg(F.pow(truth - predicted, 2)))

    data = stored(v)
    return each_horizon(v.spark, lambda h: training.validate_folds(data, AREA, "obs_time", WIND_FEATURES, f"target_nearby_wind_speed_{h}", rmse))


@query("top06_feature_importance")
def _(v):
    data = cut_lineage(dataset(v).select(*AREA, "obs_time", *WIND_FEATURES, *[f"target_nearby_wind_speed_{h}" for h in HORIZONS]).dropna())

    def one(horizon):
        model = training.fit_pipeline(data, WIND_FEATURES, training.regressor("random_forest", f"target_nearby_wind_speed_{horizon}"))
        return training.top_importance(training.importance_table(model, WIND_FEATURES, v.spark), 20)

    return each_horizon(v.spark, one)
