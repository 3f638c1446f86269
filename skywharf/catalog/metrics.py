"""Forecast scores over nearest-time labels of the half-hour area series."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywharf.catalog.joins import nearest_pick, scored
from skywharf.catalog.registry import query
from skywharf.catalog.views import define_view, r, rounded, ts, tsql, with_views
from skywharf.operators import features, labels, metrics
from skywharf.schema import GRADE_CUTOFFS, HORIZONS

define_view(
    "pairs",
    "SELECT *, x_speed AS persistence, 0.7::DOUBLE * x_speed + 1 AS model, CASE WHEN x_rain > 5 THEN 0.8::DOUBLE * x_rain ELSE x_rain + 0.5::DOUBLE END AS rain_model, "
    "least(1.0::DOUBLE, x_rain / 10) AS prob, CAST(y_rain > 0.5 AS INT) AS event FROM ("
    + " UNION ALL ".join(
        f"SELECT a.target_area, a.obs_time, '{h}' AS label, a.nearby_cwa_wind_speed_max AS x_speed, a.nearby_cwa_precipitation_1hr_max AS x_rain, p.p.speed AS y_speed, p.p.rain AS y_rain "
        f"FROM area_half a LEFT JOIN ({nearest_pick(m, {'speed': 'nearby_cwa_wind_speed_max', 'rain': 'nearby_cwa_precipitation_1hr_max'}, 'area_half')}) p ON p.target_area = a.target_area AND p.obs_time = a.obs_time"
        for h, m in HORIZONS.items()
    )
    + ")",
    ["area_half"],
)


def pairs(v):
    """One row per (area, time, horizon): labels, persistence and two simple models."""
    wide = labels.area_labels(v.area_half, ["target_area"])
    long = wide.withColumn(
        "_h",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(h).alias("label"), F.col(f"target_nearby_wind_speed_{h}").alias("y_speed"), F.col(f"target_nearby_precipitation_1hr_{h}").alias("y_rain"))
                    for h in HORIZONS
                ]
            )
        ),
    )
    x_speed, x_rain = F.col("nearby_cwa_wind_speed_max"), F.col("nearby_cwa_precipitation_1hr_max")
    return long.select(
        "target_area", "obs_time", "_h.label", x_speed.alias("x_speed"), x_rain.alias("x_rain"), "_h.y_speed", "_h.y_rain",
        x_speed.alias("persistence"), (F.lit(0.7) * x_speed + 1).alias("model"),
        F.when(x_rain > 5, F.lit(0.8) * x_rain).otherwise(x_rain + 0.5).alias("rain_model"), F.least(F.lit(1.0), x_rain / 10).alias("prob"),
        (F.col("_h.y_rain") > 0.5).cast("int").alias("event"),
    )


GROUPS = ["target_area", "label"]
SPEED = "y_speed IS NOT NULL AND model IS NOT NULL"
RAIN = "y_rain IS NOT NULL AND rain_model IS NOT NULL"
R2 = "round(1 - SUM((model - y_speed) * (model - y_speed)) / (VAR_POP(y_speed) * COUNT(*)), 8) AS r2"
ERRORS = f"""COUNT(*) AS n, round(sqrt(AVG((model - y_speed) * (model - y_speed))), 8) AS rmse, round(AVG(abs(model - y_speed)), 8) AS mae, {R2}, round(AVG(model - y_speed), 8) AS bias"""


@query(
    "agg17_regression_scores",
    with_views(
        f"""SELECT target_area, label, {ERRORS}, round(AVG(abs((model - y_speed) / (y_speed + 1e-10))) * 100, 6) AS mape, round(quantile_cont(abs(model - y_speed), 0.5), 8) AS medae
            FROM pairs WHERE {SPEED} GROUP BY ALL""",
        "pairs",
    ),
)
def _(v):
    out = metrics.regression_scores(pairs(v), GROUPS, "y_speed", "model")
    return rounded(rounded(out, "rmse", "mae", "r2", "bias", "medae", places=8), "mape", places=6)


@query(
    "agg18_anchor_scores",
    with_views(
        f"""SELECT label, {ERRORS}, round(AVG(CASE WHEN abs(y_speed) > 1e-9 THEN abs((model - y_speed) / y_speed) END) * 100, 6) AS mape FROM pairs WHERE {SPEED} GROUP BY ALL""",
        "pairs",
    ),
)
def _(v):
    out = metrics.anchor_scores(pairs(v), ["label"], "y_speed", "model")
    return rounded(rounded(out, "rmse", "mae", "r2", "bias", places=8), "mape", places=6)


@query(
    "agg19_error_quantiles",
    with_views(
        "SELECT target_area, label, " + ", ".join(f"round(quantile_cont(abs(model - y_speed), {p}), 9) AS {n}" for n, p in metrics.ERROR_QUANTILES.items()) + f" FROM pairs WHERE {SPEED} GROUP BY ALL",
        "pairs",
    ),
)
def _(v):
    return rounded(metrics.error_quantiles(pairs(v), GROUPS, "y_speed", "model"), *metrics.ERROR_QUANTILES)


@query(
    "agg20_skill_score",
    with_views(
        f"SELECT target_area, label, round(1 - AVG(pow(y_speed - model, 2)) / AVG(pow(y_speed - persistence, 2)), 8) AS skill_score FROM pairs WHERE {SPEED} AND persistence IS NOT NULL GROUP BY ALL",
        "pairs",
    ),
)
def _(v):
    return rounded(metrics.skill_score(pairs(v), GROUPS, "y_speed", "model", "persistence"), "skill_score", places=8)


def contingency_sql(y: str, p: str) -> str:
    return f"""COUNT(*) FILTER (WHERE {y} AND {p}) AS hits, COUNT(*) FILTER (WHERE {y} AND NOT ({p})) AS misses,
        COUNT(*) FILTER (WHERE NOT ({y}) AND {p}) AS false_alarms, COUNT(*) FILTER (WHERE NOT ({y}) AND NOT ({p})) AS correct_negatives"""


SCORES_SQL = """round(h / nullif(h + m, 0), 9) AS pod, round(f / nullif(h + f, 0), 9) AS far, round(h / nullif(h + m + f, 0), 9) AS csi,
    round((h + c - e) / nullif(t - e, 0), 9) AS hss, round((h - x) / nullif(h + m + f - x, 0), 9) AS ets, round((h + c) / nullif(t, 0), 9) AS accuracy, round((h + f) / nullif(h + m, 0), 9) AS bias_score"""


def scores_from(inner: str, keys: str) -> str:
    return f"""SELECT {keys}, hits, misses, false_alarms, correct_negatives, {SCORES_SQL} FROM (SELECT *, ((h + m) * (h + f) + (c + m) * (c + f)) / t AS e, (h + m) * (h + f) / t AS x FROM (
        SELECT *, hits::DOUBLE AS h, misses::DOUBLE AS m, false_alarms::DOUBLE AS f, correct_negatives::DOUBLE AS c, (hits + misses + false_alarms + correct_negatives)::DOUBLE AS t FROM ({inner})))"""


SCORE_NAMES = ["pod", "far", "csi", "hss", "ets", "accuracy", "bias_score"]


@query(
    "agg21_rain_contingency",
    with_views(scores_from(f"SELECT target_area, label, {contingency_sql('y_rain >= 10', 'rain_model >= 10')} FROM pairs WHERE {RAIN} GROUP BY ALL", "target_area, label"), "pairs"),
)
def _(v):
    return rounded(metrics.rain_scores(pairs(v), GROUPS, "y_rain", "rain_model", threshold=10.0), *SCORE_NAMES)


def categorical_sql(name, t):
    y, p = f"y_rain > {t}", f"rain_model > {t}"
    tp, fp, fn = (f"COUNT(*) FILTER (WHERE {c})" for c in (f"{y} AND {p}", f"NOT ({y}) AND {p}", f"{y} AND NOT ({p})"))
    return (
        f"{tp} AS tp_{name}, {fp} AS fp_{name}, {fn} AS fn_{name}, round({tp}::DOUBLE / nullif({tp} + {fp} + {fn}, 0), 9) AS csi_{name}, "
        f"round({fp}::DOUBLE / nullif({tp} + {fp}, 0), 9) AS far_{name}, round({tp}::DOUBLE / nullif({tp} + {fn}, 0), 9) AS pod_{name}"
    )


@query(
    "agg22_categorical_rain",
    with_views(f"SELECT target_area, label, {categorical_sql('1mm', 1)}, {categorical_sql('10mm', 10)}, round(AVG(CASE WHEN y_rain > 1 THEN abs(rain_model - y_rain) END), 9) AS mae_rain_only FROM pairs WHERE {RAIN} GROUP BY ALL", "pairs"),
)
def _(v):
    out = metrics.categorical_rain(pairs(v), GROUPS, "y_rain", "rain_model")
    return rounded(out, "mae_rain_only", *[f"{m}_{n}" for m in ("csi", "far", "pod") for n in ("1mm", "10mm")])


@query(
    "agg23_intensity_scores",
    with_views(
        scores_from(
            f"SELECT target_area, label, threshold, {contingency_sql('y_rain >= threshold', 'rain_model >= threshold')} FROM pairs, (VALUES (0.1::DOUBLE), (2.0), (10.0), (30.0)) t(threshold) WHERE {RAIN} GROUP BY ALL",
            "target_area, label, threshold",
        ),
        "pairs",
    ),
)
def _(v):
    return rounded(metrics.intensity_scores(pairs(v), GROUPS, "y_rain", "rain_model"), *SCORE_NAMES)


@query(
    "agg24_extreme_values",
    with_views(
        f"""SELECT target_area, label, round(MAX(q), 9) AS extreme_threshold, COUNT(*) AS extreme_count, round(AVG(abs(model - y_speed)), 8) AS extreme_mae, round(sqrt(AVG(pow(model - y_speed, 2))), 8) AS extreme_rmse,
            round(AVG(model - y_speed), 8) AS extreme_bias, round(AVG(CAST(model >= q AS INT)), 9) AS extreme_capture_rate
            FROM (SELECT * FROM pairs WHERE {SPEED}) JOIN (SELECT target_area, label, quantile_cont(y_speed, 0.9) AS q FROM pairs WHERE {SPEED} GROUP BY ALL) USING (target_area, label) WHERE y_speed >= q GROUP BY ALL""",
        "pairs",
    ),
)
def _(v):
    out = metrics.extreme_scores(pairs(v), GROUPS, "y_speed", "model")
    return rounded(rounded(out, "extreme_threshold", "extreme_capture_rate"), "extreme_mae", "extreme_rmse", "extreme_bias", places=8)


@query(
    "agg25_scenarios",
    with_views(
        """SELECT scenario, COUNT(*) AS sample_count, round(AVG(abs(pred_wind_speed - wind_speed)), 8) AS model_mae, round(AVG(abs(cwa_wind_speed - wind_speed)), 8) AS external_mae,
           round(sqrt(AVG(pow(pred_wind_speed - wind_speed, 2))), 8) AS model_rmse, coalesce(AVG(abs(pred_wind_speed - wind_speed)) < AVG(abs(cwa_wind_speed - wind_speed)), FALSE) AS model_beats_external
           FROM (SELECT *, unnest(list_filter(['all', CASE WHEN wind_speed >= q90 THEN 'high' END, CASE WHEN wind_speed <= q10 THEN 'low' END, CASE WHEN wind_speed >= 5 THEN 'rainy' END, CASE WHEN wind_speed < 5 THEN 'dry' END], lambda x: x IS NOT NULL)) AS scenario
             FROM (SELECT * FROM scored WHERE wind_speed IS NOT NULL AND pred_wind_speed IS NOT NULL), (SELECT quantile_cont(wind_speed, 0.1) AS q10, quantile_cont(wind_speed, 0.9) AS q90 FROM scored WHERE wind_speed IS NOT NULL AND pred_wind_speed IS NOT NULL)) GROUP BY scenario""",
        "scored",
    ),
)
def _(v):
    out = metrics.scenario_scores(scored(v), [], "wind_speed", "pred_wind_speed", "cwa_wind_speed", rain_threshold=5.0)
    return rounded(out, "model_mae", "external_mae", "model_rmse", places=8)


@query(
    "agg26_event_scores",
    with_views(
        """SELECT target_area, label, n, round(brier, 9) AS brier, hits, misses, false_alarms, correct_negatives, round(auc, 9) AS auc, round(hits::DOUBLE / nullif(hits + misses + false_alarms, 0), 9) AS csi,
           round(false_alarms::DOUBLE / nullif(hits + false_alarms, 0), 9) AS far, round(hits::DOUBLE / nullif(hits + misses, 0), 9) AS pod, round(coalesce(hits::DOUBLE / nullif(hits + false_alarms, 0), 0), 9) AS precision, round(coalesce(hits::DOUBLE / nullif(hits + misses, 0), 0), 9) AS recall FROM (
             SELECT target_area, label, COUNT(*) AS n, AVG(pow(prob - event, 2)) AS brier, COUNT(*) FILTER (WHERE event = 1 AND prob >= 0.5) AS hits, COUNT(*) FILTER (WHERE event = 1 AND prob < 0.5) AS misses,
               COUNT(*) FILTER (WHERE event = 0 AND prob >= 0.5) AS false_alarms, COUNT(*) FILTER (WHERE event = 0 AND prob < 0.5) AS correct_negatives,
               (SUM(CASE WHEN event = 1 THEN rk END) - SUM(event) * (SUM(event) + 1) / 2.0) / nullif(SUM(event) * SUM(1 - event), 0) AS auc
             FROM (SELECT *, rank() OVER (PARTITION BY target_area, label ORDER BY prob) + (COUNT(*) OVER (PARTITION BY target_area, label, prob) - 1) / 2.0 AS rk FROM pairs WHERE event IS NOT NULL AND prob IS NOT NULL)
             GROUP BY target_area, label)""",
        "pairs",
    ),
)
def _(v):
    return rounded(metrics.event_scores(pairs(v), GROUPS, "event", "prob"), "brier", "auc", "csi", "far", "pod", "precision", "recall")


@query(
    "agg27_persistence",
    with_views(
        f"""SELECT target_area, label, round(AVG(abs(model - y_speed)), 8) AS mae, round(AVG(abs(persistence - y_speed)), 8) AS persistence_mae, AVG(abs(model - y_speed)) < AVG(abs(persistence - y_speed)) AS beats_persistence,
            AVG(abs(model - y_speed)) <= AVG(abs(persistence - y_speed)) AS matches_persistence FROM pairs WHERE {SPEED} GROUP BY ALL""",
        "pairs",
    ),
)
def _(v):
    out = metrics.persistence_comparison(pairs(v).withColumn("mean_label", F.lit(0.0)), GROUPS, "y_speed", "model", "persistence", "mean_label")
    return rounded(out, "mae", "persistence_mae", places=8)


define_view(
    "metric_long",
    f"""SELECT variable, label, metric, value FROM (
        SELECT 'wind_speed' AS variable, label, unnest(['mae', 'rmse']) AS metric, unnest([AVG(abs(model - y_speed)), sqrt(AVG(pow(model - y_speed, 2)))]) AS value FROM pairs WHERE {SPEED} GROUP BY label
        UNION ALL SELECT 'precipitation_1hr', label, unnest(['mae', 'csi_threshold_1mm']), unnest([AVG(abs(rain_model - y_rain)), COUNT(*) FILTER (WHERE y_rain > 1 AND rain_model > 1)::DOUBLE / COUNT(*) FILTER (WHERE y_rain > 1 OR rain_model > 1)]) FROM pairs WHERE {RAIN} GROUP BY label)""",
    ["pairs"],
)


def metric_long(v):
    base = pairs(v)
    speed = metrics.anchor_scores(base, ["label"], "y_speed", "model").unpivot(["label"], ["mae", "rmse"], "metric", "value")
    rain = metrics.categorical_rain(base, ["label"], "y_rain", "rain_model").select("label", F.col("csi_1mm").alias("value"), F.lit("csi_threshold_1mm").alias("metric"))
    rain_mae = metrics.anchor_scores(base, ["label"], "y_rain", "rain_model").select("label", F.col("mae").alias("value"), F.lit("mae").alias("metric"))
    return speed.withColumn("variable", F.lit("wind_speed")).unionByName(rain.unionByName(rain_mae).withColumn("variable", F.lit("precipitation_1hr")))


def grade_sql() -> str:
    arms = []
    for variable, rules in GRADE_CUTOFFS.items():
        for metric, by_label in rules.items():
            for label, (good, fair) in by_label.items():
                op = ">=" if metric.startswith("csi") else "<="
                arms.append(f"WHEN variable = '{variable}' AND metric = '{metric}' AND label = '{label}' THEN CASE WHEN value {op} {good} THEN 0 WHEN value {op} {fair} THEN 1 ELSE 2 END")
    return "CASE " + " ".join(arms) + " END"


@query(
    "agg28_accuracy_grade",
    with_views(
        f"SELECT variable, label, CASE coalesce(MAX({grade_sql()}), 1) WHEN 0 THEN 'excellent' WHEN 1 THEN 'acceptable' ELSE 'poor' END AS accuracy_grade, "
        "CASE WHEN MAX(CASE WHEN metric = 'mae' THEN value END) <= 1 THEN 'excellent' WHEN MAX(CASE WHEN metric = 'mae' THEN value END) <= 2 THEN 'good' WHEN MAX(CASE WHEN metric = 'mae' THEN value END) <= 3 THEN 'acceptable' ELSE 'poor' END AS mae_grade FROM metric_long GROUP BY ALL",
        "metric_long",
    ),
)
def _(v):
    table = metric_long(v)
    mae = table.filter("metric = 'mae'").select("variable", "label", metrics.mae_grade(F.col("value")).alias("mae_grade"))
    return metrics.accuracy_grades(table).join(mae, ["variable", "label"])


@query(
    "agg28_combined_grade",
    with_views(f"SELECT label, CASE MAX(g) WHEN 0 THEN 'excellent' WHEN 1 THEN 'acceptable' ELSE 'poor' END AS combined_grade FROM (SELECT variable, label, MAX({grade_sql()}) AS g FROM metric_long GROUP BY ALL) GROUP BY label", "metric_long"),
)
def _(v):
    return metrics.combined_grade(metrics.accuracy_grades(metric_long(v)))


SWEEP_SQL = f"""SELECT target_area, t AS threshold, label AS anchor, COUNT(*) FILTER (WHERE y AND p) AS tp, COUNT(*) FILTER (WHERE NOT y AND p) AS fp, COUNT(*) FILTER (WHERE y AND NOT p) AS fn FROM (
    SELECT target_area, label, t, y_rain > 1 AS y, prob > t AND rain_model > 1 AS p FROM (SELECT * FROM pairs WHERE {RAIN}), (VALUES {', '.join(f'({t}::DOUBLE)' for t in metrics.SWEEP_THRESHOLDS)}) s(t)) GROUP BY ALL"""
SWEEP_SCORED = f"SELECT *, tp::DOUBLE / nullif(tp + fp + fn, 0) AS csi, fp::DOUBLE / nullif(tp + fp, 0) AS far, tp::DOUBLE / nullif(tp + fn, 0) AS pod FROM ({SWEEP_SQL})"
SWEEP_MEAN = f"SELECT target_area, threshold, 'mean' AS anchor, CAST(SUM(tp) AS BIGINT) AS tp, CAST(SUM(fp) AS BIGINT) AS fp, CAST(SUM(fn) AS BIGINT) AS fn, AVG(csi) AS csi, AVG(far) AS far, AVG(pod) AS pod FROM ({SWEEP_SCORED}) GROUP BY ALL"


def sweep(v):
    rows = pairs(v).filter(F.col("y_rain").isNotNull() & F.col("rain_model").isNotNull())
    return metrics.threshold_sweep(rows, ["target_area"], "label", "y_rain", "rain_model", "prob")


@query(
    "agg29_threshold_sweep",
    with_views(f"SELECT target_area, threshold, anchor, tp, fp, fn, round(csi, 9) AS csi, round(far, 9) AS far, round(pod, 9) AS pod FROM ({SWEEP_SCORED} UNION ALL {SWEEP_MEAN})", "pairs"),
)
def _(v):
    return rounded(sweep(v), "csi", "far", "pod")


@query(
    "agg29_best_threshold",
    with_views(
        f"""SELECT target_area, threshold AS best_threshold, round(csi, 9) AS best_csi_mean, round(far, 9) AS best_far_mean FROM (
            SELECT *, row_number() OVER (PARTITION BY target_area ORDER BY CASE WHEN coalesce(far, 1) < 0.55 THEN 0 ELSE 1 END, csi DESC, threshold) AS rn FROM ({SWEEP_MEAN}) WHERE csi IS NOT NULL) WHERE rn = 1""",
        "pairs",
    ),
)
def _(v):
    return rounded(metrics.best_threshold(sweep(v), ["target_area"]), "best_csi_mean", "best_far_mean")


CORRELATED = ["wind_speed", "wind_gust", "station_pressure", "temperature", "visibility", "tide_level"]


def corr_rows() -> str:
    return " UNION ALL ".join(
        f"SELECT '{b}' AS feature, abs(corr({a}, {b})) AS c FROM clean" for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:]
    )


@query(
    "agg30_correlation_pruning",
    with_views(f"SELECT feature, round(MAX(c), 8) AS strongest_earlier_correlation, MAX(c) <= 0.95 AS kept FROM ({corr_rows()}) GROUP BY feature", "clean"),
)
def _(v):
    return rounded(features.drop_correlated(v.clean, CORRELATED), "strongest_earlier_correlation", places=8)


DELTA = f"SELECT 'wind_speed' AS target, label AS horizon, unnest(['MAE', 'RMSE']) AS metric, unnest([AVG(abs({{p}} - y_speed)), sqrt(AVG(pow({{p}} - y_speed, 2)))]) AS value FROM pairs WHERE {SPEED} GROUP BY label"


@query(
    "agg31_metric_delta",
    with_views(
        f"""SELECT b.target, b.horizon, b.metric, round(c.value - b.value, 4) AS delta, CASE WHEN b.metric = 'MAE' THEN c.value < b.value END AS improved_by_primary_metric
            FROM ({DELTA.format(p='persistence')}) b JOIN ({DELTA.format(p='model')}) c USING (target, horizon, metric)""",
        "pairs",
    ),
)
def _(v):
    def table(column):
        scores = metrics.anchor_scores(pairs(v).filter("model IS NOT NULL"), ["label"], "y_speed", column)
        long = scores.select(F.col("label").alias("horizon"), F.col("mae").alias("MAE"), F.col("rmse").alias("RMSE")).unpivot(["horizon"], ["MAE", "RMSE"], "metric", "value")
        return long.withColumn("target", F.lit("wind_speed"))

    return metrics.metric_deltas(table("persistence"), table("model"))


@query(
    "agg34_basic_statistics",
    with_views(
        f"""SELECT label, COUNT(*) AS n, """
        + ", ".join(f"round({f}({c}), 8) AS {n}_{s}" for n, c in (("actual", "y_speed"), ("predicted", "model")) for f, s in (("AVG", "mean"), ("STDDEV_POP", "std"), ("MIN", "min"), ("MAX", "max")))
        + f", round(AVG(model - y_speed), 8) AS mean_error, round(quantile_cont(abs(model - y_speed), 0.5), 8) AS median_abs_error, round(quantile_cont(abs(model - y_speed), 0.9), 8) AS p90_abs_error FROM pairs WHERE {SPEED} GROUP BY label",
        "pairs",
    ),
)
def _(v):
    rows = metrics.finite_pairs(pairs(v), "y_speed", "model")
    out = metrics.basic_statistics(rows, ["label"], "y_speed", "model")
    return rounded(out, *[c for c in out.columns if c not in ("label", "n")], places=8)


@query(
    "agg36_metrics_by_horizon",
    with_views(
        """SELECT target_area, label AS horizon, round(h / nullif(h + m + f, 0), 9) AS csi, round(h / nullif(h + m, 0), 9) AS pod, round(f / nullif(h + f, 0), 9) AS far, TRUE AS available FROM (
           SELECT target_area, label, COUNT(*) FILTER (WHERE event = 1 AND prob >= 0.5)::DOUBLE AS h, COUNT(*) FILTER (WHERE event = 1 AND prob < 0.5)::DOUBLE AS m, COUNT(*) FILTER (WHERE event = 0 AND prob >= 0.5)::DOUBLE AS f
           FROM pairs WHERE event IS NOT NULL AND prob IS NOT NULL GROUP BY ALL)""",
        "pairs",
    ),
)
def _(v):
    wide = metrics.event_scores(pairs(v), GROUPS, "event", "prob")
    long = wide.select("target_area", F.col("label").alias("horizon"), "csi", "pod", "far").unpivot(["target_area", "horizon"], ["csi", "pod", "far"], "metric", "value")
    return rounded(metrics.metrics_by_horizon(long, ["target_area"]), "csi", "pod", "far")


@query(
    "ml06_imbalance_weights",
    with_views(
        """SELECT seq, target_area, CASE WHEN precipitation_1hr > 0.1 THEN round(COUNT(*) FILTER (WHERE precipitation_1hr <= 0.1) OVER (PARTITION BY target_area) / COUNT(*) FILTER (WHERE precipitation_1hr > 0.1) OVER (PARTITION BY target_area)::DOUBLE, 9) ELSE 1.0 END AS weight FROM clean""",
        "clean",
    ),
)
def _(v):
    out = metrics.imbalance_weights(v.clean.select("seq", "target_area", "precipitation_1hr"), ["target_area"], "precipitation_1hr")
    return rounded(out.select("seq", "target_area", "weight"), "weight")
