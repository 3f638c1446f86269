"""Decision rules over the runs of every area and hour."""

from __future__ import annotations

from pyspark.sql import functions as F

from skywharf.catalog.aggregates import latest
from skywharf.catalog.joins import ANCHOR_ID, anchors, periods
from skywharf.catalog.registry import query
from skywharf.catalog.scalar import ACTION_SQL, amount_sql, beaufort_sql, case_levels, gust_sql, map_sql, rain_sql, speed_sql
from skywharf.catalog.views import BASELINE_STATION, define_view, r, rounded, ts, tsql, with_views
from skywharf.functions import wind
from skywharf.functions.weather import rain_probability_level
from skywharf.operators import decisions, joins, metrics, reports
from skywharf.plans.dims import dimension, lookup
from skywharf.schema import HORIZONS, LOW_RELIABILITY, WIND_GUST_THRESHOLDS, WIND_SPEED_THRESHOLDS

RUN = ["target_area", "obs_time"]
KEYS = f"target_area, {tsql('obs_time')} AS obs_time, label"

# One row per (area, hour, anchor) with simple model outputs and the matched external forecast.
define_view(
    "runs",
    """SELECT a.target_area, a.obs_time, h.label, h.minutes, least(1.0::DOUBLE, h0.nearby_cwa_rainy_station_ratio * (1 + h.minutes / 120.0::DOUBLE)) AS raw_probability,
         h0.nearby_cwa_wind_speed_max * (1 - h.minutes / 600.0::DOUBLE) AS wind_pred, h0.nearby_cwa_wind_gust_max * (1 - h.minutes / 600.0::DOUBLE) AS gust_pred,
         round(h0.nearby_cwa_precipitation_1hr_mean, 6) * (1 + h.minutes / 120.0::DOUBLE) AS amount_pred, h0.nearby_cwa_precipitation_1hr_max AS max_1hr,
         round(h0.nearby_cwa_precipitation_1hr_mean, 6) AS mean_1hr, h0.nearby_cwa_rainy_station_count AS rainy_count,
         CASE WHEN h0.nearby_cwa_station_count >= 4 THEN h0.nearby_cwa_wind_speed_max END AS observed_speed,
         CASE WHEN h0.nearby_cwa_station_count >= 4 THEN h0.nearby_cwa_wind_gust_max END AS observed_gust,
         h0.nearby_cwa_station_count AS station_count,
         CASE WHEN p.raw_value <> '' THEN CASE WHEN p.x <= 1 THEN p.x ELSE p.x / 100 END END AS pop, coalesce(p.raw_value <> '', FALSE) AS pop_available,
         CASE WHEN p.raw_value IS NULL THEN 'not_available' WHEN p.raw_value = '' THEN 'missing_field' ELSE 'ok' END AS parse_status,
         p.next_pop
       FROM area_hour h0 JOIN (SELECT target_area, obs_time FROM area_hour) a USING (target_area, obs_time), (VALUES ('H1', 30), ('H2', 60), ('H3', 90), ('H4', 120)) h(label, minutes)
       LEFT JOIN (SELECT *, CAST(rtrim(nullif(raw_value, ''), '%') AS DOUBLE) AS x, lead(pop) OVER (PARTITION BY target_area ORDER BY start_ts) AS next_pop FROM periods) p
         ON p.target_area = a.target_area AND a.obs_time + to_minutes(h.minutes) >= p.start_ts AND a.obs_time + to_minutes(h.minutes) < p.end_ts""",
    ["area_hour", "periods"],
)


def runs(v):
    """Anchors of every area and hour with simple forecasts and the matched external probability."""
    from skywharf.plans.timeline import over_chunks

    followed = over_chunks(periods(v), ["target_area"], "start_ts", [lambda w: {"next_pop": F.lead("pop").over(w)}], reach_back=0, reach_ahead=1, tie=["seq"])
    external = joins.align_to_periods(anchors(v), followed, ["target_area"], "anchor_ts", carry=["next_pop"]).drop("anchor_ts", "alignment_status")
    lead = F.col("minutes") / F.lit(120.0)
    decay = F.lit(1.0) - F.col("minutes") / F.lit(600.0)
    mean = F.round("nearby_cwa_precipitation_1hr_mean", 6)
    enough = F.col("nearby_cwa_station_count") >= 4
    return v.area_hour.join(external, RUN).select(
        *RUN, "label", "minutes", F.least(F.lit(1.0), F.col("nearby_cwa_rainy_station_ratio") * (F.lit(1.0) + lead)).alias("raw_probability"),
        (F.col("nearby_cwa_wind_speed_max") * decay).alias("wind_pred"), (F.col("nearby_cwa_wind_gust_max") * decay).alias("gust_pred"),
        (mean * (F.lit(1.0) + lead)).alias("amount_pred"), F.col("nearby_cwa_precipitation_1hr_max").alias("max_1hr"), mean.alias("mean_1hr"),
        F.col("nearby_cwa_rainy_station_count").alias("rainy_count"), F.when(enough, F.col("nearby_cwa_wind_speed_max")).alias("observed_speed"),
        F.when(enough, F.col("nearby_cwa_wind_gust_max")).alias("observed_gust"), F.col("nearby_cwa_station_count").alias("station_count"),
        "pop", F.col("available").alias("pop_available"), "parse_status", "next_pop",
    )


def keyed(df, *columns):
    return df.select("target_area", ts("obs_time").alias("obs_time"), "label", *columns)


NEAR = "label IN ('H1', 'H2')"
RULES_SQL = f"""SELECT *, CASE WHEN likely THEN greatest(p2, pop * 0.8::DOUBLE) ELSE p2 END AS p3 FROM (
    SELECT *, CASE WHEN several AND {NEAR} THEN greatest(p1, 0.85::DOUBLE) ELSE p1 END AS p2 FROM (
      SELECT *, CASE WHEN single AND {NEAR} THEN greatest(raw_probability, 0.7::DOUBLE) ELSE raw_probability END AS p1 FROM (
        SELECT *, max_1hr > 0.5 AS single, mean_1hr > 2 AS several, pop_available AND pop > 0.6 AS likely, pop_available AND pop < 0.1 AND max_1hr = 0 AS dry FROM runs)))"""
ADJUSTED_SQL = f"SELECT *, CASE WHEN dry AND {NEAR} THEN least(p3, 0.15::DOUBLE) ELSE p3 END AS adjusted FROM ({RULES_SQL})"


@query(
    "dec01_rain_rules",
    with_views(
        f"""SELECT {KEYS}, round(adjusted, 9) AS adjusted, concat_ws(',', CASE WHEN single THEN 'nearby_single_station_trigger' END, CASE WHEN several THEN 'nearby_mean_trigger' END,
            CASE WHEN likely THEN 'cwa_high_pop_floor' END, CASE WHEN dry THEN 'cwa_low_pop_dry_suppression' END) AS applied_rules FROM ({ADJUSTED_SQL})""",
        "runs",
    ),
)
def _(v):
    adjusted, rules = decisions.rain_rules(F.col("raw_probability"), F.col("label"), F.col("max_1hr").isNotNull(), F.col("max_1hr"), F.col("mean_1hr"), F.col("pop_available"), F.col("pop"))
    return keyed(runs(v), r(adjusted).alias("adjusted"), F.array_join(rules, ",").alias("applied_rules"))


@query(
    "dec02_pop_blend",
    with_views(
        f"""SELECT {KEYS}, round(least(1, greatest(0, CASE WHEN NOT pop_available THEN raw_probability WHEN label = 'H3' THEN 0.5::DOUBLE * raw_probability + 0.5::DOUBLE * coalesce(pop, 0)
            WHEN label = 'H4' THEN 0.3::DOUBLE * raw_probability + 0.7::DOUBLE * coalesce(next_pop, 0) ELSE raw_probability END)), 9) AS blended FROM runs""",
        "runs",
    ),
)
def _(v):
    return keyed(runs(v), r(decisions.blend_pop(F.col("raw_probability"), F.col("label"), F.col("pop_available"), F.col("pop"), F.col("next_pop"))).alias("blended"))


GRADUATED = "CASE label WHEN 'H1' THEN 0.2 WHEN 'H2' THEN 0.4 WHEN 'H3' THEN 0.6 ELSE 0.8 END::DOUBLE"


@query(
    "dec03_pop_prior",
    with_views(
        f"""SELECT {KEYS}, round(CASE WHEN parse_status = 'ok' AND label IN ('H3', 'H4') THEN 0.8 * raw_probability + 0.2 * pop ELSE raw_probability END, 8) AS conservative, parse_status = 'ok' AND label IN ('H3', 'H4') AS conservative_applied,
            round(CASE WHEN parse_status = 'ok' THEN (1 - {GRADUATED}) * raw_probability + {GRADUATED} * pop ELSE raw_probability END, 8) AS graduated FROM runs""",
        "runs",
    ),
)
def _(v):
    args = [F.col("raw_probability"), F.col("label"), F.col("pop_available"), F.col("parse_status"), F.col("pop")]
    mild, used = decisions.pop_prior(*args)
    graduated, _ = decisions.pop_prior(*args, profile="graduated_like_wind")
    return keyed(runs(v), r(mild, 8).alias("conservative"), used.alias("conservative_applied"), r(graduated, 8).alias("graduated"))


@query("dec04_conditioned_amount", with_views(f"SELECT {KEYS}, round(CASE WHEN raw_probability < 0.35 THEN 0 ELSE amount_pred END, 9) AS amount, round(CASE WHEN raw_probability < 0.5 THEN 0 ELSE amount_pred END, 9) AS amount_default FROM runs", "runs"))
def _(v):
    amount, p = F.col("amount_pred"), F.col("raw_probability")
    return keyed(runs(v), r(decisions.conditioned_amount(amount, p)).alias("amount"), r(decisions.conditioned_amount(amount, p, 0.5)).alias("amount_default"))


def escalated_sql(floor: str, active: str) -> str:
    return f"""SELECT {KEYS}, CASE WHEN {NEAR} AND {active} AND fl IS NOT NULL THEN round(greatest(raw_probability, fl), 4) ELSE raw_probability END AS probability,
        CASE WHEN {NEAR} AND {active} AND wind_max >= 10.8 THEN 'warning' ELSE {speed_sql('wind_pred')} END AS wind_level,
        CASE WHEN {NEAR} AND {active} AND gust_max >= 13.9 THEN 'warning' ELSE {gust_sql('gust_pred')} END AS gust_level
        FROM (SELECT *, {floor} AS fl FROM (SELECT r.*, wind_pred / (1 - minutes / 600.0::DOUBLE) AS wind_max, gust_pred / (1 - minutes / 600.0::DOUBLE) AS gust_max FROM runs r))"""


def escalated(v, floor, active):
    base = runs(v)
    decay = F.lit(1.0) - F.col("minutes") / F.lit(600.0)
    label = F.col("label")
    return keyed(
        base, decisions.escalate_probability(F.col("raw_probability"), label, floor, active).alias("probability"),
        decisions.override_with_warning(wind.wind_speed_level(F.col("wind_pred")), label, F.col("wind_pred") / decay, WIND_SPEED_THRESHOLDS, active).alias("wind_level"),
        decisions.override_with_warning(wind.wind_gust_level(F.col("gust_pred")), label, F.col("gust_pred") / decay, WIND_GUST_THRESHOLDS, active).alias("gust_level"),
    )


@query("dec05_multi_station_escalation", with_views(escalated_sql("greatest(CASE WHEN max_1hr > 0.5 THEN 0.7 END, CASE WHEN mean_1hr > 2 THEN 0.85 END, CASE WHEN rainy_count >= 2 THEN 0.6 END)::DOUBLE", "station_count > 3"), "runs"))
def _(v):
    return escalated(v, decisions.nearby_rain_floor(F.col("max_1hr"), F.col("mean_1hr"), F.col("rainy_count")), F.col("station_count") > 3)


@query("dec06_port_local_escalation", with_views(escalated_sql("CASE WHEN max_1hr > 0.5 THEN 0.7 WHEN rainy_count >= 2 THEN 0.6 END::DOUBLE", "TRUE"), "runs"))
def _(v):
    return escalated(v, decisions.port_rain_floor(F.col("max_1hr"), F.col("rainy_count")), F.lit(True))


RANK_SQL = "CASE {x} WHEN 'normal' THEN 0 WHEN 'watch' THEN 1 WHEN 'warning' THEN 2 WHEN 'high_risk' THEN 3 WHEN 'stop' THEN 4 ELSE -1 END"


def trigger_sql(value: str, t: dict) -> str:
    return f"CASE WHEN {value} >= {t['stop']} THEN 'stop' WHEN {value} >= {t['high_risk']} THEN 'high_risk' WHEN {value} >= {t['warning']} THEN 'warning' END"


def escalate_sql(base: str, value: str, t: dict) -> str:
    trig = trigger_sql(value, t)
    return f"CASE WHEN {RANK_SQL.format(x=f'({trig})')} > {RANK_SQL.format(x=f'({base})')} THEN ({trig}) ELSE ({base}) END"


@query(
    "dec07_monotone_escalation",
    with_views(
        f"""SELECT {KEYS}, {escalate_sql(speed_sql('wind_pred'), 'observed_speed', WIND_SPEED_THRESHOLDS)} AS wind_level, {escalate_sql(gust_sql('gust_pred'), 'observed_gust', WIND_GUST_THRESHOLDS)} AS gust_level,
            {escalate_sql(gust_sql('gust_pred'), 'observed_gust', WIND_GUST_THRESHOLDS)} <> {gust_sql('gust_pred')} AS gust_applied,
            CASE WHEN observed_gust IS NULL THEN 'no wind gust value' WHEN observed_gust < 13.9 THEN 'wind gust below thresholds' ELSE 'wind gust exceeded ' || {trigger_sql('observed_gust', WIND_GUST_THRESHOLDS)} END AS gust_reason FROM runs""",
        "runs",
    ),
)
def _(v):
    speed = decisions.escalate_level(wind.wind_speed_level(F.col("wind_pred")), F.col("observed_speed"), WIND_SPEED_THRESHOLDS, "wind speed")
    gust = decisions.escalate_level(wind.wind_gust_level(F.col("gust_pred")), F.col("observed_gust"), WIND_GUST_THRESHOLDS, "wind gust")
    out = runs(v).withColumns({"s": speed, "g": gust})
    return keyed(out, F.col("s.level").alias("wind_level"), F.col("g.level").alias("gust_level"), F.col("g.applied").alias("gust_applied"), F.col("g.reason").alias("gust_reason"))


PERSIST = "CASE label WHEN 'H1' THEN 0.8 WHEN 'H2' THEN 0.6 WHEN 'H3' THEN 0.4 ELSE 0.2 END::DOUBLE"


def blended_sql(model: str, own: str, other: str) -> str:
    return f"CASE WHEN {own} IS NOT NULL AND {other} IS NOT NULL AND {model} IS NOT NULL THEN round(greatest(0, {PERSIST} * {own} + (1 - {PERSIST}) * {model}), 3) ELSE {model} END"


@query(
    "dec08_persistence_blending",
    with_views(
        f"""SELECT {KEYS}, round(s, 9) AS speed, round(g, 9) AS gust, {speed_sql('s')} AS wind_level, {gust_sql('g')} AS gust_level FROM (
            SELECT *, {blended_sql('wind_pred', 'observed_speed', 'observed_gust')} AS s, {blended_sql('gust_pred', 'observed_gust', 'observed_speed')} AS g FROM runs)""",
        "runs",
    ),
)
def _(v):
    out = runs(v).withColumns(
        {
            "s": decisions.persistence_blend(F.col("wind_pred"), F.col("observed_speed"), F.col("observed_gust"), F.col("label")),
            "g": decisions.persistence_blend(F.col("gust_pred"), F.col("observed_gust"), F.col("observed_speed"), F.col("label")),
        }
    )
    return keyed(out, r("s").alias("speed"), r("g").alias("gust"), wind.wind_speed_level(F.col("s")).alias("wind_level"), wind.wind_gust_level(F.col("g")).alias("gust_level"))


LOW = ", ".join(f"'{x}'" for x in LOW_RELIABILITY)


def risk_sql(inner: str) -> str:
    """Risk, trigger, reliability and action over rain_level, wind_level, gust_level."""
    rank = ", ".join(RANK_SQL.format(x=c) for c in ("rain_level", "wind_level", "gust_level"))
    return f"""SELECT *, coalesce(reliability IN ({LOW}), FALSE) AS is_low, {ACTION_SQL.replace("WHEN level =", "WHEN risk =")} AS action FROM (
        SELECT *, CASE trigger WHEN 'wind_gust' THEN 'medium_high' WHEN 'wind_speed' THEN 'high' WHEN 'rain_probability' THEN 'low_to_medium' END AS reliability FROM (
          SELECT *, CASE WHEN risk = 'normal' THEN 'none' WHEN gust_level = risk THEN 'wind_gust' WHEN wind_level = risk THEN 'wind_speed' ELSE 'rain_probability' END AS trigger FROM (
            SELECT *, CASE greatest({rank}, 0) WHEN 4 THEN 'stop' WHEN 3 THEN 'high_risk' WHEN 2 THEN 'warning' WHEN 1 THEN 'watch' ELSE 'normal' END AS risk FROM ({inner}))))"""


RISK_OUT = "risk AS dispatch_risk_level, trigger AS primary_trigger, reliability AS primary_trigger_reliability, is_low AS is_low_reliability_trigger, action AS dispatch_action_level"
RISK_COLUMNS = ["dispatch_risk_level", "primary_trigger", "primary_trigger_reliability", "is_low_reliability_trigger", "dispatch_action_level"]


@query(
    "dec09_risk_and_trigger",
    with_views(f"SELECT {KEYS}, {RISK_OUT} FROM (" + risk_sql(f"SELECT *, {rain_sql('raw_probability')} AS rain_level, {speed_sql('wind_pred')} AS wind_level, {gust_sql('gust_pred')} AS gust_level FROM runs") + ")", "runs"),
)
def _(v):
    leveled = runs(v).withColumns(
        {"rain_level": rain_probability_level(F.col("raw_probability")), "wind_level": wind.wind_speed_level(F.col("wind_pred")), "gust_level": wind.wind_gust_level(F.col("gust_pred"))}
    )
    return keyed(decisions.with_risk(leveled), *RISK_COLUMNS)


@query(
    "dec10_availability_mode",
    with_views(
        f"""SELECT target_area, {tsql('obs_time')} AS obs_time, CASE WHEN w >= 3 AND on_ AND ok THEN 'port_local_model' WHEN w >= 3 THEN 'port_local_postprocess' ELSE 'fallback_baseline' END AS mode,
            CASE WHEN w < 3 THEN CASE WHEN n > 0 THEN 'Only ' || w || ' valid KHWD wind station(s) available; require 3.' ELSE 'No valid port-local KHWD station data available.' END END AS reason FROM (
              SELECT target_area, obs_time, nearby_cwa_valid_wind_station_count AS w, nearby_cwa_station_count AS n, nearby_cwa_station_count % 2 = 0 AS on_, nearby_cwa_rainy_station_count > 0 AS ok FROM area_hour)""",
        "area_hour",
    ),
)
def _(v):
    mode, reason = decisions.availability_mode(
        F.col("nearby_cwa_valid_wind_station_count"), F.col("nearby_cwa_station_count"), F.col("nearby_cwa_station_count") % 2 == 0,
        F.col("nearby_cwa_rainy_station_count") > 0, F.lit(True), minimum=3,
    )
    return v.area_hour.select("target_area", ts("obs_time").alias("obs_time"), mode.alias("mode"), reason.alias("reason"))


def contexts(v):
    """Selection context of every area and hour, from its station counts."""
    n, wet, gust = F.col("nearby_cwa_station_count"), F.col("nearby_cwa_rainy_station_count"), F.col("nearby_cwa_valid_gust_station_count")
    return v.area_hour.select(
        *RUN, (n % 2 == 0).alias("dataset_ready"), (n % 2 == 0).alias("port_local_model_trained"), F.lit(True).alias("port_local_model_available"),
        (wet % 3 == 1).alias("port_local_model_accepted"), (wet > 2).cast("int").alias("port_local_model_critical_under_warning_count"),
        (gust >= 3).alias("khwd_realtime_available"), gust.alias("valid_khwd_station_count"), (n == 5).alias("no_realtime_khwd_mode"),
        (n != 4).alias("nearby_cwa_historical_model_available"), (wet < 3).alias("nearby_cwa_historical_model_accepted"), F.lit(True).alias("all_nearby_cwa_stations_closer_than_467441"),
    )


CONTEXT_SQL = """SELECT target_area, obs_time, n % 2 = 0 AS ready, wet % 3 = 1 AS accepted, wet > 2 AS critical, gust >= 3 AS realtime, gust, n = 5 AS disabled, n <> 4 AS near_available, wet < 3 AS near_accepted FROM (
    SELECT target_area, obs_time, nearby_cwa_station_count AS n, nearby_cwa_rainy_station_count AS wet, nearby_cwa_valid_gust_station_count AS gust FROM area_hour)"""
MODEL_REASONS = "concat_ws(',', CASE WHEN NOT ready THEN 'DATASET_NOT_READY' END, CASE WHEN NOT ready THEN 'PORT_LOCAL_MODEL_NOT_TRAINED' END, CASE WHEN NOT accepted THEN 'PORT_LOCAL_MODEL_NOT_ACCEPTED' END, CASE WHEN critical THEN 'CRITICAL_UNDER_WARNING_COUNT_GT_0' END)"
POST_REASONS = "concat_ws(',', CASE WHEN disabled THEN 'KHWD_REALTIME_DISABLED_BY_REQUEST' END, CASE WHEN NOT realtime THEN 'KHWD_REALTIME_UNAVAILABLE' END, CASE WHEN gust < 2 THEN 'VALID_KHWD_STATION_COUNT_LT_2' END)"
NEAR_REASONS = "concat_ws(',', CASE WHEN NOT near_available THEN 'NEARBY_CWA_MODEL_UNAVAILABLE' END, CASE WHEN NOT near_accepted THEN 'NEARBY_CWA_MODEL_NOT_ACCEPTED' END)"
SELECTED_SQL = f"SELECT *, CASE WHEN m = '' THEN 'port_local_model' WHEN p = '' THEN 'port_local_postprocess' WHEN q = '' THEN 'nearby_cwa_historical_model' ELSE 'fallback_baseline' END AS selected_mode FROM (SELECT *, {MODEL_REASONS} AS m, {POST_REASONS} AS p, {NEAR_REASONS} AS q FROM ({CONTEXT_SQL}))"


@query(
    "dec11_mode_selection",
    with_views(
        f"""SELECT target_area, {tsql('obs_time')} AS obs_time, selected_mode, CASE selected_mode WHEN 'port_local_model' THEN 'PORT_LOCAL_MODEL_ACCEPTED' WHEN 'nearby_cwa_historical_model' THEN 'KHWD_UNAVAILABLE_NEARBY_ACCEPTED'
            WHEN 'fallback_baseline' THEN 'KHWD_UNAVAILABLE_NEARBY_REJECTED' ELSE CASE WHEN near_accepted THEN 'KHWD_REALTIME_AVAILABLE_NEARBY_ACCEPTED' ELSE 'DEFAULT_SELECTION' END END AS selection_case_id,
            m AS blocked_port_local_model, CASE WHEN m <> '' THEN p ELSE '' END AS blocked_port_local_postprocess, CASE WHEN m <> '' AND p <> '' THEN q ELSE '' END AS blocked_nearby_model,
            NOT critical OR selected_mode <> 'port_local_model' AS critical_blocks_model FROM ({SELECTED_SQL})""",
        "area_hour",
    ),
)
def _(v):
    out = decisions.select_mode(contexts(v))
    joined = [F.array_join(c, ",").alias(c) for c in ("blocked_port_local_model", "blocked_port_local_postprocess", "blocked_nearby_model")]
    return out.select("target_area", ts("obs_time").alias("obs_time"), "selected_mode", "selection_case_id", *joined, "critical_blocks_model")


def family_metrics(v):
    """Error of a persistence and a damped model against the next hour, per day, as a long metric table."""
    from skywharf.plans.timeline import over_chunks

    nxt = over_chunks(
        v.area_hour, ["target_area"], "obs_time",
        [lambda w: {"y_speed": F.lead("nearby_cwa_wind_speed_mean").over(w), "y_gust": F.lead("nearby_cwa_wind_gust_mean").over(w)}], reach_back=0, reach_ahead=1,
    ).withColumn("day", F.date_format("obs_time", "yyyy-MM-dd"))
    speed = F.abs(F.col("nearby_cwa_wind_speed_mean") - F.col("y_speed"))
    gust = F.abs(F.lit(0.7) * F.col("nearby_cwa_wind_gust_mean") + 1 - F.col("y_gust"))
    wide = nxt.groupBy("day").agg((F.avg(speed) * 0.45).alias("wind_speed|H1"), (F.avg(speed) * 0.55).alias("wind_speed|H2"), F.avg(gust).alias("wind_gust|H1"))
    long = wide.unpivot(["day"], ["wind_speed|H1", "wind_speed|H2", "wind_gust|H1"], "name", "value")
    parts = F.split("name", r"\|")
    return long.select("day", F.lit("port_local_model").alias("family"), parts[0].alias("target"), parts[1].alias("horizon"), F.lit("MAE").alias("metric"), "value")


define_view(
    "family_metrics",
    """SELECT strftime(obs_time, '%Y-%m-%d') AS day, AVG(abs(nearby_cwa_wind_speed_mean - y_speed)) * 0.45::DOUBLE AS s1, AVG(abs(nearby_cwa_wind_speed_mean - y_speed)) * 0.55::DOUBLE AS s2, AVG(abs(0.7::DOUBLE * nearby_cwa_wind_gust_mean + 1 - y_gust)) AS g1
       FROM (SELECT *, lead(nearby_cwa_wind_speed_mean) OVER w AS y_speed, lead(nearby_cwa_wind_gust_mean) OVER w AS y_gust FROM area_hour WINDOW w AS (PARTITION BY target_area ORDER BY obs_time)) GROUP BY day""",
    ["area_hour"],
)


@query(
    "dec12_acceptance_gates",
    with_views(
        """SELECT day, 'port_local_model' AS family, concat_ws(',', CASE WHEN g1 > 2 THEN 'wind_gust H1 MAE outside gate' END, 'wind_gust H2 MAE missing', CASE WHEN s1 > 1 THEN 'wind_speed H1 MAE outside gate' END, CASE WHEN s2 > 1.2 THEN 'wind_speed H2 MAE outside gate' END) AS failed_reasons, FALSE AS accepted FROM family_metrics""",
        "family_metrics",
    ),
)
def _(v):
    out = decisions.acceptance_failures(family_metrics(v), ["day"])
    return out.withColumn("failed_reasons", F.array_join("failed_reasons", ","))


GROUP_OF = {"port_local": "KHWD", "nearby": "nearby_cwa", "fallback": "cwa_baseline"}


def usage(v):
    chosen = decisions.select_mode(contexts(v)).select(*RUN, F.col("selected_mode").alias("prediction_mode"))
    group = lookup(GROUP_OF, F.col("priority_group"))
    area = F.when(F.substring("station_id", 2, 2).cast("int") < 8, "north").otherwise("south")
    stations = v.station.select("station_id", area.alias("target_area"), group.alias("station_group")).filter("station_group IS NOT NULL")
    return decisions.station_usage(chosen, stations)


USAGE_SQL = f"""SELECT u.target_area, u.obs_time, u.selected_mode, s.station_id, s.station_group, (s.station_group = 'KHWD' AND selected_mode IN ('port_local_postprocess', 'port_local_model'))
    OR (s.station_group = 'nearby_cwa' AND selected_mode = 'nearby_cwa_historical_model') OR (s.station_group = 'cwa_baseline' AND selected_mode = 'fallback_baseline') AS used
    FROM ({SELECTED_SQL}) u JOIN (SELECT station_id, CASE WHEN CAST(right(station_id, 2) AS INT) < 8 THEN 'north' ELSE 'south' END AS target_area,
      CASE priority_group WHEN 'port_local' THEN 'KHWD' WHEN 'nearby' THEN 'nearby_cwa' WHEN 'fallback' THEN 'cwa_baseline' END AS station_group FROM station WHERE priority_group <> 'marine') s USING (target_area)"""


@query(
    "dec13_station_usage",
    with_views(
        f"""SELECT station_id, station_group, CASE station_group WHEN 'KHWD' THEN 'port_local_realtime_core' WHEN 'nearby_cwa' THEN 'nearby_cwa_historical_fallback_reference' ELSE 'fallback_baseline_only' END AS role,
            COUNT(*) AS run_count, COUNT(*) FILTER (WHERE used) AS used_count FROM ({USAGE_SQL}) GROUP BY ALL""",
        "area_hour", "station",
    ),
)
def _(v):
    return usage(v).groupBy("station_id", "station_group", "role").agg(F.count(F.lit(1)).alias("run_count"), F.count_if("used_for_current_prediction").alias("used_count"))


@query(
    "dec13_role_violations",
    with_views(
        f"""SELECT station_id, 'khwd_used_in_non_port_local_mode' AS violation, COUNT(*) AS n_rows FROM ({USAGE_SQL}) WHERE station_group = 'KHWD' AND selected_mode NOT IN ('port_local_postprocess', 'port_local_model') GROUP BY station_id""",
        "area_hour", "station",
    ),
)
def _(v):
    # Mark every harbour station as used, as a faulty export would.
    wrong = usage(v).withColumn("used_for_current_prediction", F.col("used_for_current_prediction") | (F.col("station_group") == "KHWD"))
    return decisions.role_violations(wrong, BASELINE_STATION).groupBy("station_id", "violation").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "dec14_station_validation",
    with_views(
        """SELECT 'invalid' AS kind, station_id, 'port-local station must set is_port_local=true' AS detail FROM station WHERE enabled AND left(station_id, 2) = 'S0' AND priority_group <> 'port_local'
           UNION ALL SELECT 'invalid', 'S11', 'role must be fallback_baseline/fallback_only'
           UNION ALL SELECT 'valid_port_local', station_id, NULL FROM station WHERE enabled AND priority_group = 'port_local' AND station_id IN (SELECT station_id FROM obs WHERE k > 50)
           UNION ALL SELECT 'unknown', station_id, NULL FROM (SELECT DISTINCT station_id FROM obs) WHERE station_id NOT IN (SELECT station_id FROM station WHERE enabled)""",
        "obs", "station",
    ),
)
def _(v):
    stations = v.station.filter("enabled").select(
        "station_id", "role", "priority", (F.col("priority_group") == "port_local").alias("is_port_local"), (F.col("priority") == 1).alias("is_core_station")
    )
    return decisions.validate_stations(stations, v.obs.select("station_id"), BASELINE_STATION, ["S0"])


@query(
    "dec15_anchor_base_time",
    with_views(
        f"""SELECT target_area, {tsql('day')} AS day, label, source, CAST(greatest(0, floor((epoch_us(day + INTERVAL 1 DAY) - epoch_us(base)) / 60e6)) AS BIGINT) AS staleness, {tsql('base + to_minutes(m)')} AS anchor_time FROM (
            SELECT *, CASE WHEN mode = 'port_local_postprocess' AND port_time IS NOT NULL THEN 'port_local_khwd' WHEN mode = 'nearby_cwa_historical_model' AND near_time IS NOT NULL THEN 'nearby_cwa_historical' ELSE 'fallback_467441' END AS source,
              coalesce(CASE WHEN mode = 'port_local_postprocess' THEN port_time WHEN mode = 'nearby_cwa_historical_model' THEN near_time END, fall_time) AS base FROM (
              SELECT target_area, date_trunc('day', obs_time) AS day, MAX(CASE WHEN device_type = 'WIND' AND k > 30 THEN obs_time END) AS port_time, MAX(CASE WHEN device_type = 'TIDE' THEN obs_time END) AS near_time, MAX(obs_time) AS fall_time,
                CASE COUNT(*) % 3 WHEN 0 THEN 'port_local_postprocess' WHEN 1 THEN 'nearby_cwa_historical_model' ELSE 'fallback_baseline' END AS mode FROM obs GROUP BY ALL)), (VALUES ('H1', 30), ('H2', 60), ('H3', 90), ('H4', 120)) h(label, m)""",
        "obs",
    ),
)
def _(v):
    def newest(condition):
        return F.max(F.when(condition, F.col("obs_time")))

    remainder = F.count(F.lit(1)) % 3
    daily = v.obs.groupBy("target_area", F.date_trunc("day", "obs_time").alias("day")).agg(
        newest((F.col("device_type") == "WIND") & (F.col("k") > 30)).alias("port_time"), newest(F.col("device_type") == "TIDE").alias("nearby_time"),
        F.max("obs_time").alias("fallback_time"), F.lit(None).cast("timestamp").alias("forecast_time"),
        F.when(remainder == 0, "port_local_postprocess").when(remainder == 1, "nearby_cwa_historical_model").otherwise("fallback_baseline").alias("prediction_mode"),
    ).withColumn("generated_at", F.col("day") + F.expr("interval 1 day"))
    out = decisions.anchor_base_time(daily, HORIZONS)
    return out.select("target_area", ts("day").alias("day"), "label", F.col("anchor_time_source").alias("source"), F.col("anchor_time_staleness_minutes").alias("staleness"), ts("anchor_time").alias("anchor_time"))


@query(
    "dec16_extended_windows",
    with_views(
        f"""SELECT target_area, {tsql('obs_time')} AS obs_time, w AS forecast_window, round(pop, 4) AS rain_probability, {rain_sql('pop')} AS rain_level, CAST(floor(pop * 12) AS INT) AS beaufort_min,
            {case_levels('floor(pop * 12)', {'stop': 8, 'high_risk': 7, 'warning': 6, 'watch': 5})} AS operation_level FROM (
              SELECT a.*, p.pop, row_number() OVER (PARTITION BY a.target_area, a.obs_time, a.w ORDER BY CASE WHEN a.t >= p.start_ts AND a.t < p.end_ts THEN 0 ELSE 1 END, abs(epoch(p.start_ts) - epoch(a.t)), p.start_ts) AS rn
              FROM (SELECT target_area, obs_time, w, obs_time + to_hours(h) AS t FROM area_hour, (VALUES ('+3h', 3), ('+6h', 6)) x(w, h)) a JOIN periods p ON a.target_area = p.target_area AND p.pop IS NOT NULL) WHERE rn = 1""",
        "area_hour", "periods",
    ),
)
def _(v):
    from skywharf.plans.dispatch import extended_windows

    hours = v.obs.select("target_area", F.col("obs_hour").alias("obs_time")).distinct()
    forecast = periods(v).withColumn("beaufort_scale_min", F.floor(F.col("pop") * 12).cast("int"))
    out = extended_windows(hours, forecast, ["target_area"], "obs_time")
    return out.select("target_area", ts("obs_time").alias("obs_time"), "forecast_window", r("rain_probability", 4).alias("rain_probability"), "rain_level", "beaufort_min", "operation_level")


FINAL_SQL = f"""SELECT *, round(CASE WHEN parse_status = 'ok' AND label IN ('H3', 'H4') THEN 0.8 * adjusted + 0.2 * pop ELSE adjusted END, 4) AS final_probability, parse_status = 'ok' AND label IN ('H3', 'H4') AS prior_applied,
    {blended_sql('wp', 'observed_speed', 'observed_gust')} AS speed, {blended_sql('gp', 'observed_gust', 'observed_speed')} AS gust
    FROM (SELECT *, greatest(0, coalesce(wind_pred, 0)) AS wp, greatest(0, coalesce(gust_pred, 0)) AS gp FROM ({ADJUSTED_SQL}))"""
LEVELED_SQL = f"""SELECT *, {rain_sql('final_probability')} AS rain_level, CASE WHEN {NEAR} THEN {escalate_sql(speed_sql('speed'), 'observed_speed', WIND_SPEED_THRESHOLDS)} ELSE {speed_sql('speed')} END AS wind_level,
    CASE WHEN {NEAR} THEN {escalate_sql(gust_sql('gust'), 'observed_gust', WIND_GUST_THRESHOLDS)} ELSE {gust_sql('gust')} END AS gust_level,
    round(CASE WHEN final_probability < 0.35 THEN 0 ELSE amount_pred END, 3) AS amount FROM ({FINAL_SQL})"""


def assembled(v):
    return decisions.assemble_risk(runs(v))


@query(
    "dec17_dispatch_risk",
    with_views(
        f"""SELECT {KEYS}, final_probability, prior_applied, rain_level, amount AS predicted_amount_mm, {amount_sql('amount', 1)} AS amount_level, round(speed, 6) AS speed, round(gust, 6) AS gust,
            CAST({beaufort_sql('speed')} AS INT) AS beaufort, wind_level, gust_level, {RISK_OUT} FROM ({risk_sql(LEVELED_SQL)})""",
        "runs",
    ),
)
def _(v):
    return keyed(assembled(v), "final_probability", "prior_applied", "rain_level", "predicted_amount_mm", "amount_level", r("speed", 6).alias("speed"), r("gust", 6).alias("gust"),
                 "beaufort", "wind_level", "gust_level", *RISK_COLUMNS)


@query(
    "dec18_source_inventory",
    with_views(
        f"""SELECT source, device_type, COUNT(DISTINCT station_id) AS station_count, COUNT(*) AS total_rows, COUNT(wind_speed) AS valid_rows, round(COUNT(wind_speed)::DOUBLE / COUNT(*), 4) AS valid_ratio,
            {tsql('MIN(obs_time)')} AS time_start, {tsql('MAX(obs_time)')} AS time_end, CASE WHEN COUNT(wind_speed) > 0 THEN 'available' ELSE 'not_available' END AS status FROM clean GROUP BY ALL""",
        "clean",
    ),
)
def _(v):
    out = reports.source_inventory(v.clean, ["source", "device_type"], "wind_speed")
    return out.withColumns({"time_start": ts("time_start"), "time_end": ts("time_end")})


@query(
    "dec18_selection_summary",
    with_views(f"SELECT target_area, selected_mode, COUNT(*) AS run_count, round(COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY target_area), 6) AS share FROM ({SELECTED_SQL}) GROUP BY target_area, selected_mode", "area_hour"),
)
def _(v):
    return rounded(reports.selection_summary(decisions.select_mode(contexts(v)), ["target_area"], "selected_mode"), "share", places=6)


@query(
    "dec19_selection_regression",
    with_views(
        f"""SELECT target_area, COUNT(*) AS total_cases, COUNT(*) FILTER (WHERE selected_mode = expected) AS passed_cases, COUNT(*) FILTER (WHERE selected_mode <> expected) AS failed_cases, bool_and(selected_mode = expected) AS all_passed
            FROM (SELECT *, CASE WHEN ready AND accepted AND NOT critical THEN 'port_local_model' WHEN gust >= 3 AND NOT disabled THEN 'port_local_postprocess' WHEN near_available AND near_accepted THEN 'nearby_cwa_historical_model' ELSE 'fallback_baseline' END AS expected FROM ({SELECTED_SQL})) GROUP BY target_area""",
        "area_hour",
    ),
)
def _(v):
    c = F.col
    expected = (
        F.when(c("dataset_ready") & c("port_local_model_accepted") & (c("port_local_model_critical_under_warning_count") == 0), "port_local_model")
        .when((c("valid_khwd_station_count") >= 3) & ~c("no_realtime_khwd_mode"), "port_local_postprocess")
        .when(c("nearby_cwa_historical_model_available") & c("nearby_cwa_historical_model_accepted"), "nearby_cwa_historical_model")
        .otherwise("fallback_baseline")
    )
    return reports.regression_report(decisions.select_mode(contexts(v)).withColumn("expected_mode", expected), ["target_area"])


@query(
    "dec20_observation_source",
    with_views(
        f"""SELECT target_area, {tsql('obs_time')} AS obs_time, n AS rain_values, CASE WHEN n > 0 AND live THEN 'nearby_cwa_live_observations' WHEN n > 0 THEN 'nearby_observations' WHEN fb THEN 'fallback_observations' ELSE 'unavailable' END AS observation_source FROM (
            SELECT target_area, obs_hour AS obs_time, COUNT(CASE WHEN k % 2 = 0 THEN precipitation_1hr END) AS n, bool_and(left(station_id, 2) = 'S0') AS live, bool_or(k % 5 = 0) AS fb FROM clean GROUP BY ALL)""",
        "clean",
    ),
)
def _(v):
    thinned = v.clean.select("target_area", F.col("obs_hour").alias("obs_time"), "station_id", "k", F.when(F.col("k") % 2 == 0, F.col("precipitation_1hr")).alias("precipitation_1hr"))
    return decisions.observation_source(thinned, RUN, "S0", F.col("k") % 5 == 0).withColumn("obs_time", ts("obs_time"))


@query(
    "dec21_rain_integrity",
    with_views(
        f"""SELECT target_area, {tsql('obs_time')} AS obs_time, bool_and(f IS NOT NULL) AS rain_probability_preserved, coalesce(string_agg(CASE WHEN f IS NULL THEN label END, ',' ORDER BY label), '') AS missing_anchors,
            coalesce(string_agg(CASE WHEN prior THEN label END, ',' ORDER BY label), '') AS prior_anchors FROM (SELECT *, CASE WHEN rainy_count = 2 AND label = 'H4' THEN NULL ELSE raw_probability END AS f, parse_status = 'ok' AND label IN ('H3', 'H4') AS prior FROM runs) GROUP BY target_area, obs_time""",
        "runs",
    ),
)
def _(v):
    _, used = decisions.pop_prior(F.col("raw_probability"), F.col("label"), F.col("pop_available"), F.col("parse_status"), F.col("pop"))
    marked = runs(v).withColumns({"final_probability": F.when(~((F.col("rainy_count") == 2) & (F.col("label") == "H4")), F.col("raw_probability")), "prior_applied": used})
    out = decisions.rain_integrity(marked, RUN)
    return out.select("target_area", ts("obs_time").alias("obs_time"), "rain_probability_preserved", *[F.array_join(c, ",").alias(c) for c in ("missing_anchors", "prior_anchors")])


@query(
    "dec22_station_inputs",
    with_views(
        """SELECT role, COUNT(*) AS configured_count, COUNT(o.station_id) AS available_count, coalesce(string_agg(o.station_id, ',' ORDER BY o.station_id), '') AS available_ids,
           coalesce(string_agg(CASE WHEN o.station_id IS NULL THEN s.station_id END, ',' ORDER BY s.station_id), '') AS missing_ids, COUNT(o.station_id) > 1 AS multi_station_input, COUNT(o.station_id) <= 1 AS fallback_to_single_station
           FROM (SELECT station_id, role FROM station UNION ALL VALUES ('S97', 'core'), ('S98', 'extra')) s
           LEFT JOIN (SELECT DISTINCT station_id FROM obs) o ON s.station_id = o.station_id GROUP BY role""",
        "obs", "station",
    ),
)
def _(v):
    silent = dimension(v.spark, [("S97", "core"), ("S98", "extra")], "station_id string, role string")
    return decisions.station_input_summary(v.station.select("station_id", "role").unionByName(silent), v.obs)


@query(
    "dec23_model_registry",
    with_views(
        """SELECT family, MAX(artifact) AS artifact_version, COUNT(value) AS metric_count, COUNT(value) > 0 AS metrics_available, bool_or(trained) AS trained, bool_or(available) AS available, bool_or(accepted) AS accepted FROM (
             SELECT 'port_local_model' AS family, 'port_local' AS artifact, TRUE AS trained, TRUE AS available, FALSE AS accepted, unnest([s1, s2, g1]) AS value FROM family_metrics
             UNION ALL SELECT 'nearby_cwa_historical_model', 'nearby', TRUE, TRUE, TRUE, NULL UNION ALL SELECT 'sequence_model', 'sequence', FALSE, FALSE, FALSE, NULL) GROUP BY family""",
        "family_metrics",
    ),
)
def _(v):
    families = dimension(
        v.spark, [("port_local_model", "port_local", True, True, False), ("nearby_cwa_historical_model", "nearby", True, True, True), ("sequence_model", "sequence", False, False, False)],
        "family string, artifact_version string, trained boolean, available boolean, accepted boolean",
    )
    return reports.model_registry(families, family_metrics(v))


@query(
    "dec23_registry_summary",
    with_views(
        """SELECT day, coalesce(string_agg(CASE WHEN a THEN f END, ',' ORDER BY f), '') AS available_families, coalesce(string_agg(CASE WHEN ok THEN f END, ',' ORDER BY f), '') AS accepted_families FROM (
           SELECT day, unnest(['wind_gust H1', 'wind_speed H1', 'wind_speed H2']) AS f, unnest([g1 IS NOT NULL, s1 IS NOT NULL, s2 IS NOT NULL]) AS a, unnest([g1 <= 2, s1 <= 1, s2 <= 1.2]) AS ok FROM family_metrics) GROUP BY day""",
        "family_metrics",
    ),
)
def _(v):
    table = family_metrics(v).withColumns(
        {"family": F.concat_ws(" ", "target", "horizon"), "available": F.col("value").isNotNull(),
         "accepted": F.col("value") <= F.when(F.col("target") == "wind_gust", 2.0).when(F.col("horizon") == "H1", 1.0).otherwise(1.2)}
    )
    return reports.registry_summary(table, ["day"])
