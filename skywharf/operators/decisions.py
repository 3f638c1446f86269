"""Rules over forecast anchors: probabilities, levels, triggers, model choice.

Everything is a Column or a DataFrame transform over many runs at once; an
anchor row is one (area, run, H1..H4).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywharf.functions import wind
from skywharf.functions.weather import clip, rain_amount_level, rain_probability_level
from skywharf.plans.dims import dimension, lookup
from skywharf.schema import (
    ACTION_BY_LEVEL_HIGH_RELIABILITY,
    ACTION_BY_LEVEL_LOW_RELIABILITY,
    LEVEL_RANK,
    LOW_RELIABILITY,
    RELIABILITY,
    TRIGGER_PRIORITY,
    WIND_GUST_THRESHOLDS,
    WIND_SPEED_THRESHOLDS,
)

# --- fixed values ---------------------------------------------------------

# Rain probability rules.
SINGLE_STATION_MM, SINGLE_STATION_FLOOR = 0.5, 0.70
MEAN_MM, MEAN_FLOOR = 2.0, 0.85
HIGH_POP, HIGH_POP_SHARE = 0.60, 0.80
LOW_POP, DRY_CAP = 0.10, 0.15
RULE_SINGLE, RULE_MEAN = "nearby_single_station_trigger", "nearby_mean_trigger"
RULE_HIGH_POP, RULE_DRY = "cwa_high_pop_floor", "cwa_low_pop_dry_suppression"
NEAR_ANCHORS = ["H1", "H2"]

# Share of the external probability per anchor, and which period it is read from.
BLEND_WEIGHTS = {
    "H1": (1.0, 0.0, "current"),
    "H2": (1.0, 0.0, "current"),
    "H3": (0.5, 0.5, "current"),
    "H4": (0.3, 0.7, "next"),
}
PRIOR_PROFILES = {
    "conservative": {"H3": (0.8, 0.2), "H4": (0.8, 0.2)},
    "graduated_like_wind": {"H1": (0.8, 0.2), "H2": (0.6, 0.4), "H3": (0.4, 0.6), "H4": (0.2, 0.8)},
}
# Weight of the observed harbour wind against the model.
PERSISTENCE_WEIGHTS = {"H1": 0.8, "H2": 0.6, "H3": 0.4, "H4": 0.2}
AMOUNT_PROBABILITY_THRESHOLD = 0.35

# Prediction modes, preferred first.
MODES = ["port_local_model", "port_local_postprocess", "nearby_cwa_historical_model", "fallback_baseline"]
CASE_IDS = {
    "port_local_model": "PORT_LOCAL_MODEL_ACCEPTED",
    "nearby_cwa_historical_model": "KHWD_UNAVAILABLE_NEARBY_ACCEPTED",
    "fallback_baseline": "KHWD_UNAVAILABLE_NEARBY_REJECTED",
}
POSTPROCESS_CASE, DEFAULT_CASE = "KHWD_REALTIME_AVAILABLE_NEARBY_ACCEPTED", "DEFAULT_SELECTION"

# Acceptance gates: family, target, horizon, metric, comparison, limit.
ACCEPTANCE_GATES = [
    ("port_local_model", "wind_speed", "H1", "MAE", "max", 1.0),
    ("port_local_model", "wind_speed", "H2", "MAE", "max", 1.2),
    ("port_local_model", "wind_speed", "H1", "beats_persistence", "min", 1.0),
    ("port_local_model", "wind_gust", "H1", "MAE", "max", 2.0),
    ("port_local_model", "wind_gust", "H2", "MAE", "max", 2.2),
    ("nearby_cwa_historical_model", "wind_speed", "H1", "MAE", "max", 1.3),
    ("nearby_cwa_historical_model", "wind_speed", "H2", "MAE", "max", 1.5),
    ("nearby_cwa_historical_model", "wind_speed", "H1", "beats_persistence", "min", 1.0),
    ("nearby_cwa_historical_model", "wind_gust", "H1", "MAE", "max", 2.4),
    ("nearby_cwa_historical_model", "wind_gust", "H2", "MAE", "max", 2.8),
    ("nearby_cwa_historical_model", "rain_probability", "H1", "Brier Score", "max", 0.25),
    ("nearby_cwa_historical_model", "rain_probability", "H1", "FAR", "max", 0.75),
    ("nearby_cwa_historical_model", "rain_probability", "H1", "POD", "min", 0.30),
]


# --- actions and reliability ----------------------------------------------


def action_for(level: Column, reliability: Column) -> Column:
    """Dispatch action for a level; weak sources lead to milder actions."""
    weak = F.coalesce(reliability.isin(LOW_RELIABILITY), F.lit(False))
    return F.when(weak, lookup(ACTION_BY_LEVEL_LOW_RELIABILITY, level, "normal_dispatch")).otherwise(
        lookup(ACTION_BY_LEVEL_HIGH_RELIABILITY, level, "normal_dispatch")
    )


def confidence_for(family: Column, override: Column | None = None, default: str = "unknown") -> Column:
    """Reliability of a variable: configured value first, then the default table."""
    base = lookup(RELIABILITY, family, default)
    return base if override is None else F.coalesce(override, base)


# --- rain probability -----------------------------------------------------


def rain_rules(probability: Column, label: Column, nearby_available: Column, max_1hr: Column, mean_1hr: Column,
               pop_available: Column, pop: Column) -> tuple[Column, Column]:
    """(adjusted probability, applied rule ids). Rules act in order on H1/H2 or all anchors."""
    near, zero = label.isin(NEAR_ANCHORS), F.lit(0.0)
    wettest, mean, chance = F.coalesce(max_1hr, zero), F.coalesce(mean_1hr, zero), F.coalesce(pop, zero)
    single = nearby_available & (wettest > SINGLE_STATION_MM)
    several = nearby_available & (mean > MEAN_MM)
    likely = pop_available & (chance > HIGH_POP)
    dry = pop_available & (chance < LOW_POP) & (wettest == 0.0)
    p = clip(F.coalesce(probability, zero), 0.0, 1.0)
    p = F.when(single & near, F.greatest(p, F.lit(SINGLE_STATION_FLOOR))).otherwise(p)
    p = F.when(several & near, F.greatest(p, F.lit(MEAN_FLOOR))).otherwise(p)
    p = F.when(likely, F.greatest(p, chance * HIGH_POP_SHARE)).otherwise(p)
    p = F.when(dry & near, F.least(p, F.lit(DRY_CAP))).otherwise(p)
    applied = F.array_compact(
        F.array(
            F.when(single, F.lit(RULE_SINGLE)), F.when(several, F.lit(RULE_MEAN)),
            F.when(likely, F.lit(RULE_HIGH_POP)), F.when(dry, F.lit(RULE_DRY)),
        )
    )
    return clip(p, 0.0, 1.0), applied


def blend_pop(probability: Column, label: Column, available: Column, current: Column, following: Column) -> Column:
    """Weighted mix with the external probability; passthrough when unavailable."""
    own = lookup({k: w[0] for k, w in BLEND_WEIGHTS.items()}, label, 1.0)
    share = lookup({k: w[1] for k, w in BLEND_WEIGHTS.items()}, label, 0.0)
    source = lookup({k: w[2] for k, w in BLEND_WEIGHTS.items()}, label, "current")
    external = F.coalesce(F.when(source == "next", following).otherwise(current), F.lit(0.0))
    return clip(F.when(F.coalesce(available, F.lit(False)), own * probability + share * external).otherwise(probability), 0.0, 1.0)


def pop_prior(probability: Column, label: Column, available: Column, parse_status: Column, pop: Column,
              profile: str = "conservative") -> tuple[Column, Column]:
    """(probability, applied flag): a prior on the profile's anchors when the value is usable."""
    weights = PRIOR_PROFILES[profile]
    usable = F.coalesce(available & (parse_status == "ok") & pop.isNotNull() & label.isin(list(weights)), F.lit(False))
    own = lookup({k: w[0] for k, w in weights.items()}, label, 1.0)
    share = lookup({k: w[1] for k, w in weights.items()}, label, 0.0)
    base = clip(probability, 0.0, 1.0)
    return F.when(usable, clip(own * base + share * clip(pop, 0.0, 1.0), 0.0, 1.0)).otherwise(base), usable


def conditioned_amount(amount: Column, probability: Column, threshold: float = AMOUNT_PROBABILITY_THRESHOLD) -> Column:
    """Amount is 0 when rain itself is unlikely."""
    return F.when(F.coalesce(probability, F.lit(0.0)) < threshold, F.lit(0.0)).otherwise(amount)


# --- escalation -----------------------------------------------------------


def nearby_rain_floor(max_mm: Column, mean_mm: Column, wet_stations: Column) -> Column:
    """Probability floor from neighbours: 0.70, 0.85 or 0.60, whichever is highest; null if none."""
    return F.greatest(
        F.when(max_mm > SINGLE_STATION_MM, F.lit(0.70)), F.when(mean_mm > MEAN_MM, F.lit(0.85)), F.when(wet_stations >= 2, F.lit(0.60))
    )


def port_rain_floor(max_mm: Column, wet_stations: Column) -> Column:
    return F.when(max_mm > SINGLE_STATION_MM, F.lit(0.70)).when(wet_stations >= 2, F.lit(0.60))


def escalate_probability(probability: Column, label: Column, floor: Column, active: Column) -> Column:
    raised = F.round(F.greatest(F.coalesce(probability, F.lit(0.0)), floor), 4)
    return F.when(label.isin(NEAR_ANCHORS) & active & floor.isNotNull(), raised).otherwise(probability)


def override_with_warning(level: Column, label: Column, observed: Column, thresholds: dict[str, float], active: Column) -> Column:
    """Near anchors are set to warning once the observed maximum reaches that threshold."""
    hit = label.isin(NEAR_ANCHORS) & active & F.coalesce(observed >= thresholds["warning"], F.lit(False))
    return F.when(hit, F.lit("warning")).otherwise(level)


def observed_trigger(observed: Column, thresholds: dict[str, float]) -> Column:
    """Level from warning upward that an observed value reaches, else null."""
    return F.when(observed >= thresholds["stop"], "stop").when(observed >= thresholds["high_risk"], "high_risk").when(observed >= thresholds["warning"], "warning")


def escalate_level(base: Column, observed: Column, thresholds: dict[str, float], name: str) -> Column:
    """Level never drops: the stronger of the base and the observed trigger, with a reason."""
    triggered = observed_trigger(observed, thresholds)
    final = F.when(wind.level_rank(triggered) > wind.level_rank(base), triggered).otherwise(base)
    reason = (
        F.when(observed.isNull(), F.lit(f"no {name} value"))
        .when(triggered.isNull(), F.lit(f"{name} below thresholds"))
        .otherwise(F.concat(F.lit(f"{name} exceeded "), triggered))
    )
    return F.struct(final.alias("level"), (final != base).alias("applied"), triggered.alias("triggered"), reason.alias("reason"))


def persistence_blend(model: Column, observed: Column, other_observed: Column, label: Column) -> Column:
    """Observed wind weighted by anchor; model only unless both speed and gust were observed."""
    weight = lookup(PERSISTENCE_WEIGHTS, label, 0.0)
    mixed = F.greatest(F.lit(0.0), weight * observed + (F.lit(1.0) - weight) * model)
    return F.when(observed.isNotNull() & other_observed.isNotNull() & model.isNotNull(), F.round(mixed, 3)).otherwise(model)


# --- risk and triggers ----------------------------------------------------


def with_risk(anchors: DataFrame, levels: dict[str, str] | None = None, priority: Sequence[str] = tuple(TRIGGER_PRIORITY)) -> DataFrame:
    """Add the strongest level, the first trigger by priority at that level, its reliability and the action.

    ``levels`` maps trigger names to level columns. Each step is its own
    projection, so expressions are evaluated once instead of being repeated.
    """
    levels = levels or {"rain_probability": "rain_level", "wind_speed": "wind_level", "wind_gust": "gust_level"}
    table = {**RELIABILITY, "visibility": "unavailable"}
    risk, primary, reliability = F.col("dispatch_risk_level"), F.col("primary_trigger"), F.col("primary_trigger_reliability")
    first = F.coalesce(*[F.when(F.col(levels[name]) == risk, F.lit(name)) for name in priority if name in levels], F.lit("unknown"))
    return (
        anchors.withColumn("dispatch_risk_level", wind.strongest(*[F.col(c) for c in levels.values()]))
        .withColumn("primary_trigger", F.when(risk == "normal", F.lit("none")).otherwise(first))
        .withColumn("primary_trigger_reliability", F.when(risk != "normal", lookup({k: table[k] for k in TRIGGER_PRIORITY}, primary)))
        .withColumns(
            {
                "is_low_reliability_trigger": F.coalesce(reliability.isin(LOW_RELIABILITY), F.lit(False)),
                "dispatch_action_level": action_for(risk, reliability),
            }
        )
    )


# --- model choice ---------------------------------------------------------


def availability_mode(available_wind: Column, available_any: Column, model_enabled: Column, metrics_ok: Column, postprocess_enabled: Column,
                      minimum: int = 2) -> tuple[Column, Column]:
    """(mode, fallback reason) from the number of available harbour wind stations."""
    enough = available_wind >= minimum
    mode = (
        F.when(enough & model_enabled & metrics_ok, "port_local_model").when(enough & postprocess_enabled, "port_local_postprocess")
        .otherwise("fallback_baseline")
    )
    short = F.concat(F.lit("Only "), available_wind.cast("string"), F.lit(f" valid KHWD wind station(s) available; require {minimum}."))
    reason = F.when((available_any > 0) & ~enough, short).otherwise("No valid port-local KHWD station data available.")
    return mode, F.when(mode == "fallback_baseline", reason)


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for bad, code in pairs]))


def select_mode(contexts: DataFrame) -> DataFrame:
    """First eligible mode per context row, with blocking reasons, case id and assertions.

    Missing flags count as false, except the ones that default to true.
    """
    def flag(name: str, default: bool = False) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in contexts.columns else F.lit(default)

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) if name in contexts.columns else F.lit(0)

    critical = count("port_local_model_critical_under_warning_count") > 0
    model = _reasons(
        (~flag("dataset_ready"), "DATASET_NOT_READY"), (~flag("port_local_model_trained"), "PORT_LOCAL_MODEL_NOT_TRAINED"),
        (~flag("port_local_model_available"), "PORT_LOCAL_MODEL_UNAVAILABLE"), (~flag("port_local_model_accepted"), "PORT_LOCAL_MODEL_NOT_ACCEPTED"),
        (critical, "CRITICAL_UNDER_WARNING_COUNT_GT_0"),
    )
    realtime, disabled, stations = flag("khwd_realtime_available"), flag("no_realtime_khwd_mode"), count("valid_khwd_station_count")
    post = _reasons(
        (disabled, "KHWD_REALTIME_DISABLED_BY_REQUEST"), (~realtime, "KHWD_REALTIME_UNAVAILABLE"), (stations < 2, "VALID_KHWD_STATION_COUNT_LT_2")
    )
    core = flag("nearby_cwa_used_as_port_local_core")
    near = _reasons(
        (~flag("nearby_cwa_historical_training_enabled", True), "NEARBY_CWA_TRAINING_DISABLED"),
        (~flag("nearby_cwa_historical_model_available"), "NEARBY_CWA_MODEL_UNAVAILABLE"),
        (~flag("nearby_cwa_historical_model_accepted"), "NEARBY_CWA_MODEL_NOT_ACCEPTED"),
        (~flag("all_nearby_cwa_stations_closer_than_467441"), "NEARBY_CWA_STATIONS_NOT_ALL_CLOSER_THAN_467441"),
        (core, "NEARBY_CWA_USED_AS_PORT_LOCAL_CORE"), (count("nearby_cwa_critical_under_warning_count") > 0, "CRITICAL_UNDER_WARNING_COUNT_GT_0"),
    )
    judged = contexts.withColumns({"_model": model, "_post": post, "_near": near})
    none = [F.size(c) == 0 for c in ("_model", "_post", "_near")]
    mode = F.when(none[0], MODES[0]).when(none[1], MODES[1]).when(none[2], MODES[2]).otherwise(MODES[3])
    case = F.coalesce(
        lookup(CASE_IDS, mode),
        F.when((mode == MODES[1]) & flag("nearby_cwa_historical_model_accepted"), F.lit(POSTPROCESS_CASE)), F.lit(DEFAULT_CASE),
    )
    nothing = F.array().cast("array<string>")
    overridden = realtime & (stations >= 2) & ~disabled & (mode == MODES[2])
    return judged.withColumns(
        {
            "selected_mode": mode,
            "selection_case_id": case,
            "blocked_port_local_model": F.when(~none[0], F.col("_model")).otherwise(nothing),
            "blocked_port_local_postprocess": F.when(~none[0] & ~none[1], F.col("_post")).otherwise(nothing),
            "blocked_nearby_model": F.when(~none[0] & ~none[1] & ~none[2], F.col("_near")).otherwise(nothing),
            "realtime_overrides_nearby": ~overridden,
            "nearby_only_without_realtime": ~((mode == MODES[2]) & realtime & ~disabled),
            "no_core_role_violation": ~core & ~flag("467441_used_as_core_station"),
            "critical_blocks_model": ~critical | (mode != MODES[0]),
        }
    ).drop("_model", "_post", "_near")


def acceptance_failures(metrics: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Violated gates per model family; a missing H1/H2 error also fails.

    ``metrics`` is long: groups, family, target, horizon, metric, value.
    """
    spark = metrics.sparkSession
    gates = dimension(spark, ACCEPTANCE_GATES, "family string, target string, horizon string, metric string, kind string, gate double")
    families = metrics.select(*groups, "family").distinct().join(gates, "family")
    joined = families.join(metrics, [*groups, "family", "target", "horizon", "metric"], "left")
    violated = F.when(F.col("kind") == "max", F.col("value") > F.col("gate")).otherwise(F.col("value") < F.col("gate"))
    missing = F.col("value").isNull() & (F.col("metric") == "MAE")
    text = F.concat_ws(" ", "target", "horizon", "metric", F.when(missing, F.lit("missing")).otherwise(F.lit("outside gate")))
    return joined.groupBy(*groups, "family").agg(
        F.sort_array(F.collect_list(F.when(missing | F.coalesce(violated, F.lit(False)), text))).alias("failed_reasons")
    ).withColumn("accepted", F.size("failed_reasons") == 0)


# --- stations -------------------------------------------------------------

# Station groups and the mode in which each is used.
GROUP_MODES = {"KHWD": ["port_local_postprocess", "port_local_model"], "nearby_cwa": ["nearby_cwa_historical_model"], "cwa_baseline": ["fallback_baseline"]}
GROUP_ROLES = {"KHWD": "port_local_realtime_core", "nearby_cwa": "nearby_cwa_historical_fallback_reference", "cwa_baseline": "fallback_baseline_only"}
ACTIVE_SOURCE = {
    "port_local_postprocess": "KHWD",
    "port_local_model": "port_local_model",
    "nearby_cwa_historical_model": "nearby_cwa_historical_model",
    "fallback_baseline": "467441_fallback_baseline",
}


def station_usage(runs: DataFrame, stations: DataFrame) -> DataFrame:
    """One row per (run, station): role and whether the run's mode uses it.

    ``stations`` is the dimension (station_id, station_group) of every run's area.
    """
    used = F.lit(False)
    for group, modes in GROUP_MODES.items():
        used = used | ((F.col("station_group") == group) & F.col("prediction_mode").isin(modes))
    return runs.join(stations, "target_area").withColumns(
        {
            "role": lookup(GROUP_ROLES, F.col("station_group")),
            "used_for_current_prediction": used,
            "is_port_local_core": F.col("station_group") == "KHWD",
            "active_wind_source": lookup(ACTIVE_SOURCE, F.col("prediction_mode"), ACTIVE_SOURCE["fallback_baseline"]),
        }
    )


def role_violations(usage: DataFrame, baseline_id: str) -> DataFrame:
    """Rows of a usage table that break a role rule, one per violation."""
    mode, group, used, core = (F.col(c) for c in ("prediction_mode", "station_group", "used_for_current_prediction", "is_port_local_core"))
    baseline = F.col("station_id") == baseline_id
    port_mode = mode.isin(GROUP_MODES["KHWD"])
    checks = F.array_compact(
        F.array(
            F.when(baseline & core, F.lit("baseline_must_not_be_port_local_core")),
            F.when((group == "nearby_cwa") & core, F.lit("nearby_cwa_must_not_be_port_local_core")),
            F.when((group == "KHWD") & used & ~port_mode, F.lit("khwd_used_in_non_port_local_mode")),
            F.when((group == "nearby_cwa") & used & (mode != "nearby_cwa_historical_model"), F.lit("nearby_used_in_wrong_mode")),
            F.when(baseline & used & (mode != "fallback_baseline"), F.lit("baseline_used_outside_fallback_baseline")),
        )
    )
    return usage.withColumn("violation", F.explode(checks))


def validate_stations(stations: DataFrame, available: DataFrame, baseline_id: str, port_prefixes: Sequence[str]) -> DataFrame:
    """Metadata problems, missing port stations and unknown ids as (kind, station_id, detail) rows."""
    named_port = F.lit(False)
    for prefix in port_prefixes:
        named_port = named_port | F.col("station_id").startswith(prefix)
    baseline = F.col("station_id") == baseline_id
    problems = F.array_compact(
        F.array(
            F.when(named_port & ~F.col("is_port_local"), F.lit("port-local station must set is_port_local=true")),
            F.when(baseline & F.col("is_port_local"), F.lit("fallback station must set is_port_local=false")),
            F.when(baseline & (F.col("is_core_station") | (F.col("priority") == 1)), F.lit("fallback station cannot be a priority-1 core station")),
            F.when(baseline & (F.col("role") != "fallback_baseline"), F.lit("role must be fallback_baseline/fallback_only")),
        )
    )
    invalid = stations.select(F.lit("invalid").alias("kind"), "station_id", F.explode(problems).alias("detail"))
    present = available.select("station_id").distinct()
    none = F.lit(None).cast("string").alias("detail")
    port = stations.filter("is_port_local").select("station_id")
    missing = port.join(present, "station_id", "left_anti").select(F.lit("missing_port_local").alias("kind"), "station_id", none)
    valid = port.join(present, "station_id", "left_semi").select(F.lit("valid_port_local").alias("kind"), "station_id", none)
    unknown = present.join(stations.select("station_id"), "station_id", "left_anti").select(F.lit("unknown").alias("kind"), "station_id", none)
    return invalid.unionByName(missing).unionByName(valid).unionByName(unknown)


def anchor_base_time(runs: DataFrame, offsets: dict[str, int]) -> DataFrame:
    """Base time by mode, its source and staleness, exploded to the anchors.

    Input columns: prediction_mode, port_time, nearby_time, fallback_time,
    forecast_time, generated_at.
    """
    mode = F.col("prediction_mode")
    port = F.when(mode.isin(GROUP_MODES["KHWD"]), F.col("port_time"))
    near = F.when(mode == "nearby_cwa_historical_model", F.col("nearby_time"))
    own = F.coalesce(port, near)
    fallback = F.when((mode == "fallback_baseline") | own.isNull(), F.col("fallback_time"))
    source = (
        F.when(port.isNotNull(), "port_local_khwd").when(near.isNotNull(), "nearby_cwa_historical").when(fallback.isNotNull(), "fallback_467441")
        .when(F.col("forecast_time").isNotNull(), "cwa_forecast_generated_at").otherwise("unavailable")
    )
    base = F.coalesce(own, fallback, F.col("forecast_time"))
    stale = F.greatest(F.lit(0), F.floor((F.col("generated_at").cast("double") - base.cast("double")) / 60)).cast("long")
    options = F.array(*[F.struct(F.lit(h).alias("label"), F.lit(m).alias("minutes")) for h, m in offsets.items()])
    out = runs.withColumns(
        {"anchor_base_time": base, "anchor_time_source": source, "anchor_time_staleness_minutes": F.when(base.isNotNull(), stale), "_a": F.explode(options)}
    )
    return out.withColumn("label", F.col("_a.label")).withColumn(
        "anchor_time", F.col("anchor_base_time") + F.make_dt_interval(mins=F.col("_a.minutes"))
    ).drop("_a")


def observation_source(df: DataFrame, groups: Sequence[str], live_prefix: str, fallback_has_rain: Column) -> DataFrame:
    """Which observations feed the rain amount model of each group."""
    return df.groupBy(*groups).agg(
        F.count("precipitation_1hr").alias("rain_values"), F.bool_and(F.col("station_id").startswith(live_prefix)).alias("_live"),
        F.bool_or(fallback_has_rain).alias("_fallback"),
    ).withColumn(
        "observation_source",
        F.when((F.col("rain_values") > 0) & F.col("_live"), "nearby_cwa_live_observations").when(F.col("rain_values") > 0, "nearby_observations")
        .when(F.col("_fallback"), "fallback_observations").otherwise("unavailable"),
    ).drop("_live", "_fallback")


def rain_integrity(anchors: DataFrame, run_keys: Sequence[str]) -> DataFrame:
    """Per run: every anchor has a final probability; which lack it and which used a prior."""
    return anchors.groupBy(*run_keys).agg(
        F.bool_and(F.col("final_probability").isNotNull()).alias("rain_probability_preserved"),
        F.sort_array(F.collect_list(F.when(F.col("final_probability").isNull(), F.col("label")))).alias("missing_anchors"),
        F.sort_array(F.collect_list(F.when(F.col("prior_applied"), F.col("label")))).alias("prior_anchors"),
    )


def station_input_summary(stations: DataFrame, observed: DataFrame) -> DataFrame:
    """Configured, available and missing stations per role (a dimension-sized result)."""
    present = observed.select("station_id").distinct().withColumn("_present", F.lit(1))
    marked = stations.join(present, "station_id", "left")
    there = F.col("_present").isNotNull()
    return marked.groupBy("role").agg(
        F.count(F.lit(1)).alias("configured_count"), F.count_if(there).alias("available_count"),
        F.array_join(F.sort_array(F.collect_list(F.when(there, F.col("station_id")))), ",").alias("available_ids"),
        F.array_join(F.sort_array(F.collect_list(F.when(~there, F.col("station_id")))), ",").alias("missing_ids"),
    ).withColumns({"multi_station_input": F.col("available_count") > 1, "fallback_to_single_station": F.col("available_count") <= 1})


# --- assembly -------------------------------------------------------------


def assemble_risk(anchors: DataFrame, profile: str = "conservative") -> DataFrame:
    """Full risk of every anchor: rain rules, prior, blending, levels, amounts, triggers, action.

    Input per anchor: label, raw_probability, wind_pred, gust_pred, amount_pred,
    max_1hr, mean_1hr, observed_speed, observed_gust, pop, pop_available, parse_status.
    """
    label = F.col("label")
    near_available = F.col("max_1hr").isNotNull()
    pop_known = F.coalesce(F.col("pop_available"), F.lit(False))
    adjusted, rules = rain_rules(F.col("raw_probability"), label, near_available, F.col("max_1hr"), F.col("mean_1hr"), pop_known, F.col("pop"))
    staged = anchors.withColumns({"nearby_adjusted": adjusted, "applied_rules": rules})
    final, used = pop_prior(F.col("nearby_adjusted"), label, pop_known, F.col("parse_status"), F.col("pop"), profile)
    staged = staged.withColumns(
        {
            "final_probability": F.round(final, 4),
            "prior_applied": used,
            "speed": persistence_blend(F.greatest(F.lit(0.0), F.coalesce("wind_pred", F.lit(0.0))), F.col("observed_speed"), F.col("observed_gust"), label),
            "gust": persistence_blend(F.greatest(F.lit(0.0), F.coalesce("gust_pred", F.lit(0.0))), F.col("observed_gust"), F.col("observed_speed"), label),
        }
    )
    amount = conditioned_amount(F.col("amount_pred"), F.col("final_probability"))
    speed_level = escalate_level(wind.wind_speed_level(F.col("speed")), F.col("observed_speed"), WIND_SPEED_THRESHOLDS, "wind speed")
    gust_level = escalate_level(wind.wind_gust_level(F.col("gust")), F.col("observed_gust"), WIND_GUST_THRESHOLDS, "wind gust")
    near = label.isin(NEAR_ANCHORS)
    staged = staged.withColumns(
        {
            "rain_level": rain_probability_level(F.col("final_probability")),
            "predicted_amount_mm": F.round(amount, 3),
            "amount_level": rain_amount_level(F.round(amount, 3), 1),
            "wind_level": F.when(near, speed_level["level"]).otherwise(wind.wind_speed_level(F.col("speed"))),
            "gust_level": F.when(near, gust_level["level"]).otherwise(wind.wind_gust_level(F.col("gust"))),
            "beaufort": wind.beaufort(F.col("speed")),
        }
    )
    return with_risk(staged)


def monotone_rank(level: Column) -> Column:
    return lookup(LEVEL_RANK, level, 0)
