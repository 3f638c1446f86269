"""Aggregations of station rows into area series, snapshots and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skywharf.functions import clock, weather
from skywharf.operators.cleaning import keep_last
from skywharf.plans.dims import lookup
from skywharf.schema import DEFAULT_FRESHNESS, FRESHNESS_POLICIES, STATION_TYPE_LIMITS


def spread_stats(column: str, prefix: str, fill_std: bool = True) -> list[Column]:
    """Mean, max, min and population deviation; a missing deviation counts as 0."""
    std = F.stddev_pop(column)
    return [
        F.avg(column).alias(f"{prefix}_mean"),
        F.max(column).alias(f"{prefix}_max"),
        F.min(column).alias(f"{prefix}_min"),
        (F.coalesce(std, F.lit(0.0)) if fill_std else std).alias(f"{prefix}_std"),
    ]


def rainy_count(column: str = "precipitation_1hr", threshold: float = 0.5) -> Column:
    return F.count_if(F.coalesce(F.col(column), F.lit(0.0)) > threshold)


def direction_means(column: str, prefix: str) -> list[Column]:
    """Mean sine and cosine of a direction in degrees."""
    angle = F.radians(F.col(column))
    return [F.avg(F.sin(angle)).alias(f"{prefix}_sin_mean"), F.avg(F.cos(angle)).alias(f"{prefix}_cos_mean")]


def area_wind_rain(df: DataFrame, keys: Sequence[str], prefix: str = "nearby_cwa", directions: bool = False,
                   pressure: bool = False, weighted: bool = False) -> DataFrame:
    """Area series: one row per key with station counts and wind, gust and rain statistics."""
    aggs = [
        F.count_distinct("station_id").alias(f"{prefix}_station_count"),
        *spread_stats("wind_speed", f"{prefix}_wind_speed"),
        F.count("wind_speed").alias(f"{prefix}_valid_wind_station_count"),
        *spread_stats("wind_gust", f"{prefix}_wind_gust"),
        F.count("wind_gust").alias(f"{prefix}_valid_gust_station_count"),
        F.avg("precipitation_1hr").alias(f"{prefix}_precipitation_1hr_mean"),
        F.max("precipitation_1hr").alias(f"{prefix}_precipitation_1hr_max"),
        rainy_count().alias(f"{prefix}_rainy_station_count"),
    ]
    if directions:
        aggs += direction_means("wind_direction", f"{prefix}_wind_direction")
        aggs += direction_means("wind_gust_direction", f"{prefix}_gust_direction")
    if pressure:
        aggs += pressure_humidity_aggs(prefix)
    if weighted:
        aggs += distance_weighted_aggs()
    out = df.groupBy(*keys).agg(*aggs).withColumn(
        f"{prefix}_rainy_station_ratio",
        F.try_divide(F.col(f"{prefix}_rainy_station_count"), F.col(f"{prefix}_station_count")),
    )
    if pressure:
        out = out.withColumns(pressure_humidity_derived(prefix))
    if weighted:
        out = finish_distance_weighted(out)
    return out


def pressure_humidity_aggs(prefix: str = "nearby_cwa") -> list[Column]:
    return [
        *spread_stats("station_pressure", f"{prefix}_pressure"),
        *spread_stats("relative_humidity", f"{prefix}_relative_humidity"),
        *spread_stats("temperature", f"{prefix}_temperature"),
    ]


def pressure_humidity_derived(prefix: str = "nearby_cwa") -> dict[str, Column]:
    mean_temperature = F.col(f"{prefix}_temperature_mean")
    dew = weather.dew_point(mean_temperature, F.col(f"{prefix}_relative_humidity_mean"))
    return {
        f"{prefix}_pressure_gradient": F.col(f"{prefix}_pressure_max") - F.col(f"{prefix}_pressure_min"),
        f"{prefix}_dew_point_mean": dew,
        f"{prefix}_dew_point_spread_mean": mean_temperature - dew,
    }


# Measure -> name of its distance-weighted mean.
DISTANCE_WEIGHTED = {
    "wind_speed": "distance_weighted_wind_speed",
    "wind_gust": "distance_weighted_wind_gust",
    "precipitation_1hr": "distance_weighted_precipitation",
}


def distance_weighted_aggs(distance: str = "distance_to_port_km") -> list[Column]:
    """Partial sums of the 1/(d+1) weighted mean.

    A missing distance takes the largest distance of the group (0 if none), which
    is known only after the aggregation, so rows without a distance are summed apart.
    """
    weight = F.lit(1.0) / (F.col(distance) + 1.0)
    known = F.col(distance).isNotNull()
    aggs = [F.max(distance).alias("_dmax")]
    for measure in DISTANCE_WEIGHTED:
        value = F.col(measure)
        aggs += [
            F.sum(F.when(known, value * weight)).alias(f"_vw_{measure}"),
            F.sum(F.when(known & value.isNotNull(), weight)).alias(f"_w_{measure}"),
            F.sum(F.when(~known, value)).alias(f"_v0_{measure}"),
            F.count(F.when(~known, value)).alias(f"_n0_{measure}"),
        ]
    return aggs


def finish_distance_weighted(df: DataFrame) -> DataFrame:
    far = F.lit(1.0) / (F.coalesce("_dmax", F.lit(0.0)) + 1.0)
    zero = F.lit(0.0)
    out = {}
    for measure, name in DISTANCE_WEIGHTED.items():
        total = F.coalesce(f"_vw_{measure}", zero) + F.coalesce(f"_v0_{measure}", zero) * far
        weights = F.coalesce(f"_w_{measure}", zero) + F.col(f"_n0_{measure}") * far
        out[name] = F.when(weights > 0, total / weights)
    partial = [c for c in df.columns if c.startswith(("_vw_", "_w_", "_v0_", "_n0_"))]
    return df.withColumns(out).drop("_dmax", *partial)


def port_local_by_time(df: DataFrame, keys: Sequence[str], prefix: str = "khwd", rain: bool = True) -> DataFrame:
    """Harbour wind series with ranges, valid counts and an optional rain block."""
    aggs = [
        *spread_stats("wind_speed", f"{prefix}_wind_speed"),
        *spread_stats("wind_gust", f"{prefix}_wind_gust"),
        F.count_distinct("station_id").alias(f"{prefix}_station_count"),
        F.count("wind_speed").alias(f"{prefix}_valid_wind_station_count"),
        F.count("wind_gust").alias(f"{prefix}_valid_gust_station_count"),
        (F.max("wind_speed") - F.min("wind_speed")).alias(f"{prefix}_wind_speed_range"),
        (F.max("wind_gust") - F.min("wind_gust")).alias(f"{prefix}_wind_gust_range"),
        *direction_means("wind_direction", f"{prefix}_wind_direction"),
        *direction_means("wind_gust_direction", f"{prefix}_gust_direction"),
    ]
    if rain:
        aggs += [
            F.max("precipitation_1hr").alias("port_local_precipitation_1hr_max"),
            F.avg("precipitation_1hr").alias("port_local_precipitation_1hr_mean"),
            rainy_count().alias("port_local_rainy_station_count"),
        ]
    out = df.groupBy(*keys).agg(*aggs)
    if rain:
        out = out.withColumn(
            "port_local_rainy_station_ratio",
            F.try_divide(F.col("port_local_rainy_station_count"), F.col(f"{prefix}_station_count")),
        )
    return out


def upstream_lead(df: DataFrame, keys: Sequence[str], time: str, upstream: dict[str, Sequence[str]],
                  typhoon_months: list[int] | None = None) -> DataFrame:
    """Statistics over the stations upstream of the harbour in the season of each time.

    ``upstream`` maps season to station ids already restricted to the selected
    ones; a time without upstream stations keeps count 0 and null statistics.
    """
    season = clock.season(F.col(time), typhoon_months)
    flag = F.lit(False)
    for name, ids in upstream.items():
        if ids:
            flag = flag | ((season == name) & F.col("station_id").isin(list(ids)))
    flagged = df.withColumn("_season", season).withColumn("_up", F.coalesce(flag, F.lit(False)))
    aggs = [
        F.max(clock.season_code(F.col("_season"))).alias("upstream_subset_season_code"),
        F.count_distinct(F.when(F.col("_up"), F.col("station_id"))).alias("upstream_subset_station_count"),
    ]
    for measure in ("wind_speed", "wind_gust", "precipitation_1hr"):
        chosen = F.when(F.col("_up"), F.col(measure))
        aggs += [F.avg(chosen).alias(f"upstream_subset_{measure}_mean"), F.max(chosen).alias(f"upstream_subset_{measure}_max")]
    return flagged.groupBy(*keys).agg(*aggs)


# --- snapshots ------------------------------------------------------------


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep_last(df, keys, order)


def nearby_snapshot(latest: DataFrame, target_station: str, groups: Sequence[str] = ()) -> DataFrame:
    """Neighbour statistics around a target station, from one row per station."""
    near = F.col("station_id") != target_station
    own = ~near
    aggs: list[Column] = []
    for m in ("wind_speed", "wind_gust"):
        v = F.when(near, F.col(m))
        target = F.max(F.when(own, F.col(m)))
        aggs += [
            F.avg(v).alias(f"nearby_{m}_mean"), F.max(v).alias(f"nearby_{m}_max"),
            F.min(v).alias(f"nearby_{m}_min"), F.stddev_pop(v).alias(f"nearby_{m}_std"),
            (target - F.avg(v)).alias(f"target_{m}_minus_nearby_mean"),
            (F.max(v) - target).alias(f"nearby_{m}_max_minus_target"),
        ]
    rain = F.when(near, F.col("precipitation_1hr"))
    aggs += [
        F.avg(rain).alias("nearby_precipitation_1hr_mean"), F.max(rain).alias("nearby_precipitation_1hr_max"),
        F.sum(rain).alias("nearby_precipitation_1hr_sum"),
        F.when(F.count(rain) > 0, F.count_if(rain > 0)).alias("nearby_rainy_station_count"),
        F.try_divide(F.count_if(rain > 0), F.count(rain)).alias("nearby_rainy_station_ratio"),
        F.count(F.lit(1)).alias("input_station_count"),
        F.count_if(near).alias("nearby_station_count"),
        F.count(F.when(near, F.col("wind_speed"))).alias("available_wind_station_count"),
        F.count(F.when(near, F.col("wind_gust"))).alias("available_gust_station_count"),
        F.count(rain).alias("available_rain_station_count"),
        (F.count_if(near) > 0).cast("int").alias("multi_station_input_flag"),
        (F.count_if(near) == 0).cast("int").alias("fallback_to_single_station_flag"),
    ]
    return latest.groupBy(*groups).agg(*aggs)


def port_local_snapshot(latest: DataFrame, groups: Sequence[str] = (), minimum: int = 2, prefix: str = "khwd") -> DataFrame:
    """Latest harbour wind statistics (4 places) with a quality status."""
    aggs = []
    for m in ("wind_speed", "wind_gust"):
        aggs += [
            F.round(F.avg(m), 4).alias(f"{prefix}_{m}_mean"), F.round(F.max(m), 4).alias(f"{prefix}_{m}_max"),
            F.round(F.min(m), 4).alias(f"{prefix}_{m}_min"), F.round(F.stddev_pop(m), 4).alias(f"{prefix}_{m}_std"),
        ]
    aggs += [
        F.count(F.lit(1)).alias(f"{prefix}_station_count"),
        F.count("wind_speed").alias(f"{prefix}_valid_wind_station_count"),
        F.count("wind_gust").alias(f"{prefix}_valid_gust_station_count"),
        F.max("obs_time").alias(f"{prefix}_latest_observation_time"),
        F.when(F.count(F.lit(1)) == 0, "unavailable").when(F.count("wind_speed") < minimum, "degraded")
        .otherwise("ok").alias("quality_status"),
    ]
    return latest.groupBy(*groups).agg(*aggs)


def last_valid_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Last non-null value of each measure per key."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), place)).alias(m) for m in measures])


def multistation_features(df: DataFrame, groups: Sequence[str], target_station: str, order: Sequence[str],
                          target_measures: Sequence[str], nearby_measures: Sequence[str],
                          forbidden: Sequence[str] = (), rain: str = "precipitation_1hr") -> DataFrame:
    """Target's last valid values next to statistics over all neighbour rows."""
    near, place = F.col("station_id") != target_station, F.struct(*order)
    aggs = [
        F.max_by(m, F.when(~near & F.col(m).isNotNull(), place)).alias(m) for m in target_measures if m not in forbidden
    ]
    for m in nearby_measures:
        if m not in forbidden:
            aggs += _plain_spread(F.when(near, F.col(m)), f"nearby_{m}")
    aggs += [
        F.count_if(near).alias("nearby_active_station_count"),
        F.count_if(near & (F.col(rain) > 0)).alias("nearby_rain_station_count"),
    ]
    return df.groupBy(*groups).agg(*aggs)


def _plain_spread(value: Column, prefix: str) -> list[Column]:
    return [
        F.avg(value).alias(f"{prefix}_mean"), F.max(value).alias(f"{prefix}_max"),
        F.min(value).alias(f"{prefix}_min"), F.stddev_pop(value).alias(f"{prefix}_std"),
    ]


def rain_summary(latest: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Rain of each station as a map (one entry per station), with max, mean and wet count."""
    rain = F.col("precipitation_1hr")
    entries = F.sort_array(F.collect_list(F.when(rain.isNotNull(), F.struct("station_id", rain))))
    return latest.groupBy(*groups).agg(
        F.map_from_entries(entries).alias("station_values_1hr"),
        F.max(rain).alias("max_1hr"), F.avg(rain).alias("mean_1hr"),
        F.count_if(rain > 0).alias("rainy_station_count"), (F.count(rain) > 0).alias("available"),
    )


# --- status and reports ---------------------------------------------------


def freshness_threshold(source: Column, device: Column, override: int | None = None) -> Column:
    """Allowed age in minutes by (lower-case source, upper-case device)."""
    if override is not None:
        return F.lit(int(override))
    key = F.concat_ws("|", F.lower(source), F.upper(device))
    return lookup({f"{s}|{d}": p[0] for (s, d), p in FRESHNESS_POLICIES.items()}, key, DEFAULT_FRESHNESS[0])


def freshness_texts(source: Column, device: Column) -> dict[str, Column]:
    key = F.concat_ws("|", F.lower(source), F.upper(device))
    return {
        "expected_update_interval": lookup({f"{s}|{d}": p[1] for (s, d), p in FRESHNESS_POLICIES.items()}, key, DEFAULT_FRESHNESS[1]),
        "policy_note": lookup({f"{s}|{d}": p[2] for (s, d), p in FRESHNESS_POLICIES.items()}, key, DEFAULT_FRESHNESS[2]),
    }


def data_status(df: DataFrame, as_of: Column, override: int | None = None) -> DataFrame:
    """Row, station and freshness counts per (source, device) and overall.

    Observed rows are first reduced to one row per (source, device, station);
    groups and the overall line then come from one grouping-sets pass.
    ``scope`` is 'group' or 'overall'.
    """
    per_station = df.filter(~F.col("is_forecast")).groupBy("source", "device_type", "station_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("obs_time").alias("latest_obs"),
        F.max("fetched_at").alias("latest_fetch"), F.sum(F.col("stale").cast("int")).alias("stale_n"),
    )
    threshold = freshness_threshold(F.col("source"), F.col("device_type"), override)
    status = clock.status_level(clock.age_minutes(F.col("latest_obs"), as_of), threshold)
    marked = per_station.withColumn("status", status)
    grouped = marked.groupingSets([["source", "device_type"], []], "source", "device_type").agg(
        F.when(F.grouping_id() == 0, "group").otherwise("overall").alias("scope"),
        F.sum("n").alias("row_count"),
        F.count_distinct("station_id").alias("station_count"),
        F.count(F.lit(1)).alias("latest_station_count"),
        F.max("latest_obs").alias("latest_obs_time"),
        F.max("latest_fetch").alias("latest_fetched_at"),
        F.sum("stale_n").alias("stored_stale_count"),
        F.count_if(F.col("status") != "current").alias("current_stale_count"),
        F.count_if(F.col("status") == "outage").alias("outage_count"),
    )
    return grouped.withColumns(
        {
            "latest_obs_age_minutes": clock.age_minutes(F.col("latest_obs_time"), as_of),
            "is_current": F.col("current_stale_count") == 0,
        }
    )


# Texts of failed readiness conditions.
READINESS_TEXTS = {
    "stations": "selected station count below threshold",
    "samples": "sample_count below min_total_samples",
    "days": "training_days below min_training_days",
    "wind": "valid_wind_samples below threshold",
    "gust": "valid_gust_samples below threshold",
    "rain": "valid_rain_samples below threshold",
    "feature_missing": "feature missing ratio above threshold",
    "label_missing": "label missing ratio above threshold",
    "horizon": "{} valid labels below threshold",
}


def _span_seconds(time: str = "obs_time") -> Column:
    return (F.max(F.unix_micros(time)) - F.min(F.unix_micros(time))) / F.lit(1e6)


def nearby_readiness(df: DataFrame, groups: Sequence[str], min_stations: int = 2, min_samples: int = 1000,
                     min_days: int = 30, min_valid: int = 500) -> DataFrame:
    """Row count, whole-day span and valid counts, with the list of failed thresholds."""
    counted = df.groupBy(*groups).agg(
        F.count_distinct("station_id").alias("station_count"),
        F.count(F.lit(1)).alias("sample_count"),
        F.floor(_span_seconds() / 86400).alias("training_days"),
        F.count("wind_speed").alias("valid_wind_samples"),
        F.count("wind_gust").alias("valid_gust_samples"),
        F.count("precipitation_1hr").alias("valid_rain_samples"),
    )
    checks = [
        ("stations", F.col("station_count") < min_stations), ("samples", F.col("sample_count") < min_samples),
        ("days", F.col("training_days") < min_days), ("wind", F.col("valid_wind_samples") < min_valid),
        ("gust", F.col("valid_gust_samples") < min_valid), ("rain", F.col("valid_rain_samples") < min_valid),
    ]
    failed = F.array_compact(F.array(*[F.when(bad, F.lit(READINESS_TEXTS[name])) for name, bad in checks]))
    return counted.withColumn("failed_reasons", failed).withColumn("ready", F.size("failed_reasons") == 0)


def dataset_readiness(df: DataFrame, groups: Sequence[str], features: Sequence[str], labels: dict[str, Sequence[str]],
                      min_samples: int = 500, min_days: float = 14.0, max_missing: float = 0.30,
                      min_labels: int = 100) -> DataFrame:
    """Fractional days, worst missing ratios, and rows per horizon with every label."""
    label_columns = [c for columns in labels.values() for c in columns]

    def worst(columns: Sequence[str]) -> Column:
        ratios = [F.avg(F.col(c).isNull().cast("double")) for c in columns]
        return F.greatest(*ratios) if len(ratios) > 1 else ratios[0]

    def complete(columns: Sequence[str]) -> Column:
        whole = F.lit(True)
        for c in columns:
            whole = whole & F.col(c).isNotNull()
        return F.count_if(whole)

    counted = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("sample_count"),
        (_span_seconds() / 86400).alias("training_days"),
        worst(features).alias("feature_missing_ratio"),
        worst(label_columns).alias("label_missing_ratio"),
        *[complete(columns).alias(f"valid_{h}") for h, columns in labels.items()],
    )
    checks = [
        F.when(F.col("sample_count") < min_samples, F.lit(READINESS_TEXTS["samples"])),
        F.when(F.col("training_days") < min_days, F.lit(READINESS_TEXTS["days"])),
        F.when(F.col("feature_missing_ratio") > max_missing, F.lit(READINESS_TEXTS["feature_missing"])),
        F.when(F.col("label_missing_ratio") > max_missing, F.lit(READINESS_TEXTS["label_missing"])),
        *[F.when(F.col(f"valid_{h}") < min_labels, F.lit(READINESS_TEXTS["horizon"].format(h))) for h in labels],
    ]
    return counted.withColumn("failed_reasons", F.array_compact(F.array(*checks))).withColumn(
        "ready", F.size("failed_reasons") == 0
    )


def surge_readiness(df: DataFrame, columns: Sequence[str], main: str = "tide_level", min_days: float = 21, min_rows: int = 336) -> DataFrame:
    """Coverage days, non-null counts and usability for residual training per station."""
    counted = df.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("rows"),
        (_span_seconds() / 86400).alias("_days"),
        *[F.count(c).alias(f"{c}_non_null") for c in columns],
    )
    usable = (F.col(f"{main}_non_null") >= min_rows) & (F.col("_days") >= float(min_days))
    blockers = F.array_compact(
        F.array(F.when(F.col(f"{main}_non_null") < min_rows, F.lit("rows")), F.when(F.col("_days") < min_days, F.lit("coverage_days")))
    )
    return counted.withColumns(
        {"coverage_days": F.round("_days", 3), "usable": usable, "blockers": blockers}
    ).drop("_days")


def station_quality(df: DataFrame, keys: Sequence[str], station_type: str = "wind") -> DataFrame:
    """Missing ratios, out-of-range counts, warnings and validity per station."""
    limits = STATION_TYPE_LIMITS[station_type]
    aggs = [F.count(F.lit(1)).alias("record_count")]
    for name, (lo, hi) in limits.items():
        aggs += [
            F.round(F.avg(F.col(name).isNull().cast("double")), 4).alias(f"{name}_missing_ratio"),
            F.count_if((F.col(name) < lo) | (F.col(name) > hi)).alias(f"{name}_out_of_range"),
        ]
    if station_type == "wind":
        aggs.append(F.count_if(F.col("wind_gust") < F.col("wind_speed")).alias("gust_below_speed"))
    out = df.groupBy(*keys).agg(*aggs)
    missing = [F.col(f"{n}_missing_ratio") > 0.5 for n in limits]
    outside = [F.col(f"{n}_out_of_range") > 0 for n in limits]
    warnings = []
    for n, miss, out_of in zip(limits, missing, outside):
        warnings += [F.when(miss, F.lit(f"{n}: missing_ratio > 0.5")), F.when(out_of, F.lit(f"{n}: out_of_range"))]
    if station_type == "wind":
        warnings.append(F.when(F.col("gust_below_speed") > 0, F.lit("wind_gust lower than wind_speed")))
    bad, all_missing = F.lit(False), F.lit(True)
    for flag in [*missing, *outside]:
        bad = bad | flag
    for flag in missing:
        all_missing = all_missing & flag
    return out.withColumns(
        {
            "quality_status": F.when(bad, "degraded").otherwise("ok"),
            "valid": ~bad | ~all_missing,
            "warnings": F.array_compact(F.array(*warnings)),
        }
    )


def coverage(df: DataFrame, groups: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Span in days (3 places), rows, rows with any measure, and their share."""
    any_value = F.coalesce(*[F.col(m) for m in measures]).isNotNull()
    return df.groupBy(*groups).agg(
        F.min("obs_time").alias("first_time"), F.max("obs_time").alias("last_time"),
        F.round((F.max(F.unix_micros("obs_time")) - F.min(F.unix_micros("obs_time"))) / 86400e6, 3).alias("duration_days"),
        F.count(F.lit(1)).alias("row_count"), F.count_if(any_value).alias("valid_row_count"),
        F.round(F.avg(any_value.cast("double")), 4).alias("valid_ratio"),
    )


def availability_by_prefix(requested: DataFrame, available: DataFrame, minimum: int) -> DataFrame:
    """Requested, available and missing station counts per id prefix, with a gate."""
    found = available.select("station_id").distinct().withColumn("_found", F.lit(1))
    return (
        requested.join(found, "station_id", "left")
        .groupBy("prefix")
        .agg(
            F.count(F.lit(1)).alias("requested_count"),
            F.count("_found").alias("available_count"),
            F.count_if(F.col("_found").isNull()).alias("missing_count"),
        )
        .withColumn("meets_minimum", F.col("available_count") >= minimum)
    )


def current_quality(df: DataFrame, as_of: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Record count, stale count and whether anything is stale right now."""
    age = clock.age_minutes(F.col("obs_time"), as_of)
    stale = clock.status_level(age, freshness_threshold(F.col("source"), F.col("device_type"))) != "current"
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("record_count"), F.count_if(stale).alias("stale_count"),
        F.coalesce(F.bool_or(stale), F.lit(False)).alias("contains_stale"),
    )


def negative_counts(df: DataFrame, measures: Sequence[str], minimum_rows: int = 500) -> DataFrame:
    """Rows and negative values per station, with the row-count gate."""
    return df.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(F.col(m) < 0).alias(f"{m}_negative_count") for m in measures],
        (F.count(F.lit(1)) >= minimum_rows).alias("enough_rows"),
    )


def cumulative_share(df: DataFrame, value: str, name: str) -> DataFrame:
    """Normalised value and its running sum, largest first. For importance tables."""
    total = F.sum(value).over(Window.partitionBy())
    running = Window.orderBy(F.col(value).desc(), F.col(name)).rowsBetween(Window.unboundedPreceding, 0)
    share = F.when(total > 0, F.col(value) / total).otherwise(F.lit(0.0))
    return df.withColumn("normalized_importance", share).withColumn(
        "cumulative_importance", F.sum("normalized_importance").over(running)
    )
