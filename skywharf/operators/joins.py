"""Joins between stations, areas, forecasts and dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywharf.functions.geo import haversine_km, planar_degrees
from skywharf.operators.aggregates import _plain_spread
from skywharf.plans.asof import around, interval_match, nearest_join, segments
from skywharf.plans.timeline import number_rows, over_chunks
from skywharf.schema import EARTH_RADIUS_KM, HORIZONS


def spatial_aggregation(primary: DataFrame, neighbors: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Neighbour statistics at the same time, and own value minus their mean."""
    stats = neighbors.groupBy(*keys).agg(
        *[c for m in measures for c in _plain_spread(F.col(m), f"{m}_neighbors")]
    )
    joined = primary.join(stats, list(keys), "left")
    return joined.withColumns(
        {f"{m}_spatial_diff": F.col(m) - F.col(f"{m}_neighbors_mean") for m in measures if m in primary.columns}
    )


def prefix_stations(target: DataFrame, features: DataFrame, time: str, station_ids: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per target time with every station's measures as prefixed columns.

    A single conditional aggregation replaces one join per station.
    """
    wide = features.groupBy(time).agg(
        *[
            F.max(F.when(F.col("station_id") == s, F.col(m))).alias(f"{s}_{m}")
            for s in station_ids for m in measures
        ]
    )
    return target.join(wide, time, "left")


def nearest_labels(area: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], horizons: dict[str, int] = HORIZONS,
                   tolerance_minutes: float = 30.0, strict_future: bool = False) -> DataFrame:
    """Per row and horizon, the values observed nearest to time + horizon.

    Ties go to the later row and a row may label itself at 30 minutes;
    ``strict_future`` forbids that. Output: one row per input row with
    ``<value>_<horizon>`` columns. All horizons share one pass.
    """
    keys = list(keys)
    shifts = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("minutes")) for h, m in horizons.items()])
    targets = (
        area.select(*keys, F.col(time).alias("_row_time"))
        .withColumn("_h", F.explode(shifts))
        .select(
            *keys, "_row_time", F.col("_h.horizon").alias("_horizon"),
            (F.col("_row_time") + F.make_dt_interval(mins=F.col("_h.minutes"))).alias("_target_time"),
        )
    )
    matched = nearest_join(
        targets, area.select(*keys, time, *values), keys, "_target_time", time, values,
        tolerance_seconds=tolerance_minutes * 60.0,
    )
    if strict_future:
        matched = matched.withColumn("_match", F.when(F.col(f"_match.{time}") > F.col("_row_time"), F.col("_match")))
    wide = matched.groupBy(*keys, F.col("_row_time").alias(time)).agg(
        *[
            F.max(F.when(F.col("_horizon") == h, F.col(f"_match.{c}"))).alias(f"{c}_{h}")
            for h in horizons for c in values
        ],
        *[F.bool_or((F.col("_horizon") == h) & F.col("_match").isNotNull()).alias(f"_found_{h}") for h in horizons],
    )
    return area.join(wide, [*keys, time])


def align_to_periods(anchors: DataFrame, periods: DataFrame, keys: Sequence[str], at: str,
                     raw: str = "raw_value", carry: Sequence[str] = ()) -> DataFrame:
    """First forecast period containing each anchor, parsed with its quality.

    ``carry`` names further period columns to return.

    Status: matched_forecast_period, no_matching_forecast_period, or
    no_forecast_timeseries when the key has no periods at all.
    """
    from skywharf.functions.weather import pop_quality

    matched = interval_match(anchors, periods, keys, at, "start_ts", "end_ts", ["seq"], [raw, *carry])
    known = periods.select(*keys).distinct().withColumn("_has_series", F.lit(True))
    quality = pop_quality(F.col(f"_period.{raw}"))
    status = (
        F.when(F.col("_period").isNotNull(), "matched_forecast_period")
        .when(F.col("_has_series").isNull(), "no_forecast_timeseries")
        .otherwise("no_matching_forecast_period")
    )
    return (
        matched.join(known, list(keys), "left")
        .withColumn("_quality", quality)
        .withColumn("alignment_status", status)
        .select(
            *anchors.columns, "alignment_status", F.col("_quality.available").alias("available"),
            F.col("_quality.normalized_value").alias("pop"), F.col("_quality.parse_status").alias("parse_status"),
            *[F.col(f"_period.{c}").alias(c) for c in carry],
        )
    )


def period_or_nearest(points: DataFrame, periods: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Each value of the containing period, else of the period whose start is nearest.

    Only periods that have the value count; ties go to the earlier start. All
    values and both directions come from one scan of the points.
    """
    keys = list(keys)
    cut = segments(periods, keys, "start_ts", "end_ts", ["start_ts", "seq"], {v: (F.col(v).isNotNull(), F.struct(F.col(v).alias("v"))) for v in values})
    sources = {"_held": cut.select(*keys, "_at", F.struct(*values).alias("_value"))}
    for v in values:
        starts = periods.filter(F.col(v).isNotNull()).groupBy(*keys, "start_ts").agg(F.min_by(v, "seq").alias("v"))
        sources[f"_start_{v}"] = starts.select(*keys, F.col("start_ts").alias("_at"), F.struct(F.col("start_ts").alias("_time"), "v").alias("_value"))
    found = around(points, sources, keys, at)

    def chosen(v: str) -> Column:
        before, after = F.col(f"_start_{v}_prev"), F.col(f"_start_{v}_next")
        gap_before = F.col(at).cast("double") - before["_time"].cast("double")
        gap_after = after["_time"].cast("double") - F.col(at).cast("double")
        nearest = F.when(after.isNull() | (gap_before <= gap_after), before["v"]).otherwise(after["v"])
        held = F.col("_held_prev")[v]
        return F.when(held.isNotNull(), held["v"]).otherwise(nearest)

    return found.withColumns({v: chosen(v) for v in values}).drop(*[f"{n}_{side}" for n in sources for side in ("prev", "next")])


def current_and_next(points: DataFrame, periods: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Value of the period containing each point and of the one after it.

    The last period repeats as its own successor; outside all periods the
    first and second periods of the series are used.
    """
    keys = list(keys)
    with_next = over_chunks(
        periods, keys, "start_ts",
        [lambda w: {"_next_value": F.lead(value).over(w), "_is_last": F.lead("start_ts").over(w).isNull()}],
        reach_back=0, reach_ahead=1, tie=["seq"], keep_position=True,
    ).withColumn("_next_value", F.when(F.col("_is_last"), F.col(value)).otherwise(F.col("_next_value")))
    heads = with_next.filter(F.col("_rn") <= 2).groupBy(*keys).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(value))).alias("_first_value"),
        F.max(F.when(F.col("_rn") == 2, F.col(value))).alias("_second_value"),
        F.count(F.lit(1)).alias("_heads"),
    )
    matched = interval_match(points, with_next, keys, at, "start_ts", "end_ts", ["_rn"], [value, "_next_value"])
    inside = F.col("_period").isNotNull()
    fallback_next = F.when(F.col("_heads") > 1, F.col("_second_value")).otherwise(F.col("_first_value"))
    return matched.join(heads, keys, "left").select(
        *points.columns,
        F.when(inside, F.col(f"_period.{value}")).otherwise(F.col("_first_value")).alias("current_value"),
        F.when(inside, F.col("_period._next_value")).otherwise(fallback_next).alias("next_value"),
    )


def merge_predictions(obs: DataFrame, predictions: DataFrame, forecast: DataFrame | None, keys: Sequence[str], variable: str) -> DataFrame:
    """Observations with predictions (inner) and an external forecast (left), nulls dropped."""
    predicted = f"pred_{variable}"
    out = obs.join(predictions.select(*keys, predicted), list(keys))
    if forecast is not None:
        out = out.join(forecast.select(*keys, f"cwa_{variable}"), list(keys), "left")
    return out.dropna(subset=[variable, predicted])


def latest_all_ties(df: DataFrame, keys: Sequence[str], time: str = "obs_time") -> DataFrame:
    """Every observed row at the latest time of its key; ties are all kept.

    The latest time per key is a combinable maximum, so the join side has one
    row per key and the large side is not gathered by key.
    """
    observed = df.filter(~F.col("is_forecast"))
    newest = observed.groupBy(*keys).agg(F.max(time).alias(time))
    return observed.join(newest, [*keys, time], "left_semi")


def within_radius(stations: DataFrame, target_lat: float, target_lon: float, radius_km: float, earth: float = EARTH_RADIUS_KM) -> DataFrame:
    """Stations at most ``radius_km`` from a target; stations without coordinates stay."""
    distance = haversine_km(F.lit(target_lat), F.lit(target_lon), F.col("latitude"), F.col("longitude"), earth)
    measured = stations.withColumn("distance_km", F.round(distance, 3)).withColumn("_exact", distance)
    return measured.filter(F.col("_exact").isNull() | (F.col("_exact") <= radius_km)).drop("_exact")


def nearest_planar(stations: DataFrame, lat: Column, lon: Column, radius_degrees: float, groups: Sequence[str] = ()) -> DataFrame:
    """Nearest station by planar degrees within a radius, first by id on ties."""
    distance = planar_degrees(F.col("latitude"), F.col("longitude"), lat, lon)
    inside = stations.withColumn("distance_degrees", distance).filter(F.col("distance_degrees") <= radius_degrees)
    return inside.groupBy(*groups).agg(
        F.min_by(F.struct("station_id", "distance_degrees"), F.struct("distance_degrees", "station_id")).alias("nearest")
    ).select(*groups, "nearest.*")


def merge_sources(frames: dict[str, DataFrame], how: str = "outer") -> DataFrame:
    """Stack sources by name, or join them on (time, station) with prefixed columns."""
    stamped = {
        name: frame if "source" in frame.columns else frame.withColumn("source", F.lit(name)) for name, frame in frames.items()
    }
    if how == "outer":
        out = None
        for frame in stamped.values():
            out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
        return out
    keys, out = ["obs_time", "station_id"], None
    for name, frame in stamped.items():
        renamed = frame.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in frame.columns if c not in keys])
        out = renamed if out is None else out.join(renamed, keys)
    return out


def attach_to_latest(df: DataFrame, features: DataFrame, station: str, time: str, columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Put per-station feature values on the station's latest row, zero elsewhere.

    ``tie`` orders rows of one time; with it the last one alone is the latest.
    """
    order = [time, *tie]
    newest = df.groupBy(station).agg(F.max(F.struct(*order)).alias("_o")).select(station, "_o.*")
    placed = newest.join(features.select(station, *columns), station, "left")
    joined = df.join(placed, [station, *order], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})
