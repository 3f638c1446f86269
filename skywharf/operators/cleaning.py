"""Masking, deduplication, resampling and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywharf.functions import clock, text
from skywharf.plans.ranks import exact_quantiles
from skywharf.plans.timeline import neighbours, number_rows, over_chunks, time_grid
from skywharf.schema import (
    ARCHIVE_COLUMNS,
    ARCHIVE_LIMITS,
    ARCHIVE_MEASURES,
    ARCHIVE_TIME_COLUMNS,
    BASE_FEATURES,
    CYCLIC_FEATURES,
    FORECAST_FEATURE_DEFAULTS,
    FORECAST_FEATURES,
    OPTIONAL_FEATURES,
    QPE_FEATURES,
    RAIN_AMOUNT_FEATURES,
    RAIN_FEATURE_WORDS,
    SEQUENCE_LIMITS,
    SPATIAL_RAIN_FEATURES,
)

Limits = dict[str, tuple[float, float]]


# --- masking --------------------------------------------------------------


def mask_ranges(df: DataFrame, limits: Limits = ARCHIVE_LIMITS) -> DataFrame:
    """Null out measures outside their inclusive limits."""
    return df.withColumns(
        {name: F.when(F.col(name).between(lo, hi), F.col(name)) for name, (lo, hi) in limits.items() if name in df.columns}
    )


def range_report(df: DataFrame, limits: Limits = ARCHIVE_LIMITS, groups: Sequence[str] = ()) -> DataFrame:
    """Count of out-of-range values per limited column, in one pass, as rows."""
    present = [name for name in limits if name in df.columns]
    counts = df.groupBy(*groups).agg(
        *[
            F.count_if((F.col(n) < limits[n][0]) | (F.col(n) > limits[n][1])).alias(n)
            for n in present
        ]
    )
    return counts.unpivot(list(groups), present, "column_name", "invalid_count")


def deduplicate_fullest(df: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    """One row per key: most non-null values, then the last by ``tie``.

    ``max_by`` combines on the map side, so a key with many copies shrinks
    before the shuffle.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    filled = sum((F.col(c).isNotNull().cast("int") for c in df.columns if c != tie), F.lit(0))
    best = F.max_by(F.struct(*rest), F.struct(filled.alias("n"), F.col(tie).alias("t"))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that sit in duplicate groups and rows a deduplication removes."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_duplicate_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows_removed"),
        F.count(F.lit(1)).alias("row_count_after"),
    )


def keep_last(df: DataFrame, keys: Sequence[str], tie: str | Sequence[str]) -> DataFrame:
    """Last row per key by ``tie``, combined on the map side."""
    keys = list(keys)
    order = [tie] if isinstance(tie, str) else list(tie)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


# --- normalisation --------------------------------------------------------


def archive_time_column(columns: Sequence[str]) -> Column:
    for name in ARCHIVE_TIME_COLUMNS:
        if name in columns:
            return F.col(f"`{name}`")
    if {"Date", "Time"} <= set(columns):
        return F.concat_ws(" ", F.col("Date").cast("string"), F.col("Time").cast("string"))
    raise ValueError("no recognisable time column")


def normalize_archive(df: DataFrame, station_id: str | Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Archive columns to canonical names, typed, masked; rows without a time dropped. ``carry`` names columns to keep as they are."""
    cleaned = df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])
    renamed = cleaned.withColumnsRenamed({c: ARCHIVE_COLUMNS[c] for c in cleaned.columns if c in ARCHIVE_COLUMNS})
    time = archive_time_column(renamed.columns)
    station = (
        station_id if isinstance(station_id, Column)
        else F.lit(station_id) if station_id is not None
        else F.col("station_id")
    )
    measures = [m for m in ARCHIVE_MEASURES if m in renamed.columns]
    typed = renamed.select(
        time.try_cast("timestamp").alias("obs_time"),
        station.cast("string").alias("station_id"),
        *carry,
        *[text.nan_to_null(F.col(m).try_cast("double")).alias(m) for m in measures],
    ).filter(F.col("obs_time").isNotNull())
    return mask_ranges(typed, ARCHIVE_LIMITS)


def preprocess(df: DataFrame, aliases: dict[str, str], id_columns: Sequence[str] = ("station_id", "source"),
               limits: Limits | None = None) -> DataFrame:
    """Rename, parse the time, drop rows without one, make every other column numeric."""
    named = df.withColumnsRenamed({k: v for k, v in aliases.items() if k in df.columns})
    out = named.select(
        F.col("obs_time").try_cast("timestamp").alias("obs_time"),
        *[
            F.col(c) if c in id_columns else F.col(c).try_cast("double").alias(c)
            for c in named.columns if c != "obs_time"
        ],
    ).filter(F.col("obs_time").isNotNull())
    return mask_ranges(out, limits) if limits else out


# --- grid and gaps --------------------------------------------------------


def resample_mean(df: DataFrame, keys: Sequence[str], time: str, measures: Sequence[str], step_minutes: int = 10) -> DataFrame:
    """Mean per grid step, with a row for every step between first and last."""
    keys, step = list(keys), step_minutes * 60
    slot = F.timestamp_seconds((F.floor(F.unix_seconds(F.col(time)) / step) * step).cast("long"))
    means = df.groupBy(*keys, slot.alias(time)).agg(*[F.avg(m).alias(m) for m in measures])
    return time_grid(df, keys, time, step).join(means, [*keys, time], "left")


def interpolate_limited(df: DataFrame, keys: Sequence[str], time: str, limits: dict[str, int]) -> DataFrame:
    """Linear interpolation in time, each gap row at most ``limit`` rows from a value.

    A gap row is filled when it lies within the limit of the previous or of
    the next valid row; beyond the first or last value the nearest one is
    repeated. Adds ``<name>_gap`` for rows that stay empty.
    """
    numbered = number_rows(df, keys, time, position="_pos")
    marks = {
        name: F.when(
            F.col(name).isNotNull(), F.struct(F.col(time).alias("t"), F.col(name).alias("v"), F.col("_pos").alias("p"))
        )
        for name in limits
    }
    around = neighbours(numbered, keys, time, marks, tie=["_pos"])
    out = {}
    for name, limit in limits.items():
        value, before, after = F.col(name), F.col(f"{name}_prev"), F.col(f"{name}_next")
        near = (F.col("_pos") - before["p"] <= limit) | (after["p"] - F.col("_pos") <= limit)
        since = F.col(time).cast("double") - before["t"].cast("double")
        span = after["t"].cast("double") - before["t"].cast("double")
        between = before["v"] + (after["v"] - before["v"]) * since / span
        estimate = F.coalesce(between, before["v"], after["v"])
        filled = F.when(value.isNotNull(), value).when(near, estimate)
        out[name] = filled
        out[f"{name}_gap"] = filled.isNull() & (before.isNotNull() | after.isNotNull())
    kept = [c for c in df.columns if c not in limits]
    return around.select(*kept, *[column.alias(name) for name, column in out.items()])


def fill_limited(df: DataFrame, keys: Sequence[str], time: str, forward: dict[str, int],
                 backward: dict[str, int] | None = None) -> DataFrame:
    """Repeat the last value for at most ``limit`` rows, then optionally the next one."""
    reach = max([*forward.values(), 0])
    reach_back = max([*(backward or {}).values(), 0])

    def ahead(window):
        return {n: F.last(n, ignorenulls=True).over(window.rowsBetween(-lim, 0)) for n, lim in forward.items()}

    def behind(window):
        return {n: F.first(n, ignorenulls=True).over(window.rowsBetween(0, lim)) for n, lim in backward.items()}

    stages = [ahead] + ([behind] if backward else [])
    return over_chunks(df, keys, time, stages, reach_back=reach + reach_back, reach_ahead=reach_back)


def fill_defaults(df: DataFrame, pure_temporal: bool = False) -> DataFrame:
    """Zero rain; add and zero-fill the external rain features unless switched off."""
    cols: dict[str, Column] = {}
    if "precipitation_1hr" in df.columns:
        cols["precipitation_1hr"] = F.coalesce("precipitation_1hr", F.lit(0.0))
        if not pure_temporal:
            for name in SPATIAL_RAIN_FEATURES:
                cols[name] = F.coalesce(F.col(name), F.lit(0.0)) if name in df.columns else F.lit(0.0)
            for name in FORECAST_FEATURES:
                cols[name] = (
                    F.coalesce(F.col(name), F.lit(0.0)) if name in df.columns else F.lit(FORECAST_FEATURE_DEFAULTS[name])
                )
    for name in QPE_FEATURES:
        if name in df.columns:
            cols[name] = F.coalesce(F.col(name), F.lit(0.0))
    return df.withColumns(cols) if cols else df


def valid_ratios(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Share of non-null steps per variable, as rows, with the number of steps."""
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_steps"),
        *[F.round(F.avg(F.col(m).isNotNull().cast("double")), 6).alias(m) for m in measures],
    )
    return wide.unpivot([*keys, "total_steps"], list(measures), "variable", "valid_ratio")


def prepare_grid(df: DataFrame, keys: Sequence[str], time: str, required: Sequence[str], step_minutes: int = 10) -> DataFrame:
    """Masked, resampled, gap-filled station grid with cyclic features and ``invalid``."""
    measures = [c for c in df.columns if c in SEQUENCE_LIMITS or c in BASE_FEATURES]
    grid = resample_mean(mask_ranges(df, SEQUENCE_LIMITS), keys, time, measures, step_minutes)
    hour_steps, half_hour = max(1, 60 // step_minutes), max(1, 30 // step_minutes)
    interpolated = {m: half_hour for m in ("wind_speed", "wind_gust") if m in measures}
    if "tide_level" in measures:
        interpolated["tide_level"] = max(1, 180 // step_minutes)
    grid = interpolate_limited(fill_defaults(grid), keys, time, interpolated)
    forward = {m: hour_steps for m in ("visibility", "wind_direction") if m in measures}
    if forward:
        back = {"wind_direction": hour_steps} if "wind_direction" in measures else None
        grid = fill_limited(grid, keys, time, forward, back)
    at = F.col(time)
    cyclic = {**clock.cyclic_time(at, 365.0, with_minutes=False, month=False), **clock.tidal_phase(at)}
    if "wind_direction" in measures:
        cyclic["wind_dir_sin"] = F.sin(F.radians("wind_direction"))
        cyclic["wind_dir_cos"] = F.cos(F.radians("wind_direction"))
    else:
        cyclic["wind_dir_sin"], cyclic["wind_dir_cos"] = F.lit(0.0), F.lit(1.0)
    grid = mask_ranges(grid.withColumns(cyclic), SEQUENCE_LIMITS)
    gaps = [F.col(f"{m}_gap") for m in interpolated]
    missing = [F.col(m).isNull() for m in required]
    invalid = F.lit(False)
    for flag in [*gaps, *missing]:
        invalid = invalid | flag
    return grid.withColumn("invalid", invalid).drop(*[f"{m}_gap" for m in interpolated])


def feature_completeness(df: DataFrame) -> DataFrame:
    """One row per present sequence feature with its number of nulls."""
    present = [f for f in [*BASE_FEATURES, *OPTIONAL_FEATURES, *QPE_FEATURES, *SPATIAL_RAIN_FEATURES, *FORECAST_FEATURES]
               if f in df.columns]
    counts = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in present])
    return counts.unpivot([], present, "feature", "null_count")


def complete_features(df: DataFrame) -> list[str]:
    """Names of sequence features without a single null, then the cyclic ones. Runs a one-pass job."""
    complete = {row.feature for row in feature_completeness(df).filter("null_count = 0").collect()}
    return [c for c in df.columns if c in complete] + [c for c in CYCLIC_FEATURES if c in df.columns]


# --- scaling and fills ----------------------------------------------------


def train_statistics(df: DataFrame, keys: Sequence[str], features: Sequence[str], is_train: Column) -> DataFrame:
    """Per-key minimum and maximum over training rows only."""
    return df.groupBy(*keys).agg(
        *[F.min(F.when(is_train, F.col(f))).alias(f"{f}_min") for f in features],
        *[F.max(F.when(is_train, F.col(f))).alias(f"{f}_max") for f in features],
    )


def scale_min_max(df: DataFrame, keys: Sequence[str], features: Sequence[str], is_train: Column) -> DataFrame:
    """Scale by training range; a constant column is divided by one. Keeps the range columns."""
    stats = train_statistics(df, keys, features, is_train)
    joined = df.join(stats, list(keys))
    return joined.withColumns({f"{f}_scaled": (F.col(f) - F.col(f"{f}_min")) / _span(f) for f in features})


def unscale(name: str, scaled: Column) -> Column:
    return scaled * _span(name) + F.col(f"{name}_min")


def _span(name: str) -> Column:
    width = F.col(f"{name}_max") - F.col(f"{name}_min")
    return F.when(width == 0, F.lit(1.0)).otherwise(width)


def fill_train_medians(df: DataFrame, keys: Sequence[str], features: Sequence[str], is_train: Column) -> DataFrame:
    """Fill nulls with the exact training median per key, then with zero."""
    long = df.filter(is_train).select(*keys, *features).unpivot(list(keys), list(features), "_feature", "_value")
    medians = (
        exact_quantiles(long, [*keys, "_feature"], "_value", {"_median": 0.5})
        .groupBy(*keys)
        .pivot("_feature", list(features))
        .agg(F.first("_median"))
    )
    renamed = medians.withColumnsRenamed({f: f"{f}_median" for f in features})
    joined = df.join(renamed, list(keys), "left")
    return joined.withColumns(
        {f: F.coalesce(F.col(f), F.col(f"{f}_median"), F.lit(0.0)) for f in features}
    ).drop(*[f"{f}_median" for f in features])


def align_features(df: DataFrame, source_features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Project to a source model's columns; absent rain is 0, anything else 0.5."""
    def column(name: str) -> Column:
        if name in df.columns:
            return F.col(name)
        return F.lit(0.0 if name == "precipitation_1hr" else 0.5).alias(name)

    return df.select(*keep, *[column(name) for name in source_features])


# --- filters and guards ---------------------------------------------------

# Prefixes that must not reach a purely temporal model.
FORBIDDEN_PREFIXES = ("nearby_", "cwa_", "qpe_")


def forbidden(columns: Sequence[str], prefixes: Sequence[str] = FORBIDDEN_PREFIXES) -> list[str]:
    """External features, which a temporal model must not see."""
    return [c for c in columns if c.startswith(tuple(prefixes))]


def refuse_forbidden(columns: Sequence[str], prefixes: Sequence[str] = FORBIDDEN_PREFIXES) -> None:
    """Raise before any job when an external feature reaches a temporal model."""
    bad = forbidden(columns, prefixes)
    if bad:
        raise ValueError(f"forbidden model inputs: {bad}")


def rain_amount_features(columns: Sequence[str]) -> list[str]:
    """Columns on the allow-list of the rain amount model: no same-time wind."""
    return [c for c in columns if c in RAIN_AMOUNT_FEATURES]


def rain_benchmark_features(columns: Sequence[str]) -> list[str]:
    """Rain, time and station-count features without same-time wind or labels."""
    return [
        c for c in columns
        if any(word in c for word in RAIN_FEATURE_WORDS)
        and not c.startswith("target_") and "wind_speed" not in c and "wind_gust" not in c
    ]


def recent(df: DataFrame, as_of: Column, hours: int, time: str = "obs_time") -> DataFrame:
    """Observed rows no older than ``hours`` before ``as_of``."""
    rows = df.filter(F.col(time) >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), F.lit(0)))
    return rows.filter(~F.col("is_forecast")) if "is_forecast" in df.columns else rows


def labelled_rows(df: DataFrame, label: str, event: str | None = None) -> DataFrame:
    """Rows with a label; only event rows if asked for and if there are any."""
    labelled = df.filter(F.col(label).isNotNull())
    if event is None:
        return labelled
    events = labelled.filter(F.col(event) == 1)
    any_event = events.limit(1).select(F.lit(1).alias("_has")).scalar()
    return labelled.filter(any_event.isNull() | (F.col(event) == 1))
