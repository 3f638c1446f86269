"""Wind vectors, Beaufort numbers and operational levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skywharf.plans.dims import lookup
from skywharf.schema import (
    BEAUFORT_LOWER,
    BEAUFORT_NAMES,
    GUST_BUFFER_MPS,
    LEVEL_RANK,
    OPERATION_LABELS,
    WIND_GUST_THRESHOLDS,
    WIND_SPEED_THRESHOLDS,
)


def wind_u(speed: Column, direction: Column) -> Column:
    return -speed * F.sin(F.radians(direction))


def wind_v(speed: Column, direction: Column) -> Column:
    return -speed * F.cos(F.radians(direction))


def wrap_angle(delta: Column) -> Column:
    """Signed angle in [-180, 180), by floor modulo."""
    shifted = delta + F.lit(180.0)
    return shifted - F.lit(360.0) * F.floor(shifted / F.lit(360.0)) - F.lit(180.0)


def beaufort(speed: Column) -> Column:
    """Beaufort number 0..12; negative speeds count as calm."""
    clamped = F.greatest(F.lit(0.0), speed)
    steps = sum((F.when(clamped >= lower, 1).otherwise(0) for lower in BEAUFORT_LOWER[1:]), F.lit(0))
    return F.when(speed.isNotNull(), steps)


def beaufort_name(number: Column) -> Column:
    return lookup(dict(enumerate(BEAUFORT_NAMES)), number)


def beaufort_from_text(text: Column) -> Column:
    """Smallest number in texts such as ``>=6``, ``4-5`` or ``5級``."""
    compact = F.regexp_replace(text, "[級 ]", "")
    first = F.regexp_extract(compact, r"^>?=?([^-~～–—]*)", 1)
    digits = F.regexp_replace(first, "[^0-9]", "")
    return F.when(digits != "", digits.try_cast("int"))


def level_from_beaufort(number: Column) -> Column:
    return (
        F.when(number >= 8, "stop")
        .when(number >= 7, "high_risk")
        .when(number >= 6, "warning")
        .when(number >= 5, "watch")
        .when(number.isNotNull(), "normal")
    )


def level_by_thresholds(value: Column, thresholds: dict[str, float]) -> Column:
    """Strongest level whose threshold is reached; null value gives null."""
    ordered = sorted(thresholds.items(), key=lambda kv: LEVEL_RANK[kv[0]], reverse=True)
    out = F.when(value.isNotNull(), "normal")
    for name, limit in reversed(ordered):
        out = F.when(value >= limit, F.lit(name)).otherwise(out)
    return out


def wind_speed_level(speed: Column, thresholds: dict[str, float] | None = None) -> Column:
    return level_by_thresholds(speed, {**WIND_SPEED_THRESHOLDS, **(thresholds or {})})


def wind_gust_level(gust: Column, thresholds: dict[str, float] | None = None, buffer: float = GUST_BUFFER_MPS) -> Column:
    return level_by_thresholds(gust + F.lit(float(buffer)), {**WIND_GUST_THRESHOLDS, **(thresholds or {})})


def speed_operation(speed: Column) -> Column:
    level = wind_speed_level(speed)
    return F.struct(
        level.alias("operation_level"),
        lookup(OPERATION_LABELS, level).alias("operation_label"),
        F.lit("wind_speed_mps").alias("threshold_basis"),
        beaufort(speed).alias("beaufort"),
        beaufort_name(beaufort(speed)).alias("beaufort_label"),
    )


def gust_operation(gust: Column, buffer: float = GUST_BUFFER_MPS) -> Column:
    buffered, plain = wind_gust_level(gust, buffer=buffer), wind_gust_level(gust, buffer=0.0)
    return F.struct(
        buffered.alias("operation_level"),
        lookup(OPERATION_LABELS, buffered).alias("operation_label"),
        F.lit("wind_gust_mps").alias("threshold_basis"),
        (buffered != plain).alias("buffer_applied"),
        F.lit(float(buffer)).alias("buffer_mps"),
        plain.alias("original_level_without_buffer"),
        beaufort(gust).alias("beaufort"),
    )


def level_rank(level: Column) -> Column:
    """0 for normal up to 4 for stop; null for anything that is not a level."""
    return lookup(LEVEL_RANK, level)


def strongest(*levels: Column) -> Column:
    """Highest level among the given ones; unknown and null levels are ignored."""
    best = F.greatest(*[F.coalesce(level_rank(x), F.lit(-1)) for x in levels], F.lit(0))
    return lookup({rank: name for name, rank in LEVEL_RANK.items()}, best)
