"""Parsing of numbers, key-value strings, clocks, ids; record shaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skywharf.schema import AGENCY_SENTINELS, PANEL_SENTINELS


def number_or_null(text: Column, sentinels=AGENCY_SENTINELS) -> Column:
    """Numeric value of a text, null for sentinels and anything unparsable."""
    value = F.trim(text).try_cast("double")
    return F.when(~text.isin(list(sentinels)) & ~F.isnan(value), value)


def panel_number(text: Column) -> Column:
    stripped = F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")
    return number_or_null(stripped, PANEL_SENTINELS)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def key_values(raw: Column) -> Column:
    """``[WS_AVG]=2.2,WD_AVG=180`` as a map of texts; malformed parts are skipped."""
    parts = F.filter(F.split(raw, ","), lambda p: p.contains("="))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_replace(F.trim(F.substring_index(p, "=", 1)), r"^[\[\]]+|[\[\]]+$", "").alias("key"),
            F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("value"),
        ),
    )
    named = F.filter(pairs, lambda kv: kv["key"] != "")
    # The last of repeated keys wins; sentinel texts become null.
    def value_of(key):
        same_key = F.filter(named, lambda kv: kv["key"] == key)
        text = F.element_at(same_key, -1)["value"]
        return F.when(~text.isin(PANEL_SENTINELS), text)

    keys = F.array_distinct(F.transform(named, lambda kv: kv["key"]))
    return F.map_from_arrays(keys, F.transform(keys, value_of))


# Timestamp formats tried in turn when a text is not ISO.
FALLBACK_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm"]


def local_time(text: Column, zone: str = "Asia/Taipei") -> Column:
    """ISO or fallback-format text as an instant; texts without a zone are local.

    The result is independent of the session zone: zone-less texts are read
    as wall-clock time and placed in ``zone``.
    """
    trimmed = F.trim(text)
    zoned = trimmed.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    wall = F.coalesce(
        F.when(~zoned, trimmed.try_cast("timestamp_ntz")),
        *[F.try_to_timestamp(F.when(~zoned, trimmed), F.lit(fmt)).cast("timestamp_ntz") for fmt in FALLBACK_FORMATS],
    )
    return F.coalesce(
        F.when(zoned, trimmed.try_cast("timestamp")),
        F.convert_timezone(F.lit(zone), F.current_timezone(), wall).cast("timestamp"),
    )


def meridiem_time(text: Column) -> Column:
    """``2026/6/30 下午 08:35:00`` as zone-less wall-clock time."""
    pattern = r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})\s*(上午|下午)?\s*(\d{1,2}):(\d{2}):(\d{2})$[\s\S]*"
    trimmed = F.trim(text)
    # The T tells a text that matched from one that did not.
    plain = F.regexp_replace(trimmed, pattern, "$1-$2-$3T$5:$6:$7")
    clock = F.when(plain != trimmed, plain.try_cast("timestamp_ntz"))
    return (
        F.when(trimmed.contains("下午") & (F.hour(clock) < 12), clock + F.expr("interval 12 hours"))
        .when(trimmed.contains("上午") & (F.hour(clock) == 12), clock - F.expr("interval 12 hours"))
        .otherwise(clock)
    )


def record_id(source: Column, device: Column, station: Column, is_forecast: Column, observed_at: Column) -> Column:
    kind = F.when(is_forecast, "forecast").otherwise("observed")
    return F.concat_ws(":", source, device, station, kind, observed_at)


def redact_authorization(url: Column) -> Column:
    """Hide the first ``Authorization`` value of a URL."""
    return F.regexp_replace(url, r"^(.*?Authorization=)[^&]*", "$1***")


def canonical_id(raw: Column, known_ids: list[str]) -> Column:
    """First known id the raw reference starts with."""
    return F.coalesce(*[F.when(raw.startswith(k), F.lit(k)) for k in known_ids])


# Conversion factors to m/s.
KNOT_MPS, KMH_DIVISOR = 0.514444, 3.6
KNOT_UNITS, KMH_UNITS = ["knot", "knots", "kt"], ["km/h", "kmh", "kph"]


def speed_mps(value: Column, unit: Column) -> Column:
    unit = F.lower(F.coalesce(unit, F.lit("m/s")))
    converted = (
        F.when(unit.isin(KNOT_UNITS), value * KNOT_MPS)
        .when(unit.isin(KMH_UNITS), value / KMH_DIVISOR)
        .otherwise(value)
    )
    return F.round(converted, 6)


def speed_was_converted(value: Column, unit: Column) -> Column:
    return F.coalesce(value.isNotNull() & F.lower(unit).isin(KNOT_UNITS + KMH_UNITS), F.lit(False))


def length_in(value: Column, unit: Column, target: str) -> Column:
    """Length in cm (tide) or m (wave) from the other of the two units."""
    unit = F.lower(F.coalesce(unit, F.lit(target)))
    if target == "cm":
        return F.round(F.when(unit == "m", value * 100).otherwise(value), 6)
    return F.round(F.when(unit == "cm", value / 100).otherwise(value), 6)


def canonical_record(c) -> Column:
    """Nested record with unit-suffixed metric names. ``c(name)`` yields a column."""
    return F.struct(
        record_id(c("source"), c("device_type"), c("station_id"), c("is_forecast"), c("observed_at")).alias("record_id"),
        c("source").alias("source"),
        c("device_type").alias("device_type"),
        F.struct(c("station_id").alias("station_id"), c("station_name").alias("station_name"),
                 c("location").alias("location"), c("port_code").alias("port_code"),
                 c("longitude").alias("longitude"), c("latitude").alias("latitude"),
                 c("elevation").alias("elevation")).alias("station"),
        F.struct(c("observed_at").alias("observed_at"), c("fetched_at").alias("fetched_at")).alias("time"),
        F.struct(*[c(name).alias(f"{name}{unit}") for name, unit in METRIC_UNITS.items()]).alias("metrics"),
        F.struct(c("is_forecast").alias("is_forecast"), c("confidence").alias("confidence"),
                 c("stale").alias("stale_at_fetch")).alias("quality"),
    )


# Unit suffix of each metric in the canonical record.
METRIC_UNITS = {
    "wind_speed": "_mps",
    "wind_gust": "_mps",
    "wind_direction": "_deg",
    "wind_gust_direction": "_deg",
    "precipitation_10min": "_mm",
    "precipitation_1hr": "_mm",
    "precipitation_24hr": "_mm",
    "air_temperature": "_c",
    "relative_humidity": "_percent",
    "air_pressure": "_hpa",
    "visibility": "_m",
    "tide_level": "",
    "tide_level_unit": "",
    "wave_height": "_m",
    "wave_period": "_s",
    "wave_max_height": "_m",
    "current_speed": "_mps",
    "current_direction": "_deg",
}
