"""Rain, humidity and visibility expressions, and prediction clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skywharf.functions.wind import level_by_thresholds
from skywharf.schema import (
    RAIN_AMOUNT_LABELS,
    RAIN_AMOUNT_THRESHOLDS,
    RAIN_PROBABILITY_THRESHOLDS,
    RAIN_WARNING_THRESHOLDS,
)

# Magnus coefficients.
MAGNUS_A, MAGNUS_B = 17.625, 243.04


def clip(value: Column, low: float, high: float) -> Column:
    bounded = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    return F.when(value.isNotNull(), bounded)


def dew_point(temperature: Column, humidity: Column) -> Column:
    gamma = F.log(clip(humidity, 1e-6, 100.0) / 100.0) + MAGNUS_A * temperature / (MAGNUS_B + temperature)
    return MAGNUS_B * gamma / (MAGNUS_A - gamma)


def rain_probability_level(probability: Column) -> Column:
    return level_by_thresholds(clip(probability, 0.0, 1.0), RAIN_PROBABILITY_THRESHOLDS)


def rain_warning_level(probability: Column) -> Column:
    return level_by_thresholds(probability, RAIN_WARNING_THRESHOLDS)


def rain_amount_level(amount: Column, hours: float) -> Column:
    """Amount class over a 1 h or 3 h window; longer windows are not classified."""
    label, limit = RAIN_AMOUNT_LABELS, RAIN_AMOUNT_THRESHOLDS
    if hours > 3:
        return F.when(amount.isNotNull(), label["over"])
    out = (
        F.when(amount >= limit["heavy_1hr"], label["heavy"])
        .when(amount >= limit["light"], label["light"])
        .when(amount.isNotNull(), label["none"])
    )
    if hours >= 3:
        out = (
            F.when(amount >= limit["severe_torrential_3hr"], label["severe"])
            .when(amount >= limit["torrential_3hr"], label["torrential"])
            .otherwise(out)
        )
    return out


# Label shown for a probability level, and visibility grades (m).
PROBABILITY_LABELS = {"normal": "無", "watch": "小雨", "warning": "大雨", "high_risk": "豪雨", "stop": "超大豪雨"}
VISIBILITY_GRADES = {"excellent": 10000, "good": 5000, "moderate": 1000, "poor": 500}


def visibility_grade(metres: Column) -> Column:
    out = F.when(metres.isNotNull(), "very_poor")
    for name, limit in sorted(VISIBILITY_GRADES.items(), key=lambda kv: kv[1]):
        out = F.when(metres >= limit, F.lit(name)).otherwise(out)
    return out


def clipped_predictions(rain: Column, wind: Column, gust: Column, visibility: Column, small_rain: float | None = None) -> dict[str, Column]:
    """Physical bounds on model output; a gust is never below the wind speed."""
    rain_out = clip(rain, 0.0, 200.0)
    if small_rain is not None:
        rain_out = F.when(rain_out < small_rain, F.lit(0.0)).otherwise(rain_out)
    wind_out = clip(wind, 0.0, 50.0)
    visibility_out = clip(visibility, 0.0, 30000.0)
    return {
        "rain_clipped": rain_out,
        "wind_clipped": wind_out,
        "gust_clipped": F.greatest(clip(gust, 0.0, 60.0), wind_out),
        "visibility_clipped": visibility_out,
        "visibility_grade": visibility_grade(visibility_out),
    }


def saturation_ratio(spread: Column) -> Column:
    return F.exp(F.lit(-0.06) * spread)


def pop_quality(raw: Column) -> Column:
    """Parse a rain probability text into value and two status codes.

    Null is "not_available", empty text "missing_field". 0..1 is a
    probability (so 1 means certain), above 1 up to 100 a percentage.
    """
    number = F.trim(F.regexp_replace(F.trim(raw), "%$", "")).try_cast("double")
    number = F.when(~F.isnan(number), number)
    status = (
        F.when(raw.isNull(), "not_available")
        .when(raw == "", "missing_field")
        .when(number.isNull(), "parse_error")
        .when((number < 0) | (number > 100), "out_of_range")
        .otherwise("ok")
    )
    value = F.when(status == "ok", F.when(number <= 1, number).otherwise(number / 100.0))
    return F.struct(
        (status == "ok").alias("available"),
        value.alias("normalized_value"),
        status.alias("parse_status"),
        F.when(status == "ok", "valid").otherwise("invalid").alias("quality_status"),
    )
