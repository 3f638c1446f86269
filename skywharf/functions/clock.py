"""Calendar, season and freshness expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skywharf.schema import OUTAGE_AFTER_MINUTES, SEASON_CODES, SEASON_MONTHS

TWO_PI = 2.0 * math.pi


def cycle(position: Column, period: float, prefix: str) -> dict[str, Column]:
    """Sine and cosine of a position on a cycle of the given length."""
    angle = F.lit(TWO_PI) * position / F.lit(float(period))
    return {f"{prefix}_sin": F.sin(angle), f"{prefix}_cos": F.cos(angle)}


def hour_of_day(time: Column, with_minutes: bool = True) -> Column:
    hour = F.hour(time).cast("double")
    return hour + F.minute(time) / F.lit(60.0) if with_minutes else hour


def cyclic_time(time: Column, year_days: float = 365.0, with_minutes: bool = True, month: bool = True) -> dict[str, Column]:
    """Hour, day-of-year and (optionally) month cycles.

    The feature builder and the sequence path use 365 days, the area datasets
    366; the sequence path also ignores minutes.
    """
    out = cycle(hour_of_day(time, with_minutes), 24.0, "hour")
    out |= cycle(F.dayofyear(time).cast("double"), year_days, "doy")
    if month:
        out |= cycle(F.month(time).cast("double"), 12.0, "month")
    return out


def tidal_phase(time: Column) -> dict[str, Column]:
    """Phase of a 745-minute tide counted from midnight."""
    return cycle((F.hour(time) * 60 + F.minute(time)).cast("double"), 745.0, "tide")


def special_periods(time: Column) -> dict[str, Column]:
    hour, month = F.hour(time), F.month(time)
    return {
        "is_night": ((hour >= 18) | (hour < 6)).cast("int"),
        "is_dawn": hour.between(4, 7).cast("int"),
        "is_afternoon": hour.between(13, 16).cast("int"),
        "is_typhoon_season": month.between(5, 11).cast("int"),
    }


def season(time: Column, typhoon_months: list[int] | None = None, months: dict | None = None) -> Column:
    """Season name; configured typhoon months win over the calendar season."""
    month = F.month(time)
    out = F.lit(None).cast("string")
    for name, members in reversed(list((months or SEASON_MONTHS).items())):
        if members:
            out = F.when(month.isin(members), F.lit(name)).otherwise(out)
    if typhoon_months:
        out = F.when(month.isin(list(typhoon_months)), F.lit("typhoon")).otherwise(out)
    return out


def season_code(name: Column) -> Column:
    out = F.lit(None).cast("double")
    for key, code in SEASON_CODES.items():
        out = F.when(name == key, F.lit(code)).otherwise(out)
    return out


def age_minutes(time: Column, as_of: Column) -> Column:
    """Whole minutes since ``time``, never negative; null stays null."""
    gap = F.floor((as_of.cast("double") - time.cast("double")) / 60.0)
    return F.when(time.isNotNull(), F.greatest(F.lit(0), gap).cast("long"))


def status_level(age: Column, threshold: Column) -> Column:
    return (
        F.when(age.isNull(), "stale")
        .when(age > OUTAGE_AFTER_MINUTES, "outage")
        .when(age > threshold, "stale")
        .otherwise("current")
    )


def source_is_stale(resolved_at: Column, as_of: Column, limit_hours: float = 3.0) -> Column:
    """True when a resolved forecast is undated or older than the limit."""
    age_seconds = as_of.cast("double") - resolved_at.cast("double")
    return F.coalesce(age_seconds > limit_hours * 3600.0, F.lit(True))


# Hours of the day at which forecasts are released, and the release interval.
RELEASE_HOURS = [5.5, 11.5, 17.5, 23.5]
RELEASE_INTERVAL_HOURS = 6.0


def forecast_age(time: Column) -> Column:
    """Hours since the last forecast release over the release interval, within 0..1."""
    now = F.hour(time) + F.minute(time) / 60.0
    released = F.array_max(F.filter(F.array(*[F.lit(h) for h in RELEASE_HOURS]), lambda h: h <= now))
    since = F.when(released.isNotNull(), now - released).otherwise(now + 24.0 - RELEASE_HOURS[-1])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), since / RELEASE_INTERVAL_HOURS))


def day_pieces(start: Column, end: Column) -> Column:
    """Array of (start, end) pieces of a span, cut at midnights."""
    days = F.sequence(F.to_date(start), F.to_date(end), F.expr("interval 1 day"))
    return F.transform(
        days,
        lambda d: F.struct(
            F.greatest(start, d.cast("timestamp")).alias("piece_start"),
            F.least(end, F.date_add(d, 1).cast("timestamp") - F.expr("interval 1 second")).alias("piece_end"),
        ),
    )
