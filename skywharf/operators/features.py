"""Lag, rolling, change and physical features over station or area timelines.

A ``Feature`` lists window expressions by depth (depth 1 may use columns of
depth 0) and how many earlier rows they reach. ``apply_features`` evaluates
any number of features in one ordered pass over skew-safe chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skywharf.functions import clock, wind
from skywharf.functions.weather import saturation_ratio
from skywharf.plans.ranks import counted_quantiles
from skywharf.plans.timeline import CHUNK_ROWS, HOUR, MOST_ROWS, Stage, cell_of, fitting_cell, over_chunks
from skywharf.session import cut_lineage

DEFAULT_STEPS_PER_HOUR = 2


@dataclass(frozen=True)
class Feature:
    depths: tuple[Stage, ...]
    reach: int


def step_count(hours: float, steps_per_hour: int) -> int:
    """Rows that make up a number of hours: half-even rounding, at least one."""
    return max(1, int(round(float(hours) * steps_per_hour)))


def hour_label(hours: float) -> str:
    return f"{hours:g}h"


def gap_counts(df: DataFrame, keys: Sequence[str], time: str) -> tuple[DataFrame, DataFrame]:
    """Counted gaps between the rows of a key (keys, ``_gap`` in minutes, ``_gaps``), and the rows of its hours (``_rows``).

    Gaps inside an hour and gaps between an hour's last row and the next one's first are counted apart, so no row gets a
    position for it; counts are combined before they are shuffled.
    """
    rows = df.select(*keys, F.unix_micros(time).alias("_us"), cell_of(time, HOUR).alias("_cell")).filter(F.col("_us").isNotNull())
    step = F.col("_us") - F.lag("_us").over(Window.partitionBy(*keys, "_cell").orderBy("_us"))
    inside = rows.select(*keys, step.alias("_us")).groupBy(*keys, "_us").agg(F.count(F.lit(1)).alias("_gaps"))
    hours = rows.groupBy(*keys, "_cell").agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"), F.count(F.lit(1)).alias("_rows"))
    across = F.col("_lo") - F.lag("_hi").over(Window.partitionBy(*keys).orderBy("_cell"))
    between = hours.select(*keys, across.alias("_us")).groupBy(*keys, "_us").agg(F.count(F.lit(1)).alias("_gaps"))
    both = inside.unionByName(between).filter(F.col("_us").isNotNull()).groupBy(*keys, "_us").agg(F.sum("_gaps").alias("_gaps"))
    return both.select(*keys, (F.col("_us") / 60e6).alias("_gap"), "_gaps"), hours


def steps_per_hour(df: DataFrame, keys: Sequence[str], time: str, default: int = DEFAULT_STEPS_PER_HOUR) -> DataFrame:
    """Rows per hour of each key, from the exact median gap between its rows."""
    return _shape(df, keys, time, default).drop("_fullest")


def _shape(df: DataFrame, keys: Sequence[str], time: str, default: int = DEFAULT_STEPS_PER_HOUR) -> DataFrame:
    """``steps_per_hour`` with ``_fullest``, the rows of the key's fullest hour."""
    gaps, hours = gap_counts(df, keys, time)
    medians = counted_quantiles(gaps, keys, "_gap", "_gaps", {"median_gap_minutes": 0.5})
    per_hour = F.greatest(F.lit(1), F.bround(60.0 / F.col("median_gap_minutes"), 0).cast("int"))
    inferred = F.when(F.col("median_gap_minutes") > 0, per_hour).otherwise(default)
    counted = hours.groupBy(*keys).agg(F.max("_rows").alias("_fullest"))
    return counted.join(medians.withColumn("steps_per_hour", inferred), list(keys), "left").withColumn(
        "steps_per_hour", F.coalesce("steps_per_hour", F.lit(default))
    )


def apply_features(df: DataFrame, keys: Sequence[str], time: str, features: Sequence[Feature], tie: Sequence[str] = (),
                   chunk_rows: int = CHUNK_ROWS, cell_seconds: int = HOUR) -> DataFrame:
    """Add the columns of all features; their depths are merged into shared passes."""
    depth = max(len(f.depths) for f in features)

    def merged(level: int) -> Stage:
        def stage(window):
            out: dict[str, Column] = {}
            for feature in features:
                if level < len(feature.depths):
                    out |= feature.depths[level](window)
            return out

        return stage

    return over_chunks(df, keys, time, [merged(i) for i in range(depth)], reach_back=max(f.reach for f in features),
                       tie=tie, chunk_rows=chunk_rows, cell_seconds=cell_seconds)


def hourly_features(df: DataFrame, keys: Sequence[str], time: str, build: Callable[[int], Sequence[Feature]], tie: Sequence[str] = (),
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Features named by hours, with the rows per hour that each key's own gaps show.

    The rows are stored once; one job over their keys and times gives the rates and how full an hour is. Only the distinct
    rates reach the driver: whole numbers, one for each kind of feed. Keys of one rate share a pass. Cells are as narrow
    as the fullest one needs.
    """
    stored = cut_lineage(df)
    rates = cut_lineage(_shape(stored, keys, time).select(*keys, "steps_per_hour", "_fullest"))
    shape = rates.groupBy("steps_per_hour").agg(F.max("_fullest").alias("rows")).collect()
    found = sorted(row["steps_per_hour"] for row in shape) or [DEFAULT_STEPS_PER_HOUR]
    crowded = max((row["rows"] for row in shape), default=0) > MOST_ROWS
    cell_seconds = fitting_cell(stored, keys, time) if crowded else HOUR
    parts = []
    for steps in found:
        own = stored.join(rates.where(F.col("steps_per_hour") == steps), list(keys), "left_semi") if len(found) > 1 else stored
        parts.append(apply_features(own, keys, time, build(steps), tie, chunk_rows, cell_seconds))
    return reduce(DataFrame.unionByName, parts)


# --- generic features -----------------------------------------------------


def lags(variables: Sequence[str], hours: Sequence[float] = (0.5, 1, 2, 3, 6), steps: int = DEFAULT_STEPS_PER_HOUR) -> Feature:
    counts = {h: step_count(h, steps) for h in hours}

    def stage(w):
        return {f"{v}_lag_{hour_label(h)}": F.lag(v, n).over(w) for v in variables for h, n in counts.items()}

    return Feature((stage,), max(counts.values()))


ROLLING = {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_pop, "sum": F.sum}


def rolling(variables: Sequence[str], windows: dict[str, float] | None = None, statistics: Sequence[str] = tuple(ROLLING),
            steps: int = DEFAULT_STEPS_PER_HOUR) -> Feature:
    """Statistics over the last rows, current one included; one valid row suffices."""
    counts = {name: step_count(h, steps) for name, h in (windows or {"1h": 1, "3h": 3, "6h": 6}).items()}

    def stage(w):
        return {
            f"{v}_roll_{name}_{s}": ROLLING[s](v).over(w.rowsBetween(-(n - 1), 0))
            for v in variables for name, n in counts.items() for s in statistics
        }

    return Feature((stage,), max(counts.values()) - 1)


def _slope(variable: str, rows: int, w) -> Column:
    """Least-squares slope per row; needs a full frame of values."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(variable).over(frame) == rows, F.regr_slope(F.col(variable), F.col("_rn")).over(frame))


def changes(variables: Sequence[str], hours: Sequence[float] = (0.5, 1, 3, 6), trend_hours: float = 3, steps: int = DEFAULT_STEPS_PER_HOUR) -> Feature:
    counts, trend = {h: step_count(h, steps) for h in hours}, step_count(trend_hours, steps)

    def stage(w):
        out = {f"{v}_change_{hour_label(h)}": F.col(v) - F.lag(v, n).over(w) for v in variables for h, n in counts.items()}
        return out | {f"{v}_trend_{hour_label(trend_hours)}": _slope(v, trend, w) for v in variables}

    return Feature((stage,), max(*counts.values(), trend - 1))


# --- physical features ----------------------------------------------------

ANOMALY_HOURS = 24 * 30


def pressure_features(column: str = "pressure", steps: int = DEFAULT_STEPS_PER_HOUR) -> Feature:
    """Changes, trend, acceleration, and the anomaly against a 30-day row mean."""
    hour, month = step_count(1, steps), step_count(ANOMALY_HOURS, steps)

    def first(w):
        out = {f"pressure_change_{hour_label(h)}": F.col(column) - F.lag(column, step_count(h, steps)).over(w) for h in (0.5, 1, 3, 6)}
        out["pressure_current"] = F.col(column)
        out["pressure_trend_3h"] = _slope(column, step_count(3, steps), w)
        out["pressure_anomaly"] = F.col(column) - F.avg(column).over(w.rowsBetween(-(month - 1), 0))
        return out

    def second(w):
        return {"pressure_acceleration_1h": F.col("pressure_change_1h") - F.lag("pressure_change_1h", hour).over(w)}

    return Feature((first, second), max(month - 1, step_count(6, steps), 2 * hour))


def dewpoint_features(temperature: str = "temperature", dewpoint: str = "dewpoint", steps: int = DEFAULT_STEPS_PER_HOUR) -> Feature:
    hour = step_count(1, steps)
    spread = F.col(temperature) - F.col(dewpoint)

    def stage(w):
        out = {
            "temperature_current": F.col(temperature),
            "dewpoint_current": F.col(dewpoint),
            "temp_dewpoint_diff": spread,
            "temp_change_1h": F.col(temperature) - F.lag(temperature, hour).over(w),
            "dewpoint_change_1h": F.col(dewpoint) - F.lag(dewpoint, hour).over(w),
            "saturation_ratio": saturation_ratio(spread),
        }
        return out | {f"temp_dewpoint_diff_lag_{hour_label(h)}": F.lag(spread, step_count(h, steps)).over(w) for h in (1, 2, 6)}

    return Feature((stage,), step_count(6, steps))


HIGH_HUMIDITY = 85


def humidity_features(column: str = "humidity", steps: int = DEFAULT_STEPS_PER_HOUR) -> Feature:
    one, three, six = (step_count(h, steps) for h in (1, 3, 6))

    def stage(w):
        humid = F.when(F.col(column) > HIGH_HUMIDITY, 1).otherwise(0)
        return {
            "humidity_current": F.col(column),
            "humidity_change_1h": F.col(column) - F.lag(column, one).over(w),
            "humidity_change_3h": F.col(column) - F.lag(column, three).over(w),
            "humidity_roll_3h_mean": F.avg(column).over(w.rowsBetween(-(three - 1), 0)),
            "high_humidity_hours": F.sum(humid).over(w.rowsBetween(-(six - 1), 0)) / F.lit(steps),
        }

    return Feature((stage,), max(three, six - 1))


def wind_features(speed: str = "wind_speed", direction: str = "wind_direction", steps: int = DEFAULT_STEPS_PER_HOUR) -> Feature:
    one, three = step_count(1, steps), step_count(3, steps)
    u, v = wind.wind_u(F.col(speed), F.col(direction)), wind.wind_v(F.col(speed), F.col(direction))

    def stage(w):
        out = {
            "wind_u": u,
            "wind_v": v,
            "wind_speed_change_1h": F.col(speed) - F.lag(speed, one).over(w),
            "wind_direction_change_1h": wind.wrap_angle(F.col(direction) - F.lag(direction, one).over(w)),
            "wind_speed_std_1h": F.stddev_pop(speed).over(w.rowsBetween(-(one - 1), 0)),
            "wind_speed_std_3h": F.stddev_pop(speed).over(w.rowsBetween(-(three - 1), 0)),
        }
        for h in (1, 2, 6):
            n = step_count(h, steps)
            out[f"wind_u_lag_{hour_label(h)}"] = F.lag(u, n).over(w)
            out[f"wind_v_lag_{hour_label(h)}"] = F.lag(v, n).over(w)
        return out

    return Feature((stage,), step_count(6, steps))


def interactions(columns: Sequence[str]) -> dict[str, Column]:
    """Products and ratios whose inputs are present."""
    have, out = set(columns), {}
    if {"pressure_change_3h", "humidity"} <= have:
        out["pressure_humidity_interaction"] = F.col("pressure_change_3h") * F.col("humidity") / 100
    if {"temp_dewpoint_diff", "wind_speed"} <= have:
        out["dewpoint_wind_interaction"] = F.col("temp_dewpoint_diff") / (F.col("wind_speed") + 0.1)
    if {"pressure_change_1h", "temp_change_1h"} <= have:
        out["pressure_temp_interaction"] = F.col("pressure_change_1h") * F.col("temp_change_1h")
    return out


# --- area features --------------------------------------------------------

# Area columns that get a one-row lag and a three-row mean.
AREA_LAGGED = [
    "nearby_cwa_wind_speed_max",
    "nearby_cwa_wind_gust_max",
    "nearby_cwa_precipitation_1hr_max",
    "nearby_cwa_pressure_mean",
    "upstream_subset_wind_speed_max",
    "upstream_subset_wind_gust_max",
    "upstream_subset_precipitation_1hr_max",
]
RAIN_ROLLS = {
    "nearby_cwa_precipitation_1hr_max": "nearby_cwa_precipitation",
    "upstream_subset_precipitation_1hr_max": "upstream_subset_precipitation",
}
PRESSURE_TREND = "nearby_cwa_pressure_mean"
# Harbour columns with their lags, and those with a three-row mean.
PORT_LAGS = {"khwd_wind_speed_mean": [1, 2], "khwd_wind_speed_max": [1], "khwd_wind_gust_max": [1, 2]}
PORT_ROLLS = ["khwd_wind_speed_mean", "khwd_wind_speed_max", "khwd_wind_gust_mean", "khwd_wind_gust_max"]


def area_lag_roll(columns: Sequence[str]) -> Feature:
    """Row lags and means of the area series, for the columns that are present."""
    present = [c for c in AREA_LAGGED if c in columns]

    def stage(w):
        def mean(c, rows):
            return F.avg(c).over(w.rowsBetween(-(rows - 1), 0))

        out = {f"{c}_lag1": F.lag(c).over(w) for c in present} | {f"{c}_roll3": mean(c, 3) for c in present}
        for c in present:
            if c in RAIN_ROLLS:
                out |= {f"{RAIN_ROLLS[c]}_roll{n}": mean(c, n) for n in (3, 6)}
        if PRESSURE_TREND in present:
            out[f"{PRESSURE_TREND}_trend_3h"] = F.col(PRESSURE_TREND) - F.lag(PRESSURE_TREND, 3).over(w)
        return out

    return Feature((stage,), 5)


def port_lag_roll(columns: Sequence[str]) -> Feature:
    def stage(w):
        out = {f"{c}_lag{n}": F.lag(c, n).over(w) for c, ns in PORT_LAGS.items() if c in columns for n in ns}
        return out | {f"{c}_roll3": F.avg(c).over(w.rowsBetween(-2, 0)) for c in PORT_ROLLS if c in columns}

    return Feature((stage,), 2)


# --- pipeline and selection -----------------------------------------------


def feature_pipeline(df: DataFrame, keys: Sequence[str], time: str, variables: Sequence[str], pressure: str | None = None,
                     tie: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Lags, rolls, changes, cycles, periods, pressure and interactions in one pass for each rate of rows."""

    def parts(steps: int) -> list[Feature]:
        generic = [lags(variables, steps=steps), rolling(variables, steps=steps), changes(variables, steps=steps)]
        return generic + ([pressure_features(pressure, steps)] if pressure else [])

    out = hourly_features(df, keys, time, parts, tie, chunk_rows)
    at = F.col(time)
    out = out.withColumns({**clock.cyclic_time(at), **clock.special_periods(at)})
    products = interactions(out.columns)
    return out.withColumns(products) if products else out


def correlations(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every column pair on pairwise complete rows, as rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    stats = df.groupBy(*groups).agg(
        *[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"{a}|{b}") for a, b in pairs]
    )
    long = stats.unpivot(list(groups), [f"{a}|{b}" for a, b in pairs], "pair", "correlation")
    parts = F.split("pair", r"\|")
    return long.select(*groups, parts[0].alias("column_a"), parts[1].alias("column_b"), "correlation")


def drop_correlated(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Columns that stay: none of the earlier columns correlates above the threshold."""
    high = correlations(df, columns).groupBy("column_b").agg(
        F.max(F.abs("correlation")).alias("strongest_earlier_correlation")
    )
    return high.select(
        F.col("column_b").alias("feature"), "strongest_earlier_correlation",
        (F.coalesce("strongest_earlier_correlation", F.lit(0.0)) <= threshold).alias("kept"),
    )


def select_by_importance(importance: DataFrame, threshold: float = 0.001) -> DataFrame:
    return importance.filter(F.col("importance") >= threshold)


def select_by_cumulative(importance: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Features within the cumulative share; the strongest one if none qualifies."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.orderBy("cumulative_importance", "feature"))
    any_inside = F.max((F.col("cumulative_importance") <= threshold).cast("int")).over(Window.partitionBy())
    tagged = importance.withColumns({"_place": first, "_any": any_inside})
    return tagged.filter(
        (F.col("cumulative_importance") <= threshold) | ((F.col("_any") == 0) & (F.col("_place") == 1))
    ).drop("_place", "_any")
