"""Labels, sequence windows and chronological splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywharf.functions import wind
from skywharf.operators.joins import nearest_labels
from skywharf.plans.timeline import CHUNK_ROWS, number_rows, over_chunks
from skywharf.schema import HORIZONS

RAIN_EVENT_MM, HEAVY_RAIN_MM = 0.5, 10.0


def area_labels(area: DataFrame, keys: Sequence[str], time: str = "obs_time", horizons: dict[str, int] = HORIZONS,
                tolerance_minutes: float = 30.0, strict_future: bool = False) -> DataFrame:
    """Wind, gust and rain labels of the nearest row to each horizon."""
    speed, gust, rain = "nearby_cwa_wind_speed_max", "nearby_cwa_wind_gust_max", "nearby_cwa_precipitation_1hr_max"
    out = nearest_labels(area, keys, time, [speed, gust, rain], horizons, tolerance_minutes, strict_future)
    labels: dict[str, Column] = {}
    for h in horizons:
        amount = F.col(f"{rain}_{h}")
        labels |= {
            f"target_nearby_wind_speed_{h}": F.col(f"{speed}_{h}"),
            f"target_nearby_wind_gust_{h}": F.col(f"{gust}_{h}"),
            f"target_nearby_precipitation_1hr_{h}": amount,
            f"target_nearby_precipitation_amount_{h}": amount,
            f"target_rain_event_{h}": (amount > RAIN_EVENT_MM).cast("int"),
            f"target_heavy_rain_event_{h}": (amount > HEAVY_RAIN_MM).cast("int"),
        }
    helper = [f"{c}_{h}" for h in horizons for c in (speed, gust, rain)] + [f"_found_{h}" for h in horizons]
    return out.withColumns(labels).drop(*helper)


def port_labels(area: DataFrame, keys: Sequence[str], time: str = "obs_time", horizons: dict[str, int] = HORIZONS,
                tolerance_minutes: float = 30.0, rain: bool = False) -> DataFrame:
    """Harbour wind labels; the optional rain label of a found row without rain data is 0."""
    columns = ["khwd_wind_speed_max", "khwd_wind_gust_max"] + (["port_local_precipitation_1hr_max"] if rain else [])
    out = nearest_labels(area, keys, time, columns, horizons, tolerance_minutes)
    labels: dict[str, Column] = {}
    for h in horizons:
        labels[f"target_wind_speed_{h}"] = F.col(f"khwd_wind_speed_max_{h}")
        labels[f"target_wind_gust_{h}"] = F.col(f"khwd_wind_gust_max_{h}")
        if rain:
            wet = F.coalesce(F.col(f"port_local_precipitation_1hr_max_{h}") > RAIN_EVENT_MM, F.lit(False))
            labels[f"target_rain_event_{h}"] = F.when(F.col(f"_found_{h}"), wet.cast("int"))
    helper = [f"{c}_{h}" for h in horizons for c in columns] + [f"_found_{h}" for h in horizons]
    return out.withColumns(labels).drop(*helper)


def dispatch_labels(df: DataFrame, keys: Sequence[str], time: str, offsets: Sequence[int] = (30, 60, 90, 120), step_minutes: int = 10,
                    rain_threshold: float = 0.0, tie: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Future wind, gust, their levels, and a rain event that is 0 past the end."""
    rows = [max(1, int(o / step_minutes)) for o in offsets]

    def futures(w):
        out = {}
        for i, n in enumerate(rows, start=1):
            wet = F.lead("precipitation_1hr", n).over(w) > rain_threshold
            out[f"rain_event_H{i}"] = F.coalesce(wet, F.lit(False)).cast("int")
            out[f"future_wind_speed_mps_H{i}"] = F.lead("wind_speed", n).over(w)
            out[f"future_wind_gust_mps_H{i}"] = F.lead("wind_gust", n).over(w)
        return out

    def levels(_):
        out = {}
        for i in range(1, len(rows) + 1):
            out[f"future_wind_level_H{i}"] = wind.wind_speed_level(F.col(f"future_wind_speed_mps_H{i}"))
            out[f"future_gust_level_H{i}"] = wind.wind_gust_level(F.col(f"future_wind_gust_mps_H{i}"))
        return out

    return over_chunks(df, keys, time, [futures, levels], reach_back=0, reach_ahead=max(rows), tie=tie, chunk_rows=chunk_rows)


def sequence_windows(df: DataFrame, keys: Sequence[str], time: str, features: Sequence[str], targets: Sequence[str], invalid: str = "invalid",
                     lookback: int = 72, ahead: int = 12, anchor_rows: Sequence[int] = (2, 5, 8, 11), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per clean window: history matrix, future matrix, anchors, persistence.

    The timestamp is the first future step. Windows that touch an invalid row,
    or do not fit into the series, are dropped.
    """
    vector = F.array(*[F.col(f).cast("double") for f in features])
    target = F.array(*[F.col(t).cast("double") for t in targets])

    def stage(w):
        span = w.rowsBetween(-lookback, ahead - 1)
        return {
            "_bad": F.sum(F.col(invalid).cast("int")).over(span),
            "_rows": F.count(F.lit(1)).over(span),
            "history": F.collect_list(vector).over(w.rowsBetween(-lookback, -1)),
            "future": F.collect_list(target).over(w.rowsBetween(0, ahead - 1)),
            "_last": F.lag(target, 1).over(w),
        }

    out = over_chunks(df, keys, time, [stage], reach_back=lookback, reach_ahead=ahead - 1, chunk_rows=chunk_rows)
    clean = out.filter((F.col("_bad") == 0) & (F.col("_rows") == lookback + ahead))
    anchors = F.array(*[F.col("future")[i] for i in anchor_rows])
    return clean.select(
        *keys, time, "history", "future", anchors.alias("anchors"), F.array_repeat("_last", len(anchor_rows)).alias("persistence")
    )


def chronological_split(df: DataFrame, keys: Sequence[str], time: str, train: float = 0.7, val: float = 0.15, tie: Sequence[str] = ()) -> DataFrame:
    """Tag rows train / val / test by position, with truncation and minimum sizes."""
    numbered = number_rows(df, keys, time, tie, position="_rn", total="_n")
    train_end = F.greatest(F.lit(1), F.floor(F.col("_n") * train))
    val_end = F.least(F.greatest(train_end + 1, F.floor(F.col("_n") * (train + val))), F.col("_n") - 1)
    part = F.when(F.col("_n") < 3, None).when(F.col("_rn") <= train_end, "train").when(F.col("_rn") <= val_end, "val").otherwise("test")
    return numbered.withColumn("split", part).drop("_rn", "_n")


def expanding_folds(df: DataFrame, keys: Sequence[str], time: str, n_splits: int = 5, test_size: float | None = None, gap: int = 0,
                    tie: Sequence[str] = ()) -> DataFrame:
    """One row per (row, fold) it takes part in, with role train or test."""
    numbered = number_rows(df, keys, time, tie, position="_rn", total="_n")
    n, index = F.col("_n"), F.col("_rn") - 1
    if test_size is None:
        size = F.greatest(F.lit(1), F.floor(n / (n_splits + 1)))
    elif test_size < 1:
        size = F.greatest(F.lit(1), F.floor(n * float(test_size)))
    else:
        size = F.lit(int(test_size)).cast("long")
    enough = n >= n_splits * size + gap + 1

    def role(fold: Column) -> Column:
        start = n - n_splits * size + fold * size
        part = F.when(index < start - gap, "train").when((index >= start) & (index < start + size), "test")
        return F.struct((fold + 1).alias("fold"), part.alias("role"))

    folds = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_splits - 1)), role), lambda f: f["role"].isNotNull())
    return numbered.filter(enough).withColumn("_f", F.explode(folds)).select(*df.columns, "_f.fold", "_f.role")


def fold_masks(df: DataFrame, keys: Sequence[str], time: str, n_splits: int = 5, gap: int = 0, tie: Sequence[str] = ()) -> DataFrame:
    """``expanding_folds`` without copies: bit k of ``train_folds`` and ``test_folds`` tells whether a row has that role in fold k + 1.

    A row stays one row; keys with too few rows for all folds have no bits. Up to 62 folds.
    """
    numbered = number_rows(df, keys, time, tie, position="_rn", total="_n")
    n, index = F.col("_n"), F.col("_rn") - 1
    size = F.greatest(F.lit(1), F.floor(n / (n_splits + 1)))
    enough = n >= n_splits * size + gap + 1

    def mask(inside) -> Column:
        bits = [F.when(enough & inside(n - n_splits * size + fold * size), F.lit(1 << fold)).otherwise(0).cast("long") for fold in range(n_splits)]
        return reduce(Column.bitwiseOR, bits)

    masks = {"train_folds": mask(lambda start: index < start - gap), "test_folds": mask(lambda start: (index >= start) & (index < start + size))}
    return numbered.withColumns(masks).drop("_rn", "_n")


def rolling_folds(df: DataFrame, keys: Sequence[str], time: str, train_size: int, test_size: int, step: int | None = None,
                  tie: Sequence[str] = ()) -> DataFrame:
    """Fixed-size windows: each row computes the folds that cover it, no join needed."""
    step = int(step or test_size)
    numbered = number_rows(df, keys, time, tie, position="_rn", total="_n")
    index, span = F.col("_rn") - 1, train_size + test_size
    last_fold = F.floor((F.col("_n") - span) / step)
    low = F.greatest(F.lit(0), F.ceil((index - span + 1) / step)).cast("long")
    high = F.least(last_fold, F.floor(index / step)).cast("long")
    covered = numbered.filter(low <= high).withColumn("_fold", F.explode(F.sequence(low, high)))
    role = F.when(index - F.col("_fold") * step < train_size, "train").otherwise("test")
    return covered.select(*df.columns, (F.col("_fold") + 1).alias("fold"), role.alias("role"))


def lookback_tail(df: DataFrame, keys: Sequence[str], time: str, lookback: int, invalid: str = "invalid") -> DataFrame:
    """Per key: whether the last ``lookback`` rows exist and are all valid, and why not."""
    numbered = number_rows(df, keys, time, position="_rn", total="_n")
    tail = numbered.filter(F.col("_rn") > F.col("_n") - lookback)
    return tail.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tail_rows"), F.count_if(F.col(invalid)).alias("invalid_rows"), F.max(time).alias("last_time")
    ).withColumn(
        "reason",
        F.when(F.col("tail_rows") < lookback, "not_enough_rows").when(F.col("invalid_rows") > 0, "invalid_gap"),
    ).withColumn("usable", F.col("reason").isNull())


def wind_projection(df: DataFrame, as_of: Column, hours: int = 2, offsets: Sequence[int] = (10, 30, 60, 90), limit_minutes: int = 90,
                    time: str = "obs_time") -> DataFrame:
    """Straight-line wind forecast per (station, device) from first and last recent point."""
    window = F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), F.lit(0))
    recent = df.filter((F.col(time) >= as_of - window) & (F.col(time) <= as_of) & F.col("wind_speed").isNotNull() & ~F.col("is_forecast"))
    order = F.struct(time, "seq")
    ends = recent.groupBy("station_id", "device_type").agg(
        F.min_by(F.struct(time, "wind_speed"), order).alias("first"), F.max_by(F.struct(time, "wind_speed"), order).alias("last"),
        F.count(F.lit(1)).alias("points"),
    )
    minutes = F.greatest((F.col(f"last.{time}").cast("double") - F.col(f"first.{time}").cast("double")) / 60, F.lit(1.0))
    slope = (F.col("last.wind_speed") - F.col("first.wind_speed")) / minutes
    targets = [o for o in offsets if o <= limit_minutes]
    spread = ends.withColumn("offset_minutes", F.explode(F.array(*[F.lit(o) for o in targets])))
    projected = F.when(F.col("points") < 2, F.col("last.wind_speed")).otherwise(
        F.round(F.col("last.wind_speed") + slope * F.col("offset_minutes"), 3)
    )
    return spread.select(
        "station_id", "device_type", "offset_minutes", (as_of + F.make_dt_interval(mins=F.col("offset_minutes"))).alias("forecast_time"),
        projected.alias("wind_speed"), F.when(F.col("points") >= 2, "medium").otherwise("low").alias("confidence"),
    )


def three_hour_rain(anchors: DataFrame, run_keys: Sequence[str], label: str = "label", amount: str = "predicted_amount_mm") -> DataFrame:
    """Sum of the H1..H3 amounts per run and its level, null if any is missing."""
    from skywharf.functions.weather import rain_amount_level

    inside = F.col(label).isin("H1", "H2", "H3")
    sums = anchors.groupBy(*run_keys).agg(
        F.when(F.count(F.when(inside, F.col(amount))) == 3, F.round(F.sum(F.when(inside, F.col(amount))), 3)).alias("rain_3h_mm")
    )
    return sums.withColumn("rain_3h_level", rain_amount_level(F.col("rain_3h_mm"), 3))
