"""From station rows to the supervised area datasets, as chained transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywharf.functions import clock
from skywharf.operators import aggregates, features, labels
from skywharf.schema import HORIZONS

YEAR_DAYS = 366.0


def area_features(rows: DataFrame, keys: Sequence[str], time: str, upstream: dict[str, Sequence[str]] | None = None,
                  typhoon_months: list[int] | None = None, pressure: bool = False) -> DataFrame:
    """Area statistics, optional upstream and pressure blocks, time cycles, lags and rolls.

    Training and inference share this path, so live features follow the same
    lag rules as the training set.
    """
    by_time = [*keys, time]
    series = aggregates.area_wind_rain(rows, by_time, directions=True, pressure=pressure, weighted="distance_to_port_km" in rows.columns)
    if upstream:
        series = series.join(aggregates.upstream_lead(rows, by_time, time, upstream, typhoon_months), by_time, "left")
    timed = series.withColumns(clock.cyclic_time(F.col(time), YEAR_DAYS, month=False))
    return features.apply_features(timed, keys, time, [features.area_lag_roll(timed.columns)])


def area_dataset(rows: DataFrame, keys: Sequence[str], time: str, horizons: dict[str, int] = HORIZONS, strict_future: bool = False,
                 **options) -> DataFrame:
    """Features plus H1..H4 labels of the area series."""
    return labels.area_labels(area_features(rows, keys, time, **options), keys, time, horizons, strict_future=strict_future)


def inference_rows(rows: DataFrame, keys: Sequence[str], time: str, **options) -> DataFrame:
    """Feature row at the last time of each area."""
    return aggregates.latest_per(area_features(rows, keys, time, **options).withColumn("_at", F.col(time)), keys, ["_at"]).drop("_at")


def port_dataset(rows: DataFrame, keys: Sequence[str], time: str, horizons: dict[str, int] = HORIZONS, tolerance_minutes: float = 30.0,
                 rain: bool = False) -> DataFrame:
    """Harbour wind features plus labels."""
    series = aggregates.port_local_by_time(rows, [*keys, time])
    timed = series.withColumns(clock.cyclic_time(F.col(time), YEAR_DAYS, month=False))
    lagged = features.apply_features(timed, keys, time, [features.port_lag_roll(timed.columns)])
    return labels.port_labels(lagged, keys, time, horizons, tolerance_minutes, rain)


def dataset_report(dataset: DataFrame, keys: Sequence[str], tolerance_minutes: int = 30) -> DataFrame:
    """Rows, span, column counts and label rule of a dataset, per area."""
    label_columns = [c for c in dataset.columns if c.startswith("target_") and c not in keys]
    feature_columns = [c for c in dataset.columns if c not in {"obs_time", *keys, *label_columns}]
    return dataset.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), F.min("obs_time").alias("time_start"), F.max("obs_time").alias("time_end"),
        F.lit(len(feature_columns)).alias("feature_count"), F.lit(len(label_columns)).alias("label_count"),
        F.lit("nearest_with_tolerance").alias("label_alignment_method"), F.lit(int(tolerance_minutes)).alias("tolerance_minutes"),
    )
