"""Inventories and status tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalization_status(df: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """'ok', or 'degraded' with the list of required columns that have no value at all."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("record_count"), *[F.count(c).alias(f"_n_{c}") for c in required])
    missing = F.array_compact(F.array(*[F.when(F.col(f"_n_{c}") == 0, F.lit(c)) for c in required]))
    return counted.withColumn("missing_columns", missing).withColumn(
        "normalization_status", F.when(F.size("missing_columns") > 0, "degraded").otherwise("ok")
    ).drop(*[f"_n_{c}" for c in required])


def station_diagnostics(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Rows and latest time per station with the station's attributes."""
    counted = df.groupBy("station_id").agg(F.count(F.lit(1)).alias("row_count"), F.max("obs_time").alias("latest_time"))
    return counted.join(stations, "station_id")


def source_inventory(df: DataFrame, groups: Sequence[str], main: str) -> DataFrame:
    """Stations, rows, valid share and span of each source group."""
    return df.groupBy(*groups).agg(
        F.count_distinct("station_id").alias("station_count"), F.count(F.lit(1)).alias("total_rows"), F.count(main).alias("valid_rows"),
        F.round(F.count(main) / F.count(F.lit(1)), 4).alias("valid_ratio"), F.min("obs_time").alias("time_start"), F.max("obs_time").alias("time_end"),
        F.when(F.count(main) > 0, "available").otherwise("not_available").alias("status"),
    )


def selection_summary(selected: DataFrame, groups: Sequence[str], mode: str) -> DataFrame:
    """Runs per selected mode and their share of the group."""
    from pyspark.sql import Window

    counts = selected.groupBy(*groups, mode).agg(F.count(F.lit(1)).alias("run_count"))
    return counts.withColumn("share", F.col("run_count") / F.sum("run_count").over(Window.partitionBy(*groups)))


def regression_report(selected: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Selected against expected mode, counted, with an all-passed flag."""
    passed = F.col("selected_mode") == F.col("expected_mode")
    return selected.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if(passed).alias("passed_cases"), F.count_if(~passed).alias("failed_cases"),
        F.bool_and(passed).alias("all_passed"),
    )


def model_registry(families: DataFrame, metrics: DataFrame) -> DataFrame:
    """Model families with their state and whether any metric exists for them."""
    counted = metrics.groupBy("family").agg(F.count("value").alias("metric_count"))
    return families.join(counted, "family", "left").select(
        "family", "artifact_version", F.coalesce("metric_count", F.lit(0)).alias("metric_count"),
        (F.coalesce("metric_count", F.lit(0)) > 0).alias("metrics_available"), "trained", "available", "accepted",
    )


def registry_summary(models: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Lists of available and of accepted families (one entry per configured family)."""
    return models.groupBy(*groups).agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("available"), F.col("family")))), ",").alias("available_families"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("accepted"), F.col("family")))), ",").alias("accepted_families"),
    )
