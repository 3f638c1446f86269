"""Station and zone dimensions from configuration, and their availability."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywharf.operators.decisions import availability_mode
from skywharf.plans.dims import dimension

# The group that is never an input, and the priority of groups without one.
AUXILIARY_GROUP, LAST_PRIORITY = "cwa_forecast_auxiliary", 999
POOL_SCHEMA = (
    "station_id string, name string, longitude double, latitude double, role string, priority_group string, priority int, "
    "is_port_local boolean, is_core_station boolean"
)


def read_yaml(path: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML configuration needs PyYAML") from error
    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle) or {}


def station_pool(spark: SparkSession, config: dict[str, Any], include_reference: bool = True) -> DataFrame:
    """Enabled stations of all priority groups, auxiliary group left out."""
    rows = [
        (
            str(s["station_id"]), s.get("name"), s.get("longitude"), s.get("latitude"), s.get("role"), name,
            int(group.get("priority", LAST_PRIORITY)), bool(s.get("is_port_local", False)), bool(s.get("is_core_station", False)),
        )
        for name, group in config.get("priority_groups", {}).items()
        if name != AUXILIARY_GROUP and (include_reference or group.get("role") != "reference_only")
        for s in group.get("stations") or []
        if s.get("station_id") and s.get("enabled", True)
    ]
    return dimension(spark, rows, POOL_SCHEMA)


def upstream_map(zoning: dict[str, Any], selected: Sequence[str]) -> dict[str, list[str]]:
    """Season -> upstream stations that are selected, from zoning pairs."""
    out: dict[str, list[str]] = {}
    for pair in zoning.get("upstream_downstream_pairs") or []:
        known = out.setdefault(str(pair.get("season", "")), [])
        known += [str(s) for s in pair.get("upstream_station_ids") or [] if str(s) in set(selected) and str(s) not in known]
    return out


def availability(pool: DataFrame, observed: DataFrame) -> DataFrame:
    """Pool stations with a flag telling whether any observation exists."""
    present = observed.select("station_id").distinct().withColumn("_there", F.lit(True))
    return pool.join(present, "station_id", "left").withColumn("available", F.coalesce("_there", F.lit(False))).drop("_there")


def load_summary(pool: DataFrame, observed: DataFrame, target: str) -> DataFrame:
    """Available and missing ids of a pool and the single-station fallback flag (one row)."""
    marked = availability(pool, observed)
    there = F.col("available")

    def ids(condition):
        return F.array_join(F.sort_array(F.collect_list(F.when(condition, F.col("station_id")))), ",")

    return marked.agg(
        F.count_if(there).alias("input_station_count"), ids(there).alias("available_ids"), ids(~there).alias("missing_ids"),
        F.coalesce(F.bool_or(there & (F.col("station_id") == target)), F.lit(False)).alias("target_available"),
        (F.count_if(there & (F.col("station_id") != target)) == 0).alias("fallback_to_single_station"),
    )


def priority_summary(pool: DataFrame, observed: DataFrame, wind_group: str, minimum: int = 2, model_enabled: bool = False) -> DataFrame:
    """Per-group availability and the prediction mode the harbour stations allow."""
    marked = availability(pool, observed)
    counts = marked.groupBy("priority_group").agg(
        F.count(F.lit(1)).alias("configured"), F.count_if("available").alias("available_count"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("available"), F.col("station_id")))), ",").alias("available_ids"),
        F.array_join(F.sort_array(F.collect_list(F.when(~F.col("available"), F.col("station_id")))), ",").alias("missing_ids"),
    )
    mode, reason = availability_mode(F.col("available_count"), F.col("available_count"), F.lit(model_enabled), F.lit(True), F.lit(True), minimum)
    only_wind = F.col("priority_group") == wind_group
    return counts.withColumns({"prediction_mode": F.when(only_wind, mode), "fallback_reason": F.when(only_wind, reason)})
