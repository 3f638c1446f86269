"""Station ranking, nearest-N and best-candidate choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skywharf.functions.geo import distance_to_points, haversine_km
from skywharf.schema import EARTH_RADIUS_KM, EARTH_RADIUS_MEAN_KM, REFERENCE_POINTS

FIRST_PRIORITY = "priority_1_near_port"
OTHER_PRIORITY = "priority_2_outer_nearby"


def rank_nearby(stations: DataFrame, baseline_id: str, first_ids: Sequence[str], max_selected: int = 6, points=REFERENCE_POINTS) -> DataFrame:
    """Order a station dimension by (first priority, distance to the port) and select the nearest.

    Only stations closer than the baseline can be selected. The input is one
    row per station (a dimension), so ranking it in one sorted pass is bounded.
    """
    exact = distance_to_points(F.col("latitude"), F.col("longitude"), points, EARTH_RADIUS_MEAN_KM)
    everything = Window.partitionBy()
    measured = stations.withColumn("_exact", exact).withColumn(
        "_baseline", F.max(F.when(F.col("station_id") == baseline_id, F.col("_exact"))).over(everything)
    )
    flagged = measured.withColumns(
        {
            "distance_to_port_km": F.round("_exact", 4),
            "closer_than_baseline": (F.col("_exact") < F.col("_baseline")) & (F.col("station_id") != baseline_id),
            "_first": F.col("station_id").isin(list(first_ids)),
        }
    )
    order = [F.when(F.col("_first"), 0).otherwise(1), F.col("distance_to_port_km"), F.col("station_id")]
    ranked = flagged.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    picked = F.sum(F.col("closer_than_baseline").cast("int")).over(
        Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    )
    return ranked.withColumns(
        {
            "selected": F.col("closer_than_baseline") & (picked <= max_selected),
            "ranked_group": F.when(F.col("_first"), FIRST_PRIORITY).otherwise(OTHER_PRIORITY),
        }
    ).drop("_exact", "_baseline", "_first")


def nearest_stations(stations: DataFrame, lat: float, lon: float, radius_km: float, top_n: int) -> DataFrame:
    """Closest N stations within a radius, by distance rounded to 2 places."""
    km = haversine_km(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"), EARTH_RADIUS_KM)
    inside = stations.withColumn("_km", km).filter(F.col("_km") <= radius_km).withColumn("dist_km", F.round("_km", 2)).drop("_km")
    return inside.orderBy("dist_km", "station_id").limit(top_n)


def nearest_vector(nearest: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, top_n: int = 3) -> DataFrame:
    """Values of the nearest N per group as ``nearby_precip_1..N``, zero when absent.

    ``nearest`` holds at most N rows per group (see ``nearest_stations``).
    """
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    numbered = nearest.withColumn("_place", place)
    return numbered.groupBy(*groups).agg(
        *[
            F.coalesce(F.max(F.when(F.col("_place") == i, F.col(value))), F.lit(0.0)).alias(f"nearby_precip_{i}")
            for i in range(1, top_n + 1)
        ],
        F.lit(1.0).alias("nearby_available"),
    )


# Preference among forecast resolutions, best first.
RESOLUTION_SCORE = {"3h": 0, "6h": 1, "12h": 2, "3h_unverified": 3, "6h_unverified": 3, "12h_unverified": 3, "unknown": 4}


def source_resolution(hours: Column, element: Column) -> Column:
    """Period length of a series, else a guess from its element name."""
    rounded = F.bround(hours, 0).cast("int")
    name = F.lower(F.coalesce(element, F.lit("")))
    guessed = (
        F.when(name.contains("3"), "3h_unverified").when(name.contains("6"), "6h_unverified")
        .when(name.contains("12"), "12h_unverified").otherwise("unknown")
    )
    known = F.when(rounded.isin(3, 6, 12), F.concat(rounded.cast("string"), F.lit("h"))).otherwise("unknown")
    return F.when(hours.isNotNull(), known).otherwise(guessed)


def best_source(candidates: DataFrame, groups: Sequence[str] = (), position: str = "candidate_index") -> DataFrame:
    """Available candidate with the lowest (resolution score, dataset priority, location index, element index).

    ``position`` is unique in its group and decides ties: the first candidate of the list wins.
    """
    from skywharf.plans.dims import lookup

    score = F.struct(
        lookup(RESOLUTION_SCORE, F.col("source_resolution"), 3).alias("s"), F.col("dataset_priority"), F.col("location_index"), F.col("element_index"), F.col(position),
    )
    fields = F.struct("dataset_id", "location_name", "element_name", "source_resolution", "record_count")
    usable = F.col("record_count") > 0
    return candidates.groupBy(*groups).agg(F.min_by(fields, F.when(usable, score)).alias("_b"), F.bool_or(usable).alias("available")).select(
        *groups, "available", "_b.*"
    )


def first_available(candidates: DataFrame, fallback: str, groups: Sequence[str] = ()) -> DataFrame:
    """First location with rows, by candidate order, else the configured fallback."""
    return candidates.groupBy(*groups).agg(
        F.coalesce(F.min_by("location_name", F.when(F.col("record_count") > 0, F.col("location_index"))), F.lit(fallback)).alias("resolved_location_name")
    )
