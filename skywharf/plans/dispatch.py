"""Dispatch plans that combine forecasts, rules and levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywharf.functions import wind
from skywharf.functions.weather import rain_probability_level
from skywharf.operators import joins

# Extended windows and their hours ahead.
EXTENDED_WINDOWS = {"+3h": 3, "+6h": 6}


def extended_windows(runs: DataFrame, periods: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """+3 h and +6 h look-ups of probability and Beaufort minimum, with their levels.

    Each value comes from the containing period that has it, else from the
    period whose start is nearest.
    """
    options = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in EXTENDED_WINDOWS.items()])
    points = runs.withColumn("_w", F.explode(options)).select(
        *keys, time, F.col("_w.w").alias("forecast_window"), (F.col(time) + F.make_dt_interval(hours=F.col("_w.h"))).alias("_at")
    )
    both = joins.period_or_nearest(points, periods, keys, "_at", ["pop", "beaufort_scale_min"])
    return both.select(
        *keys, time, "forecast_window", F.col("pop").alias("rain_probability"), rain_probability_level(F.col("pop")).alias("rain_level"),
        F.col("beaufort_scale_min").alias("beaufort_min"), wind.level_from_beaufort(F.col("beaufort_scale_min")).alias("operation_level"),
    )
