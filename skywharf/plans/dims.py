"""Small dimension tables with a checked size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROW_LIMIT = 100_000


def dimension(spark: SparkSession, rows: Sequence[tuple], schema: str, broadcast_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Configuration rows, which the driver holds as literals, as a DataFrame.

    Up to ``broadcast_rows`` of them are marked for broadcast; more are joined
    by shuffle. The parameter changes the plan only, never the rows.
    """
    frame = spark.createDataFrame(list(rows), schema)
    return F.broadcast(frame) if len(rows) <= broadcast_rows else frame


def lookup(mapping: dict, key, default=None):
    """Value of ``key`` in a literal map: an expression, no join, key evaluated once."""
    found = F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)
    return found if default is None else F.coalesce(found, F.lit(default))
