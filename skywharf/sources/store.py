"""Observation store semantics on plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywharf.schema import KEY_COLUMNS, UPSERT_KEPT, UPSERT_REPLACED


def upsert(existing: DataFrame | None, incoming: DataFrame, order: Sequence[str], keys: Sequence[str] = tuple(KEY_COLUMNS),
           kept: Sequence[str] = tuple(UPSERT_KEPT), replaced: Sequence[str] = tuple(UPSERT_REPLACED)) -> DataFrame:
    """One row per key: replaced columns from the last version, kept ones from the first.

    Existing rows count as older than any incoming row. Both picks combine on
    the map side, so many versions of one key do not meet in one task.
    """
    new = incoming.withColumn("_age", F.lit(1))
    both = new if existing is None else existing.withColumn("_age", F.lit(0)).unionByName(new, allowMissingColumns=True)
    place = F.struct("_age", *order)
    last_names = list(dict.fromkeys(c for c in [*replaced, *order] if c in both.columns and c not in keys and c not in kept))
    first_names = [c for c in kept if c in both.columns]
    aggs = [F.max_by(F.struct(*last_names), place).alias("_last")] if last_names else []
    if first_names:
        aggs.append(F.min_by(F.struct(*first_names), place).alias("_first"))
    return both.groupBy(*keys).agg(*aggs).select(
        *keys, *[F.col(f"_last.{c}").alias(c) for c in last_names], *[F.col(f"_first.{c}").alias(c) for c in first_names]
    )


def history(sources: dict[str, DataFrame], since: str, source: str | None = None) -> DataFrame:
    """Rows of one or all history sources since a time, stacked and ordered."""
    out = None
    for name, frame in sources.items():
        if source is not None and name != source:
            continue
        part = frame.filter(F.col("obs_time") >= F.lit(since).cast("timestamp")).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.orderBy("source", "station_id", "obs_time")


def latest_release(points: DataFrame, releases: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Newest forecast release known at each time (``fetched_at <= at``): a leak-free read."""
    from skywharf.plans.asof import nearest_join

    matched = nearest_join(points, releases, keys, at, "fetched_at", values, direction="backward")
    return matched.select(
        *points.columns, F.col("_match.fetched_at").alias("released_at"), *[F.col(f"_match.{v}").alias(v) for v in values]
    )
