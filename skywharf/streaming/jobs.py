"""Streaming forms of ingestion, deduplication, status, resampling and alerts.

Every function maps a streaming (or batch) DataFrame to another one; ``run``
starts it with an ``availableNow`` or processing-time trigger. Checkpoints
live in the shared folder the caller names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywharf.functions import clock, wind
from skywharf.operators.aggregates import freshness_threshold
from skywharf.operators.cleaning import keep_last
from skywharf.session import cut_lineage
from skywharf.sources import store



def landing_streams(spark: SparkSession, folders: dict[str, str], schema: T.StructType, fmt: str = "parquet", max_files: int = 1000) -> dict[str, DataFrame]:
    """One file stream per source folder. An unreadable file fails the query of its source, and no other."""
    return {
        source: spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(folder).withColumn("landing_source", F.lit(source))
        for source, folder in folders.items()
    }


def run_sources(streams: dict[str, DataFrame], checkpoint: str, sink: Callable[[DataFrame, int], None]) -> DataFrame:
    """Run one query for each source over what is available; one row for each tells how it ended.

    Rows: source, failed, error, all_failed. A source that failed starts again at its last finished batch.
    """
    spark = next(iter(streams.values())).sparkSession
    running = {source: run(stream, f"{checkpoint}/{source}", sink) for source, stream in streams.items()}
    ended = []
    for source, started in running.items():
        try:
            started.awaitTermination()
            ended.append((source, False, None))
        except StreamingQueryException as error:
            ended.append((source, True, str(error)))
    failed = all(row[1] for row in ended)
    return spark.createDataFrame([(*row, failed) for row in ended], "source string, failed boolean, error string, all_failed boolean")


def batch_sink(path: str, build: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of ``build(batch)`` to the batch's own partition: a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")

    return write


def upsert_partitions(spark: SparkSession, batch: DataFrame, path: str, order: Sequence[str], keys: Sequence[str], kept: Sequence[str], replaced: Sequence[str],
                      day: str = "obs_date") -> None:
    """Merge a micro-batch into the day partitions it touches, leaving all others alone.

    The merged days are checkpointed to shared storage and then replaced by a
    dynamic partition overwrite. Merging is by key, so a repeated batch ends
    in the same table.
    """
    incoming = batch.withColumn(day, F.to_date("obs_time")).persist()
    try:
        try:
            existing = spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            existing = None
        if existing is not None:
            touched = incoming.select(day).distinct()
            existing = existing.join(touched, day, "left_semi")
        merged = store.upsert(existing, incoming, order, [*keys, day], kept, replaced)
        # The table cannot be read and overwritten in one plan: checkpoint in between.
        cut_lineage(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    finally:
        incoming.unpersist()


def upsert_sink(path: str, order: Sequence[str], keys: Sequence[str], kept: Sequence[str] = (), replaced: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer with last-wins (and first-wins for kept columns) semantics."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_partitions(batch.sparkSession, batch, path, order, keys, kept, replaced)

    return write


def first_sink(path: str, keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that keeps the first row per key, however late a repeat comes."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        upsert_partitions(batch.sparkSession, batch, path, order, keys, rest, ())

    return write


def append_last_sink(path: str, keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that keeps the last row per key, as repeated polls do."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        upsert_partitions(batch.sparkSession, keep_last(batch, keys, list(order)).select(*keys, *rest), path, order, keys, (), rest)

    return write


def latest_state(stream: DataFrame, keys: Sequence[str], values: Sequence[str], time: str = "obs_time") -> DataFrame:
    """Latest observed row per key, kept live in update mode."""
    return stream.filter(~F.col("is_forecast")).groupBy(*keys).agg(
        F.max(time).alias(time), F.max_by(F.struct(*values), F.struct(time, "seq")).alias("_v")
    ).select(*keys, time, "_v.*")


def freshness(latest: DataFrame, as_of: Column) -> DataFrame:
    """Age, policy threshold and status of a latest-state table, as a scheduled check.

    A silent station sends no event, so silence is judged against the clock
    of the check and not against the stream.
    """
    age = clock.age_minutes(F.col("obs_time"), as_of)
    threshold = freshness_threshold(F.col("source"), F.col("device_type"))
    return latest.withColumns({"age_minutes": age, "threshold_minutes": threshold, "status": clock.status_level(age, threshold)})


SILENCE_SCHEMA = "station_id string, last_time timestamp, status string"


def silence(stream: DataFrame, limit_seconds: float, time: str = "obs_time") -> DataFrame:
    """A row when a station falls silent and one when it comes back, in append mode.

    Each station has a keyed state with a timer of the processing clock, set anew by every batch that has rows of it. When
    no row came for ``limit_seconds``, the timer itself gives the ``outage`` row: no event of any station is needed. The
    first rows after it give ``recovered``. ``last_time`` is the newest observation seen; rows without a station or a time
    count for nothing. A batch hands a station over in Arrow batches, so no station is held whole.
    """

    def watch(key, frames, state):
        last, silent = state.get if state.exists else (None, False)
        if state.hasTimedOut:
            state.update((last, True))
            yield pd.DataFrame({"station_id": [key[0]], "last_time": [last], "status": ["outage"]})
            return
        newest = max((frame[time].max() for frame in frames if len(frame)), default=None)
        last = newest if last is None else max(last, newest)
        state.update((last, False))
        state.setTimeoutDuration(int(limit_seconds * 1000))
        if silent:
            yield pd.DataFrame({"station_id": [key[0]], "last_time": [last], "status": ["recovered"]})

    seen = stream.filter(F.col("station_id").isNotNull() & F.col(time).isNotNull()).select("station_id", time)
    return seen.groupBy("station_id").applyInPandasWithState(watch, SILENCE_SCHEMA, "last timestamp, silent boolean", "append", "ProcessingTimeTimeout")


def stamped_stale(stream: DataFrame, limit_minutes: int = 20) -> DataFrame:
    """Flag set at ingest: the row was already old when it was fetched."""
    age = F.col("fetched_at").cast("double") - F.col("obs_time").cast("double")
    return stream.withColumn("stale_at_fetch", age > limit_minutes * 60)


def tumbling_parts(rows: DataFrame, measures: Sequence[str], minutes: int = 10, time: str = "obs_time") -> DataFrame:
    """Sums and counts per station and grid step. Parts of any batches add up, so a row is never too late."""
    return rows.groupBy(F.window(time, f"{minutes} minutes").alias("_w"), "station_id").agg(
        *[F.sum(m).alias(f"{m}_sum") for m in measures], *[F.count(m).alias(f"{m}_n") for m in measures]
    ).select("station_id", F.col("_w.start").alias(time), *[f"{m}_{x}" for m in measures for x in ("sum", "n")])


def tumbling_merged(parts: DataFrame, measures: Sequence[str], time: str = "obs_time") -> DataFrame:
    """Parts of several batches added up to parts."""
    return parts.groupBy("station_id", time).agg(*[F.sum(f"{m}_{x}").alias(f"{m}_{x}") for m in measures for x in ("sum", "n")])


def tumbling_mean(parts: DataFrame, measures: Sequence[str], time: str = "obs_time") -> DataFrame:
    """Mean per station and grid step from the parts of all batches."""
    return parts.groupBy("station_id", time).agg(*[(F.sum(f"{m}_sum") / F.nullif(F.sum(f"{m}_n"), F.lit(0))).alias(m) for m in measures])


TREND_KEYS = ["station_id", "device_type", "window_end"]


def trend_parts(rows: DataFrame, time: str = "obs_time") -> DataFrame:
    """First and last point and number of points of each two-hour window; parts of any batches merge."""
    point = F.struct(F.col(time).alias("t"), F.col("seq").alias("s"), F.col("wind_speed").alias("v"))
    return rows.filter(F.col("wind_speed").isNotNull()).groupBy(F.window(time, "2 hours", "10 minutes").alias("_w"), "station_id", "device_type").agg(
        F.min(point).alias("first"), F.max(point).alias("last"), F.count(F.lit(1)).alias("points")
    ).select("station_id", "device_type", F.col("_w.end").alias("window_end"), "first", "last", "points")


def trend_merged(parts: DataFrame) -> DataFrame:
    """Parts of several batches as parts."""
    return parts.groupBy(*TREND_KEYS).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("points").alias("points"))


def sliding_trend(parts: DataFrame, offsets: Sequence[int] = (10, 30, 60, 90)) -> DataFrame:
    """Straight-line wind forecast from the first and last point of each two-hour window."""
    ends = trend_merged(parts).withColumnsRenamed({"first": "a", "last": "b"})
    minutes = F.greatest((F.col("b.t").cast("double") - F.col("a.t").cast("double")) / 60, F.lit(1.0))
    slope = (F.col("b.v") - F.col("a.v")) / minutes
    spread = ends.withColumn("offset_minutes", F.explode(F.array(*[F.lit(o) for o in offsets])))
    value = F.when(F.col("points") < 2, F.col("b.v")).otherwise(F.round(F.col("b.v") + slope * F.col("offset_minutes"), 3))
    return spread.select(*TREND_KEYS, "offset_minutes", value.alias("wind_speed"))


# Wind speeds (m/s) above which an alert is raised.
ALERT_MPS, SEVERE_ALERT_MPS = 13.8, 17.2


def alerts(stream: DataFrame) -> DataFrame:
    """Rows at or above the alert speed or at warning level by speed or gust; stateless."""
    leveled = stream.withColumns(
        {
            "wind_level": wind.wind_speed_level(F.col("wind_speed")), "gust_level": wind.wind_gust_level(F.col("wind_gust")),
            "alert": F.when(F.col("wind_speed") >= SEVERE_ALERT_MPS, "severe").when(F.col("wind_speed") >= ALERT_MPS, "strong"),
        }
    )
    serious = ["warning", "high_risk", "stop"]
    return leveled.filter(F.col("alert").isNotNull() | F.col("wind_level").isin(serious) | F.col("gust_level").isin(serious))


def run(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append", every: str | None = None):
    """Start a query; without ``every`` it processes what is available and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.foreachBatch(sink).start()
