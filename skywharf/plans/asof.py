"""Nearest-time and interval joins as one scan of a merged stream, without candidate pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skywharf.plans.timeline import DAY, neighbours

#: Levels of a dyadic cover: enough for 2^LEVELS borders in one cell.
LEVELS = 40


def around(
    points: DataFrame, sources: dict[str, DataFrame], keys: Sequence[str], at: str, sides: Sequence[str] = ("prev", "next"), cell_seconds: int | None = None
) -> DataFrame:
    """Attach to each point the row of every source before (``<name>_prev``) and after it (``<name>_next``), in one scan.

    A source has the keys, a time ``_at`` and a struct ``_value``, whose field ``_time``, if it has one, is that time: a row
    at exactly the time of a point then counts as both. All sources and the points are merged into one ordered stream per
    key, so several values and both directions cost one shuffle of the points.
    """
    keys, names = list(keys), list(sources)
    shape = {n: sources[n].schema["_value"].dataType for n in names}
    looked = ("prev", "next") if "next" in sides else sides

    def payload(own: str | None) -> list[Column]:
        return [(F.col("_value") if n == own else F.lit(None).cast(shape[n])).alias(f"_pay_{n}") for n in names]

    merged = points.select("*", F.col(at).alias("_event_time"), F.lit(1).alias("_is_target"), *payload(None))
    for n in names:
        rows = sources[n].select(*keys, F.col("_at").alias("_event_time"), F.lit(0).alias("_is_target"), *payload(n))
        merged = merged.unionByName(rows.dropna(subset=[*keys, "_event_time"]), allowMissingColumns=True)
    found = neighbours(merged, keys, "_event_time", {n: F.col(f"_pay_{n}") for n in names}, ["_is_target"], cell_seconds, sides=looked)
    rows = found.filter(F.col("_is_target") == 1)
    # The scan meets a source row before a point of the same time, so only the look ahead has to be told of it.
    exact = {n: F.col(f"{n}_prev._time") == F.col(at) for n in names if "next" in sides and "_time" in shape[n].names}
    ahead = {f"{n}_next": F.when(same, F.col(f"{n}_prev")).otherwise(F.col(f"{n}_next")) for n, same in exact.items()}
    unasked = [f"{n}_{side}" for n in names for side in looked if side not in sides]
    return rows.withColumns(ahead).drop("_event_time", "_is_target", *[f"_pay_{n}" for n in names], *unasked)


def nearest_join(
    targets: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    target_time: str,
    source_time: str,
    values: Sequence[str],
    tolerance_seconds: float | None = None,
    direction: str = "nearest",
    cell_seconds: int | None = None,
) -> DataFrame:
    """Attach to each target the source row nearest in time, as struct ``_match``.

    Ties between an earlier and a later row go to the later one; the tolerance
    is inclusive. ``direction`` may be "backward" (latest at or before) or
    "forward".
    """
    fields = [source_time, *[v for v in values if v != source_time]]
    rows = source.select(*keys, F.col(source_time).alias("_at"), F.struct(F.col(source_time).alias("_time"), F.struct(*fields).alias("row")).alias("_value"))
    sides = {"backward": ("prev",), "forward": ("next",)}.get(direction, ("prev", "next"))
    found = around(targets, {"_near": rows}, keys, target_time, sides, cell_seconds)
    if direction != "nearest":
        found = found.withColumn("_near_next" if direction == "backward" else "_near_prev", F.lit(None).cast(rows.schema["_value"].dataType))
    back_gap = F.col(target_time).cast("double") - F.col("_near_prev._time").cast("double")
    ahead_gap = F.col("_near_next._time").cast("double") - F.col(target_time).cast("double")
    before, after = F.col("_near_prev.row"), F.col("_near_next.row")
    if direction == "backward":
        choice, gap = before, back_gap
    elif direction == "forward":
        choice, gap = after, ahead_gap
    else:
        use_back = F.col("_near_prev").isNotNull() & (F.col("_near_next").isNull() | (back_gap == 0) | (back_gap < ahead_gap))
        choice, gap = F.when(use_back, before).otherwise(after), F.when(use_back, back_gap).otherwise(ahead_gap)
    if tolerance_seconds is not None:
        choice = F.when(gap <= F.lit(float(tolerance_seconds)), choice)
    return found.withColumn("_match", choice).drop("_near_prev", "_near_next")


def segments(
    periods: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    order: Sequence[str],
    winners: dict[str, tuple[Column, Column]],
    cell_seconds: int = DAY,
) -> DataFrame:
    """Periods that may overlap, cut into disjoint segments: keys, ``_at`` and a struct per winner, null where there is none.

    ``winners`` maps a name to (condition, struct): of the periods that hold a segment and fulfil the condition, the first
    by ``order`` (unique within a key) gives its struct. A segment reaches from its ``_at`` to the next one of the key.

    Starts and ends are ranked inside time cells; a period covers a range of ranks, which is cut into dyadic ranges, and a
    segment asks the ranges above it for their first period. So thousands of overlapping periods make rows by the
    logarithm of their number, never pairs.
    """
    keys, names = list(keys), list(winners)
    width = cell_seconds * 1_000_000
    us = {x: F.unix_micros(x) for x in (start, end)}
    listed = periods.filter(F.col(end) > F.col(start)).select(
        *keys, F.struct(*order).alias("_order"), us[start].alias("_start"), us[end].alias("_end"),
        *[F.when(condition, value).alias(f"_win_{n}") for n, (condition, value) in winners.items()],
        F.explode(F.sequence(F.floor(us[start] / width), F.floor(us[end] / width))).alias("_cell"),
    )
    opens = F.greatest(F.col("_start"), F.col("_cell") * width)
    borders = F.array_compact(F.array(
        F.when(opens < F.col("_end"), F.struct(opens.alias("at"), F.lit(True).alias("opens"))),
        F.when(F.col("_end") < (F.col("_cell") + 1) * width, F.struct(F.col("_end").alias("at"), F.lit(False).alias("opens"))),
    ))
    cell = [*keys, "_cell"]
    ranked = listed.withColumn("_border", F.explode(borders)).withColumn("_rank", F.dense_rank().over(Window.partitionBy(*cell).orderBy("_border.at")) - 1)
    ranked = ranked.withColumn("_ranks", F.max("_rank").over(Window.partitionBy(*cell)) + 1)
    covers = ranked.groupBy(*cell, "_order").agg(
        F.min(F.when(F.col("_border.opens"), F.col("_rank"))).alias("_from"),
        F.coalesce(F.min(F.when(~F.col("_border.opens"), F.col("_rank"))), F.max("_ranks")).alias("_to"),
        *[F.any_value(f"_win_{n}").alias(f"_win_{n}") for n in names],
    ).filter(F.col("_from").isNotNull())

    def nodes(level: Column) -> Column:
        low, high = F.ceil(F.col("_from") / F.pow(F.lit(2), level)).cast("long"), F.floor(F.col("_to") / F.pow(F.lit(2), level)).cast("long")
        some = low < high
        return F.array(
            F.when(some & (low % 2 == 1), F.struct(level.alias("level"), low.alias("index"))),
            F.when(some & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).alias("index"))),
        )

    deep = F.least(F.lit(LEVELS), F.ceil(F.log2(F.col("_to") - F.col("_from") + 1)).cast("int"))
    ranges = covers.withColumn("_node", F.explode(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), deep), nodes)))))
    best = ranges.groupBy(*cell, "_node").agg(*[F.min(F.when(F.col(f"_win_{n}").isNotNull(), F.struct("_order", f"_win_{n}"))).alias(f"_win_{n}") for n in names])
    leaves = ranked.groupBy(*cell, F.col("_border.at").alias("_at"), "_rank").agg(F.max("_ranks").alias("_ranks"))
    above = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.col("_ranks") + 1)).cast("int")), lambda x: F.struct(x.alias("level"), F.floor(F.col("_rank") / F.pow(F.lit(2), x)).cast("long").alias("index")))
    asked = leaves.withColumn("_node", F.explode(above)).join(best, [*cell, "_node"], "left")
    return asked.groupBy(*keys, "_at").agg(*[F.min(f"_win_{n}").alias(f"_win_{n}") for n in names]).select(
        *keys, F.timestamp_micros("_at").cast(periods.schema[start].dataType).alias("_at"), *[F.col(f"_win_{n}._win_{n}").alias(n) for n in names]
    )


def interval_match(
    points: DataFrame,
    periods: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    order: Sequence[str],
    values: Sequence[str],
    cell_seconds: int = DAY,
) -> DataFrame:
    """First period (by ``order``) with ``start <= at < end``, as struct ``_period``.

    Periods are cut into disjoint segments, of which each point takes the last
    one at or before it. ``order`` must be unique within a key. Points without
    a period keep a null ``_period``.
    """
    fields = [start, end, *[v for v in values if v not in (start, end)]]
    cut = segments(periods, keys, start, end, order, {"_period": (F.lit(True), F.struct(*fields))}, cell_seconds)
    rows = cut.select(*keys, "_at", F.struct(F.col("_period").alias("row")).alias("_value"))
    return around(points, {"_held": rows}, keys, at, ("prev",)).withColumn("_period", F.col("_held_prev.row")).drop("_held_prev")
