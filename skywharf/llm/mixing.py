"""Mixing sources to target weights by capped water-filling.

Sources share a total by weight. A share above ``max_epochs`` times the source's size is clamped there, and the excess
is shared again by weight until no share is above. Whole repetitions take every document; the fraction takes
documents in a seeded order until its words are used up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skywharf.session import cut_lineage

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def source_sizes(sized: DataFrame) -> DataFrame:
    """source, position in code-point order (null last) and size; ranked by a distributed sort, not in one task."""
    sizes = cut_lineage(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda pair: (pair[0][0], pair[0][1], pair[1]))
    return sizes.sparkSession.createDataFrame(ranked, "source string, source_size long, rank long")


def water_level(sources: DataFrame, total: float, max_epochs: int) -> float:
    """Words for each unit of weight at which the clamped shares sum to ``total``; infinite if all are clamped.

    The level only rises from round to round, so it is all the state: a source is clamped when its weight times the
    level exceeds its cap. One small aggregation a round; every round but the last clamps one source more at least.
    """
    cap, level = F.col("source_size") * max_epochs, 0.0
    while True:
        over = F.col("weight") * F.lit(level) > cap
        clamped, weight = sources.agg(F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if not weight:
            return float("inf")
        following = (total - clamped) / weight
        if following <= level:
            return level
        level = following


def mix(docs: DataFrame, share: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", digits: int = 3) -> DataFrame:
    """row (all columns of ``docs``), size, source_size, target, copies and taken for each row of ``docs`` (doc_id, source, text).

    ``weights`` repeat over the sources in code-point order, null last. ``digits`` of the seeded order (hexadecimal)
    split each source into ranges that are summed first, so that no source is walked by one task. A document takes
    part in the fraction when at least half of it fits. Null and empty texts have size 0 and take 0 words. Repeated
    rows count one by one. Empty tables stay empty.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    keyed = docs.select(F.struct("*").alias("row"), "source", F.col("doc_id").alias("id"), size.alias("size"), order.alias("order"), F.substring(order, 1, digits).alias("range"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    sources = cut_lineage(source_sizes(keyed).withColumn("weight", weight))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, share * total, max_epochs) if total else 0.0
    cap = F.col("source_size") * F.lit(float(max_epochs))
    share_of = F.col("weight") * F.lit(level)
    plan = sources.select(
        F.col("source").alias("plan_source"), "source_size", F.when(share_of > cap, cap).otherwise(share_of).cast("double").alias("target"),
    ).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    ranges = keyed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select(F.col("source").alias("start_source"), F.col("range").alias("start_range"), before.alias("before"))
    starts = starts.join(plan, F.col("start_source").eqNullSafe(F.col("plan_source")))
    within = F.sum("size").over(
        Window.partitionBy("source", "range").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("size")
    joined = keyed.withColumn("within", within).join(starts, F.col("source").eqNullSafe(F.col("start_source")) & (F.col("range") == F.col("start_range")))
    extra = (2 * (F.col("before") + F.col("within")) + F.col("size") <= 2 * F.col("part")).cast("long")
    copies = F.when(F.col("size") > 0, F.least(F.col("whole") + extra, F.lit(max_epochs))).otherwise(0).cast("long")
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeat(mixed: DataFrame) -> DataFrame:
    """The rows of a mix, each as often as it is taken, with their own columns."""
    rows = mixed.where(F.col("copies") > 0)
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
