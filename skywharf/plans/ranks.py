"""Exact order statistics without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = 128


def value_buckets(df: DataFrame, groups: Sequence[str], value: str, splits: int = SPLITS) -> DataFrame:
    """Distinct values with counts, the group total, and an order-preserving bucket.

    Bucket borders come from a mergeable quantile sketch, so a crowded value
    range is spread over many buckets. The sketch only balances the work;
    results do not depend on its accuracy.
    """
    groups = list(groups)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_count"))
    return bordered(counted.withColumnRenamed("_count", "_n"), groups, value, "_n", splits).withColumnsRenamed({"_n": "_count", "_total": "_n"})


def bordered(counted: DataFrame, groups: Sequence[str], value: str, weight: str, splits: int = SPLITS) -> DataFrame:
    """Add ``_bucket``, monotone in value, and ``_total``, the sum of ``weight`` of the group, to distinct values.

    Borders and totals come from the counted values, so the input is read once
    and the counting shuffle is shared.
    """
    shape = counted.groupBy(*groups).agg(
        F.percentile_approx(value, [i / splits for i in range(1, splits)], 1000).alias("_borders"), F.sum(weight).alias("_total")
    )
    bucket = F.size(F.filter("_borders", lambda b: b < F.col(value)))
    return attach(counted, shape, groups).withColumn("_bucket", bucket).drop("_borders")


def attach(df: DataFrame, grouped: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Join aggregates back to their groups; one global row comes as a scalar subquery, without a join."""
    if groups:
        return df.join(grouped, list(groups))
    row = grouped.select(F.struct("*").alias("_row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, "_row.*")


def cumulative_counts(df: DataFrame, groups: Sequence[str], value: str, counts: Sequence[str]) -> DataFrame:
    """Add ``<count>_before``: the sum of each count over strictly smaller values.

    ``df`` has one row per (groups, value) with a ``_bucket`` that is monotone in value.
    """
    groups = list(groups)
    inside = Window.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = df.groupBy(*groups, "_bucket").agg(*[F.sum(c).alias(c) for c in counts])
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_bucket.select(
        *groups, "_bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_shift_{c}") for c in counts]
    )
    out = df.join(shifts, [*groups, "_bucket"])
    return out.withColumns(
        {
            f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_shift_{c}")
            for c in counts
        }
    ).drop(*[f"_shift_{c}" for c in counts])


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per named probability.

    Positions are ``p * (n - 1)``; the two neighbouring order statistics are
    picked from running counts over distinct values.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_weight"))
    return counted_quantiles(counted, groups, value, "_weight", probabilities)


def counted_quantiles(
    counted: DataFrame, groups: Sequence[str], value: str, weight: str, probabilities: dict[str, float]
) -> DataFrame:
    """``exact_quantiles`` of values that are counted already: one row for each distinct value, with its count."""
    groups = list(groups)
    shaped = bordered(counted, groups, value, weight).withColumnsRenamed({weight: "_count", "_total": "_n"})
    ranked = cumulative_counts(shaped, groups, value, ["_count"])
    first, last = F.col("_count_before"), F.col("_count_before") + F.col("_count") - 1

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position <= last), F.col(value)))

    aggregates, names = [], []
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("_n") - 1)
        aggregates += [
            at(F.floor(place)).alias(f"_lo_{name}"),
            at(F.ceil(place)).alias(f"_hi_{name}"),
            F.max(place - F.floor(place)).alias(f"_w_{name}"),
        ]
        names.append(name)
    picked = ranked.groupBy(*groups).agg(*aggregates)
    return picked.select(
        *groups,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in names
        ],
    )
