"""Independent model fits side by side over one stored table of feature vectors.

A boosted fit is a long chain of small jobs, and one chain leaves most of a cluster idle. Fits that do not depend on each
other run in threads of the driver, which only submit jobs; rows and trees stay with the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession

from skywharf.session import cut_lineage

#: Fits that one call submits at a time, and rows of a partition of the vector table.
AT_ONCE, PART_ROWS = 8, 50_000

Result = TypeVar("Result")


def side_by_side(spark: SparkSession, builds: Sequence[Callable[[], Result]], at_once: int = AT_ONCE) -> list[Result]:
    """Results of ``builds`` in their order. Each thread has the caller's job group, pool and tags; the first error is raised."""
    if len(builds) < 2:
        return [build() for build in builds]
    with ThreadPoolExecutor(min(len(builds), at_once)) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(build)) for build in builds]
        return [future.result() for future in futures]


def vectors(rows: DataFrame, features: Sequence[str], keep: Sequence[str], store: bool = True) -> DataFrame:
    """``keep`` and the vector ``features``; stored, it has a partition for each PART_ROWS rows, so a fit reads nothing twice.

    A partition is the smallest task of every job of a fit: small tables get one, large ones keep theirs.
    """
    table = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows).select(*keep, "features")
    if not store:
        return table
    table = cut_lineage(table)
    parts = table.count() // PART_ROWS + 1
    return cut_lineage(table.coalesce(parts)) if parts < table.rdd.getNumPartitions() else table
