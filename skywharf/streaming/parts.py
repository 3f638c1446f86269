"""Mergeable parts of micro-batches, folded so that a long-running stream keeps few folders.

Each batch writes its parts to a folder of its own. When ``fold`` folders of one level are there, they are merged into
one folder of the next level, whose name tells the batches it holds. A folder counts once its writer has finished, and
from then on stands in for every folder whose batches it holds: readers see either all of a merge or nothing of it, a
merge that died is written again, and a repeated batch that was merged already is left alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLD = 16


@dataclass(frozen=True)
class Part:
    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"part-{self.level}-{self.first}-{self.last}"

    def holds(self, other: Part) -> bool:
        return self.level > other.level and self.first <= other.first and other.last <= self.last


def _finished(spark: SparkSession, path: str) -> list[Part]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = []
    for status in files.listStatus(root):
        match = re.fullmatch(r"part-(\d+)-(\d+)-(\d+)", status.getPath().getName())
        if match and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(Part(*map(int, match.groups())))
    return found


def live_parts(spark: SparkSession, path: str) -> list[Part]:
    """Finished folders that no finished folder of a higher level stands in for, by batch."""
    found = _finished(spark, path)
    return sorted((p for p in found if not any(q.holds(p) for q in found)), key=lambda p: p.first)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Parts of all batches so far, partly merged: merge them once more to read totals."""
    return spark.read.parquet(*[f"{path}/{part.name}" for part in live_parts(spark, path)])


def _forget(spark: SparkSession, path: str) -> None:
    """Remove folders that a merge stood in for already when the next one begins; readers of then are done with them."""
    found = _finished(spark, path)
    for part in found:
        if any(q.holds(part) for q in found):
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part.name}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def part_sink(path: str, build: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], fold: int = FOLD) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of ``build(batch)``; ``merge`` adds up parts into parts of the same columns."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, Part(0, batch_id, batch_id)
        if any(part.holds(own) for part in _finished(spark, path)):
            return
        build(batch).write.mode("overwrite").parquet(f"{path}/{own.name}")
        level = 0
        while True:
            ready = [part for part in live_parts(spark, path) if part.level == level]
            if len(ready) < fold:
                return
            _forget(spark, path)
            merged = Part(level + 1, ready[0].first, ready[-1].last)
            merge(spark.read.parquet(*[f"{path}/{part.name}" for part in ready])).write.mode("overwrite").parquet(f"{path}/{merged.name}")
            level += 1

    return write


def keyed_parts(batch: DataFrame, batch_id: int, keys: Sequence[str], order: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """One row for each key of a batch: its last version, and its first one for the ``kept`` columns.

    Versions are ordered by batch and then by ``order``; what a later batch brings is newer.
    """
    place = F.struct(F.lit(batch_id).cast("long").alias("_batch"), *order)
    last = [c for c in batch.columns if c not in keys and c not in kept]
    return batch.groupBy(*keys).agg(
        F.max(place).alias("_last_place"), F.max_by(F.struct(*last), place).alias("_last"), F.min(place).alias("_first_place"),
        F.min_by(F.struct(*(kept or order)), place).alias("_first"),
    )


def keyed_merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of several batches as parts: combined by key before they are shuffled."""
    return parts.groupBy(*keys).agg(
        F.max("_last_place").alias("_last_place"), F.max_by("_last", "_last_place").alias("_last"), F.min("_first_place").alias("_first_place"),
        F.min_by("_first", "_first_place").alias("_first"),
    )


def keyed_sink(path: str, keys: Sequence[str], order: Sequence[str], kept: Sequence[str] = (), fold: int = FOLD) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of an upserted table as deltas: a batch writes its own keys and nothing else.

    Columns but keys and ``kept`` are those of the last version of a key, ``kept`` ones those of the first. Deltas are
    folded as all parts are, so a row is written again once for each level.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        part_sink(path, lambda rows: keyed_parts(rows, batch_id, keys, order, kept), lambda parts: keyed_merged(parts, keys), fold)(batch, batch_id)

    return write


def keyed_table(spark: SparkSession, path: str, keys: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """The upserted table: deltas merged as they are read."""
    merged = keyed_merged(read_parts(spark, path), keys)
    return merged.select(*keys, "_last.*", *[F.col(f"_first.{c}").alias(c) for c in kept])
