"""Rows carried whole through joins, so that no column of theirs can clash with a column of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts are long, and the usual 10,000 of them take tens of megabytes outside the heap.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Have the session hand texts to Python in batches of TEXT_ROWS rows; a smaller setting of its own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)


def carried(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), row_id (doc_id) and row_key (hash of the text)."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_key"))


def matching(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` with (``left_semi``) or without (``left_anti``) their doc_id and text_key in ``found``."""
    keys = found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")).distinct()
    same = F.col("row_id").eqNullSafe(F.col("found_id")) & (F.col("row_key") == F.col("found_key"))
    return carried(docs).join(keys, same, how).select("row.*")
