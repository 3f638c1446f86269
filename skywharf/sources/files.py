"""Observation files, landing folders, reports and appended tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywharf.functions.text import local_time, nan_to_null
from skywharf.operators.cleaning import keep_last, normalize_archive
from skywharf.schema import ARCHIVE_MEASURES, OBSERVATION_ALIASES

PARQUET_SUFFIXES = (".parquet", ".pq")
# Encodings archives come in; the last two need the Java charset switch.
ENCODINGS = ["UTF-8", "Big5", "MS950"]
JAVA_CHARSETS = {"Big5", "MS950"}


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or CSV by suffix. CSV columns are read as text unless a schema is given."""
    if path.rstrip("/").lower().endswith(PARQUET_SUFFIXES):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def rename_aliases(df: DataFrame, aliases: dict[str, str] = OBSERVATION_ALIASES) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in aliases.items() if old in df.columns and new not in df.columns})


def load_observations(spark: SparkSession, path: str, schema: T.StructType | None = None, aliases: dict[str, str] = OBSERVATION_ALIASES,
                      start: str | None = None, end: str | None = None) -> DataFrame:
    """Observation file with canonical column names and NaN turned into null.

    The optional inclusive time range is applied to the raw column, so it
    reaches the Parquet scan.
    """
    named = rename_aliases(read_any(spark, path, schema), aliases)
    if start is not None:
        named = named.filter(F.col("obs_time") >= F.lit(start).cast(named.schema["obs_time"].dataType))
    if end is not None:
        named = named.filter(F.col("obs_time") <= F.lit(end).cast(named.schema["obs_time"].dataType))
    doubles = [f.name for f in named.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return named.withColumns({c: nan_to_null(F.col(c)) for c in doubles}) if doubles else named


def station_from_path() -> Column:
    """File stem, used as station id when a file has no such column."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)


def collect_data(spark: SparkSession, paths: dict[str, str], start: str | None = None, end: str | None = None,
                 stations: Sequence[str] | None = None, aliases: dict[str, str] = OBSERVATION_ALIASES) -> DataFrame:
    """Union of source folders by column name, with time and station filters on rows.

    ``paths`` maps a source name to its path. Both filters apply to rows, and
    the time range is inclusive.
    """
    out = None
    for source, path in paths.items():
        raw = read_any(spark, path)
        if "station_id" not in raw.columns:
            raw = raw.withColumn("station_id", station_from_path())
        part = rename_aliases(raw, aliases)
        if start is not None or end is not None:
            time_type = part.schema["obs_time"].dataType
            if isinstance(time_type, T.StringType):
                part = part.withColumn("obs_time", F.col("obs_time").try_cast("timestamp"))
                time_type = T.TimestampType()
            if start is not None:
                part = part.filter(F.col("obs_time") >= F.lit(start).cast(time_type))
            if end is not None:
                part = part.filter(F.col("obs_time") <= F.lit(end).cast(time_type))
        if stations is not None:
            part = part.filter(F.col("station_id").isin(list(stations)))
        part = part.withColumn("source", F.lit(source)) if "source" not in part.columns else part
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def java_charset(spark: SparkSession, encoding: str) -> None:
    if encoding in JAVA_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def load_archive_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", station_id: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Historical archive CSV in one encoding, normalised.

    Landing folders hold one encoding each. The station is ``station_id``,
    else that of the folder (``station_id=...``), else the part of the file
    name before the first underscore. A mark before the first column name is
    ignored; ``carry`` names columns to keep as text.
    """
    java_charset(spark, encoding)
    raw = spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE").csv(path)
    by_folder = F.col("station_id") if "station_id" in raw.columns else F.split(F.col("_metadata.file_name"), r"[_.]")[0]
    station = F.lit(station_id) if station_id else by_folder
    columns = [F.col(f"`{c}`") for c in raw.columns if c != "station_id"]
    return normalize_archive(raw.select(*columns, station.cast("string").alias("_station")), F.col("_station"), carry)


def write_archive_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """Archive CSV in one encoding with a folder for each station. Runs a job."""
    java_charset(df.sparkSession, encoding)
    df.hint("rebalance", "station_id").write.option("header", True).option("encoding", encoding).partitionBy("station_id").csv(path)


def write_observations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by day, so time filters prune folders. Runs a job.

    Rows are gathered by day and split again by size, so that a busy day is
    written by as many tasks as it needs.
    """
    daily = df.withColumn("obs_date", F.to_date("obs_time"))
    daily.hint("rebalance", "obs_date").write.mode(mode).partitionBy("obs_date").parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Report rows; the commit protocol makes the replacement all-or-nothing. Runs a job."""
    df.write.mode("overwrite").format(fmt).save(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Append long metric rows to a summary table. Runs a job."""
    df.write.mode("append").parquet(path)


def append_dedupe(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("station_id", "obs_time"), order: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    """Union by name, then the last row per key; by time alone without a station column."""
    both = existing.unionByName(incoming, allowMissingColumns=True)
    used = [k for k in keys if k in both.columns]
    return keep_last(both, used, list(order))


def read_landing_archive(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Archives of several encodings: folder path per encoding, stacked by name."""
    out = None
    for encoding, folder in folders.items():
        part = load_archive_csv(spark, folder, encoding)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def parse_local_times(df: DataFrame, column: str = "obs_time", zone: str = "Asia/Taipei") -> DataFrame:
    return df.withColumn(column, local_time(F.col(column), zone)).filter(F.col(column).isNotNull())


ARCHIVE_OUTPUT = ["obs_time", "station_id", *ARCHIVE_MEASURES]
