"""Streams: an extension, as file sources over event tables and over a dataset's data folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """With a watermark if a stream; those need instants, so a time without zone is taken in the session's zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts and sums of ``value`` by window and keys; the watermark bounds the state.  Works on tables too."""
    e, kind = _timed(events, ts, late), events.schema[ts].dataType
    out = e.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast(kind).alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    e, kind = _timed(events, ts, late), events.schema[ts].dataType
    out = e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast(kind).alias("started"), F.col("w.end").cast(kind).alias("ended"), "n")


def first_seen(events: DataFrame, key: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    return _timed(events, ts, late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)
