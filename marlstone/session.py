"""A session with the settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(name: str = "marlstone", **conf: str) -> SparkSession:
    """Adaptive plans, UTC, Arrow; further settings by keyword with dots written as two underscores."""
    b = SparkSession.builder.appName(name)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.parquet.filterPushdown": "true"}
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def register(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> None:
    """A temporary view for each table of ``folder``."""
    for t in tables:
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)
