"""The changefeed: bounded reads, and a stream of the same files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from honeyframe.sources.store import SCHEMAS


def read_since(feed: DataFrame, after: int, limit: int, ops: tuple[int, ...] = (), keys: Column | None = None) -> DataFrame:
    """At most ``limit`` records after a sequence, in order; none for a limit of 0 or less."""
    rows = feed.filter(F.col("seq") > after)
    if ops:
        rows = rows.filter(F.col("op").isin(*ops))
    if keys is not None:
        rows = rows.filter(keys)
    return rows.orderBy("seq").limit(max(limit, 0))


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The feed of a store as a stream of its commits' files; a consumer applies batches idempotently."""
    return spark.readStream.schema(f"{SCHEMAS['changelog']}, commit_seq long").option("recursiveFileLookup", True).parquet(f"{path.rstrip('/')}/changelog")


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts per window and type; an extension for event tables, batch or stream."""
    rows = events if late is None else events.withWatermark("ts", late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
