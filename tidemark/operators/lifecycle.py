"""Partitions: statistics, flushing, retention, and the log position that is safe to cut."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeops import align, expired
from tidemark.model import DAY

#: Accounted bytes of an insert and of a series besides its names; flush limits.
INSERT_BYTES, SERIES_BYTES = 24, 48
FLUSH_BYTES, FLUSH_AGE, MOST_ACTIVE = 64 << 20, 15 * 60 * 1_000_000_000, 4
PRIORITY = {"size": 0, "age": 1, "count": 2}


class RetentionPolicy(Protocol):
    """What users implement to decide on partitions."""

    def is_expired(self, part_start: Column, width: int, now: int) -> Column: ...


class KeepFor:
    """Keeps a partition for a time after its end; a week unless told otherwise."""

    def __init__(self, ttl: int = 7 * DAY):
        self.ttl = ttl

    def is_expired(self, part_start: Column, width: int, now: int) -> Column:
        return expired(part_start, width, self.ttl, now)


def label_bytes(labels: Column) -> Column:
    sizes = F.transform(F.map_entries(labels), lambda e: F.octet_length(e["key"]) + F.octet_length(e["value"]))
    return F.aggregate(sizes, F.lit(0), lambda a, x: a + x)


def memtable_stats(points: DataFrame) -> DataFrame:
    """Per partition (part_start): inserts (overwrites too), series, accounted bytes, first and last time."""
    by_series = points.groupBy("part_start", "series_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.max("lsn").alias("lsn"),
        F.max(F.octet_length("metric") + label_bytes(F.col("labels"))).alias("names"),
    )
    return by_series.groupBy("part_start").agg(
        F.sum("n").alias("inserts"), F.count(F.lit(1)).alias("series"),
        (F.sum("n") * INSERT_BYTES + F.sum(F.col("names") + SERIES_BYTES)).alias("bytes"),
        F.min("lo").alias("min_ts"), F.max("hi").alias("max_ts"), F.max("lsn").alias("max_lsn"),
    )


def manager_stats(partitions: DataFrame) -> DataFrame:
    return partitions.agg(
        F.count(F.lit(1)).alias("partitions"), F.sum("inserts").alias("inserts"), F.sum("bytes").alias("bytes"),
        F.min("part_start").alias("oldest"), F.max("part_start").alias("newest"),
    )


def flush_summary(points: DataFrame) -> DataFrame:
    """Per partition what a flush writes: series, points after the last write of each time won, bounds."""
    distinct = points.groupBy("part_start", "series_key", "timestamp").agg(F.max("lsn").alias("lsn"))
    return distinct.groupBy("part_start").agg(
        F.countDistinct("series_key").alias("series"), F.count(F.lit(1)).alias("points"), F.min("timestamp").alias("min_ts"),
        F.max("timestamp").alias("max_ts"), F.max("lsn").alias("max_lsn"),
    )


def flush_candidates(partitions: DataFrame, now: int, most_bytes: int = FLUSH_BYTES, most_age: int = FLUSH_AGE, most_active: int = MOST_ACTIVE) -> DataFrame:
    """(part_start, priority) of the partitions to flush, by size, then age, then because too many are active: of all
    partitions the oldest that are too many, unless chosen already. ``partitions``: part_start, bytes, created.

    The rank runs over partitions, of which there is a row each, not over points."""
    rank = F.row_number().over(Window.orderBy("part_start"))
    total = F.count(F.lit(1)).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = partitions.withColumn("rank", rank).withColumn("total", total)
    priority = (
        F.when(F.col("bytes") >= most_bytes, PRIORITY["size"]).when(F.lit(now) - F.col("created") >= most_age, PRIORITY["age"])
        .when(F.col("rank") <= F.col("total") - most_active, PRIORITY["count"])
    )
    return ranked.withColumn("priority", priority).where("priority is not null").select("part_start", "priority", "bytes")


def flush_next(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy("priority", "part_start").limit(1)


def writable(points: DataFrame, state: DataFrame) -> DataFrame:
    """Points whose partition is active, or unknown, and not being flushed. ``state``: part_start, state, flushing."""
    closed = state.where((F.coalesce("state", F.lit("Active")) != "Active") | F.coalesce("flushing", F.lit(False)))
    return points.join(closed.select("part_start"), "part_start", "left_anti")


def route(points: DataFrame, width: int) -> DataFrame:
    return points.withColumn("part_start", align("timestamp", width))


def safe_lsn(flushed: DataFrame, pending: DataFrame) -> DataFrame:
    """The log position up to which everything is in files. ``flushed``: part_start, lsn, seq (the latest notice of a
    partition counts); ``pending``: lsn of drops that are recorded and not complete."""
    latest = flushed.groupBy("part_start").agg(F.max_by("lsn", "seq").alias("lsn")).agg(F.min("lsn").alias("a"))
    drops = pending.agg(F.min("lsn").alias("b"))
    low = F.least(F.col("a"), F.when(F.col("b").isNotNull(), F.greatest(F.col("b") - 1, F.lit(0))))
    return latest.crossJoin(drops).select(F.when(F.col("a").isNotNull(), low).alias("safe_lsn"))  # one row each
