"""Reading points: ranges, series, catalogues and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeops import align, block_overlaps, in_range, overlaps


def scan(points: DataFrame, start: int, end: int, width: int | None = None) -> DataFrame:
    """Points in [start, end). With ``width``, the table has a partition column part_start, and its bounds are added:
    partition pruning cannot be derived from the timestamp alone."""
    found = points.where(in_range("timestamp", start, end))
    return found.where(overlaps("part_start", width, start, end)) if width else found


def block_stats(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("point_count"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"), F.max("lsn").alias("max_lsn")
    )


def pruned_blocks(blocks: DataFrame, start: int, end: int) -> DataFrame:
    return blocks.where(block_overlaps(F.col("min_ts"), F.col("max_ts"), start, end))


def series_points(points: DataFrame, key: str) -> DataFrame:
    """One series in order of time; nothing if it does not exist."""
    return points.where(F.col("series_key") == key).select("timestamp", "value").orderBy("timestamp")


def catalog(points: DataFrame) -> DataFrame:
    """A row for each series."""
    return points.groupBy("series_key").agg(F.max("metric").alias("metric"), F.count(F.lit(1)).alias("points"))


def enrich(samples: DataFrame, series: DataFrame) -> DataFrame:
    """Series metadata beside samples (series_key, timestamp, value); without metadata it is empty."""
    found = samples.join(series.select("series_key", "metric", "labels"), "series_key", "left")
    return found.withColumn("metric", F.coalesce("metric", F.lit("")))


def last_write(points: DataFrame, order: Column, *keys: str) -> DataFrame:
    """One value for each key: that of the greatest ``order``, which must be unique within a key."""
    return points.groupBy(*keys).agg(F.max_by("value", order).alias("value"), F.count(F.lit(1)).alias("writes"))


def hot_and_cold(hot: DataFrame, cold: DataFrame, *keys: str) -> DataFrame:
    """Both sides as one table, the last write of each key."""
    return last_write(hot.unionByName(cold), F.col("lsn"), *keys)


def with_partition(points: DataFrame, width: int) -> DataFrame:
    return points.withColumn("part_start", align("timestamp", width))
