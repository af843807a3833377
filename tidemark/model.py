"""The data model: labelled points, series, and how tables become them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType(
    [
        T.StructField("metric", T.StringType(), False),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType(), False), False),
        T.StructField("timestamp", T.LongType(), False),
        T.StructField("value", T.DoubleType(), False),
        T.StructField("lsn", T.LongType(), False),
    ]
)

#: Nanoseconds.
SECOND = 1_000_000_000
HOUR = 3_600 * SECOND
DAY = 24 * HOUR
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def canonical(labels: Column) -> Column:
    """The map with its entries in order of (key, value)."""
    return F.map_from_entries(F.array_sort(F.map_entries(labels)))


def escaped(x: Column) -> Column:
    """With a backslash before the characters that a series' name is built with, so that no two series have one name."""
    return F.regexp_replace(x, r"([\\,={}])", r"\\$1")


def labels_key(labels: Column) -> Column:
    """``k=v,...`` in order of (key, value); different maps never have the same key."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(escaped(e["key"]), F.lit("="), escaped(e["value"])))
    return F.array_join(pairs, ",")


def series_key(metric: Column | str = "metric", labels: Column | str = "labels") -> Column:
    """``metric{k=v,...}`` with sorted labels: the readable identity of a series."""
    metric, labels = (F.col(x) if isinstance(x, str) else x for x in (metric, labels))
    return F.concat(escaped(metric), F.lit("{"), labels_key(labels), F.lit("}"))


def series_id(key: Column) -> Column:
    """64-bit identity; only ever printed by ``hex16``, which sorts as the unsigned number."""
    return F.xxhash64(key)


def hex16(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number)), 16, "0")


def nanos(ts: str) -> Column:
    """Nanoseconds of a zone-less timestamp column, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts}) * 1000")


def ntz(ns: int) -> str:
    """SQL literal of the zone-less timestamp at or before ``ns``, for predicates that reach the scan."""
    seconds, rest = divmod(ns, SECOND)
    return f"timestampadd(MICROSECOND, {rest // 1000}L, timestampadd(SECOND, {seconds}L, {EPOCH}))"


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def points(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None, metric: str | None = None, user_id: int | None = None) -> DataFrame:
    """The events table as points, with series_key. Bounds, the metric and the label are also set on the stored columns, so
    files and row groups without them are skipped."""
    events = events_table(spark, sf_dir)
    if start is not None:
        events = events.where(F.expr(f"ts >= {ntz(start)}"))
    if end is not None:
        events = events.where(F.expr(f"ts <= {ntz(end)}"))
    if metric is not None:
        events = events.where(F.col("event_type") == metric)
    if user_id is not None:
        events = events.where(F.col("user_id") == user_id)
    found = events.select(
        F.col("event_type").alias("metric"), F.create_map(F.lit("user_id"), F.col("user_id").cast("string")).alias("labels"),
        nanos("ts").alias("timestamp"), "value", (F.col("event_id") + 1).alias("lsn"),
    ).withColumn("series_key", series_key())
    if start is not None:
        found = found.where(F.col("timestamp") >= start)
    if end is not None:
        found = found.where(F.col("timestamp") < end)
    return found
