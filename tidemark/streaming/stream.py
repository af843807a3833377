"""Streams: appending points, last writes, continuous queries, and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.model import nanos
from tidemark.sources.engine import Engine
from tidemark.sources.store import Store


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1, glob: str = "events*.parquet") -> DataFrame:
    """Points, with ``time`` for watermarks, from event files as they arrive in a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(folder)
    return rows.select(
        F.col("event_type").alias("metric"), F.create_map(F.lit("user_id"), F.col("user_id").cast("string")).alias("labels"), nanos("ts").alias("timestamp"),
        "value", (F.col("event_id") + 1).alias("lsn"), F.col("ts").cast("timestamp").alias("time"),
    )


def append(points: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Every micro-batch becomes one append. A batch that runs again appends the same points with the same lsn, which the
    last write absorbs."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.insert(batch.drop("time"))

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(points: DataFrame, engine: Engine, checkpoint: str, **limits: int) -> StreamingQuery:
    """Every micro-batch is logged and inserted, and then whatever is due is flushed: partitions that are too large, too old,
    or too many (``limits`` as in ``flush_candidates``)."""

    def take(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.insert(batch.select("metric", "labels", "timestamp", "value"))
        engine.flush_due(**limits)

    return points.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def continuous(points: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums of each metric in tumbling windows; a window is given out once its watermark has passed."""
    windows = points.withWatermark("time", late).groupBy(F.window("time", width), "metric")
    return windows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "metric", "n", "total")


def without_repeats(points: DataFrame, late: str) -> DataFrame:
    """The first of points with one lsn, while it is not later than ``late``."""
    return points.withWatermark("time", late).dropDuplicatesWithinWatermark(["lsn"])


def last_writes(points: DataFrame) -> DataFrame:
    """Last write of each (metric, labels, timestamp) as a stream in update mode; the state keeps one value each."""
    keyed = points.select("metric", F.to_json("labels").alias("labels"), "timestamp", "value", "lsn")
    return keyed.groupBy("metric", "labels", "timestamp").agg(F.max_by("value", "lsn").alias("value"), F.max("lsn").alias("lsn"))
