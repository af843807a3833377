"""The write-ahead log as a table: sequences, segments, recovery, truncation.

Columns: segment, offset, sequence, kind (point or drop), ok, and a point's or a drop's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of an entry with its frame, and of a segment's header.
ENTRY_BYTES, HEADER_BYTES = 41, 22


def assign_sequences(rows: DataFrame, folder: str, *order: str, start: int = 1) -> DataFrame:
    """``sequence`` from ``start`` on, without a gap, in order of ``order``. Rows are cut into ranges of it, each sorted by
    itself, and written to ``folder``, for a second evaluation might cut them elsewhere; only the ranges' counts, a row
    each, meet in one place. A row's number is its place in its range and the rows of the ranges before."""
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_at": F.monotonically_increasing_id()})
    laid.withColumn("_range", F.shiftright("_at", 33)).write.parquet(folder)
    laid = rows.sparkSession.read.parquet(folder)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = laid.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    place = F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1) + start
    return laid.join(F.broadcast(base), "_range").withColumn("sequence", place).drop("_at", "_range", "_base")  # base: a row for each range


def segments(rows: DataFrame, total: int, batch: int, segment_bytes: int) -> DataFrame:
    """``segment`` of each row by its ``sequence`` (from 1) when full batches are written: a segment is closed before a
    batch that would pass its limit, so none is split, and a batch above the limit leaves an empty segment behind it.

    All batches but the last are equal, so the segment follows from the sequence alone; no row waits for another."""
    per = max(1, (segment_bytes - HEADER_BYTES) // (batch * ENTRY_BYTES))
    first = 1 if HEADER_BYTES + min(batch, total) * ENTRY_BYTES <= segment_bytes else 2
    number = F.floor((F.col("sequence") - 1) / batch)
    segment = F.floor(number / per)
    full, rest = divmod(total, batch)
    if rest and full and full % per == 0 and HEADER_BYTES + (per * batch + rest) * ENTRY_BYTES <= segment_bytes:
        segment = F.when(number == full, segment - 1).otherwise(segment)  # the short last batch still fits
    return rows.withColumn("segment", (segment + first).cast("long"))


def recover(log: DataFrame) -> DataFrame:
    """Entries before the first bad one of each segment. Order by sequence to replay."""
    bad = log.where("not ok").groupBy("segment").agg(F.min("offset").alias("bad"))
    return log.join(bad, "segment", "left").where(F.col("bad").isNull() | (F.col("offset") < F.col("bad"))).drop("bad")


def without_dropped(points: DataFrame, drops: DataFrame) -> DataFrame:
    """Points (part_start) of partitions that no tombstone (partition_start) names."""
    gone = drops.select(F.col("partition_start").alias("part_start")).distinct()
    return points.join(gone, "part_start", "left_anti")


def truncatable(log: DataFrame, up_to: int) -> DataFrame:
    """Closed segments that hold nothing above ``up_to``; the newest one never, and none with unreadable entries."""
    current = log.agg(F.max("segment").alias("current"))
    stats = log.groupBy("segment").agg(F.max("sequence").alias("last"), F.min("ok").alias("readable"))
    return stats.crossJoin(F.broadcast(current)).where((F.col("last") <= up_to) & (F.col("segment") < F.col("current")) & F.col("readable")).select("segment", "last")  # current: one row


def resume(log: DataFrame) -> DataFrame:
    """Where a reopened log goes on, over readable entries."""
    return log.agg(
        (F.coalesce(F.max("segment"), F.lit(0)) + 1).alias("next_segment"), (F.coalesce(F.max(F.when(F.col("ok"), F.col("sequence"))), F.lit(0)) + 1).alias("next_sequence")
    )
