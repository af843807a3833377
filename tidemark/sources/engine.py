"""The store and its log as one: inserts are durable before they are visible, hot points live in the log until a flush.

A point is logged first and so has a sequence number; what the log holds above the number that its partition was flushed up
to is hot. Reads merge hot points and files. A flush writes the hot points of a partition as one generation and then notes
the number; a crash between the two leaves points in both places, which the last write absorbs.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import PartitionNotFound
from tidemark.functions.timeops import in_range
from tidemark.model import HOUR
from tidemark.operators import lifecycle
from tidemark.operators.lifecycle import KeepFor, RetentionPolicy
from tidemark.sources.log import Log
from tidemark.sources.store import Store


@dataclass
class Engine:
    """``root`` may be any address that Spark's file systems open."""

    spark: SparkSession
    root: str
    width: int = HOUR
    retention: RetentionPolicy = field(default_factory=KeepFor)
    segment_rows: int = 1_000_000
    #: When this process first saw hot points of a partition: what a flush by age goes by.
    created: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        """Opens, and after a crash recovers: drops that the log has are done again, and what is left of it is hot."""
        self.store = Store(self.spark, f"{self.root}/store", self.width, self.retention)
        self.log = Log(self.spark, f"{self.root}/log", self.segment_rows)
        self.recovered = self.recover()

    def recover(self) -> list[int]:
        drops = self.log.entries().where("kind = 'drop'").select("partition_start").distinct()
        logged = [r[0] for r in drops.collect()]  # a row for each dropped partition
        self.store.set_state("Dropping", *[p for p in logged if self.store.states.get(p) != "Dropped"])
        return self.store.recover()

    # -- writing -----------------------------------------------------------------------------------------------------
    def insert(self, points: DataFrame, partition: int | None = None, now: int | None = None) -> int:
        """Check every point, log all, and only then let them be seen; returns the last sequence number. Where the check or
        the log fails, nothing was inserted."""
        rows = self.store.prepared(points)
        self.store.check_writable(rows, partition)
        before = self.log.current_sequence()
        last = self.log.append(points)
        now = time.time_ns() if now is None else now
        new = self.hot().where(F.col("lsn") > before).select("part_start").distinct()
        for r in new.collect():  # a row for each partition that was written
            self.created.setdefault(r[0], now)
        return last

    # -- reading -----------------------------------------------------------------------------------------------------
    def flushed(self) -> DataFrame:
        """(part_start, flushed): the number up to which a partition is in files."""
        return self.store.control().where("kind = 'flushed'").groupBy("part_start").agg(F.max("lsn").alias("flushed"))

    def hot(self) -> DataFrame:
        """Logged points that no flush has taken."""
        rows = self.store.prepared(self.log.recover())
        hot = rows.join(F.broadcast(self.flushed()), "part_start", "left")  # a row for each partition
        return hot.where(F.col("flushed").isNull() | (F.col("lsn") > F.col("flushed"))).drop("flushed")

    def scan(self, start: int, end: int) -> DataFrame:
        """Last writes in [start, end), of hot points and files alike."""
        hot = self.hot().where(in_range("timestamp", start, end)).withColumn("level", F.lit(0)).withColumn("generation", F.lit(0))
        rows = self.store.raw(start, end).unionByName(hot)
        return self.store.latest(rows).select("metric", "labels", "series_key", "timestamp", "value")

    # -- flushing ----------------------------------------------------------------------------------------------------
    def stats(self) -> DataFrame:
        """Of every partition with hot points: inserts, series, accounted bytes, bounds, and when it was first seen."""
        now = time.time_ns()
        seen = self.spark.createDataFrame(list(self.created.items()), "part_start bigint, created bigint")
        return lifecycle.memtable_stats(self.hot()).join(F.broadcast(seen), "part_start", "left").withColumn("created", F.coalesce("created", F.lit(now)))

    def candidates(self, now: int | None = None, **limits: int) -> DataFrame:
        return lifecycle.flush_candidates(self.stats(), time.time_ns() if now is None else now, **limits)

    def flush_partition(self, partition: int) -> dict[str, int]:
        """Hot points of a partition become one generation of files: all of them or none. While it runs the partition takes
        no points; where it fails, it takes them again and its points stay hot."""
        self.store.mark_flushing(partition)
        try:
            rows = self.hot().where(F.col("part_start") == partition)
            found = rows.agg(F.max("lsn").alias("lsn"), F.count(F.lit(1)).alias("inserts"), F.countDistinct("series_key").alias("series")).first()
            if not found["inserts"]:
                raise PartitionNotFound(str(partition))
            latest = self.store.latest(rows.withColumn("level", F.lit(0)).withColumn("generation", F.lit(0)))
            self.store.move_in(latest, 0)
            self.store.note("flushed", [partition], lsn=found["lsn"])
            self.created.pop(partition, None)
        finally:
            self.store.unmark_flushing(partition)
        return found.asDict()

    def flush_next(self, now: int | None = None, **limits: int) -> int | None:
        """Flush the partition that is due first: by size, then age, then because too many are active."""
        first = lifecycle.flush_next(self.candidates(now, **limits)).first()
        if first is None:
            return None
        self.flush_partition(first["part_start"])
        return first["part_start"]

    def flush_due(self, now: int | None = None, **limits: int) -> list[int]:
        """Flush until nothing is due."""
        out = []
        while (p := self.flush_next(now, **limits)) is not None:
            out.append(p)
        return out

    # -- lifecycle ---------------------------------------------------------------------------------------------------
    def compact(self, lsn_scope: str = "block") -> list[dict[str, int]]:
        return self.store.run_compactions(lsn_scope)

    def safe_to_cut(self) -> int:
        """The log's number below which nothing is hot."""
        first = self.hot().agg(F.min("lsn")).first()[0]
        return self.log.current_sequence() if first is None else first - 1

    def ttl_job(self, now: int) -> dict[str, list]:
        """Drop what is over, in files or hot (Dropping, delete, tombstone in the log, Dropped), and cut the log where nothing is hot any more. A partition that cannot be
        dropped does not keep the others; the next run tries it again."""
        hot = [r[0] for r in self.hot().select("part_start").distinct().collect()]  # a row for each hot partition
        over = self.store.expired(sorted({*hot, *self.store.partitions()}), now)
        dropped, failed = [], []
        self.store.set_state("Dropping", *over)
        for p in over:
            try:
                self.store.delete(p)
                dropped.append(p)
            except Exception as e:  # noqa: BLE001 - whatever the file system says
                failed.append((p, str(e)))
        if dropped:  # deleted, then a tombstone each, and only then Dropped
            self.log.append_drops(dropped, self.width)
            self.store.set_state("Dropped", *dropped)
        return {"dropped": dropped, "failed": failed, "segments": self.log.truncate(self.safe_to_cut())}
