"""The write-ahead log on disk: a Parquet table of segments, each a folder that is written once.

A batch becomes a segment, or several when it is larger than ``segment_rows``; its commit is the folder's. Metric and
labels are logged with every point, so a replay needs nothing else."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "sequence bigint, kind string, metric string, labels map<string,string>, timestamp bigint, value double, partition_start bigint, partition_duration bigint, segment bigint"


@dataclass
class Log:
    spark: SparkSession
    root: str
    segment_rows: int = 1_000_000

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def segments(self) -> list[int]:
        files = self._files()
        if not files.exists(self._path()):
            return []
        # A folder without its commit mark was being written when the writer died.
        found = [x.getPath() for x in files.listStatus(self._path()) if x.getPath().getName().startswith("segment=")]
        return sorted(int(p.getName().split("=", 1)[1]) for p in found if files.exists(self._path(p.getName(), "_SUCCESS")))

    def entries(self) -> DataFrame:
        """All committed entries. Order by sequence to replay."""
        known = self.segments()
        if not known:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).option("basePath", self.root).parquet(*[f"{self.root}/segment={s}" for s in known])

    def current_sequence(self) -> int:
        """Sequences rise with the segments, and the newest segment is never cut."""
        known = self.segments()
        if not known:
            return 0
        newest = self.spark.read.schema(ENTRY).option("basePath", self.root).parquet(f"{self.root}/segment={known[-1]}")
        return int(newest.agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0])

    def _append(self, rows: DataFrame) -> int:
        """``rows`` with all columns of an entry but sequence; returns the last sequence.

        Rows are written once to get their numbers, and once into segments. Those are moved in one after another, so a writer
        that dies leaves the first of them; each counts from its commit mark on."""
        files, first, known = self._files(), self.current_sequence(), self.segments()
        segment = (known[-1] if known else 0) + 1
        staged = f"_staged-{uuid.uuid4().hex}"
        # zipWithIndex-like numbers without a single-task window: rank inside the task, offset by tasks before it.
        rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33))
        rows.write.parquet(f"{self.root}/{staged}/rows")
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{staged}/rows")
        counts = sorted((r["task"], r["n"]) for r in rows.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a task
        base, total = [], 0
        for task, n in counts:
            base.append((task, total))
            total += n
        if total:
            offsets = self.spark.createDataFrame(base, "task bigint, base bigint")  # a row a task
            at = F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)
            numbered = rows.join(F.broadcast(offsets), "task").withColumn("sequence", at + (first + 1)).withColumn("segment", F.expr(f"{segment}L + (sequence - {first + 1}L) div {self.segment_rows}L"))
            numbered = numbered.drop("at", "task", "base").sortWithinPartitions("sequence")
            numbered.write.partitionBy("segment").parquet(f"{self.root}/{staged}/segments")
            for i in range(segment, segment + -(-total // self.segment_rows)):
                target = self._path(f"segment={i}")
                files.delete(target, True)  # without its mark, so of a writer that died
                files.rename(self._path(staged, "segments", f"segment={i}"), target)
                files.create(self._path(f"segment={i}", "_SUCCESS")).close()
        files.delete(self._path(staged), True)
        return first + total

    def append(self, points: DataFrame) -> int:
        none = F.lit(None).cast("bigint")
        return self._append(points.select(F.lit("point").alias("kind"), "metric", "labels", "timestamp", "value", none.alias("partition_start"), none.alias("partition_duration")))

    def append_drop(self, partition_start: int, duration: int) -> int:
        return self.append_drops([partition_start], duration)

    def append_drops(self, partition_starts: list[int], duration: int) -> int:
        row = self.spark.createDataFrame([("drop", p, duration) for p in partition_starts], "kind string, partition_start bigint, partition_duration bigint")
        empty = {"metric": "string", "labels": "map<string,string>", "timestamp": "bigint", "value": "double"}
        return self._append(row.select("kind", *[F.lit(None).cast(t).alias(n) for n, t in empty.items()], "partition_start", "partition_duration"))

    def recover(self) -> DataFrame:
        """Points to replay (with lsn): those of no partition that was dropped after they were logged."""
        rows = self.entries()
        drops = rows.where("kind = 'drop'").select("partition_start", (F.col("partition_start") + F.col("partition_duration")).alias("end"), F.col("sequence").alias("dropped"))
        points = rows.where("kind = 'point'").select("metric", "labels", "timestamp", "value", F.col("sequence").alias("lsn"))
        gone = (F.col("timestamp") >= F.col("partition_start")) & (F.col("timestamp") < F.col("end")) & (F.col("lsn") < F.col("dropped"))
        if drops.isEmpty():
            return points
        widths = [r[0] for r in rows.where("kind = 'drop'").select("partition_duration").distinct().limit(2).collect()]
        if len(widths) == 1:  # one width: the partition is a key
            keyed = points.withColumn("partition_start", F.col("timestamp") - F.pmod(F.col("timestamp"), F.lit(widths[0])))
            latest = drops.groupBy("partition_start").agg(F.max("dropped").alias("dropped"))
            kept = keyed.join(latest, "partition_start", "left").where(F.col("dropped").isNull() | (F.col("lsn") > F.col("dropped")))
            return kept.select(*points.columns)
        return points.join(drops, gone, "left_anti")

    def truncate(self, up_to: int) -> list[int]:
        """Delete the closed segments that hold nothing above ``up_to``; the newest one stays."""
        known = self.segments()
        last = {r["segment"]: r["last"] for r in self.entries().groupBy("segment").agg(F.max("sequence").alias("last")).collect()}  # a row a segment
        gone = [s for s in known[:-1] if last.get(s, up_to) <= up_to]
        for s in gone:
            self._files().delete(self._path(f"segment={s}"), True)
        return gone
