"""The physical store: points as Parquet in folders by part_start, level and generation.

Writes append a generation at level 0; reads give the last write of every (series, timestamp). What rewrites a partition
writes beside it, moves the new folder in with one rename, and deletes its inputs after that: readers see the old files, both,
or the new ones, and the last write is the same in all three. Partition states are a control table, so they outlive a
process; flushing marks do not, for a flush that died is no flush.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import CorruptFile, PartitionMismatch, PartitionNotFound, PartitionNotWritable
from tidemark.functions.checksum import checksums, verify
from tidemark.functions.timeops import align, in_range, overlaps
from tidemark.model import HOUR, canonical, series_id, series_key
from tidemark.operators import compaction
from tidemark.operators.lifecycle import KeepFor, RetentionPolicy

CONTENT = "metric string, labels map<string,string>, timestamp bigint, value double, lsn bigint, series_key string"
STORED = CONTENT + ", part_start bigint, level int, generation int"
NAMES = [c.split()[0] for c in CONTENT.split(", ")]
CONTROL = "at bigint, kind string, part_start bigint, state string, lsn bigint"
CHECKSUMS = "part_start bigint, level int, generation int, series_key string, crc string"
FOLDER = re.compile(r"part_start=(-?\d+)/level=(\d+)/generation=(\d+)$")


@dataclass
class Store:
    """``root`` may be any address that Spark's file systems open."""

    spark: SparkSession
    root: str
    width: int = HOUR
    retention: RetentionPolicy = field(default_factory=KeepFor)
    states: dict[int, str] = field(default_factory=dict)
    flushing: set[int] = field(default_factory=set)

    def __post_init__(self) -> None:
        rows = self.control().where("kind = 'state'").groupBy("part_start").agg(F.max_by("state", "at").alias("state"))
        self.states = {r["part_start"]: r["state"] for r in rows.collect()} | self.states  # a row for each partition with a state

    # -- files -------------------------------------------------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        files = self._files()
        return [x.getPath().getName() for x in files.listStatus(self._path())] if files.exists(self._path()) else []

    def folders(self, partition: int | None = None) -> list[tuple[int, int, int]]:
        """(part_start, level, generation) of every folder, from names alone."""
        found = self._files().globStatus(self._path(f"part_start={'*' if partition is None else partition}", "level=*", "generation=*")) or []
        return sorted(tuple(map(int, m.groups())) for x in found if (m := FOLDER.search(x.getPath().toString())))

    def partitions(self) -> list[int]:
        """part_start of every partition in the store, from its folders."""
        return sorted(int(n.split("=", 1)[1]) for n in self._names() if n.startswith("part_start="))

    def bytes_of(self, partition: int, level: int, generation: int) -> int:
        path = self._path(f"part_start={partition}", f"level={level}", f"generation={generation}")
        return self._files().getContentSummary(path).getLength()

    def _table(self) -> DataFrame:
        if not self.partitions():
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(self.root)

    # -- control -----------------------------------------------------------------------------------------------------
    def control(self) -> DataFrame:
        """Everything that was noted of partitions; the latest note of a kind counts."""
        if "_control" not in self._names():
            return self.spark.createDataFrame([], CONTROL)
        return self.spark.read.schema(CONTROL).parquet(f"{self.root}/_control")

    def note(self, kind: str, partitions: list[int], state: str | None = None, lsn: int | None = None) -> None:
        at = (self.control().agg(F.max("at")).first()[0] or 0) + 1
        self.spark.createDataFrame([(at, kind, p, state, lsn) for p in partitions], CONTROL).coalesce(1).write.mode("append").parquet(f"{self.root}/_control")

    def set_state(self, state: str, *partitions: int) -> None:
        if partitions:
            self.note("state", list(partitions), state=state)
            self.states |= dict.fromkeys(partitions, state)

    # -- writing -----------------------------------------------------------------------------------------------------
    def prepared(self, points: DataFrame) -> DataFrame:
        lsn = F.col("lsn") if "lsn" in points.columns else F.lit(0)
        rows = points.select("metric", canonical(F.col("labels")).alias("labels"), "timestamp", "value", lsn.cast("long").alias("lsn"))
        return rows.withColumn("series_key", series_key()).withColumn("part_start", align("timestamp", self.width))

    def check_writable(self, rows: DataFrame, partition: int | None = None) -> None:
        """Raise unless every row may be written. One pass: rows are reduced to their partitions, which are few."""
        closed = {p for p, s in self.states.items() if s != "Active"} | self.flushing
        if partition is None and not closed:
            return
        touched = {r[0] for r in rows.select("part_start").distinct().collect()}  # a row for each partition that is written
        if partition is not None and touched - {partition}:
            raise PartitionMismatch(f"points outside partition {partition}")
        if touched & closed:
            raise PartitionNotWritable(f"partitions that are flushing, dropping or dropped: {sorted(touched & closed)}")

    def insert(self, points: DataFrame, partition: int | None = None) -> None:
        """Append points, all or none: every partition is checked before anything is written.

        With ``partition``, points outside it are an error."""
        rows = self.prepared(points)
        self.check_writable(rows, partition)
        rows = rows.withColumn("level", F.lit(0)).withColumn("generation", F.lit(self.next_generation()))
        # One sort groups a partition's rows, so a task keeps one file open, and row groups hold narrow series and times.
        ordered = rows.repartitionByRange("part_start", "series_key", "timestamp").sortWithinPartitions("part_start", "series_key", "timestamp")
        self._writer(ordered).mode("append").partitionBy("part_start", "level", "generation").parquet(self.root)

    @staticmethod
    def _writer(rows: DataFrame):
        return rows.write.option("parquet.bloom.filter.enabled#series_key", "true")

    def next_generation(self) -> int:
        return max((g for _, _, g in self.folders()), default=0) + 1

    def move_in(self, rows: DataFrame, level: int) -> dict[int, int]:
        """Write rows (part_start and CONTENT) as a new generation at ``level``: staged, then one rename for each partition.
        Returns the generation of each. Checksums of its blocks go on record before it can be read."""
        staged, generation, files = f"_staged-{uuid.uuid4().hex}", self.next_generation(), self._files()
        ordered = rows.select(*NAMES, "part_start").repartitionByRange("part_start", "series_key", "timestamp").sortWithinPartitions("part_start", "series_key", "timestamp")
        self._writer(ordered).partitionBy("part_start").parquet(f"{self.root}/{staged}")
        written = self.spark.read.schema(CONTENT + ", part_start bigint").parquet(f"{self.root}/{staged}")
        sums = checksums(written, "part_start", "series_key").select("part_start", F.lit(level).alias("level"), F.lit(generation).alias("generation"), "series_key", "crc")
        sums.write.mode("append").parquet(f"{self.root}/_checksums")
        done = {}
        for x in files.listStatus(self._path(staged)):
            name = x.getPath().getName()
            if name.startswith("part_start="):
                files.mkdirs(self._path(name, f"level={level}"))
                if not files.rename(x.getPath(), self._path(name, f"level={level}", f"generation={generation}")):
                    raise OSError(f"{name} could not be moved in")
                done[int(name.split("=", 1)[1])] = generation
        files.delete(self._path(staged), True)
        return done

    # -- reading -----------------------------------------------------------------------------------------------------
    def raw(self, start: int | None = None, end: int | None = None) -> DataFrame:
        rows = self._table()
        if start is not None and end is not None:
            rows = rows.where(in_range("timestamp", start, end)).where(overlaps("part_start", self.width, start, end))
        return rows

    def scan(self, start: int, end: int) -> DataFrame:
        """Last writes in [start, end): metric, labels, timestamp, value."""
        return self.latest(self.raw(start, end)).select("metric", "labels", "series_key", "timestamp", "value")

    @staticmethod
    def latest(rows: DataFrame) -> DataFrame:
        order = F.struct("lsn", "generation", "level")
        best = F.max_by(F.struct("metric", "labels", "value", "lsn"), order).alias("x")
        return rows.groupBy("part_start", "series_key", "timestamp").agg(best).select("part_start", "series_key", "timestamp", "x.*")

    def series(self, key: str) -> DataFrame:
        return self.latest(self._table().where(F.col("series_key") == key)).select("timestamp", "value").orderBy("timestamp")

    def verify(self) -> None:
        """Raise CorruptFile unless every block with a checksum on record can be read and still has it."""
        if "_checksums" not in self._names():
            return
        by = ["part_start", "level", "generation"]
        here = self.spark.createDataFrame(self.folders(), "part_start bigint, level int, generation int")
        # A folder may have been put on record twice, by a writer that died before its rename; equal rows are one.
        stored = self.spark.read.schema(CHECKSUMS).parquet(f"{self.root}/_checksums").distinct().join(F.broadcast(here), by, "left_semi")
        known = stored.select(*by).distinct()
        try:
            verify(self._table().join(F.broadcast(known), by, "left_semi"), stored, *by, "series_key")
        except (PySparkException, Py4JJavaError) as e:  # what the reader says of a damaged file
            raise CorruptFile(str(e).splitlines()[0]) from e

    # -- lifecycle ---------------------------------------------------------------------------------------------------
    def mark_flushing(self, partition: int) -> None:
        self.flushing.add(partition)

    def unmark_flushing(self, partition: int) -> None:
        self.flushing.discard(partition)

    def _remove(self, folders: list[tuple[int, int, int]]) -> None:
        for p, level, generation in folders:
            self._files().delete(self._path(f"part_start={p}", f"level={level}", f"generation={generation}"), True)

    def compact(self, partition: int) -> dict[str, int]:
        """Rewrite a whole partition as its last writes, one level above its highest."""
        inputs = self.folders(partition)
        if not inputs:
            raise PartitionNotFound(str(partition))
        rows = self._table().where(F.col("part_start") == partition)
        before = rows.count()
        generation = self.move_in(self.latest(rows), max(level for _, level, _ in inputs) + 1)[partition]
        self._remove(inputs)
        after = self._table().where((F.col("part_start") == partition) & (F.col("generation") == generation)).count()
        return {"points": after, "duplicates": before - after}

    def planned(self) -> DataFrame:
        """Compactions that are due: part_start, level, target_level, inputs."""
        return compaction.plan(self.spark.createDataFrame([x[:2] for x in self.folders()], "part_start bigint, level int"))

    def run_compactions(self, lsn_scope: str = "block") -> list[dict[str, int]]:
        """Run every compaction that is due, all partitions of a level in one job: the files of the level become one
        generation of the next, blocks of greater log numbers winning. A row of figures for each partition."""
        due: dict[int, list[int]] = {}
        for r in self.planned().collect():  # a row for each partition with too many files
            due.setdefault(r["level"], []).append(r["part_start"])
        out = []
        for level, parts in sorted(due.items()):
            inputs = [x for x in self.folders() if x[0] in set(parts) and x[1] == level]
            rows = self._table().where((F.col("level") == level) & F.col("part_start").isin(parts)).withColumn("file_id", F.concat_ws("-", "part_start", "generation"))
            compaction.check_series(rows.select(series_id(F.col("series_key")).alias("series_id"), "series_key"))
            merged = compaction.merge(rows, lsn_scope, ("metric", "labels", "lsn", "part_start"))
            before = {p: sum(self.bytes_of(*x) for x in inputs if x[0] == p) for p in parts}
            count = {r["part_start"]: r["n"] for r in rows.groupBy("part_start").agg(F.count(F.lit(1)).alias("n")).collect()}
            made = self.move_in(merged, level + 1)
            self._remove(inputs)
            new = self._table().where(F.col("generation").isin(list(set(made.values()))) & (F.col("level") == level + 1))
            for r in new.groupBy("part_start").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("series_key").alias("series")).collect():
                p = r["part_start"]
                files = sum(1 for x in inputs if x[0] == p)
                out.append({"part_start": p, "level": level + 1, "input_files": files, "output_series": r["series"], "points": r["n"], "duplicates": count[p] - r["n"], "bytes_before": before[p], "bytes_after": self.bytes_of(p, level + 1, made[p])})
        return sorted(out, key=lambda x: x["part_start"])

    def delete(self, partition: int) -> None:
        self._files().delete(self._path(f"part_start={partition}"), True)

    def drop(self, *partitions: int) -> None:
        """Dropping, delete, Dropped; each state is noted before the next step, so ``recover`` can finish it."""
        self.set_state("Dropping", *partitions)
        for p in partitions:
            self.delete(p)
        self.set_state("Dropped", *partitions)

    def expired(self, partitions: list[int], now: int) -> list[int]:
        if not partitions:
            return []
        rows = self.spark.createDataFrame([(p,) for p in partitions], "part_start long")
        return sorted(r[0] for r in rows.where(self.retention.is_expired(F.col("part_start"), self.width, now)).collect())

    def expire(self, now: int) -> list[int]:
        """Drop every partition in the store whose time is over."""
        gone = self.expired(self.partitions(), now)
        self.drop(*gone)
        return gone

    def recover(self) -> list[int]:
        """After a crash: remove what was never moved in, finish drops, and delete again what is dropped. Returns the dropped
        partitions."""
        for n in self._names():
            if n.startswith("_staged-"):
                self._files().delete(self._path(n), True)
        dropped = sorted(p for p, s in self.states.items() if s in ("Dropping", "Dropped"))
        for p in dropped:
            self.delete(p)
        self.set_state("Dropped", *[p for p in dropped if self.states[p] == "Dropping"])
        return dropped
