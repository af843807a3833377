import glob
import os
import shutil

from pyspark.sql import functions as F

from tidemark.model import DAY, points
from tidemark.sources.engine import Engine
from tidemark.sources.store import Store
from tidemark.streaming import stream

DATA = "/root/testdata/sf0.001"


def landing(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    shutil.copy(f"{DATA}/events.parquet", folder / "events-0.parquet")
    return f"file://{folder}"


def test_append_equals_batch(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", width=DAY)
    found = stream.event_stream(spark, landing(tmp_path))
    for _ in range(2):  # the second start finds nothing new
        stream.append(found, store, f"file://{tmp_path}/cp").awaitTermination()
    start, end = 0, 2**62
    want = points(spark, DATA).select("series_key", "timestamp", "value")
    got = store.scan(start, end).select("series_key", "timestamp", "value")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_flush_triggers_of_a_stream(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/engine", width=DAY)
    stream.ingest(stream.event_stream(spark, landing(tmp_path)), engine, f"file://{tmp_path}/cp", most_active=28).awaitTermination()
    days = points(spark, DATA).select((F.col("timestamp") - F.col("timestamp") % DAY).alias("d"), "series_key", "timestamp", "value")
    parts = sorted(r.d for r in days.select("d").distinct().collect())
    assert engine.store.partitions() == parts[: len(parts) - 28]
    assert sorted(r[0] for r in engine.hot().select("part_start").distinct().collect()) == parts[len(parts) - 28 :]
    got = engine.scan(0, 2**62).select("series_key", "timestamp", "value")
    assert got.exceptAll(days.drop("d")).count() == 0 and got.count() == days.count()


def test_continuous_query_and_last_writes(spark, tmp_path):
    rows = stream.event_stream(spark, landing(tmp_path))
    for name, df, mode in (("windows", stream.continuous(rows, "1 day", "1 hour"), "append"), ("writes", stream.last_writes(rows), "update"), ("once", stream.without_repeats(rows, "1 hour").select("lsn"), "append")):
        df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    batch = points(spark, DATA)
    days = batch.groupBy("metric", (F.col("timestamp") - F.col("timestamp") % DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    want = {(r.metric, r.day // 1000): r.n for r in days.collect()}
    got = {(r.metric, int(r.us)): r.n for r in spark.table("windows").select("metric", F.unix_micros("start").alias("us"), "n").collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 5  # the last day is still open
    assert spark.table("writes").count() == batch.select("series_key", "timestamp").distinct().count()
    assert spark.table("once").count() == batch.count()
    assert glob.glob(f"{tmp_path}/windows/*") and os.path.isdir(f"{tmp_path}/writes")
