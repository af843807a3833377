import pytest
from pyspark.sql import functions as F

from tidemark.errors import CorruptFile
from tidemark.functions.checksum import checksums, verify
from tidemark.sources.log import Log

SCHEMA = "metric string, labels map<string,string>, timestamp long, value double"


def points(spark, start, n):
    return spark.range(start, start + n, 1, 3).select(F.lit("m").alias("metric"), F.create_map(F.lit("h"), F.lit("a")).alias("labels"), F.col("id").alias("timestamp"), F.col("id").cast("double").alias("value"))


def test_append_reopen_truncate(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/wal", segment_rows=20)
    assert log.current_sequence() == 0 and log.recover().count() == 0
    assert log.append(points(spark, 0, 50)) == 50
    assert Log(spark, log.root, 20).append(points(spark, 50, 50)) == 100
    got = [(r.lsn, r.timestamp) for r in log.recover().orderBy("lsn").collect()]
    assert got == [(i + 1, i) for i in range(100)]
    assert log.segments() == [1, 2, 3, 4, 5, 6]
    (tmp_path / "wal" / "segment=5" / "_SUCCESS").unlink()  # never committed
    assert log.segments() == [1, 2, 3, 4, 6] and log.recover().count() == 80
    assert log.truncate(45) == [1, 2] and log.truncate(10**9) == [3, 4] and log.segments() == [6]


def test_drops(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/wal")
    log.append(points(spark, 0, 30))
    log.append_drop(10, 10)
    log.append(points(spark, 12, 3))
    times = sorted(r.timestamp for r in log.recover().collect())
    assert times == sorted([*range(10), *range(20, 30), 12, 13, 14])
    log.append_drop(0, 5)
    assert log.recover().where("timestamp < 5").count() == 0


def test_checksums(spark):
    p = points(spark, 0, 20).withColumn("series_key", F.concat(F.lit("s"), F.col("timestamp") % 2))
    stored = checksums(p, "series_key")
    verify(p.repartition(5), stored, "series_key")
    with pytest.raises(CorruptFile):
        verify(p.where("timestamp <> 3"), stored, "series_key")
    with pytest.raises(CorruptFile):
        verify(p.where("series_key = 's0'"), stored, "series_key")
