import pytest
from pyspark.sql import functions as F

from tidemark.errors import PartitionMismatch, PartitionNotFound, PartitionNotWritable
from tidemark.model import DAY, HOUR
from tidemark.operators.lifecycle import KeepFor
from tidemark.sources.store import Store

SCHEMA = "metric string, labels map<string,string>, timestamp long, value double, lsn long"


def rows(spark, *points):
    return spark.createDataFrame([("cpu", {"host": "a"}, t, float(v), n) for t, v, n in points], SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_cross_partition_scan_prunes(spark, store):
    store.insert(rows(spark, (1000, 1, 1), (2000, 2, 2), (HOUR + 1000, 3, 3), (HOUR + 2000, 4, 4), (2 * HOUR + 1000, 5, 5)))
    assert [store.scan(0, n * HOUR).count() for n in (1, 2, 3)] == [2, 4, 5]
    assert store.partitions() == [0, HOUR, 2 * HOUR]
    plan = store.raw(0, HOUR)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part_start" in plan


def test_last_write_wins_and_compaction(spark, store):
    for i in range(5):
        store.insert(rows(spark, (100, 100 + i, i + 1), (200 + i, 200 + i, i + 1)))
    assert store.scan(0, HOUR).where("timestamp = 100").first().value == 104.0
    assert store.compact(0) == {"points": 6, "duplicates": 4}
    assert store.scan(0, HOUR).count() == 6 and store.scan(0, HOUR).where("timestamp = 100").first().value == 104.0
    assert [r.timestamp for r in store.series("cpu{host=a}").collect()] == [100, 200, 201, 202, 203, 204]
    with pytest.raises(PartitionNotFound):
        store.compact(7 * HOUR)


def test_guards(spark, store):
    with pytest.raises(PartitionMismatch):
        store.insert(rows(spark, (HOUR, 1, 1)), partition=0)
    store.mark_flushing(0)
    with pytest.raises(PartitionNotWritable):
        store.insert(rows(spark, (1, 1, 1), (HOUR, 1, 1)))
    assert store.partitions() == []
    store.insert(rows(spark, (HOUR, 1, 1)))
    store.unmark_flushing(0)
    store.insert(rows(spark, (1, 1, 1)))
    assert store.partitions() == [0, HOUR]


def test_retention_drops_and_recovery(spark, store):
    store.retention = KeepFor(DAY)
    store.insert(rows(spark, (1, 1, 1), (3 * DAY, 2, 2)))
    assert store.expire(HOUR + DAY) == []
    assert store.expire(HOUR + DAY + 1) == [0]
    assert store.states[0] == "Dropped"
    with pytest.raises(PartitionNotWritable):
        store.insert(rows(spark, (2, 1, 3)))
    again = Store(spark, store.root)  # states outlive the object
    with pytest.raises(PartitionNotWritable):
        again.insert(rows(spark, (1, 1, 1)))
    again.states = {}
    again.insert(rows(spark, (1, 1, 1)))  # files of the dropped partition come back
    again = Store(spark, store.root)
    assert again.recover() == [0] and again.partitions() == [3 * DAY]


def test_negative_times_and_special_values(spark, store):
    big = [0.0, -0.0, 1.7e308, -1.7e308, 5e-324, float("inf"), float("-inf")]
    store.insert(rows(spark, *[(i - 3, v, i) for i, v in enumerate(big)]))
    assert store.partitions() == [-HOUR, 0]
    assert [r.value for r in store.series("cpu{host=a}").collect()] == big


def test_empty(spark, store):
    assert store.scan(0, HOUR).count() == 0 and store.partitions() == [] and store.expire(DAY) == [] and store.recover() == []
    assert store.series("none{}").where(F.lit(True)).count() == 0
