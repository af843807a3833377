import pytest
from pyspark.sql import functions as F

from tidemark.errors import CompactionError, CorruptFile, PartitionMismatch, PartitionNotFound, PartitionNotWritable
from tidemark.model import DAY, HOUR, SECOND
from tidemark.operators import compaction
from tidemark.operators.lifecycle import KeepFor
from tidemark.sources.engine import Engine
from tidemark.sources.store import Store

SCHEMA = "metric string, labels map<string,string>, timestamp long, value double"


def rows(spark, *points, host="a"):
    return spark.createDataFrame([("cpu", {"host": host}, t, float(v)) for t, v in points], SCHEMA)


def read(engine, start=0, end=DAY):
    return sorted((r.timestamp, r.value) for r in engine.scan(start, end).collect())


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/engine", segment_rows=4)


def test_insert_logs_first(spark, engine):
    assert engine.insert(rows(spark, (1, 1), (HOUR, 2))) == 2
    assert engine.insert(rows(spark, (1, 5))) == 3
    assert read(engine) == [(1, 5.0), (HOUR, 2.0)]
    with pytest.raises(PartitionMismatch):
        engine.insert(rows(spark, (2, 1), (HOUR, 2)), partition=0)
    engine.store.set_state("Dropped", HOUR)
    with pytest.raises(PartitionNotWritable):
        engine.insert(rows(spark, (2, 1), (HOUR, 2)))
    assert engine.log.current_sequence() == 3 and engine.store.partitions() == []  # nothing of the bad batches anywhere


def test_nothing_is_inserted_when_the_log_fails(spark, engine, monkeypatch):
    engine.insert(rows(spark, (1, 1)))
    monkeypatch.setattr(type(engine.log), "_append", lambda *_: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        engine.insert(rows(spark, (2, 2)))
    assert read(engine) == [(1, 1.0)]


def test_recovery_replays_the_log(spark, engine):
    engine.insert(rows(spark, *[(i, i) for i in range(10)]))
    engine.flush_partition(0)
    engine.insert(rows(spark, (3, 33), (HOUR + 1, 1)))
    again = Engine(spark, engine.root, segment_rows=4)
    assert again.hot().count() == 2 and dict(read(again))[3] == 33.0 and len(read(again)) == 11
    again.insert(rows(spark, (4, 44)))
    assert again.log.current_sequence() == 13 and dict(read(Engine(spark, engine.root)))[4] == 44.0


def test_flush_is_all_or_nothing(spark, engine, monkeypatch):
    engine.insert(rows(spark, (1, 1), (1, 2), (2, 3), (HOUR, 4)))
    with monkeypatch.context() as m:
        m.setattr(Store, "move_in", lambda *_: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            engine.flush_partition(0)
    assert engine.store.flushing == set() and engine.hot().count() == 4  # takes points again, and keeps them
    assert engine.flush_partition(0) == {"lsn": 3, "inserts": 3, "series": 1}
    assert engine.store.folders() == [(0, 0, 1)] and engine.hot().count() == 1
    with pytest.raises(PartitionNotFound):
        engine.flush_partition(0)
    seen = []
    with monkeypatch.context() as m:
        m.setattr(Store, "move_in", lambda store, *_: seen.append(set(store.flushing)))
        engine.flush_partition(HOUR)
    assert seen == [{HOUR}]


def test_flush_triggers(spark, engine):
    engine.insert(rows(spark, *[(i * HOUR, i) for i in range(6)]), now=0)
    assert engine.flush_due(SECOND, most_active=4) == [0, HOUR]
    assert engine.flush_due(SECOND, most_active=9) == []
    assert engine.flush_due(SECOND, most_active=9, most_bytes=1) == [i * HOUR for i in range(2, 6)]
    engine.insert(rows(spark, (7 * HOUR, 1)), now=SECOND)
    assert engine.flush_next(SECOND + 15 * 60 * SECOND - 1) is None and engine.flush_next(SECOND + 15 * 60 * SECOND) == 7 * HOUR


def test_compaction_as_planned(spark, engine):
    for i in range(5):
        engine.insert(rows(spark, (1, i), (10 + i, i)))
        engine.insert(rows(spark, (1, i), host="b"))
        assert engine.compact() == []
        engine.flush_partition(0)
    (figures,) = engine.compact()
    assert {k: figures[k] for k in ("part_start", "level", "input_files", "output_series", "points", "duplicates")} == {"part_start": 0, "level": 1, "input_files": 5, "output_series": 2, "points": 7, "duplicates": 8}
    assert figures["bytes_before"] > figures["bytes_after"] > 0
    assert engine.store.folders() == [(0, 1, 6)] and engine.compact() == []
    assert dict(read(engine))[1] == 4.0 and engine.store.raw().count() == 7


def test_compaction_checks_series(spark, engine, monkeypatch):
    for i in range(5):
        engine.insert(rows(spark, (1, i)))
        engine.insert(rows(spark, (1, i), host="b"))
        engine.flush_partition(0)
    monkeypatch.setattr("tidemark.sources.store.series_id", lambda key: F.lit(7))
    with pytest.raises(CompactionError):
        engine.compact()
    assert len(engine.store.folders()) == 5  # inputs are still there


def test_block_rule(spark):
    """An older point in the newer block wins, unless points decide."""
    b = spark.createDataFrame([("s", 1, 1.0, 5, "x", 1), ("s", 2, 0.0, 20, "x", 1), ("s", 1, 2.0, 10, "y", 2)], "series_key string, timestamp long, value double, lsn long, file_id string, generation int")
    for scope, want in (("block", 1.0), ("point", 2.0)):
        got = {r.timestamp: (r.value, r.lsn) for r in compaction.merge(b, scope, ("lsn",)).collect()}
        assert got[1] == (want, 5 if want == 1.0 else 10)


def test_ttl_job(spark, engine):
    engine.store.retention = KeepFor(HOUR)
    engine.insert(rows(spark, *[(i, i) for i in range(6)], (HOUR, 9), (5 * HOUR, 5)))
    engine.flush_partition(0)
    done = engine.ttl_job(3 * HOUR + 1)  # 0 in files, HOUR hot
    assert done["dropped"] == [0, HOUR] and done["failed"] == [] and done["segments"] == [1]
    assert read(engine) == [(5 * HOUR, 5.0)] and engine.store.partitions() == []
    again = Engine(spark, engine.root)
    assert read(again) == [(5 * HOUR, 5.0)] and again.store.states == {0: "Dropped", HOUR: "Dropped"}
    with pytest.raises(PartitionNotWritable):
        again.insert(rows(spark, (1, 1)))


def test_a_failed_drop_is_finished_by_recovery(spark, engine, monkeypatch):
    engine.store.retention = KeepFor(HOUR)
    engine.insert(rows(spark, (1, 1), (HOUR, 2)))
    with monkeypatch.context() as m:
        m.setattr(Store, "delete", lambda _, p: (_ for _ in ()).throw(OSError("disk")) if p == 0 else None)
        done = engine.ttl_job(9 * HOUR)
        assert done["dropped"] == [HOUR] and [p for p, _ in done["failed"]] == [0] and engine.store.states[0] == "Dropping"
    with pytest.raises(PartitionNotWritable):
        engine.insert(rows(spark, (1, 1)))
    again = Engine(spark, engine.root)
    assert again.recovered == [0, HOUR] and again.store.states == {0: "Dropped", HOUR: "Dropped"} and again.store.states[0] == "Dropped"


def test_damage_is_found(spark, engine, tmp_path):
    engine.insert(rows(spark, *[(i, i) for i in range(50)]))
    engine.flush_partition(0)
    engine.store.verify()
    (file,) = (tmp_path / "engine/store/part_start=0/level=0/generation=1").glob("*.parquet")
    good = file.read_bytes()
    file.write_bytes(good[: len(good) // 2])
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(CorruptFile):
        engine.store.verify()
    file.write_bytes(good)
    engine.store.verify()
    spark.createDataFrame([("cpu", {"host": "a"}, i, 0.5, 1, "cpu{host=a}") for i in range(50)], "metric string, labels map<string,string>, timestamp long, value double, lsn long, series_key string").coalesce(1).write.mode("overwrite").parquet(f"file://{file.parent}")
    with pytest.raises(CorruptFile):
        engine.store.verify()


def test_series_have_one_name_each(spark, engine):
    odd = [{"a": "1,b=2"}, {"a": "1", "b": "2"}, {"a": "1}"}, {"a\\": "1"}, {"a": "\\1"}]
    engine.insert(spark.createDataFrame([("m", labels, 5, float(i)) for i, labels in enumerate(odd)] + [("m{a=1", {}, 5, 9.0)], SCHEMA))
    assert engine.scan(0, 10).count() == 6 and engine.scan(0, 10).select("series_key").distinct().count() == 6
