"""Golden cases of single operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.errors import CompactionError, CorruptFile, QueryError
from tidemark.functions import codec, gorilla, timeops
from tidemark.model import DAY, HOUR, SECOND, series_key
from tidemark.operators import compaction, lifecycle, series_ops, wal
from tidemark.plans import promql, tsql
from tidemark.sources import ingest, scan


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_half_open_ranges(spark):
    p = spark.range(1000).select((F.col("id") * 1_000_000).alias("timestamp"))
    for a, b, n in ((0, 100, 100), (500, 600, 100), (900, 1100, 100), (0, 1000, 1000), (1000, 2000, 0)):
        assert scan.scan(p, a * 1_000_000, b * 1_000_000).count() == n
    assert scan.scan(p, -100, 0).count() == 0


def test_alignment_and_partitions(spark):
    t = spark.createDataFrame([(x,) for x in (0, 1000, HOUR - 1, HOUR, HOUR + 1000, 2 * HOUR, -1)], "timestamp long")
    assert [r.p for r in t.select(timeops.align("timestamp", HOUR).alias("p")).collect()] == [0, 0, 0, HOUR, HOUR, 2 * HOUR, -HOUR]
    assert values(timeops.partitions_in_range(spark, 0, 3 * HOUR, HOUR), "part_start") == [(0,), (HOUR,), (2 * HOUR,)]
    assert values(timeops.partitions_in_range(spark, 0, 2 * DAY, DAY), "part_start") == [(0,), (DAY,)]
    assert timeops.partitions_in_range(spark, 5, 5, HOUR).count() == 0


def test_directories(spark):
    t = spark.createDataFrame([(0,), (27 * HOUR,), (2 * HOUR,), (-HOUR,)], "t long")
    got = t.select(timeops.partition_dir("t").alias("h"), timeops.partition_dir("t", "daily").alias("d")).collect()
    assert [r.h for r in got] == ["1970-01-01/00", "1970-01-02/03", "1970-01-01/02", "1969-12-31/23"] and got[0].d == "1970-01-01"


def test_file_names(spark):
    made = spark.range(1).select(timeops.file_name(F.lit(0x3039), F.lit(2), F.lit(7)).alias("a"), timeops.file_name(F.lit(-1), F.lit(0), F.lit(1234)).alias("b")).first()
    assert made.a == "0000000000003039_L2_G007.tsm" and made.b == "ffffffffffffffff_L0_G1234.tsm"
    names = [made.a, "bad_name.txt", "0000000000000001_L0_G001.tsm", "1_L0_G001.tsm", "0000000000000001_L256_G001.tsm", "0000000000000001_L0_G4294967296.tsm", "0000000000000001_L0_G001_x.tsm", "0000000000000001_L99999999999999999999_G1.tsm"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(timeops.parse_file_name("n").alias("x")).where("x is not null").select("x.*")
    assert values(got, "series_hex", "level", "generation") == [("0000000000000001", 0, 1), ("0000000000003039", 2, 7)]


def test_series_identity(spark):
    rows = spark.createDataFrame([("m", {"a": "1", "b": "2"}), ("m", {"b": "2", "a": "1"})], "metric string, labels map<string,string>")
    assert rows.select(series_key()).distinct().count() == 1


def blocks(spark, *rows):
    return spark.createDataFrame([("s", f"f{f}", g, t, float(v), n) for f, n, g, t, v in rows], "series_key string, file_id string, generation int, timestamp long, value double, lsn long")


def test_merge(spark):
    b = blocks(spark, (1, 10, 1, 100, 1), (1, 10, 1, 200, 2), (2, 12, 1, 100, 3), (3, 12, 2, 200, 4))
    got = compaction.merge(b)
    assert values(got, "timestamp", "value") == [(100, 3.0), (200, 4.0)] and compaction.stats(got).first().duplicates == 2
    # A point in a block with a newer one beats a point that is newer than itself, unless points decide.
    b = blocks(spark, (1, 5, 1, 100, 1), (1, 20, 1, 300, 9), (2, 10, 1, 100, 2))
    assert values(compaction.merge(b).where("timestamp = 100"), "value") == [(1.0,)]
    assert values(compaction.merge(b, "point").where("timestamp = 100"), "value") == [(2.0,)]


def test_compaction_plan_and_conflicts(spark):
    files = spark.createDataFrame([(0, 0)] * 5 + [(1, 0)] * 4 + [(2, 2)] * 101 + [(3, 1)] * 11, "part_start long, level int")
    assert values(compaction.plan(files), "part_start", "level", "target_level", "inputs") == [(0, 0, 1, 5), (3, 1, 2, 11)]
    series = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "series_id long, series_key string")
    compaction.check_series(series)
    with pytest.raises(CompactionError):
        compaction.check_series(series.union(spark.createDataFrame([(2, "c")], "a long, b string")))


def test_expiry_boundary(spark):
    p = spark.createDataFrame([(0,)], "part_start long")
    expired = lambda now: p.where(timeops.expired("part_start", 5 * SECOND, 10 * SECOND, now)).count()
    assert [expired(15 * SECOND), expired(14 * SECOND), expired(15 * SECOND + 1)] == [0, 0, 1]


def test_safe_lsn(spark):
    def of(flushed, pending=()):
        f = spark.createDataFrame([(i, x, i) for i, x in enumerate(flushed)], "part_start long, lsn long, seq long")
        return lifecycle.safe_lsn(f, spark.createDataFrame([(x,) for x in pending], "lsn long")).first().safe_lsn

    assert [of([100, 120]), of([150, 200], [160]), of([]), of([300, 250, 275]), of([100], [90]), of([100]), of([5], [0])] == [100, 150, None, 250, 89, 100, 0]


def test_flush_order(spark):
    parts = spark.createDataFrame([(i, 100 if i == 3 else 1, 0 if i in (1, 3) else 90) for i in range(6)], "part_start long, bytes long, created long")
    got = lifecycle.flush_candidates(parts, 100, most_bytes=50, most_age=50, most_active=3)
    assert values(got, "priority", "part_start") == [(0, 3), (1, 1), (2, 0), (2, 2)]
    assert lifecycle.flush_next(got).first().part_start == 3


def test_stats(spark):
    rows = spark.createDataFrame([("cpu.usage", {"host": "server1"}, 1000, 1.0, 1), ("cpu.usage", {"host": "server1"}, 2000, 1.0, 2), ("cpu.usage", {"host": "server2"}, 1500, 1.0, 3)], "metric string, labels map<string,string>, timestamp long, value double, lsn long")
    r = lifecycle.memtable_stats(lifecycle.route(rows.withColumn("series_key", series_key()), HOUR)).first()
    assert (r.inserts, r.series, r.min_ts, r.max_ts, r.bytes) == (3, 2, 1000, 2000, 3 * 24 + 2 * (48 + 9 + 4 + 7))


def simulated(total, batch, limit):
    """Segments by writing batch after batch."""
    size, segment, out = 22, 1, []
    for first in range(0, total, batch):
        n = min(batch, total - first)
        if size + n * 41 > limit:
            segment, size = segment + 1, 22
        out += [segment] * n
        size += n * 41
    return out


@pytest.mark.parametrize("total,batch,limit", [(100, 10, 1500), (95, 10, 1500), (91, 10, 1300), (34, 10, 1500), (33, 10, 1300), (32, 10, 1334), (25, 10, 200), (5, 10, 300), (5, 10, 100), (1, 1, 63), (7, 1, 62)])
def test_segments(spark, total, batch, limit):
    rows = spark.range(1, total + 1).select(F.col("id").alias("sequence"))
    got = [r.segment for r in wal.segments(rows, total, batch, limit).orderBy("sequence").collect()]
    assert got == simulated(total, batch, limit)


def test_recovery(spark):
    log = spark.createDataFrame([(1, i, i + 1, i != 20) for i in range(25)] + [(2, 0, 26, True)], "segment long, offset long, sequence long, ok boolean")
    assert wal.recover(log).count() == 21
    assert tuple(wal.resume(log).first()) == (3, 27)
    assert wal.truncatable(log, 100).count() == 0
    assert wal.truncatable(log.where("ok"), 25).first().segment == 1


def test_codec(spark):
    p = spark.createDataFrame([("s", t, v, i) for i, (t, v) in enumerate([(0, 1.0), (2147483648, 1.0), (2147483648 * 2, float("nan")), (2147483648 * 3, float("nan"))])], "series_key string, timestamp long, value double, lsn long")
    assert [r.dod for r in codec.delta_of_delta(p).orderBy("timestamp").collect()] == [None, 2147483648, 0, 0]
    assert [r.repeated for r in codec.repeats(p).orderBy("timestamp").collect()] == [False, True, False, True]
    back = codec.zip_columns(codec.pack_columns(p))
    assert values(back, "timestamp") == values(p, "timestamp") and back.count() == 4


def test_gorilla(spark):
    random.seed(2)
    odd = [0.0, -0.0, 1.7e308, 5e-324, float("inf"), float("-inf"), float("nan"), 1.0, 1.0, 1.5, 1.25, 42.0]
    for _ in range(200):
        n = random.randint(0, 60)
        times = sorted(random.choice([random.randint(-(2**63), 2**63 - 1), random.randint(0, 10**5), 2147483648 * random.randint(0, 9)]) for _ in range(n))
        values = [random.choice([random.choice(odd), random.random(), float(random.randint(0, 3))]) for _ in range(n)]
        assert gorilla.decode_times(gorilla.encode_times(times), n) == times
        assert repr(gorilla.decode_values(gorilla.encode_values(values), n)) == repr(values)
    steady = [i * SECOND for i in range(10_000)]
    assert 16 * 10_000 / (len(gorilla.encode_times(steady)) + len(gorilla.encode_values([42.0] * 10_000))) > 10
    wave = [math.sin(i / 10) for i in range(10_000)]
    assert 16 * 10_000 / (len(gorilla.encode_times(steady)) + len(gorilla.encode_values(wave))) > 1.5
    with pytest.raises(CorruptFile):
        gorilla.decode_times(gorilla.encode_times(steady)[:100], 10_000)
    empty = gorilla.compress(spark.createDataFrame([], "s string, timestamp long, value double"), "s")
    assert gorilla.decompress(empty, "s").count() == 0


def test_names_of_codes(spark):
    codes = spark.createDataFrame([(0,), (1,)], "c int")
    assert [r[0] for r in codes.select(codec.named(F.col("c"), codec.VALUE_ENCODING)).collect()] == ["raw", "gorilla_xor"]
    other = spark.createDataFrame([(9,)], "c int")
    assert other.select(codec.named(F.col("c"), codec.COMPRESSION, "gorilla")).first()[0] == "gorilla"
    with pytest.raises(Exception, match="unsupported code 9"):
        other.select(codec.named(F.col("c"), codec.VALUE_ENCODING)).collect()


def test_ingest(spark):
    lines = spark.createDataFrame([(x,) for x in (r"cpu\ load,host=a\,b value=1.5,n=3i 10", "mem value=2 20", "broken", "x value=abc 5", "cpu value=1 notime")], "line string")
    got = ingest.line_protocol(lines)
    assert values(got, "metric", "timestamp", "value") == [("cpu load", 10, 1.5), ("cpu load.n", 10, 3.0), ("mem", 20, 2.0)]
    assert got.where("metric = 'cpu load'").first().labels == {"host": "a,b"}
    odd = [r'a,t=1 s="x y,z=\"1\"",ok=true,no=F,value=2u 5', "b value=1", "c value=1 1.5", r'd\,e,k\ 1=v\=w x=-1e3 7', 'bad "value=1 2']
    got = ingest.line_protocol(spark.createDataFrame([(x,) for x in odd], "line string"), now=99)
    assert values(got, "metric", "timestamp", "value") == [("a", 5, 2.0), ("a.no", 5, 0.0), ("a.ok", 5, 1.0), ("b", 99, 1.0), ("d,e.x", 7, -1000.0)]
    assert got.where("metric = 'd,e.x'").first().labels == {"k 1": "v=w"}
    bodies = spark.createDataFrame([('{"metric":"m","tags":{"a":"b"},"fields":{"value":1,"x":2.5},"timestamp":7}',), ("{}",), ("no json",)], "body string")
    assert values(ingest.json_points(bodies), "metric", "value") == [("m", 1.0), ("m.x", 2.5)]


def test_steps(spark):
    p = spark.createDataFrame([(t,) for t in (-11, -10, -5, 0, 1, 9, 10, 11, 25)], "timestamp long")
    got = values(series_ops.at_steps(p, 0, 20, 10, 10), "step", "timestamp")
    assert got == sorted((s, t) for s in (0, 10, 20) for t in (-11, -10, -5, 0, 1, 9, 10, 11, 25) if s - 10 < t <= s)


def test_promql(spark):
    rows = [("c", {"h": h}, t * SECOND, float(v), 0) for h, samples in {"a": [(0, 1), (60, 5), (120, 2)], "b": [(30, 7)]}.items() for t, v in samples]
    p = spark.createDataFrame(rows, "metric string, labels map<string,string>, timestamp long, value double, lsn long")
    one = lambda q: values(promql.evaluate(p, q, 120 * SECOND, 120 * SECOND, SECOND), "labels_key", "value")
    assert one("c") == [("h=a", 2.0), ("h=b", 7.0)]
    assert one("increase(c[5m])") == [("h=a", 6.0)]
    assert one('rate(c{h="a"}[5m])') == [("h=a", 0.05)]
    assert one("delta(c[5m])") == [("h=a", 1.0)]
    assert one("sum(c) * 2") == [("", 18.0)] and one("count without (h) (c)") == [("", 2.0)]
    assert one("c > 5") == [("h=b", 7.0)] and one("-c + c") == [("h=a", 0.0), ("h=b", 0.0)]
    assert one('c{h!~"a|x"} offset 90s') == [("h=b", 7.0)]
    assert one("first_over_time(c[90s])") == [("h=a", 5.0)]
    assert one("1 + 2 ^ 3 ^ 0 * 2") == [("", 5.0)] and one("-2 ^ 2") == [("", -4.0)] and one("vector(7) % 4") == [("", 3.0)] and one("1 > bool 2") == [("", 0.0)]
    assert one("c / 0") == [("h=a", float("inf")), ("h=b", float("inf"))] and one("abs(c - 9) ^ 2") == [("h=a", 49.0), ("h=b", 4.0)]
    assert one("irate(c[5m])") == [("h=a", 2 / 60)] and one("topk(1, c)") == [("h=b", 7.0)] and one("bottomk(1, c)") == [("h=a", 2.0)]
    assert one("quantile(0.5, c)") == [("", 4.5)] and one("stddev(c)") == [("", 2.5)] and one("quantile_over_time(0.5, c[5m])") == [("h=a", 2.0), ("h=b", 7.0)]
    assert one("c > bool 5") == [("h=a", 0.0), ("h=b", 1.0)] and one("c and c > 5") == [("h=b", 7.0)] and one("c unless c > 5") == [("h=a", 2.0)]
    assert one("c > 5 or c") == [("h=a", 2.0), ("h=b", 7.0)] and one("c / on() group_left sum(c)") == [("h=a", 2 / 9), ("h=b", 7 / 9)]
    assert one("sum(c) / ignoring(h) group_right c") == [("h=a", 4.5), ("h=b", 9 / 7)] and one("clamp_max(c, 3)") == [("h=a", 2.0), ("h=b", 3.0)]
    with pytest.raises(Exception, match="several series match"):
        one("c + on() c")
    for bad in ("c[5m]", "rate(c)", "c{", "foo(c)", "c }", "?", "1 > 2", "1 and c", "c + bool c", "quantile_over_time(c[5m])"):
        with pytest.raises(QueryError):
            promql.evaluate(p, bad, 0, 0, 1)


def test_sums_do_not_depend_on_where_rows_lie(spark):
    """0.1 + 0.2 + 0.7 is 1.0; backwards, or from partial sums, it is less."""
    rows = [("c", {"h": h}, t, v, t) for h in "ab" for t, v in ((1, 0.1), (2, 0.2), (3, 0.7))]
    schema = "metric string, labels map<string,string>, timestamp long, value double, lsn long"
    floors = lambda p: values(promql.evaluate(p, "floor(sum_over_time(c[1s]))", SECOND, SECOND, SECOND), "labels_key", "value")
    for laid_out in (rows, rows[::-1], [rows[i] for i in (1, 2, 0, 4, 5, 3)]):
        for parts in (1, 2, 6):
            p = spark.createDataFrame(spark.sparkContext.parallelize(laid_out, parts), schema)
            assert floors(p) == floors(p.drop("lsn")) == [("h=a", 1.0), ("h=b", 1.0)]
    # The order is that of the log where there is one: backwards here.
    late = spark.createDataFrame([(*r[:4], -r[4]) for r in rows], schema)
    assert floors(late) == [("h=a", 0.0), ("h=b", 0.0)]
    # A point written twice at one time counts twice; samples without a number count as none.
    twice = spark.createDataFrame([("c", {"h": "a"}, 1, v, 1) for v in (0.5, 0.5, None)] + [("c", {"h": "b"}, 1, None, 1)], schema)
    assert floors(twice) == floors(twice.drop("lsn")) == [("h=a", 1.0)]
    # Windows shorter and longer than a step, blocks cut off by the end: every sum is that of its own window.
    rng = random.Random(5)
    rows = [("c", {"h": "a"}, t, rng.randrange(10000) / 100, t) for t in rng.sample(range(-40, 140), 120)]
    p = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), schema)
    for start, end, step, window in ((0, 95, 10, 7), (0, 95, 10, 10), (3, 100, 7, 30), (0, 0, 10, 25), (5, 60, 11, 200)):
        got = {r.step: r.value for r in promql.Plan(p, start, end, step).vector(promql.Call("sum_over_time", promql.Select("c", (), window))).collect()}
        inside = {s: [r[3] for r in sorted(rows, key=lambda r: r[4]) if s - window < r[2] <= s] for s in range(start, end + 1, step)}
        want = {}
        for s, found in inside.items():
            for v in found:
                want[s] = want.get(s, 0.0) + v
        assert got == want


def test_tsql(spark):
    assert tsql.rewrite("SELECT 'NOW()', NOW() - INTERVAL '24h'", 5) == "SELECT 'NOW()', 5L - 86400000000000L"
    with pytest.raises(QueryError):
        tsql.rewrite("SELECT FIRST(a", 0)
    with pytest.raises(QueryError):
        tsql.rewrite("SELECT FIRST(a)", 0)


def test_alert(spark):
    p = spark.createDataFrame([("m", i, v) for i, v in enumerate([1.0, 9.0, 9.0, 9.0, 1.0, 9.0, 1.0])], "metric string, timestamp long, value double")
    assert values(series_ops.alerts(p, 5, 2, "metric"), "start_ts", "end_ts", "samples") == [(1, 3, 3)]


DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_series_lookup_reaches_the_scan(spark):
    from tidemark.queries import QUERIES

    plan = plan_of(QUERIES["series_lookup"](spark, DATA))
    assert "EqualTo(event_type,click)" in plan and "EqualTo(user_id,7)" in plan


def test_windows_hold_one_series(spark):
    from tidemark.queries import QUERIES

    assert "windowspecdefinition(series_key" in plan_of(QUERIES["alert_for"](spark, DATA))
    rate = plan_of(QUERIES["promql_rate"](spark, DATA))
    assert "collect_list" not in rate and "partial_sum" in rate  # windows are summed before they are shuffled
    assert "Window" not in plan_of(QUERIES["wal_insert"](spark, DATA))


def test_patterns_match_whole_values(spark):
    p = spark.createDataFrame([({"h": "a\n"},), ({"h": "a"},), ({"h": "ab"},)], "labels map<string,string>")
    hit = p.where(series_ops.label_matches(F.col("labels"), "h", "=~", "a|x"))
    assert [r.labels["h"] for r in hit.collect()] == ["a"]
