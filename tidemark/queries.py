"""Every operator as a query over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec, gorilla, timeops
from tidemark.model import DAY, HOUR, SECOND, hex16, labels_key, points
from tidemark.operators import compaction, lifecycle, series_ops, wal
from tidemark.plans import promql, tsql
from tidemark.sources import ingest, scan
from tidemark.sources.engine import Engine
from tidemark.sources.store import Store
from tidemark.workdir import shared_folder

#: 2024-01-10, 2024-01-12 and 2024-01-31 00:00 UTC in nanoseconds.
T0, T1, NOW = 1_704_844_800 * SECOND, 1_705_017_600 * SECOND, 1_706_659_200 * SECOND
SERIES = "click{user_id=7}"
QUERIES: dict = {}
SQL: dict[str, str] = {}

P = """p AS (
  SELECT event_type AS metric, user_id, event_type || '{user_id=' || CAST(user_id AS VARCHAR) || '}' AS series_key,
         epoch_us(ts) * 1000 AS timestamp, value, event_id + 1 AS lsn, event_id
  FROM events)"""
H_OF, D_OF = f"timestamp - timestamp % {HOUR}", f"timestamp - timestamp % {DAY}"


def query(sql: str | None = None):
    """Register the function under its name, with its SQL ({P} stands for the points)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("{P}", P)
        return f

    return add


def hours(rows: DataFrame) -> DataFrame:
    return scan.with_partition(rows, HOUR)


def days(rows: DataFrame) -> DataFrame:
    return scan.with_partition(rows, DAY)


def r6(x, name: str):
    return F.round(x, 6).alias(name)


# -- scans -------------------------------------------------------------------------------------------------------------


@query(f"WITH {{P}} SELECT series_key, timestamp, value FROM p WHERE timestamp >= {T0} AND timestamp < {T0 + HOUR}")
def hot_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan(points(spark, sf, T0, T0 + HOUR), T0, T0 + HOUR).select("series_key", "timestamp", "value")


@query(f"WITH {{P}} SELECT {H_OF} AS part_start, series_key, timestamp, value FROM p WHERE timestamp >= {T0} AND timestamp < {T1}")
def time_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = hours(points(spark, sf, T0, T1))
    return scan.scan(rows, T0, T1, HOUR).select("part_start", "series_key", "timestamp", "value")


@query(f"""WITH {{P}}, b AS (SELECT *, min(timestamp) OVER w AS lo, max(timestamp) OVER w AS hi FROM p WINDOW w AS (PARTITION BY series_key, {D_OF}))
SELECT series_key, timestamp, value FROM b WHERE hi >= {T0 + HOUR} AND lo < {T1} AND timestamp >= {T0 + HOUR} AND timestamp < {T1}""")
def file_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf, T0 + HOUR, T1)
    return rows.select("series_key", "timestamp", "value").orderBy("series_key", "timestamp")


@query(f"WITH {{P}} SELECT timestamp, value FROM p WHERE series_key = '{SERIES}'")
def series_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return scan.series_points(points(spark, sf, metric="click", user_id=7), SERIES)


@query("WITH {P} SELECT series_key, max(metric) AS metric, count(*) AS points FROM p GROUP BY series_key")
def series_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return scan.catalog(points(spark, sf))


@query("WITH {P} SELECT series_key, count(*) AS point_count, min(timestamp) AS min_ts, max(timestamp) AS max_ts, max(lsn) AS max_lsn FROM p GROUP BY series_key")
def series_index(spark: SparkSession, sf: str) -> DataFrame:
    return scan.block_stats(points(spark, sf), "series_key")


@query(f"""WITH {{P}}, b AS (SELECT series_key, {D_OF} AS day, count(*) AS point_count, min(timestamp) AS min_ts, max(timestamp) AS max_ts, max(lsn) AS max_lsn FROM p GROUP BY ALL)
SELECT * FROM b WHERE max_ts >= {T0 + HOUR} AND min_ts < {T0 + 3 * HOUR}""")
def block_prune(spark: SparkSession, sf: str) -> DataFrame:
    rows = days(points(spark, sf)).withColumnRenamed("part_start", "day")
    return scan.pruned_blocks(scan.block_stats(rows, "series_key", "day"), T0 + HOUR, T0 + 3 * HOUR)


@query(f"""WITH {{P}}, h AS (SELECT {H_OF} AS part_start, count(*) AS points FROM p GROUP BY 1)
SELECT * FROM h WHERE part_start < {T1 - 1} AND part_start + {HOUR} > {T0 + 5}""")
def partition_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = hours(points(spark, sf, T0 - HOUR, T1 + HOUR)).where(timeops.overlaps("part_start", HOUR, T0 + 5, T1 - 1))
    return rows.groupBy("part_start").agg(F.count(F.lit(1)).alias("points"))


@query(f"SELECT unnest(range({T0}, {T0 + 4 * HOUR}, {HOUR})) AS part_start")
def partitions_in_range(spark: SparkSession, sf: str) -> DataFrame:
    return timeops.partitions_in_range(spark, T0 + 5, T0 + 3 * HOUR + 1, HOUR)


@query("WITH {P}, s AS (SELECT series_key, max(metric) AS metric FROM p WHERE user_id % 10 <> 3 GROUP BY 1) SELECT series_key, timestamp, value, coalesce(s.metric, '') AS metric FROM p LEFT JOIN s USING (series_key)")
def series_enrich(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf)
    known = rows.where(F.col("labels").getItem("user_id").cast("long") % 10 != 3)
    series = known.groupBy("series_key").agg(F.max("metric").alias("metric"), F.any_value("labels").alias("labels"))
    return scan.enrich(rows.select("series_key", "timestamp", "value"), series).select("series_key", "timestamp", "value", "metric")


@query("WITH {P} SELECT series_key, timestamp, value FROM p")
def zip_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks are a series in a day, so no row holds more than that."""
    return codec.zip_columns(codec.pack_columns(days(points(spark, sf)), "series_key", "part_start"), "series_key")


@query(f"""WITH {{P}}, h AS (SELECT series_key, {H_OF} AS hour, value, lsn FROM p)
SELECT series_key, hour, arg_max(value, lsn) AS value, count(*) AS writes FROM h GROUP BY ALL""")
def union_hot_cold(spark: SparkSession, sf: str) -> DataFrame:
    hour = timeops.align("timestamp", HOUR).alias("hour")
    cold = points(spark, sf, end=T0 + 7 * DAY).select("series_key", hour, "value", "lsn")
    hot = points(spark, sf, T0 + 7 * DAY).select("series_key", hour, "value", "lsn")
    return scan.hot_and_cold(hot, cold, "series_key", "hour")


# -- writes and routing --------------------------------------------------------------------------------------------------


@query(f"WITH {{P}} SELECT series_key, {H_OF} AS hour, arg_max(value, lsn) AS value, count(*) AS writes FROM p GROUP BY ALL")
def upsert_last_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf).withColumn("hour", timeops.align("timestamp", HOUR))
    return scan.last_write(rows, F.col("lsn"), "series_key", "hour")


@query(f"WITH {{P}} SELECT {H_OF} AS part_start, count(*) AS points, {H_OF} + {HOUR} AS part_end FROM p GROUP BY ALL")
def partition_routing(spark: SparkSession, sf: str) -> DataFrame:
    found = hours(points(spark, sf)).groupBy("part_start").agg(F.count(F.lit(1)).alias("points"))
    return found.withColumn("part_end", F.col("part_start") + HOUR)


def partition_state(spark: SparkSession, sf: str) -> DataFrame:
    """A control table made of the partitions themselves: every third one is closed in some way."""
    parts = hours(points(spark, sf)).select("part_start").distinct()
    number = F.col("part_start") / HOUR
    return parts.select(
        "part_start", F.when(number.cast("long") % 6 == 0, "Dropped").when(number.cast("long") % 6 == 3, "Dropping").otherwise("Active").alias("state"),
        (number.cast("long") % 7 == 0).alias("flushing"),
    )


@query(f"""WITH {{P}} SELECT series_key, timestamp, value FROM p
WHERE NOT ((timestamp // {HOUR}) % 6 IN (0, 3) OR (timestamp // {HOUR}) % 7 = 0)""")
def routed_insert(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.writable(hours(points(spark, sf)), partition_state(spark, sf)).select("series_key", "timestamp", "value")


@query(f"""WITH {{P}}, d AS (SELECT {H_OF} AS part_start, series_key, timestamp, max(lsn) AS lsn FROM p GROUP BY ALL)
SELECT part_start, count(DISTINCT series_key) AS series, count(*) AS points, min(timestamp) AS min_ts, max(timestamp) AS max_ts, max(lsn) AS max_lsn FROM d GROUP BY ALL""")
def flush_summary(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.flush_summary(hours(points(spark, sf)))


# -- statistics ----------------------------------------------------------------------------------------------------------

MEMTABLE = f"""m AS (
  SELECT {{part}} AS part_start, count(*) AS inserts, count(DISTINCT series_key) AS series, min(timestamp) AS min_ts, max(timestamp) AS max_ts, max(lsn) AS max_lsn
  FROM p GROUP BY ALL), n AS (
  SELECT {{part}} AS part_start, series_key, max(strlen(metric) + strlen('user_id') + strlen(CAST(user_id AS VARCHAR))) AS names FROM p GROUP BY ALL), s AS (
  SELECT part_start, CAST(sum(names + 48) AS BIGINT) AS extra FROM n GROUP BY ALL), st AS (
  SELECT part_start, inserts, series, inserts * 24 + extra AS bytes, min_ts, max_ts, max_lsn FROM m JOIN s USING (part_start))"""


@query(f"WITH {{P}}, {MEMTABLE.replace('{part}', H_OF)} SELECT * FROM st")
def memtable_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.memtable_stats(hours(points(spark, sf)))


@query(f"""WITH {{P}}, {MEMTABLE.replace('{part}', H_OF)}
SELECT count(*) AS partitions, CAST(sum(inserts) AS BIGINT) AS inserts, CAST(sum(bytes) AS BIGINT) AS bytes, min(part_start) AS oldest, max(part_start) AS newest FROM st""")
def manager_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.manager_stats(lifecycle.memtable_stats(hours(points(spark, sf))))


FLUSH_NOW, FLUSH_SIZE, FLUSH_OLD, ACTIVE = T0 + 10 * DAY, 26_000, 9 * DAY, 24
CANDIDATES = f"""c AS (
  SELECT part_start, bytes, CASE WHEN bytes >= {FLUSH_SIZE} THEN 0 WHEN {FLUSH_NOW} - part_start >= {FLUSH_OLD} THEN 1
         WHEN row_number() OVER (ORDER BY part_start) <= count(*) OVER () - {ACTIVE} THEN 2 END AS priority FROM st)"""


@query(f"WITH {{P}}, {MEMTABLE.replace('{part}', D_OF)}, {CANDIDATES} SELECT part_start, priority, bytes FROM c WHERE priority IS NOT NULL")
def flush_candidates(spark: SparkSession, sf: str) -> DataFrame:
    parts = lifecycle.memtable_stats(days(points(spark, sf))).withColumn("created", F.col("part_start"))
    return lifecycle.flush_candidates(parts, FLUSH_NOW, FLUSH_SIZE, FLUSH_OLD, ACTIVE)


@query(f"WITH {{P}}, {MEMTABLE.replace('{part}', D_OF)}, {CANDIDATES} SELECT part_start, priority, bytes FROM c WHERE priority IS NOT NULL ORDER BY priority, part_start LIMIT 1")
def flush_next(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.flush_next(flush_candidates(spark, sf))


# -- compaction ----------------------------------------------------------------------------------------------------------

BLOCKS = f"b AS (SELECT series_key, {H_OF} AS timestamp, value, lsn, event_id % 5 AS generation FROM p)"


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Five files of each series, with times coarsened to the hour so that they overlap."""
    rows = points(spark, sf).withColumn("timestamp", timeops.align("timestamp", HOUR))
    generation = F.pmod(F.col("lsn") - 1, F.lit(5))
    return rows.select("series_key", "timestamp", "value", "lsn", generation.alias("generation"), generation.alias("file_id"))


MERGED = f"""{BLOCKS}, x AS (SELECT *, max(lsn) OVER (PARTITION BY series_key, generation) AS block_lsn FROM b), m AS (
  SELECT series_key, timestamp, arg_max(value, {{'a': block_lsn, 'b': generation, 'c': lsn}}) AS value, count(*) - 1 AS duplicates FROM x GROUP BY ALL)"""


@query(f"WITH {{P}}, {MERGED} SELECT * FROM m")
def compact_merge(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.merge(blocks(spark, sf))


@query(f"WITH {{P}}, {BLOCKS} SELECT series_key, timestamp, arg_max(value, {{'a': lsn, 'b': generation}}) AS value, count(*) - 1 AS duplicates FROM b GROUP BY ALL")
def compact_merge_point(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.merge(blocks(spark, sf), "point")


@query(f"WITH {{P}}, {MERGED} SELECT count(DISTINCT series_key) AS output_files, count(*) AS merged_points, CAST(sum(duplicates) AS BIGINT) AS duplicates FROM m")
def compact_stats(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.stats(compaction.merge(blocks(spark, sf)))


@query("WITH {P} SELECT user_id % 100 AS series_id, count(DISTINCT series_key) AS names FROM p GROUP BY ALL HAVING names > 1")
def series_meta_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf).select((F.col("labels").getItem("user_id").cast("long") % 100).alias("series_id"), "series_key")
    return compaction.conflicts(rows)


FILES = f"f AS (SELECT DISTINCT {D_OF} AS part_start, series_key, CAST(event_id % 3 AS INTEGER) AS level, event_id % 5 AS generation FROM p)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("lsn") - 1
    return days(points(spark, sf)).select("part_start", "series_key", (number % 3).cast("int").alias("level"), (number % 5).alias("generation")).distinct()


@query(f"""WITH {{P}}, {FILES}, c AS (SELECT part_start, level, count(*) AS inputs FROM f GROUP BY ALL), o AS (
  SELECT * FROM c JOIN (VALUES (0, 4), (1, 10), (2, 100)) AS l(level, most) USING (level) WHERE inputs > most)
SELECT part_start, min(level) AS level, min(level) + 1 AS target_level, arg_min(inputs, level) AS inputs FROM o GROUP BY part_start HAVING min(level) < 2""")
def compaction_plan(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.plan(files(spark, sf))


@query(f"WITH {{P}}, {FILES} SELECT series_key, max(generation) + 1 AS next_generation FROM f GROUP BY ALL")
def next_generation(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.next_generation(files(spark, sf))


# -- retention and log ---------------------------------------------------------------------------------------------------


@query(f"WITH {{P}} SELECT DISTINCT {H_OF} AS part_start FROM p WHERE {H_OF} + {HOUR} + {13 * DAY} < {T0 + 18 * DAY}")
def retention_expired(spark: SparkSession, sf: str) -> DataFrame:
    parts = hours(points(spark, sf)).select("part_start").distinct()
    return parts.where(lifecycle.KeepFor(13 * DAY).is_expired(F.col("part_start"), HOUR, T0 + 18 * DAY))


@query(f"""WITH {{P}}, d AS (SELECT DISTINCT {D_OF} AS part_start FROM p)
SELECT part_start, tier, part_start + {DAY} + ttl < {NOW} AS expired FROM d, (VALUES ('raw', {3 * DAY}), ('hour', {20 * DAY}), ('day', {365 * DAY})) AS t(tier, ttl)""")
def tiered_ttl(spark: SparkSession, sf: str) -> DataFrame:
    parts = days(points(spark, sf)).select("part_start").distinct()
    return series_ops.tiered_ttl(parts, DAY, {"raw": 3 * DAY, "hour": 20 * DAY, "day": 365 * DAY}, NOW)


@query(f"""WITH {{P}}, f AS (SELECT {D_OF} AS part_start, arg_max(lsn, timestamp) AS lsn FROM p GROUP BY ALL), d AS (SELECT min(lsn) AS b FROM p WHERE event_id % 1000 = 999)
SELECT CASE WHEN a IS NOT NULL THEN least(a, CASE WHEN b IS NOT NULL THEN greatest(b - 1, 0) END) END AS safe_lsn FROM (SELECT min(lsn) AS a FROM f), d""")
def safe_lsn(spark: SparkSession, sf: str) -> DataFrame:
    rows = days(points(spark, sf))
    return lifecycle.safe_lsn(rows.select("part_start", "lsn", F.col("timestamp").alias("seq")), rows.where((F.col("lsn") - 1) % 1000 == 999))


SEGMENT, UP_TO = 97, 5_000
LOG = f"g AS (SELECT event_id // {SEGMENT} + 1 AS segment, event_id % {SEGMENT} AS offset_, lsn AS sequence, series_key, timestamp, value, (event_id * 7919) % 409 <> 0 AS ok FROM p)"


def log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of the events: segments of 97 entries, some of which fail their checksum."""
    number = F.col("lsn") - 1
    segment = ((number - number % SEGMENT) / SEGMENT + 1).cast("long")
    return points(spark, sf).select(
        segment.alias("segment"), (number % SEGMENT).alias("offset"), F.col("lsn").alias("sequence"), "series_key", "timestamp", "value", ((number * 7919) % 409 != 0).alias("ok")
    )


@query(f"""WITH {{P}}, {LOG}, x AS (SELECT segment, min(offset_) AS bad FROM g WHERE NOT ok GROUP BY 1)
SELECT segment, sequence, series_key, timestamp, value FROM g LEFT JOIN x USING (segment) WHERE bad IS NULL OR offset_ < bad""")
def wal_recover(spark: SparkSession, sf: str) -> DataFrame:
    return wal.recover(log(spark, sf)).select("segment", "sequence", "series_key", "timestamp", "value")


@query(f"""WITH {{P}} SELECT series_key, timestamp, value FROM p WHERE {H_OF} NOT IN (SELECT {H_OF} FROM p WHERE event_id % 211 = 5)""")
def wal_recover_drops(spark: SparkSession, sf: str) -> DataFrame:
    rows = hours(points(spark, sf))
    drops = rows.where((F.col("lsn") - 1) % 211 == 5).select(F.col("part_start").alias("partition_start"))
    return wal.without_dropped(rows, drops).select("series_key", "timestamp", "value")


@query(f"WITH {{P}} SELECT {D_OF} AS part_start, lsn, row_number() OVER (ORDER BY timestamp, lsn) + 100 AS sequence FROM p")
def wal_sequence(spark: SparkSession, sf: str) -> DataFrame:
    rows = days(points(spark, sf)).select("part_start", "timestamp", "lsn")
    return wal.assign_sequences(rows, shared_folder(spark, "sequence"), "timestamp", "lsn", start=101).select("part_start", "lsn", "sequence")


BATCH, SEGMENT_BYTES = 10, 1_500


@query(f"""WITH {{P}}, s AS (SELECT (lsn - 1) // {BATCH} AS batch, lsn FROM p), k AS (SELECT count(*) AS total FROM p)
SELECT CAST(1 + CASE WHEN batch = total // {BATCH} AND total // {BATCH} > 0 AND (total // {BATCH}) % 3 = 0 AND {22 + 41 * 3 * BATCH} + 41 * (total % {BATCH}) <= {SEGMENT_BYTES} THEN batch // 3 - 1 ELSE batch // 3 END AS BIGINT) AS segment,
       count(*) AS entries, min(lsn) AS first_sequence, max(lsn) AS last_sequence FROM s, k GROUP BY ALL""")
def wal_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf).select(F.col("lsn").alias("sequence"))
    total = rows.agg(F.max("sequence")).first()[0] or 0
    found = wal.segments(rows, total, BATCH, SEGMENT_BYTES)
    return found.groupBy("segment").agg(F.count(F.lit(1)).alias("entries"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))


@query(f"""WITH {{P}}, {LOG} SELECT segment, max(sequence) AS last FROM g GROUP BY segment
HAVING max(sequence) <= {UP_TO} AND bool_and(ok) AND segment < (SELECT max(segment) FROM g)""")
def wal_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return wal.truncatable(log(spark, sf), UP_TO)


@query(f"WITH {{P}}, {LOG} SELECT max(segment) + 1 AS next_segment, max(sequence) FILTER (ok) + 1 AS next_sequence FROM g")
def wal_resume(spark: SparkSession, sf: str) -> DataFrame:
    return wal.resume(log(spark, sf))


# -- the engine on disk ----------------------------------------------------------------------------------------------------


def engine(spark: SparkSession, sf: str, **options) -> Engine:
    """A fresh engine of daily partitions with all events inserted, in order of their ids so that lsn = event_id + 1."""
    made = Engine(spark, shared_folder(spark, "engine"), DAY, **options)
    made.insert(points(spark, sf).orderBy("lsn").select("metric", "labels", "timestamp", "value"), now=T0)
    return made


@query("WITH {P} SELECT series_key, timestamp, arg_max(value, lsn) AS value FROM p GROUP BY ALL")
def wal_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Points that were logged and nothing else: a reopened engine reads them from its log."""
    again = Engine(spark, engine(spark, sf).root, DAY)
    return again.scan(T0 - 1000 * DAY, T0 + 1000 * DAY).select("series_key", "timestamp", "value")


MOST_HOT = 27


@query(f"""WITH {{P}}, d AS (SELECT {D_OF} AS part_start, series_key, timestamp, max(lsn) AS lsn FROM p GROUP BY ALL), s AS (
  SELECT part_start, count(*) AS points, count(DISTINCT series_key) AS series, max(lsn) AS last FROM d GROUP BY ALL), r AS (
  SELECT *, row_number() OVER (ORDER BY part_start) <= count(*) OVER () - {MOST_HOT} AS flushed FROM s)
SELECT part_start, points, series, flushed, CASE WHEN flushed THEN last END AS flushed_lsn FROM r""")
def flush_partition(spark: SparkSession, sf: str) -> DataFrame:
    """The oldest partitions are flushed until as many are hot as may be; points are counted in files and in the log."""
    made = engine(spark, sf)
    made.flush_due(T0, most_active=MOST_HOT, most_age=DAY)
    files = made.store.latest(made.store.raw()).select("part_start", "series_key", F.lit(True).alias("flushed"))
    hot = made.store.latest(made.hot().withColumn("level", F.lit(0)).withColumn("generation", F.lit(0))).select("part_start", "series_key", F.lit(False).alias("flushed"))
    found = files.unionByName(hot).groupBy("part_start", "flushed").agg(F.count(F.lit(1)).alias("points"), F.countDistinct("series_key").alias("series"))
    return found.join(made.flushed().withColumnRenamed("flushed", "flushed_lsn"), "part_start", "left")


@query(f"""WITH {{P}}, f AS (SELECT {D_OF} AS part_start, series_key, {H_OF} AS timestamp, value, lsn, event_id % 5 AS generation FROM p), n AS (
  SELECT part_start FROM f GROUP BY ALL HAVING count(DISTINCT generation) > 4), x AS (
  SELECT *, max(lsn) OVER (PARTITION BY part_start, series_key, generation) AS block_lsn FROM f JOIN n USING (part_start))
SELECT part_start, series_key, timestamp, arg_max(value, {{'a': block_lsn, 'b': generation, 'c': lsn}}) AS value, 1 AS level, 1 AS files FROM x GROUP BY ALL""")
def run_compaction(spark: SparkSession, sf: str) -> DataFrame:
    """Five files in each partition are one more than level 0 may have: they become one file of level 1."""
    store = Store(spark, shared_folder(spark, "store"), DAY)
    rows = points(spark, sf).withColumn("timestamp", timeops.align("timestamp", HOUR))
    for i in range(5):
        store.insert(rows.where((F.col("lsn") - 1) % 5 == i))
    done = spark.createDataFrame(store.run_compactions(), "part_start long, input_files int")
    files = spark.createDataFrame(store.folders(), "part_start long, level int, generation int").groupBy("part_start").agg(F.count(F.lit(1)).cast("int").alias("files"))
    found = store.raw().join(F.broadcast(done), "part_start").join(F.broadcast(files), "part_start")
    return found.select("part_start", "series_key", "timestamp", "value", "level", "files")


@query(f"""WITH {{P}}, k AS (SELECT * FROM p WHERE {D_OF} + {DAY} + {7 * DAY} >= {T0 + 12 * DAY})
SELECT series_key, timestamp, arg_max(value, lsn) AS value FROM k GROUP BY ALL""")
def ttl_job(spark: SparkSession, sf: str) -> DataFrame:
    """Some partitions are in files, the others hot; what is older than a week is dropped from both, for good: what a reopened
    engine reads."""
    made = engine(spark, sf, retention=lifecycle.KeepFor(7 * DAY))
    made.flush_due(T0, most_active=MOST_HOT, most_age=DAY)
    made.ttl_job(T0 + 12 * DAY)
    again = Engine(spark, made.root, DAY)
    return again.scan(T0 - 1000 * DAY, T0 + 1000 * DAY).select("series_key", "timestamp", "value")


# -- names and layout ----------------------------------------------------------------------------------------------------


@query(f"""WITH {{P}}, d AS (SELECT DISTINCT {H_OF} AS part_start FROM p)
SELECT part_start, strftime(make_timestamp(part_start // 1000), '%Y-%m-%d/%H') AS hourly, strftime(make_timestamp(part_start // 1000), '%Y-%m-%d') AS daily FROM d""")
def partition_dirs(spark: SparkSession, sf: str) -> DataFrame:
    parts = hours(points(spark, sf)).select("part_start").distinct()
    return parts.select("part_start", timeops.partition_dir("part_start").alias("hourly"), timeops.partition_dir("part_start", "daily").alias("daily"))


NAMES = f"""lpad(lower(to_hex(event_id * 104729)), 16, '0') || '_L' || (event_id % 3) || '_G' || CASE WHEN event_id % 2000 >= 100 THEN CAST(event_id % 2000 AS VARCHAR) ELSE lpad(CAST(event_id % 2000 AS VARCHAR), 3, '0') END || '{timeops.SUFFIX}'"""


def named(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("lsn") - 1
    name = timeops.file_name(number * 104729, number % 3, number % 2000)
    return hours(points(spark, sf)).select("lsn", "part_start", name.alias("file_name"))


@query(f"WITH {{P}} SELECT lsn, {NAMES} AS file_name, strftime(make_timestamp(({H_OF}) // 1000), '%Y-%m-%d/%H') || '/' || {NAMES} AS path FROM p")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    return named(spark, sf).select("lsn", "file_name", F.concat_ws("/", timeops.partition_dir("part_start"), "file_name").alias("path"))


@query(f"""WITH {{P}}, n AS (SELECT lsn, CASE WHEN event_id % 7 = 0 THEN 'bad_' || {NAMES} WHEN event_id % 11 = 0 THEN replace({NAMES}, '_L', '_L30') ELSE {NAMES} END AS file_name FROM p)
SELECT lsn, substr(file_name, 1, 16) AS series_hex, CAST(regexp_extract(file_name, '_L([0-9]+)_', 1) AS BIGINT) AS level, CAST(regexp_extract(file_name, '_G([0-9]+)', 1) AS BIGINT) AS generation
FROM n WHERE regexp_full_match(file_name, '[0-9a-f]{{16}}_L[0-9]+_G[0-9]+\\{timeops.SUFFIX}') AND CAST(regexp_extract(file_name, '_L([0-9]+)_', 1) AS BIGINT) < 256""")
def file_listing(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("lsn") - 1
    name = F.when(number % 7 == 0, F.concat(F.lit("bad_"), "file_name")).when(number % 11 == 0, F.replace("file_name", F.lit("_L"), F.lit("_L30"))).otherwise(F.col("file_name"))
    found = named(spark, sf).select("lsn", timeops.parse_file_name(name).alias("x")).where("x is not null")
    return found.select("lsn", "x.series_hex", "x.level", "x.generation")


@query("SELECT event_id, (event_id % 8) & 1 <> 0 AS hot, (event_id % 8) & 2 <> 0 AS cold, (event_id % 8) & 4 <> 0 AS meta FROM events")
def section_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf).select((F.col("lsn") - 1).alias("event_id"), ((F.col("lsn") - 1) % 8).cast("int").alias("flags"))
    return rows.select("event_id", *[timeops.has_section("flags", x).alias(x) for x in timeops.SECTIONS])


@query("WITH {P} SELECT series_key, count(*) AS points FROM p GROUP BY ALL")
def series_hex(spark: SparkSession, sf: str) -> DataFrame:
    """Identities: as many 64-bit ids as series, and one for each; two names of one id would both be wrong here."""
    from tidemark.model import series_id

    rows = points(spark, sf).groupBy(hex16(series_id(F.col("series_key"))).alias("id")).agg(F.min("series_key").alias("lo"), F.max("series_key").alias("hi"), F.count(F.lit(1)).alias("points"))
    return rows.select(F.when((F.col("lo") == F.col("hi")) & F.col("id").rlike("^[0-9a-f]{16}$"), F.col("lo")).alias("series_key"), "points")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'raw' ELSE 'gorilla' END AS compression, CASE event_id % 2 WHEN 0 THEN 'raw' ELSE 'delta_of_delta' END AS times, CASE event_id % 2 WHEN 0 THEN 'raw' ELSE 'gorilla_xor' END AS bits FROM events")
def enum_names(spark: SparkSession, sf: str) -> DataFrame:
    """A header's unknown compression is the default; a block's unknown encoding would be an error."""
    event = (F.col("lsn") - 1).alias("event_id")
    rows = points(spark, sf).select(event, ((F.col("lsn") - 1) % 4).alias("c"), ((F.col("lsn") - 1) % 2).alias("e"))
    return rows.select("event_id", codec.named(F.col("c"), codec.COMPRESSION, "gorilla").alias("compression"), codec.named(F.col("e"), codec.TIMESTAMP_ENCODING).alias("times"), codec.named(F.col("e"), codec.VALUE_ENCODING).alias("bits"))


# -- encoding models -----------------------------------------------------------------------------------------------------

DOD = """l AS (SELECT *, timestamp - lag(timestamp) OVER w AS delta FROM p WINDOW w AS (PARTITION BY series_key ORDER BY timestamp, lsn)), dd AS (
  SELECT *, delta - coalesce(lag(delta) OVER w, CASE WHEN delta IS NOT NULL THEN 0 END) AS dod FROM l WINDOW w AS (PARTITION BY series_key ORDER BY timestamp, lsn))"""


@query(f"WITH {{P}}, {DOD} SELECT series_key, timestamp, delta, dod FROM dd WHERE delta IS NOT NULL")
def delta_of_delta(spark: SparkSession, sf: str) -> DataFrame:
    found = codec.delta_of_delta(points(spark, sf)).where("delta is not null")
    return found.select("series_key", "timestamp", "delta", "dod")


@query("WITH {P}, r AS (SELECT * REPLACE (round(value / 50) AS value) FROM p) SELECT series_key, timestamp, coalesce(value = lag(value) OVER (PARTITION BY series_key ORDER BY timestamp, lsn), false) AS repeated FROM r")
def value_repeat_runs(spark: SparkSession, sf: str) -> DataFrame:
    return codec.repeats(points(spark, sf).withColumn("value", F.round(F.col("value") / 50))).select("series_key", "timestamp", "repeated")


@query(f"""WITH {{P}}, {DOD}, v AS (SELECT *, lag(value) OVER (PARTITION BY series_key ORDER BY timestamp, lsn) AS before FROM dd), b AS (
  SELECT series_key, count(*) AS n,
    CAST(sum(CASE WHEN dod IS NULL THEN 64 WHEN dod = 0 THEN 1 WHEN dod BETWEEN -63 AND 64 THEN 9 WHEN dod BETWEEN -255 AND 256 THEN 12 WHEN dod BETWEEN -2047 AND 2048 THEN 16 ELSE 36 END) AS BIGINT) AS ts_bits,
    CAST(sum(CASE WHEN before IS NULL THEN 64 WHEN before = value THEN 1 ELSE 66 END) AS BIGINT) AS v_bits FROM v GROUP BY ALL)
SELECT *, CAST(ceil(ts_bits / 8) + ceil(v_bits / 8) + 50 AS BIGINT) AS block_bytes, n * 16 AS raw_bytes FROM b""")
def gorilla_size_model(spark: SparkSession, sf: str) -> DataFrame:
    return codec.size_model(points(spark, sf))


@query(f"WITH {{P}} SELECT {D_OF} AS part_start, series_key, timestamp, value FROM p")
def gorilla_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    by = ("part_start", "series_key")
    return gorilla.decompress(gorilla.compress(days(points(spark, sf)), *by), *by)


# -- buckets, rates, selectors -------------------------------------------------------------------------------------------


@query(f"WITH {{P}} SELECT series_key, {H_OF} AS bucket, round(avg(value), 6) AS mean, count(*) AS n FROM p GROUP BY ALL")
def time_bucket_avg(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf).groupBy("series_key", series_ops.time_bucket(HOUR).alias("bucket"))
    return rows.agg(r6(F.avg("value"), "mean"), F.count(F.lit(1)).alias("n"))


@query("WITH {P} SELECT series_key, timestamp, value FROM p WHERE metric = 'click' AND regexp_full_match(CAST(user_id AS VARCHAR), '1.*') AND user_id <> 12")
def label_match(spark: SparkSession, sf: str) -> DataFrame:
    rows, labels = points(spark, sf).where("metric = 'click'"), F.col("labels")
    hit = series_ops.label_matches(labels, "user_id", "=~", "1.*") & series_ops.label_matches(labels, "user_id", "!=", "12") & series_ops.label_matches(labels, "missing", "=", "")
    return rows.where(hit).select("series_key", "timestamp", "value")


STEP, END = 6 * HOUR, T0 + 5 * DAY


def steps_sql(window: int, columns: str, where: str = "true", group: str = "GROUP BY ALL") -> str:
    return f"""WITH {{P}}, t AS (SELECT unnest(range({T0}, {END + 1}, {STEP})) AS step)
SELECT {columns} FROM p JOIN t ON timestamp > step - {window} AND timestamp <= step WHERE {where} {group}"""


@query(steps_sql(12 * HOUR, "series_key, step, count(*) AS n, round(sum(value), 6) AS total"))
def range_selector(spark: SparkSession, sf: str) -> DataFrame:
    rows = series_ops.at_steps(points(spark, sf, T0 - 12 * HOUR, END + 1), T0, END, STEP, 12 * HOUR)
    return rows.groupBy("series_key", "step").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), "total"))


@query("""WITH {P}, l AS (SELECT *, lag(value) OVER (PARTITION BY series_key ORDER BY timestamp) AS before FROM p), s AS (
  SELECT series_key, sum(CASE WHEN before IS NULL THEN 0 WHEN value >= before THEN value - before ELSE value END) AS increase, count(*) AS samples, max(timestamp) - min(timestamp) AS span FROM l GROUP BY ALL)
SELECT series_key, samples, round(increase, 6) AS increase, round(increase / (span / 1e9), 9) AS rate FROM s WHERE samples >= 2""")
def rate(spark: SparkSession, sf: str) -> DataFrame:
    found = series_ops.rate(points(spark, sf), "series_key")
    return found.select("series_key", "samples", r6(F.col("increase"), "increase"), F.round("rate", 9).alias("rate"))


FIRST_LAST = f"""fl AS (SELECT series_key, {D_OF} AS bucket, arg_min(value, timestamp) AS first, arg_max(value, timestamp) AS last FROM p GROUP BY ALL)"""


@query(f"WITH {{P}}, {FIRST_LAST} SELECT series_key, bucket, first, last FROM fl")
def first_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf).withColumn("bucket", timeops.align("timestamp", DAY))
    return series_ops.first_last(rows, "series_key", "bucket").drop("delta")


@query(f"WITH {{P}}, {FIRST_LAST} SELECT series_key, bucket, round(last - first, 6) AS delta FROM fl")
def delta(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf).withColumn("bucket", timeops.align("timestamp", DAY))
    return series_ops.first_last(rows, "series_key", "bucket").select("series_key", "bucket", r6(F.col("delta"), "delta"))


@query(f"WITH {{P}} SELECT metric, count(*) AS n, round(avg(value), 6) AS mean FROM p WHERE timestamp > {NOW} - {2 * DAY} GROUP BY ALL")
def recent_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf, NOW - 2 * DAY + 1)
    return rows.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean"))


def rollup_sql(bucket: str) -> str:
    return f"""WITH {{P}} SELECT series_key, {bucket} AS bucket, count(*) AS n, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high,
arg_min(value, timestamp) AS first, arg_max(value, timestamp) AS last, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM p GROUP BY ALL"""


@query(rollup_sql(H_OF))
def downsample_1h(spark: SparkSession, sf: str) -> DataFrame:
    return series_ops.downsample(points(spark, sf), HOUR).withColumn("total", F.round("total", 6))


@query(rollup_sql(D_OF))
def downsample_1d(spark: SparkSession, sf: str) -> DataFrame:
    return series_ops.downsample_again(series_ops.downsample(points(spark, sf), HOUR), DAY).withColumn("total", F.round("total", 6))


@query(f"""WITH {{P}}, a AS (SELECT series_key, timestamp, value > 20 AS above FROM p), r AS (
  SELECT *, sum(CASE WHEN above THEN 0 ELSE 1 END) OVER (PARTITION BY series_key ORDER BY timestamp) AS run FROM a), g AS (
  SELECT series_key, run, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS samples FROM r WHERE above GROUP BY ALL)
SELECT series_key, start_ts, end_ts, samples FROM g WHERE end_ts - start_ts >= {HOUR}""")
def alert_for(spark: SparkSession, sf: str) -> DataFrame:
    """An alert is a series', so a window holds one series."""
    return series_ops.alerts(points(spark, sf), 20.0, HOUR, "series_key")


# -- text formats --------------------------------------------------------------------------------------------------------


@query("WITH {P} SELECT metric || f AS metric, 'user_id=' || CAST(user_id AS VARCHAR) AS tags, timestamp, v AS value FROM p, LATERAL (SELECT unnest(['', '.twice']) AS f, unnest([value, CAST(lsn AS DOUBLE)]) AS v)")
def line_protocol(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("lsn").cast("string")
    line = F.concat("metric", F.lit(",user_id="), F.col("labels").getItem("user_id"), F.lit(" value="), F.col("value").cast("string"), F.lit(",twice="), number, F.lit("i "), F.col("timestamp").cast("string"))
    found = ingest.line_protocol(points(spark, sf).select(line.alias("line")))
    return found.select("metric", labels_key(F.col("labels")).alias("tags"), "timestamp", "value")


@query(f"""WITH {{P}} SELECT metric || f AS metric, 'user_id=' || CAST(user_id AS VARCHAR) || ',zone=a b' AS tags, CASE WHEN lsn % 3 = 0 THEN {NOW} ELSE timestamp END AS timestamp, v AS value
FROM p, LATERAL (SELECT unnest(['', '.even']) AS f, unnest([value, CASE WHEN lsn % 2 = 0 THEN 1.0 ELSE 0.0 END]) AS v)""")
def line_protocol_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Booleans, text with blanks, commas and quotes, escaped blanks, and lines without a time."""
    even, time = F.when(F.col("lsn") % 2 == 0, "true").otherwise("F"), F.when(F.col("lsn") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.col("timestamp").cast("string")))
    line = F.concat("metric", F.lit(",user_id="), F.col("labels").getItem("user_id"), F.lit(r',zone=a\ b note="two words, a=b and \"more\"",value='), F.col("value").cast("string"), F.lit(",even="), even, time)
    found = ingest.line_protocol(points(spark, sf).select(line.alias("line")), now=NOW)
    return found.select("metric", labels_key(F.col("labels")).alias("tags"), "timestamp", "value")


@query("WITH {P} SELECT metric || f AS metric, 'user_id=' || CAST(user_id AS VARCHAR) AS tags, timestamp, v AS value FROM p, LATERAL (SELECT unnest(['', '.k']) AS f, unnest([value, CAST(lsn AS DOUBLE)]) AS v)")
def json_ingest(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.col("lsn").cast("double"))
    body = F.to_json(F.struct("metric", F.col("labels").alias("tags"), fields.alias("fields"), "timestamp"))
    found = ingest.json_points(points(spark, sf).select(body.alias("body")))
    return found.select("metric", labels_key(F.col("labels")).alias("tags"), "timestamp", "value")


# -- query languages -----------------------------------------------------------------------------------------------------


def prom(spark: SparkSession, sf: str, text: str, window: int) -> DataFrame:
    found = promql.evaluate(points(spark, sf, T0 - window, END + 1), text, T0, END, STEP)
    return found.select("labels_key", "step", r6(F.col("value"), "value"))


@query(steps_sql(300 * SECOND, "'user_id=' || CAST(user_id AS VARCHAR) AS labels_key, step, round(arg_max(value, timestamp), 6) AS value", "metric = 'click'"))
def promql_instant(spark: SparkSession, sf: str) -> DataFrame:
    return prom(spark, sf, "click", 300 * SECOND)


@query(steps_sql(12 * HOUR, "'user_id=' || CAST(user_id AS VARCHAR) AS labels_key, step, round(avg(value), 6) AS value", "metric = 'click' AND regexp_full_match(CAST(user_id AS VARCHAR), '1.*')"))
def promql_avg_over_time(spark: SparkSession, sf: str) -> DataFrame:
    return prom(spark, sf, 'avg_over_time(click{user_id=~"1.*"}[12h])', 12 * HOUR)


@query("""SELECT '' AS labels_key, step, round(sum(v), 6) AS value FROM (""" + steps_sql(12 * HOUR, "series_key, step, CAST(count(*) AS DOUBLE) AS v", "metric IN ('click', 'view')") + ") GROUP BY ALL HAVING sum(v) > 3")
def promql_sum(spark: SparkSession, sf: str) -> DataFrame:
    return prom(spark, sf, 'sum(count_over_time({__name__=~"click|view"}[12h])) > 3', 12 * HOUR)


@query(f"""WITH {{P}}, t AS (SELECT unnest(range({T0}, {END + 1}, {STEP})) AS step), w AS (
  SELECT user_id, step, timestamp, value, lag(value) OVER (PARTITION BY user_id, step ORDER BY timestamp) AS before FROM p JOIN t ON timestamp > step - {2 * DAY} AND timestamp <= step WHERE metric = 'click'), i AS (
  SELECT user_id, step, sum(CASE WHEN before IS NULL THEN 0 WHEN value >= before THEN value - before ELSE value END) AS inc, count(*) AS n, (max(timestamp) - min(timestamp)) / 1e9 AS secs FROM w GROUP BY ALL HAVING count(*) >= 2)
SELECT 'user_id=' || CAST(user_id AS VARCHAR) AS labels_key, step, round(1000 * (inc / secs) + inc, 6) AS value FROM i""")
def promql_rate(spark: SparkSession, sf: str) -> DataFrame:
    return prom(spark, sf, "1000 * rate(click[2d]) + increase(click[2d])", 2 * DAY)


@query(f"""WITH {{P}}, t AS (SELECT unnest(range({T0}, {END + 1}, {STEP})) AS step), a AS (
  SELECT user_id, step, max(value) AS v FROM p JOIN t ON timestamp > step - {DAY} AND timestamp <= step WHERE metric = 'click' GROUP BY ALL), b AS (
  SELECT user_id, step, min(value) AS v FROM p JOIN t ON timestamp + {6 * HOUR} > step - {DAY} AND timestamp + {6 * HOUR} <= step WHERE metric = 'view' GROUP BY ALL)
SELECT 'user_id=' || CAST(user_id AS VARCHAR) AS labels_key, step, round((a.v - b.v) / 2, 6) AS value FROM a JOIN b USING (user_id, step)""")
def promql_binary(spark: SparkSession, sf: str) -> DataFrame:
    return prom(spark, sf, "(max by (user_id) (max_over_time(click[1d])) - min_over_time(view[1d] offset 6h)) / 2", DAY + 6 * HOUR)


def windows_sql(window: int) -> str:
    """Windows of clicks (c) and views (v) of every user and step."""
    return f"""WITH {{P}}, t AS (SELECT unnest(range({T0}, {END + 1}, {STEP})) AS step), w AS (
  SELECT metric, user_id, 'user_id=' || CAST(user_id AS VARCHAR) AS labels_key, step, timestamp, value FROM p JOIN t ON timestamp > step - {window} AND timestamp <= step), c AS (
  SELECT user_id, labels_key, step, sum(value) AS v, count(*) AS n FROM w WHERE metric = 'click' GROUP BY ALL), v AS (
  SELECT user_id, labels_key, step, sum(value) AS v, count(*) AS n FROM w WHERE metric = 'view' GROUP BY ALL)"""


@query(windows_sql(DAY) + " SELECT labels_key, step, round(v, 6) AS value FROM c QUALIFY row_number() OVER (PARTITION BY step ORDER BY v DESC, labels_key) <= 3")
def promql_topk(spark: SparkSession, sf: str) -> DataFrame:
    return prom(spark, sf, "topk(3, sum_over_time(click[1d]))", DAY)


@query(windows_sql(DAY) + " SELECT '' AS labels_key, step, round(quantile_cont(v, 0.9) + stddev_pop(v), 6) AS value FROM c GROUP BY step")
def promql_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return prom(spark, sf, "quantile(0.9, sum_over_time(click[1d])) + stddev(sum_over_time(click[1d]))", DAY)


@query(windows_sql(2 * DAY) + """, l AS (SELECT *, lag(value) OVER s AS before, lag(timestamp) OVER s AS since FROM w WHERE metric = 'click' WINDOW s AS (PARTITION BY user_id, step ORDER BY timestamp))
SELECT labels_key, step, round(arg_max(CASE WHEN value >= before THEN value - before ELSE value END / ((timestamp - since) / 1e9), timestamp), 9) AS value FROM l WHERE since IS NOT NULL GROUP BY ALL""")
def promql_irate(spark: SparkSession, sf: str) -> DataFrame:
    found = promql.evaluate(points(spark, sf, T0 - 2 * DAY, END + 1), "irate(click[2d])", T0, END, STEP)
    return found.select("labels_key", "step", F.round("value", 9).alias("value"))


@query(windows_sql(12 * HOUR) + """, b AS (SELECT * FROM c WHERE n >= 1 AND EXISTS (SELECT 1 FROM v WHERE v.user_id = c.user_id AND v.step = c.step)), o AS (
  SELECT * FROM v WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM c WHERE v.user_id = c.user_id AND v.step = c.step))
SELECT labels_key, step, CAST(n AS DOUBLE) AS value FROM b UNION ALL SELECT labels_key, step, CAST(n AS DOUBLE) FROM o""")
def promql_sets(spark: SparkSession, sf: str) -> DataFrame:
    text = "count_over_time(click[12h]) and count_over_time(view[12h]) or (count_over_time(view[12h]) > 1 unless count_over_time(click[12h]))"
    return prom(spark, sf, text, 12 * HOUR)


@query(windows_sql(DAY) + ", s AS (SELECT step, sum(v) AS total FROM c GROUP BY ALL) SELECT labels_key, step, round(100 * v / total, 6) AS value FROM c JOIN s USING (step)")
def promql_group_left(spark: SparkSession, sf: str) -> DataFrame:
    return prom(spark, sf, "100 * sum_over_time(click[1d]) / on() group_left sum(sum_over_time(click[1d]))", DAY)


@query(windows_sql(DAY) + """ SELECT labels_key, step, CASE WHEN n % 2 > 0 THEN floor(v) / 2 ELSE CAST('inf' AS DOUBLE) END AS value FROM c""")
def promql_numbers(spark: SparkSession, sf: str) -> DataFrame:
    n = "(count_over_time(click[1d]) % 2 > bool 0)"
    return prom(spark, sf, f"(floor(sum_over_time(click[1d])) / 2 ^ (3 - 2)) * {n} / {n}".replace(f"* {n} / {n}", f"+ (1 / {n} - 1)"), DAY)


@query(f"WITH {{P}} SELECT {H_OF} AS bucket, round(avg(value), 6) AS mean, count(*) AS n FROM p WHERE timestamp > {NOW} - {10 * DAY} GROUP BY 1")
def sqlts_bucket(spark: SparkSession, sf: str) -> DataFrame:
    text = "SELECT TIME_BUCKET('1h', timestamp) AS bucket, round(AVG(value), 6) AS mean, count(*) AS n FROM points WHERE timestamp > NOW() - INTERVAL '10d' GROUP BY 1"
    return tsql.query(spark, text, NOW, points=points(spark, sf, NOW - 10 * DAY))


@query("""WITH {P}, l AS (SELECT *, lag(value) OVER (PARTITION BY series_key ORDER BY timestamp) AS before FROM p), s AS (
  SELECT series_key, sum(CASE WHEN before IS NULL THEN 0 WHEN value >= before THEN value - before ELSE value END) AS inc, (max(timestamp) - min(timestamp)) / 1e9 AS secs,
         arg_min(value, timestamp) AS f, arg_max(value, timestamp) AS l FROM l GROUP BY ALL HAVING count(*) > 1)
SELECT series_key, f AS first_value, l AS last_value, round(l - f, 6) AS delta_value, round(inc / secs, 9) AS rate_value FROM s""")
def sqlts_functions(spark: SparkSession, sf: str) -> DataFrame:
    text = """SELECT series_key, FIRST(value, timestamp) AS first_value, LAST(value, timestamp) AS last_value, round(DELTA(value, timestamp), 6) AS delta_value,
              round(RATE(value, timestamp), 9) AS rate_value FROM points GROUP BY series_key HAVING count(*) > 1"""
    return tsql.query(spark, text, NOW, points=points(spark, sf))


# -- the flagship --------------------------------------------------------------------------------------------------------


@query(f"""WITH {{P}} SELECT {H_OF} AS part_start, series_key, count(*) AS point_count, min(timestamp) AS min_ts, max(timestamp) AS max_ts, round(avg(value), 6) AS mean
FROM p WHERE timestamp >= {T0} AND timestamp < {T0 + 7 * DAY} GROUP BY ALL""")
def hourly_series_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = scan.scan(hours(points(spark, sf, T0, T0 + 7 * DAY)), T0, T0 + 7 * DAY, HOUR)
    return rows.groupBy("part_start", "series_key").agg(
        F.count(F.lit(1)).alias("point_count"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"), r6(F.avg("value"), "mean")
    )
