"""Time arithmetic on nanosecond numbers; nothing here depends on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import DAY, HOUR, SECOND, hex16

DURATIONS = {"hourly": HOUR, "daily": DAY}
SUFFIX = ".tsm"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def align(t: Column | str, width: int) -> Column:
    """Start of the bucket that holds ``t``: floor division, also before the epoch."""
    t = col(t)
    return t - F.pmod(t, F.lit(width))


def in_range(t: Column | str, start: int, end: int) -> Column:
    """Half-open."""
    return (col(t) >= start) & (col(t) < end)


def overlaps(part_start: Column | str, width: int, start: int, end: int) -> Column:
    """Partitions [part_start, part_start + width) that meet [start, end)."""
    return (col(part_start) < end) & (col(part_start) > start - width)


def block_overlaps(min_ts: Column, max_ts: Column, start: int, end: int) -> Column:
    return (max_ts >= start) & (min_ts < end)


def expired(part_start: Column | str, width: int, ttl: int, now: int) -> Column:
    """Strictly later than the end of the partition by more than ``ttl``."""
    return col(part_start) + width + ttl < now


def partition_dir(part_start: Column | str, layout: str = "hourly") -> Column:
    """``YYYY-MM-DD`` or ``YYYY-MM-DD/HH`` in UTC."""
    t = col(part_start)
    day = F.date_add(F.lit("1970-01-01").cast("date"), ((t - F.pmod(t, F.lit(DAY))) / DAY).cast("int"))
    name = day.cast("string")
    if layout == "daily":
        return name
    hour = ((F.pmod(t, F.lit(DAY)) - F.pmod(t, F.lit(HOUR))) / HOUR).cast("int")
    return F.concat(name, F.lit("/"), F.lpad(hour.cast("string"), 2, "0"))


def partitions_in_range(spark: SparkSession, start: int, end: int, width: int) -> DataFrame:
    """part_start of every aligned partition that meets [start, end); none if the range is empty."""
    if end <= start:
        return spark.createDataFrame([], "part_start long")
    low, high = start - start % width, (end - 1) - (end - 1) % width
    return spark.range(low // width, high // width + 1).select((F.col("id") * width).alias("part_start"))


def file_name(series: Column | str, level: Column | str, generation: Column | str) -> Column:
    """``<16 hex digits>_L<level>_G<generation, three digits or more><suffix>``."""
    number = col(generation).cast("string")
    padded = F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0"))
    return F.concat(hex16(col(series)), F.lit("_L"), col(level).cast("string"), F.lit("_G"), padded, F.lit(SUFFIX))


NAME = r"^([0-9a-fA-F]{16})_L([0-9]+)_G([0-9]+)" + SUFFIX.replace(".", r"\.") + "$"


def parse_file_name(name: Column | str) -> Column:
    """struct(series_hex, level, generation), or null where the name is none: a level is below 2^8, a generation below 2^32."""
    name = col(name)
    part = lambda i: F.regexp_extract(name, NAME, i)
    level, generation = part(2).try_cast("long"), part(3).try_cast("long")
    fits = name.rlike(NAME) & (level < 256) & (generation < 1 << 32)
    return F.when(fits, F.struct(F.lower(part(1)).alias("series_hex"), level.alias("level"), generation.alias("generation")))


#: Bits of a file's section flags.
SECTIONS = {"hot": 1, "cold": 2, "meta": 4}


def has_section(flags: Column | str, section: str) -> Column:
    return col(flags).bitwiseAND(SECTIONS[section]) != 0


def seconds(n: float) -> int:
    return int(n * SECOND)
