"""How a series is laid out: differences of timestamps, repeats of values, and the size of an encoded block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a block besides its columns; bits of the first timestamp and value, of a repeated and of a
#: changed value (control bits, two widths, 64 bits); and the bits of a timestamp by its delta of delta.
BLOCK_BYTES = 50
FIRST_BITS, REPEAT_BITS, CHANGED_BITS = 64, 1, 66
DOD_BITS = ((0, 0, 1), (-63, 64, 9), (-255, 256, 12), (-2047, 2048, 16))
WIDE_BITS = 36


#: Names of the codes in a file's header and in a block.
COMPRESSION = {0: "raw", 1: "gorilla"}
TIMESTAMP_ENCODING = {0: "raw", 1: "delta_of_delta"}
VALUE_ENCODING = {0: "raw", 1: "gorilla_xor"}


def named(code: Column, names: dict[int, str], default: str | None = None) -> Column:
    """The name of a code; ``default`` for an unknown one, or without it an error when the query runs."""
    found = F.lit(None).cast("string")
    for number, name in names.items():
        found = F.when(code == number, name).otherwise(found)
    other = F.lit(default) if default is not None else F.raise_error(F.concat(F.lit("unsupported code "), code.cast("string"))).cast("string")
    return F.when(code.isin(list(names)), found).otherwise(other)


def series_window() -> Window:
    return Window.partitionBy("series_key").orderBy("timestamp", "lsn")


def delta_of_delta(points: DataFrame) -> DataFrame:
    """delta and dod of every point after the first of its series; the delta before the second point counts as 0."""
    w = series_window()
    found = points.withColumn("delta", F.col("timestamp") - F.lag("timestamp").over(w))
    return found.withColumn("dod", F.col("delta") - F.coalesce(F.lag("delta").over(w), F.when(F.col("delta").isNotNull(), F.lit(0))))


def repeats(points: DataFrame) -> DataFrame:
    """``repeated``: the value equals the one before in its series (NaN equals NaN)."""
    before = F.lag("value").over(series_window())
    return points.withColumn("repeated", F.coalesce(before.eqNullSafe(F.col("value")) & before.isNotNull(), F.lit(False)))


def dod_bits(dod: Column) -> Column:
    bits = F.when(dod.isNull(), FIRST_BITS)
    for low, high, n in DOD_BITS:
        bits = bits.when(dod.between(low, high), n)
    return bits.otherwise(WIDE_BITS)


def size_model(points: DataFrame) -> DataFrame:
    """Per series: n, ts_bits, value_bits, block_bytes, and raw bytes, in one pass over one window order."""
    w = series_window()
    before = F.lag("value").over(w)
    value_bits = F.when(before.isNull(), FIRST_BITS).when(before.eqNullSafe(F.col("value")), REPEAT_BITS).otherwise(CHANGED_BITS)
    found = delta_of_delta(points.withColumn("value_bits", value_bits))
    sums = found.groupBy("series_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(dod_bits(F.col("dod"))).cast("long").alias("ts_bits"), F.sum("value_bits").cast("long").alias("v_bits")
    )
    size = F.ceil(F.col("ts_bits") / 8) + F.ceil(F.col("v_bits") / 8) + BLOCK_BYTES
    return sums.withColumn("block_bytes", size.cast("long")).withColumn("raw_bytes", F.col("n") * 16)


def pack_columns(points: DataFrame, *by: str) -> DataFrame:
    """A row for each block (a series in a partition, so its size is bounded by the partition's width) with its timestamps
    and values as two arrays, in order of time."""
    by = by or ("series_key",)
    both = F.array_sort(F.collect_list(F.struct("timestamp", "value")))
    return points.groupBy(*by).agg(both.alias("x")).select(*by, F.col("x.timestamp").alias("timestamps"), F.col("x.value").alias("values"))


def zip_columns(packed: DataFrame, *keep: str) -> DataFrame:
    """The reverse of ``pack_columns``: the arrays zipped by position."""
    keep = keep or ("series_key",)
    rows = packed.select(*keep, F.explode(F.arrays_zip("timestamps", "values")).alias("x"))
    return rows.select(*keep, F.col("x.timestamps").alias("timestamp"), F.col("x.values").alias("value"))
