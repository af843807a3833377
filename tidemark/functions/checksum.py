"""Checksums of blocks: what a series holds, as one number that any engine can compute again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import CorruptFile


def checksums(points: DataFrame, *by: str) -> DataFrame:
    """Of every block the number of its points, and of the CRC-32 of each (timestamp, value) the sum and the exclusive or.
    They do not depend on order and add up, so no block is gathered in one row. Values count by their shortest decimal form."""
    crc = F.crc32(F.concat_ws(":", F.col("timestamp").cast("string"), F.col("value").cast("string")).cast("binary"))
    sums = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(crc).alias("total"), F.bit_xor(crc).alias("mixed"))
    return sums.select(*by, F.concat_ws("-", "n", "total", "mixed").alias("crc"))


def verify(points: DataFrame, stored: DataFrame, *by: str) -> None:
    """Raise where a block's checksum differs from the stored one, or a block is missing on either side."""
    found = checksums(points, *by).withColumnRenamed("crc", "found")
    wrong = found.join(stored, list(by), "full_outer").where(~F.col("found").eqNullSafe(F.col("crc")))
    if not wrong.isEmpty():
        raise CorruptFile(f"checksum differs, first at {wrong.select(*by).first()}")
