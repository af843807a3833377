"""Levelled compaction: which files to merge, the merge, and its figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import CompactionError

#: Level and number of files above which it is compacted into the next.
LEVELS = {0: 4, 1: 10, 2: 100}


def plan(files: DataFrame, levels: dict[int, int] = LEVELS) -> DataFrame:
    """Per partition: the first level with more files than it may have, if a next level exists. ``files``: part_start, level."""
    conf = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
    counts = files.groupBy("part_start", "level").agg(F.count(F.lit(1)).alias("inputs"))
    known = F.map_contains_key(conf, F.col("level")) & F.map_contains_key(conf, F.col("level") + 1)
    over = counts.where(F.map_contains_key(conf, F.col("level"))).where(F.col("inputs") > F.try_element_at(conf, F.col("level")))
    # The first level over its limit decides; without a next level there is no plan.
    first = over.groupBy("part_start").agg(F.min("level").alias("level"), F.min_by("inputs", "level").alias("inputs"))
    return first.where(known).select("part_start", "level", (F.col("level") + 1).alias("target_level"), "inputs")


def next_generation(files: DataFrame) -> DataFrame:
    return files.groupBy("series_key").agg((F.max("generation") + 1).alias("next_generation"))


def with_block_lsn(blocks: DataFrame) -> DataFrame:
    """block_lsn: the greatest lsn of the point's block, a series in a file."""
    highest = blocks.groupBy("series_key", "file_id").agg(F.max("lsn").alias("block_lsn"))
    return blocks.join(highest, ["series_key", "file_id"])


def merge(blocks: DataFrame, lsn_scope: str = "block", carry: tuple[str, ...] = ()) -> DataFrame:
    """One value for each (series, timestamp), with the columns ``carry`` of its row, and how many points it replaces.

    ``block``: the block with the greatest lsn wins, then the higher generation, then the point's own lsn; so an older
    point in a newer block wins. ``point``: the point's lsn decides."""
    if lsn_scope == "block":
        blocks, order = with_block_lsn(blocks), F.struct("block_lsn", "generation", "lsn")
    elif lsn_scope == "point":
        order = F.struct("lsn", "generation")
    else:
        raise ValueError(lsn_scope)
    found = blocks.groupBy("series_key", "timestamp").agg(F.max_by(F.struct("value", *carry), order).alias("x"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return found.select("series_key", "timestamp", "x.*", "duplicates")


def stats(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.countDistinct("series_key").alias("output_files"), F.count(F.lit(1)).alias("merged_points"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates")
    )


def conflicts(series: DataFrame) -> DataFrame:
    """Ids that stand for more than one series."""
    return series.groupBy("series_id").agg(F.countDistinct("series_key").alias("names")).where("names > 1")


def check_series(series: DataFrame) -> None:
    if not conflicts(series).isEmpty():
        raise CompactionError("a series id has different metadata across inputs")
