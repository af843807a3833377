"""Series analytics: buckets, rates, first and last, downsampling, selectors, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeops import align
from tidemark.model import SECOND


def time_bucket(width: int, t: Column | str = "timestamp") -> Column:
    return align(t, width)


def label_matches(labels: Column, name: str, op: str, value: str) -> Column:
    """=, !=, =~ and !~; patterns are anchored at both ends, and a missing label is an empty one."""
    found = F.coalesce(labels.getItem(name), F.lit(""))
    if op in ("=", "!="):
        hit = found == value
    elif op in ("=~", "!~"):
        hit = found.rlike(rf"\A(?:{value})\z")
    else:
        raise ValueError(op)
    return ~hit if op.startswith("!") else hit


def at_steps(points: DataFrame, start: int, end: int, step: int, window: int) -> DataFrame:
    """A row for each evaluation time t (start, start + step, ... to end) with t - window < timestamp <= t.

    Each point names the steps it belongs to, so no range join is needed: the fan-out is window / step."""
    points = points.where((F.col("timestamp") > start - window) & (F.col("timestamp") <= end))
    # Whole numbers throughout: nanoseconds do not fit a double.
    first = F.when(F.col("timestamp") <= start, F.lit(0).cast("long")).otherwise(F.expr(f"(timestamp - {start}L + {step - 1}L) div {step}L"))
    last = F.least(F.lit((end - start) // step), F.expr(f"(timestamp + {window - 1}L - {start}L) div {step}L"))  # before timestamp + window
    steps = points.withColumn("first", first).withColumn("last", last).where("first <= last")
    steps = steps.withColumn("step", F.explode(F.sequence("first", "last"))).drop("first", "last")
    return steps.withColumn("step", F.col("step") * step + start)


def increase_of(samples: Column) -> Column:
    """Of an array of struct(timestamp, value) in order of time: what a counter grew by; after a reset it starts at 0."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(samples) - 1), lambda i: F.struct(samples[i - 1]["value"].alias("a"), samples[i]["value"].alias("b")))
    grown = F.aggregate(pairs, F.lit(0.0), lambda sum_, p: sum_ + F.when(p["b"] >= p["a"], p["b"] - p["a"]).otherwise(p["b"]))
    return F.when(F.size(samples) >= 2, grown)


def samples_of() -> Column:
    return F.array_sort(F.collect_list(F.struct("timestamp", "value")))


def rate(points: DataFrame, *by: str) -> DataFrame:
    """increase, and per second between the first and last sample; no extrapolation to the window's edges. Windows with
    one sample give none. Differences are taken beside each other, so nothing is gathered into arrays."""
    w = Window.partitionBy(*by).orderBy("timestamp")
    before = F.lag("value").over(w)
    step = F.when(before.isNull(), 0.0).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    sums = points.withColumn("step", step).groupBy(*by).agg(
        F.sum("step").alias("increase"), F.count(F.lit(1)).alias("samples"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")
    )
    return sums.where("samples >= 2").withColumn("rate", F.col("increase") / ((F.col("hi") - F.col("lo")) / F.lit(float(SECOND))))


def first_last(points: DataFrame, *by: str) -> DataFrame:
    """Value at the earliest and at the latest time, and ``delta`` between them."""
    found = points.groupBy(*by).agg(F.min_by("value", "timestamp").alias("first"), F.max_by("value", "timestamp").alias("last"))
    return found.withColumn("delta", F.col("last") - F.col("first"))


def downsample(points: DataFrame, width: int) -> DataFrame:
    """Per series and bucket what composes: count, sum, min, max, first and last with their times."""
    return points.groupBy("series_key", align("timestamp", width).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.min_by("value", "timestamp").alias("first"), F.max_by("value", "timestamp").alias("last"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
    )


def downsample_again(rollup: DataFrame, width: int) -> DataFrame:
    """A coarser rollup from a finer one: never an average of averages."""
    return rollup.groupBy("series_key", align("bucket", width).alias("bucket")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min_by("first", "first_ts").alias("first"), F.max_by("last", "last_ts").alias("last"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )


def tiered_ttl(partitions: DataFrame, width: int, tiers: dict[str, int], now: int) -> DataFrame:
    """For each partition and tier whether its time is over."""
    tier = F.explode(F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(v).alias("ttl")) for k, v in tiers.items()]))
    rows = partitions.select("part_start", tier.alias("x")).select("part_start", "x.tier", "x.ttl")
    return rows.select("part_start", "tier", (F.col("part_start") + width + F.col("ttl") < now).alias("expired"))


def alerts(points: DataFrame, threshold: float, hold: int, *by: str) -> DataFrame:
    """Runs of samples above the threshold that last ``hold`` or longer: start_ts, end_ts, samples."""
    w = Window.partitionBy(*by).orderBy("timestamp")
    above = points.withColumn("above", F.col("value") > threshold)
    island = above.withColumn("run", F.sum(F.when(F.col("above"), 0).otherwise(1)).over(w)).where("above")
    runs = island.groupBy(*by, "run").agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count(F.lit(1)).alias("samples"))
    return runs.where(F.col("end_ts") - F.col("start_ts") >= hold).drop("run")

