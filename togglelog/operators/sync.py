"""How far apart the devices of a fleet start the same sync pulse.

A pulse of n devices has n(n-1)/2 pair differences, but its statistics need only the sorted starts:
the largest is last - first, the smallest is the smallest gap, and a gap with i starts below it and
n-i above it lies in i(n-i) pairs, which gives the sum. The mean square of the differences is twice
the sample variance. From three devices on the deviation is never small against the mean, so nothing
cancels; two devices have one difference, and deviation 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from togglelog.functions.columns import SYNC_EVENT, is_sync_message, is_usable_message
from togglelog.operators.skew import (
    ROWS_PER_GROUP,
    ensure_checkpoint_dir,
    find_hot_keys,
    rank_chunks,
    rank_in_groups,
    split_into_chunks,
)
from togglelog.schema import normalise

ORDER = ("start_ns", "device_id")


def pulse_rows(log: DataFrame, event: str = SYNC_EVENT) -> DataFrame:
    """Rising edges of the sync event that carry a pulse's message id."""
    return (
        normalise(log)
        .where((F.col("event") == event) & F.col("toggled"))
        .where(is_usable_message() & is_sync_message())
        .where(F.col("device_id").isNotNull() & F.col("time_ns").isNotNull())
    )


def sync_starts(log: DataFrame, event: str = SYNC_EVENT) -> DataFrame:
    """Start of each pulse on each device: the last True row in file order."""
    rows = pulse_rows(log, event).groupBy("message_id", "device_id")
    return rows.agg(F.max_by("time_ns", "ord").alias("start_ns"))


def ranked_starts(
    log: DataFrame, event: str = SYNC_EVENT, rows_per_group: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """The pulses' starts with their rank in the pulse, device_count, time since the pulse's first
    start and since the previous start (NULL for the first)."""
    starts = sync_starts(log, event)
    pulse = Window.partitionBy("message_id")
    ordered = pulse.orderBy(*ORDER)
    columns = ["message_id", "device_id", "start_ns", "rank", "device_count", "offset_ns", "gap_ns"]

    def small(rows: DataFrame) -> DataFrame:
        first = F.first("start_ns").over(ordered)
        return (
            rows.withColumn("rank", F.row_number().over(ordered).cast("long"))
            .withColumn("offset_ns", F.col("start_ns") - first)
            .withColumn("gap_ns", F.col("start_ns") - F.lag("start_ns").over(ordered))
            .withColumn("device_count", F.count("*").over(pulse))
            .select(*columns)
        )

    if rows_per_group is not None:  # worked out once, for the look and for the ranks
        ensure_checkpoint_dir(log.sparkSession)
        starts = starts.checkpoint()
    hot_keys = find_hot_keys(starts, ["message_id"], rows_per_group)
    if hot_keys is None:
        return small(starts)
    chunked = split_into_chunks(starts.where(hot_keys.matches()), hot_keys, ORDER)
    in_chunk = Window.partitionBy("message_id", "chunk").orderBy(*ORDER)
    by_chunk = Window.partitionBy("message_id").orderBy("chunk")
    # one row per chunk and hot pulse
    chunks = (
        chunked.groupBy("message_id", "chunk")
        .agg(
            F.count("*").alias("_n"),
            F.min("start_ns").alias("_first"),
            F.max("start_ns").alias("_last"),
        )
        .select(
            "message_id",
            "chunk",
            F.lag("_last").over(by_chunk).alias("_before"),
            F.min("_first").over(pulse).alias("_start"),
            F.sum("_n").over(pulse).alias("device_count"),
        )
    )
    previous = F.coalesce(F.lag("start_ns").over(in_chunk), F.col("_before"))
    big = (
        rank_chunks(chunked, ["message_id"], ORDER, "rank")
        .join(F.broadcast(chunks), ["message_id", "chunk"])
        .withColumn("gap_ns", F.col("start_ns") - previous)
        .withColumn("offset_ns", F.col("start_ns") - F.col("_start"))
        .select(*columns)
    )
    return small(starts.where(~hot_keys.matches())).unionByName(big)


def sync_stats(ranked: DataFrame) -> DataFrame:
    """Max, min, mean and population deviation of the pair differences of each pulse that at least
    two devices started. Takes `ranked_starts`."""
    n = F.col("device_count")
    below = (F.col("rank") - 1).cast("double")
    above = (n - F.col("rank") + 1).cast("double")
    square = 2.0 * F.col("_var") - F.col("mean_diff_ns") * F.col("mean_diff_ns")
    deviation = F.when(n > 2, F.sqrt(F.greatest(square, F.lit(0.0)))).otherwise(F.lit(0.0))
    return (
        ranked.where("device_count >= 2")
        .groupBy("message_id", "device_count")
        .agg(
            F.max("offset_ns").alias("max_diff_ns"),
            F.min("gap_ns").alias("min_diff_ns"),
            F.sum(F.col("gap_ns") * below * above).alias("_sum"),
            F.var_samp("offset_ns").alias("_var"),
        )
        .withColumn("mean_diff_ns", F.col("_sum") / (n.cast("double") * (n - 1) / 2.0))
        .withColumn("std_diff_ns", deviation)
        .drop("_sum", "_var")
    )


def sync_summary(ranked: DataFrame) -> DataFrame:
    """Pulses, devices that took part, largest difference, mean of the pulses' means."""
    pulses = sync_stats(ranked).select("message_id", "max_diff_ns", "mean_diff_ns")
    devices = ranked.where("device_count >= 2").select("device_id").distinct()
    return pulses.unionByName(devices, allowMissingColumns=True).agg(
        F.count("message_id").alias("sync_pulses"),
        F.count("device_id").alias("devices"),
        F.max("max_diff_ns").alias("max_diff_ns"),
        F.avg("mean_diff_ns").alias("mean_diff_ns"),
    )


def sync_pairs(ranked: DataFrame) -> DataFrame:
    """The difference of every two devices of a pulse (device1 < device2).

    This list is the report asked for, and nothing else is computed from it. Each start meets the
    half of the pulse that follows it in rank, counted round, by an equi-join on (pulse, rank): the
    work per key is the same for every device, however big the pulse.
    """
    n, rank = F.col("device_count"), F.col("rank")
    # for even n the step n/2 would meet every pair twice: only the lower half takes it
    steps = F.when(rank * 2 <= n, F.floor(n / 2)).otherwise(F.floor((n - 1) / 2))
    reach = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps.cast("long")))
    left = ranked.select("message_id", "device_id", "start_ns", n, rank, F.explode(reach).alias("_step"))
    left = left.withColumn("_meets", (rank - 1 + F.col("_step")) % n + 1)
    right = ranked.where("device_count >= 2").select(
        "message_id",
        F.col("rank").alias("_meets"),
        F.col("device_id").alias("_device"),
        F.col("start_ns").alias("_start"),
    )
    return left.join(right, ["message_id", "_meets"]).select(
        "message_id",
        F.least("device_id", "_device").alias("device1"),
        F.greatest("device_id", "_device").alias("device2"),
        F.abs(F.col("start_ns") - F.col("_start")).alias("time_diff_ns"),
    )


def sync_pairs_beyond(ranked: DataFrame, limit_ns: int, rows_per_group: int | None = ROWS_PER_GROUP) -> DataFrame:
    """The pairs of `sync_pairs` that differ by more than `limit_ns` (0 or more), without building the others.

    In a pulse's ranked starts the partners of a start are all from some rank on: the first whose offset is
    more than the limit above its own. That rank comes from one ranking of offsets together with offsets
    plus limit; then each start meets its partners by an equi-join on (pulse, rank). Rows are made
    for pairs of the result only, besides two for each start.
    """
    points = ranked.where("device_count >= 2").select("message_id", "rank", "device_id", "start_ns", "offset_ns", "device_count")
    asked = points.select("message_id", "rank", (F.col("offset_ns") + limit_ns).alias("value"), F.lit(1).alias("kind"))
    both = points.select("message_id", "rank", F.col("offset_ns").alias("value"), F.lit(0).alias("kind")).unionByName(asked)
    # of what is ranked up to a question, as many are questions as its own rank says; the rest are starts
    placed = rank_in_groups(both, ["message_id"], ["value", "kind", "rank"], "among", rows_per_group).where("kind = 1")
    first = placed.select("message_id", "rank", (F.col("among") - F.col("rank") + 1).alias("first"))
    left = points.join(first, ["message_id", "rank"]).where(F.col("first") <= F.col("device_count"))
    left = left.select("message_id", "device_id", "start_ns", F.explode(F.sequence("first", "device_count")).alias("_meets"))
    right = points.select(
        "message_id", F.col("rank").alias("_meets"), F.col("device_id").alias("_device"), F.col("start_ns").alias("_start")
    )
    return left.join(right, ["message_id", "_meets"]).select(
        "message_id",
        F.least("device_id", "_device").alias("device1"),
        F.greatest("device_id", "_device").alias("device2"),
        F.abs(F.col("start_ns") - F.col("_start")).alias("time_diff_ns"),
    )
