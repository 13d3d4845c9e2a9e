"""Checks of a log before or after it is analysed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from togglelog.operators.pairing import BY_DEVICE, BY_EVENT, fold_roles, pair_chunks, usable_rows
from togglelog.operators.skew import ROWS_PER_GROUP, find_hot_keys, join_null_safe, rank_chunks, split_into_chunks
from togglelog.schema import TIME_ORDER, normalise


def profile(log: DataFrame) -> DataFrame:
    """Rows, distinct events, devices and toggle values, and the time range, in one row."""
    groups = (
        normalise(log)
        .groupBy("event", "device_id", "toggled")
        .agg(F.count("*").alias("_n"), F.min("time_ns").alias("_lo"), F.max("time_ns").alias("_hi"))
    )
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.count_distinct("event").alias("events"),
        F.count_distinct("device_id").alias("devices"),
        F.count_distinct("toggled").alias("toggle_values"),
        F.min("_lo").alias("min_time_ns"),
        F.max("_hi").alias("max_time_ns"),
    )


def preview(log: DataFrame, n: int = 10) -> DataFrame:
    """The first rows in file order."""
    return log.orderBy("ord").limit(n)


def unbalanced_groups(log: DataFrame) -> DataFrame:
    """Groups with a different number of starts and ends."""
    return (
        normalise(log)
        .where(F.col("device_id").isNotNull() & F.col("event").isNotNull())
        .groupBy(*BY_DEVICE)
        .agg(F.count_if("toggled").alias("starts"), F.count_if(~F.col("toggled")).alias("ends"))
        .where("starts <> ends")
    )


def label_rows(
    log: DataFrame,
    by_device: bool = True,
    match_message: bool | None = None,
    rows_per_group: int | None = ROWS_PER_GROUP,
) -> DataFrame:
    """What pairing did with each row: start, end, ignored, or unclosed (opened, never closed).

    Rows of groups that are too big for one task are numbered and paired in chunks, and their roles joined on
    (group, number), which spreads even one big group. Rows with the same time and `ord` have no order among them.
    """
    keys = list(BY_DEVICE if by_device else BY_EVENT)
    match_message = by_device if match_message is None else match_message
    rows = usable_rows(log, by_device)
    hot_keys = find_hot_keys(rows, keys, rows_per_group)
    if hot_keys is None:
        return fold_roles(rows, keys, match_message)
    cold = fold_roles(rows.where(~hot_keys.matches()), keys, match_message)
    hot = rows.where(hot_keys.matches())
    chunked = split_into_chunks(hot, hot_keys, TIME_ORDER)
    # checkpointed, so that pairing and the join see the same numbers
    placed = rank_chunks(chunked, keys, TIME_ORDER, "_place").checkpoint()
    paired = pair_chunks(placed.withColumn("ord", F.col("_place")).drop("_place"), keys, match_message)
    start = F.when(F.col("end_ord").isNull(), F.lit("unclosed")).otherwise(F.lit("start"))
    marks = F.array(
        F.struct(F.col("start_ord").alias("_place"), start.alias("role")),
        F.struct(F.col("end_ord").alias("_place"), F.lit("end").alias("role")),
    )
    roles = paired.select(*keys, F.inline(marks)).where("_place IS NOT NULL")
    labelled = placed.join(roles, [*keys, "_place"], "left").fillna("ignored", ["role"])
    return cold.unionByName(labelled.select(*cold.columns))


def groups_without_execution(
    log: DataFrame,
    executions: DataFrame,
    by_device: bool = True,
) -> DataFrame:
    """Groups that have rows but completed no execution."""
    keys = list(BY_DEVICE if by_device else BY_EVENT)
    groups = usable_rows(log, by_device).select(*keys).distinct()
    return join_null_safe(groups, executions.select(*keys).distinct(), keys, "left_anti")
