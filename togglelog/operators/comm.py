"""Propagation of messages from the device that sends them to the devices that receive them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from togglelog.functions.columns import (
    RECEIVE_EVENT,
    SEND_EVENT,
    exact_sum,
    is_sync_message,
    is_usable_message,
    per_hop,
)
from togglelog.schema import normalise


def has_numeric_messages(log: DataFrame) -> bool:
    """Whether all message ids of a log are numbers. One job over the column; a log without ids has none."""
    number = F.col("message_id").try_cast("double")
    given = normalise(log).where("message_id IS NOT NULL AND message_id <> ''")
    return bool(given.agg(F.bool_and(number.isNotNull()).alias("numeric")).first()["numeric"])


def message_rows(
    log: DataFrame, send: str = SEND_EVENT, receive: str = RECEIVE_EVENT, numeric_messages: bool = False
) -> DataFrame:
    """Rising edges of the two message events, with a usable message id that is no sync pulse.

    `numeric_messages`: the ids are numbers (see `has_numeric_messages`), so that zero means none.
    """
    return (
        normalise(log)
        .where(F.col("event").isin(send, receive) & F.col("toggled") & F.col("time_ns").isNotNull())
        .where(is_usable_message(numeric=numeric_messages) & ~is_sync_message())
        .select("event", "message_id", "device_id", "position", "time_ns", "ord")
    )


def first_sends(rows: DataFrame, send: str = SEND_EVENT) -> DataFrame:
    """First send of each message in file order; later sends do not count.

    Grouped by a hash besides the message, which changes no group: so a join on the message shuffles both of its
    sides anew, and only then does adaptive execution split the side of a message that is large there.
    """
    first = F.min_by(F.struct("device_id", "position", "time_ns"), F.struct("ord", "time_ns"))
    return (
        rows.where(F.col("event") == send)
        .groupBy("message_id", F.xxhash64("message_id"))
        .agg(first.alias("_s"))
        .select(
            "message_id",
            F.col("_s.device_id").alias("from_device"),
            F.col("_s.position").alias("from_position"),
            F.col("_s.time_ns").alias("send_ns"),
        )
    )


def first_receives(rows: DataFrame, receive: str = RECEIVE_EVENT) -> DataFrame:
    """First receive of each message on each device in file order."""
    first = F.min_by(F.struct("position", "time_ns"), F.struct("ord", "time_ns"))
    return (
        rows.where((F.col("event") == receive) & F.col("device_id").isNotNull())
        .groupBy("message_id", "device_id")
        .agg(first.alias("_r"))
        .select(
            "message_id",
            F.col("device_id").alias("to_device"),
            F.col("_r.position").alias("to_position"),
            F.col("_r.time_ns").alias("receive_ns"),
        )
    )


def propagation(
    log: DataFrame,
    send: str = SEND_EVENT,
    receive: str = RECEIVE_EVENT,
    numeric_messages: bool = False,
) -> DataFrame:
    """One row per message and device that received it, other than the sender.

    Sends come down to the first of each message, receives to the first of each message on each device,
    in partial minima before they are shuffled: a message that reaches any number of devices is no larger in the first
    shuffle than the tasks that read it, and its receives are spread by device. They meet in a join on the message, whose large partitions
    adaptive execution splits; no window holds a message's rows.
    """
    rows = message_rows(log, send, receive, numeric_messages)
    joined = first_receives(rows, receive).join(first_sends(rows, send), "message_id")

    hops = F.abs(F.col("to_position") - F.col("from_position"))
    time = F.col("receive_ns") - F.col("send_ns")
    return joined.where(~F.col("to_device").eqNullSafe(F.col("from_device"))).select(
        "message_id",
        "from_device",
        "to_device",
        "from_position",
        "to_position",
        hops.alias("hops"),
        time.alias("time_ns"),
        per_hop(time, hops).alias("time_per_hop_ns"),
    )


def message_stats(propagations: DataFrame) -> DataFrame:
    """Per message: its source device and the number of devices it reached."""
    return propagations.groupBy("message_id", F.col("from_device").alias("source_device")).agg(
        F.count("*").alias("destination_count")
    )


def pair_means(propagations: DataFrame) -> DataFrame:
    """Mean time and mean hops per (from, to) pair. Order by the pair where it is shown."""
    return propagations.groupBy("from_device", "to_device").agg(
        F.avg("time_ns").alias("mean_time_ns"), F.avg("hops").alias("mean_hops")
    )


def hop_cost(propagations: DataFrame) -> DataFrame:
    """Total time over total hops (0 without hops), with the number of propagations and messages."""
    per_message = propagations.groupBy("message_id").agg(
        F.count("*").alias("_n"),
        exact_sum(propagations, "time_ns").alias("_time"),
        F.sum("hops").alias("_hops"),
    )
    total_hops = F.coalesce(F.sum("_hops"), F.lit(0.0))
    total_time = F.sum("_time").cast("double")
    return per_message.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_propagations"),
        F.count("*").alias("n_messages"),
        total_hops.alias("total_hops"),
        F.when(total_hops > 0, total_time / total_hops).otherwise(F.lit(0.0)).alias("time_per_hop_ns"),
    )


def hop_trend(propagations: DataFrame) -> DataFrame:
    """Least-squares line of time on hops per source device; NULL where hops do not vary."""
    time, hops = F.col("time_ns").cast("double"), F.col("hops")
    return propagations.groupBy("from_device").agg(
        F.regr_slope(time, hops).alias("slope_ns"),
        F.regr_intercept(time, hops).alias("intercept_ns"),
        F.regr_r2(time, hops).alias("r2"),
        F.regr_count(time, hops).alias("n"),
    )
