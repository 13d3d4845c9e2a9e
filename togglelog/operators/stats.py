"""Reports over executions. Persist or write the executions once, then run any number of these."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from togglelog.functions.columns import to_us, type_of
from togglelog.operators.skew import (
    ROWS_PER_GROUP,
    ensure_checkpoint_dir,
    find_hot_keys,
    join_null_safe,
    rank_all,
    rank_chunks,
    rank_in_groups,
    split_into_chunks,
)

QUARTILES = (0.25, 0.5, 0.75)
# A box plot's fences lie this many interquartile ranges outside the box.
FENCE = 1.5


def exec_stats(executions: DataFrame, keys: Sequence[str] = ("device_id", "event")) -> DataFrame:
    """Count, mean, population standard deviation, min and max of the durations of each group.

    `keys=("event",)` is the basic format. The executions of a group are its rows in `executions`.
    """
    return executions.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.avg("duration_ns").alias("mean_ns"),
        F.stddev_pop("duration_ns").alias("std_ns"),
        F.min("duration_ns").alias("min_ns"),
        F.max("duration_ns").alias("max_ns"),
    )


def pooled_stats(executions: DataFrame) -> DataFrame:
    """Per event, all devices pooled: every execution weighs the same."""
    return executions.groupBy("event").agg(
        F.avg("duration_ns").alias("mean_ns"),
        F.stddev_pop("duration_ns").alias("std_ns"),
        F.count("*").alias("count"),
    )


def event_means(stats: DataFrame) -> DataFrame:
    """Per event, the unweighted mean of its groups' means."""
    return stats.groupBy("event").agg(F.avg("mean_ns").alias("mean_ns"))


def fastest_slowest(stats: DataFrame) -> DataFrame:
    """Events with the lowest and the highest mean of group means; ties go to the first name."""
    return event_means(stats).agg(
        F.min_by("event", F.struct("mean_ns", "event")).alias("fastest_event"),
        F.min("mean_ns").alias("fastest_ns"),
        F.min_by("event", F.struct(-F.col("mean_ns"), "event")).alias("slowest_event"),
        F.max("mean_ns").alias("slowest_ns"),
    )


def kpis(stats: DataFrame) -> DataFrame:
    """Completed executions, and the unweighted mean of the group means."""
    return stats.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_executions"),
        F.avg("mean_ns").alias("mean_of_means_ns"),
    )


def event_distribution(executions: DataFrame) -> DataFrame:
    """Executions per event and their share of all executions."""
    counts = executions.groupBy("event").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share", F.col("count") / total)


def trends(
    executions: DataFrame,
    rows_per_group: int | None = ROWS_PER_GROUP,
    log: DataFrame | None = None,
) -> DataFrame:
    """Number the executions of each event from 0 in order of their start, devices merged.

    Given the log, big groups are looked up there and the executions need not be computed for it.
    """
    order = ("start_ns", "device_id", "end_ns", "start_ord")
    ranked = rank_in_groups(executions, ["event"], order, "rank", rows_per_group, log)
    return ranked.select(
        "event", (F.col("rank") - 1).alias("instance"), "device_id", "start_ns", "duration_ns"
    )


def histogram(executions: DataFrame, bins: int = 30) -> DataFrame:
    """Durations per event in equal bins over the range of all durations; the last bin is closed.

    The two columns are checkpointed once and read twice, for the range and for the counts: only (event, bin)
    is shuffled. Executions without a duration don't count.
    """
    ensure_checkpoint_dir(executions.sparkSession)
    narrow = executions.where("duration_ns IS NOT NULL").select("event", "duration_ns").checkpoint()
    low, high = narrow.agg(F.min("duration_ns"), F.max("duration_ns")).first()
    width = (high - low) / float(bins) if low is not None else 0.0
    start, step = F.lit(low).cast(type_of(narrow, "duration_ns")), F.lit(width)
    place = F.floor((F.col("duration_ns") - start).cast("double") / step)
    number = F.least(place, F.lit(bins - 1)).cast("long") if width > 0 else F.lit(0).cast("long")
    counts = narrow.groupBy("event", number.alias("bin")).agg(F.count("*").alias("count"))
    return counts.select("event", "bin", (start + F.col("bin") * step).alias("bin_start_ns"), "count")


def box_summary(
    executions: DataFrame,
    keys: Sequence[str] = ("event", "device_id"),
    rows_per_group: int | None = ROWS_PER_GROUP,
    log: DataFrame | None = None,
) -> DataFrame:
    """Box-plot figures per group: exact quartiles (linear interpolation), whiskers, outliers.

    Given the log, big groups are looked up there and the executions need not be computed for it.
    """
    keys = list(keys)
    durations = executions.select(*keys, "duration_ns", "start_ns", "start_ord")
    hot_keys = find_hot_keys(durations if log is None else log, keys, rows_per_group)
    if hot_keys is None:
        return _boxes(_with_quartiles(durations, keys), keys)
    cold = _with_quartiles(durations.where(~hot_keys.matches()), keys)
    hot = durations.where(hot_keys.matches())
    order = ("duration_ns", "start_ns", "start_ord")
    ranked = rank_chunks(split_into_chunks(hot, hot_keys, order), keys, order, "rank")
    # at most MAX_HOT_KEYS groups, with one row each
    hot = join_null_safe(ranked, F.broadcast(_quartiles_by_rank(ranked, keys)), keys)
    return _boxes(cold.unionByName(hot.select(*cold.columns)), keys)


def _with_quartiles(durations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quartiles beside every row. Windows over one sorted shuffle: nothing is joined, and a group
    spills instead of being held in memory."""
    group = Window.partitionBy(*keys)
    rank = F.row_number().over(group.orderBy("duration_ns"))
    ranked = durations.withColumn("rank", rank).withColumn("_n", F.count("*").over(group))
    low_high = {f"_{kind}{i}": value.over(group) for i, q in enumerate(QUARTILES) for kind, value in _ends(q)}
    return ranked.withColumns(low_high).select(*keys, "duration_ns", _quartiles().alias("_q"))


def _quartiles_by_rank(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quartiles of ranked groups, one row each."""
    sizes = ranked.groupBy(*keys).agg(F.count("*").alias("_n"))
    sized = join_null_safe(ranked, F.broadcast(sizes), keys)
    low_high = [value.alias(f"_{kind}{i}") for i, q in enumerate(QUARTILES) for kind, value in _ends(q)]
    found = sized.groupBy(*keys, "_n").agg(*low_high)
    return found.select(*keys, _quartiles().alias("_q"))


def _place(q: float) -> Column:
    """Where quantile q of a group of `_n` rows lies, counted from 0."""
    return (F.col("_n") - 1) * F.lit(q)


def _ends(q: float) -> list[tuple[str, Column]]:
    """The durations at the two ranks around quantile q, as aggregates."""
    at = F.col("rank") - 1
    below = F.max(F.when(at == F.floor(_place(q)), F.col("duration_ns")))
    above = F.max(F.when(at == F.ceil(_place(q)), F.col("duration_ns")))
    return [("low", below), ("high", above)]


def _quartiles() -> Column:
    """Linear interpolation between the two ranks around each quartile."""
    values = []
    for i, q in enumerate(QUARTILES):
        low, high = F.col(f"_low{i}").cast("double"), F.col(f"_high{i}").cast("double")
        values.append(low + (high - low) * (_place(q) - F.floor(_place(q))))
    return F.array(*values)


def _boxes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    q1, median, q3 = (F.col("_q")[i] for i in range(3))
    reach = (q3 - q1) * FENCE
    inside = F.col("duration_ns").between(q1 - reach, q3 + reach)
    value = F.when(inside, F.col("duration_ns"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.min("duration_ns").alias("min_ns"),
        F.first(q1).alias("q1_ns"),
        F.first(median).alias("median_ns"),
        F.first(q3).alias("q3_ns"),
        F.max("duration_ns").alias("max_ns"),
        F.min(value).alias("low_whisker_ns"),
        F.max(value).alias("high_whisker_ns"),
        F.count_if(~inside).alias("outliers"),
    )


def select_devices(df: DataFrame, devices: Sequence[str] | DataFrame | None) -> DataFrame:
    """Keep the chosen devices: a list, or a table with a device_id column; None keeps all."""
    if devices is None:
        return df
    if isinstance(devices, DataFrame):
        return df.join(devices.select("device_id"), "device_id", "left_semi")
    return df.where(F.col("device_id").isin(*devices))


def device_comparison(stats: DataFrame, devices: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Mean duration in microseconds per event and chosen device."""
    return select_devices(stats, devices).select("event", "device_id", to_us("mean_ns").alias("mean_us"))


def device_matrix(
    stats: DataFrame,
    columns: Sequence[str] | None = None,
    across: str = "device_id",
) -> DataFrame:
    """The comparison as a matrix. `columns` are the chosen devices, or, with `across="event"`, the
    chosen events; None takes all there are, which costs a job that looks for them (an error beyond
    `spark.sql.pivotMaxValues`). `device_matrix_blocks` has no such limit."""
    if across not in ("device_id", "event"):
        raise ValueError("across must be 'device_id' or 'event'")
    down = "event" if across == "device_id" else "device_id"
    mean = F.first(to_us("mean_ns"))
    if columns is None:
        ensure_checkpoint_dir(stats.sparkSession)
        stats = stats.select(down, across, "mean_ns").checkpoint()  # read twice
        return stats.where(F.col(across).isNotNull()).groupBy(down).pivot(across).agg(mean)
    return stats.where(F.col(across).isin(*columns)).groupBy(down).pivot(across, list(columns)).agg(mean)


def matrix_columns(stats: DataFrame, block: int = 1024, rows_per_group: int | None = ROWS_PER_GROUP) -> DataFrame:
    """(device_id, block, place): the devices of a matrix numbered by name, `block` of them side by side."""
    devices = stats.where("device_id IS NOT NULL").select("device_id").distinct()
    number = F.col("_number") - 1
    return rank_all(devices, ["device_id"], "_number", rows_per_group).select(
        "device_id", F.floor(number / block).alias("block"), (number % block).cast("int").alias("place")
    )


def device_matrix_blocks(
    stats: DataFrame, columns: DataFrame | None = None, block: int = 1024, rows_per_group: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """The comparison as a matrix with devices across, for any number of devices: (event, block, means_us).

    A row holds the means of one event for the devices of one block, as a map from their place in it; devices
    without a mean have no entry, and a block in which an event has none has no row. `columns`
    (device_id, block, place) are the chosen devices, by default all (`matrix_columns`).
    """
    columns = matrix_columns(stats, block, rows_per_group) if columns is None else columns
    cells = stats.join(columns, "device_id").select("event", "block", "place", to_us("mean_ns").alias("mean_us"))
    entries = F.sort_array(F.collect_list(F.struct("place", "mean_us")))
    return cells.groupBy("event", "block").agg(F.map_from_entries(entries).alias("means_us"))


def device_summary(stats: DataFrame, devices: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Per chosen device: completed executions, and the mean of its events' means."""
    return (
        select_devices(stats, devices)
        .groupBy("device_id")
        .agg(F.sum("count").alias("total_executions"), F.avg("mean_ns").alias("mean_of_means_ns"))
    )
