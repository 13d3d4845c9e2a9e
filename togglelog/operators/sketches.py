"""Approximate quartiles from mergeable states, for logs that are too large to sort again for each report.

A state counts durations in buckets whose width grows with the value: below 256 ns each value has its own,
and from there on every power of two is cut into 128 equal buckets. A bucket stands for its middle, which is
off by less than 1/256 of any value in it: **every rank's value is found with a relative error below 1/256
(0.4 %)**, however many states are merged, and an interpolated quantile lies within 1/256 of the exact
one. The smallest and the largest duration are exact.

States are rows: one for each group and day, with at most 7,296 buckets. They are made once a day from
that day's executions and merged by adding counts, in any order and grouping. `box_summary` stays the exact
way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from togglelog.operators.stats import FENCE, QUARTILES

# A power of two has 2 ** SUB_BITS buckets.
SUB_BITS = 7
DAY_NS = 86_400 * 10**9


def with_buckets(executions: DataFrame) -> DataFrame:
    """executions with `bucket`, numbered in the order of values. Fractions of a nanosecond are cut off."""
    half, full = 1 << SUB_BITS, 2 << SUB_BITS
    guess = F.greatest(F.floor(F.log2(F.greatest(F.col("_d"), F.lit(1)))).cast("int") - SUB_BITS, F.lit(0))
    # log2 is rounded, so the guess may be one power off at its borders
    wide = F.expr("shiftright(_d, _guess)")
    shift = F.col("_guess") + F.when(wide >= full, 1).when((wide < half) & (F.col("_guess") > 0), -1).otherwise(0)
    return (
        executions.withColumn("_d", F.greatest(F.col("duration_ns").cast("long"), F.lit(0)))
        .withColumn("_guess", guess)
        .withColumn("_shift", shift.cast("int"))
        .withColumn("bucket", (F.col("_shift") * half + F.expr("shiftright(_d, _shift)")).cast("int"))
        .drop("_d", "_guess", "_shift")
    )


def middle_of(bucket: Column) -> Column:
    """The middle of a bucket's values."""
    half = 1 << SUB_BITS
    shift = F.greatest(F.floor(bucket / half) - 1, F.lit(0)).cast("int")
    width = F.pow(F.lit(2.0), shift)
    return (bucket - shift * half) * width + (width - 1) / 2


def quantile_states(executions: DataFrame, keys: Sequence[str] = ("event", "device_id"), by_day: bool = True) -> DataFrame:
    """(keys, day, count, min_ns, max_ns, buckets): one state for each group and day its executions start on.

    `buckets` is an array of (bucket, n) in the order of values. Executions without a duration don't count. Without
    `by_day` the day is NULL.
    """
    day = F.floor(F.col("start_ns") / DAY_NS) if by_day else F.lit(None)
    rows = with_buckets(executions.where("duration_ns IS NOT NULL")).withColumn("day", day.cast("int"))
    counts = rows.groupBy(*keys, "day", "bucket").agg(
        F.count("*").alias("n"), F.min("duration_ns").alias("min_ns"), F.max("duration_ns").alias("max_ns")
    )
    return _states(counts, [*keys, "day"])


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of coarser groups, or of the same groups over all days: (keys, count, min_ns, max_ns, buckets)."""
    parts = states.select(*keys, "min_ns", "max_ns", F.inline("buckets"))
    counts = parts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.min("min_ns").alias("min_ns"), F.max("max_ns").alias("max_ns"))
    return _states(counts, list(keys))


def _states(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("count"),
        F.min("min_ns").alias("min_ns"),
        F.max("max_ns").alias("max_ns"),
        F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("buckets"),
    )


def _valued(states: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each bucket, with its value and the executions up to it. A group has at most 7,296 of them."""
    rows = states.select(*keys, "count", "min_ns", "max_ns", F.inline("buckets"))
    value = F.least(F.greatest(middle_of(F.col("bucket")), F.col("min_ns").cast("double")), F.col("max_ns").cast("double"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))
    return rows.withColumn("value", value).withColumn("upto", upto)


def _quantile(q: float, over=None) -> Column:
    """Linear interpolation between the values at the two ranks around q, as an aggregate."""
    place = (F.col("count") - 1) * F.lit(q)

    def at(rank: Column) -> Column:
        found = F.min(F.when(F.col("upto") > rank, F.col("value")))
        return found if over is None else found.over(over)

    low, high = at(F.floor(place)), at(F.ceil(place))
    part = place - F.floor(place)
    return low + (high - low) * (part if over is not None else F.first(part))


def sketch_quantiles(states: DataFrame, keys: Sequence[str], probabilities: Sequence[float] = QUARTILES) -> DataFrame:
    """(keys, count, quantiles): merged states' quantiles, each within 1/256 of the exact one."""
    keys = list(keys)
    return _valued(merge_states(states, keys), keys).groupBy(*keys, "count").agg(
        F.array(*[_quantile(q) for q in probabilities]).alias("quantiles")
    )


def approximate_boxes(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns of `box_summary` from states: count, min and max exact, the rest as good as a bucket's middle.

    The whiskers are the outermost middles inside the fences; durations in buckets with the middle outside are outliers.
    """
    keys = list(keys)
    rows = _valued(merge_states(states, keys), keys)
    whole = Window.partitionBy(*keys)
    named = dict(zip(("q1_ns", "median_ns", "q3_ns"), QUARTILES))
    boxed = rows.withColumns({name: _quantile(q, whole) for name, q in named.items()})
    reach = (F.col("q3_ns") - F.col("q1_ns")) * FENCE
    inside = F.col("value").between(F.col("q1_ns") - reach, F.col("q3_ns") + reach)
    return boxed.groupBy(*keys, "count", "min_ns", *named, "max_ns").agg(
        F.min(F.when(inside, F.col("value"))).alias("low_whisker_ns"),
        F.max(F.when(inside, F.col("value"))).alias("high_whisker_ns"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
    )
