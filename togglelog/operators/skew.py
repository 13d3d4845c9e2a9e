"""Ordered work inside groups of any size.

Pairing, ranking and gap computation need the rows of a group in order, and a plain window puts a
whole group into one task. Here a light look at the keys finds the groups that are too big for that.
Only their rows are sorted by (group, order) over range partitions and numbered in *chunks* of a fixed
number of rows; each chunk is handled on its own, and what crosses a chunk border is worked out from
one summary row per chunk. Which groups are split changes the plan, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# A window task is given at most about this many rows of one group.
ROWS_PER_GROUP = 4_000_000
# The most hot groups that are split, one LONG each on the driver. A group that is not among them holds
# less than 1/MAX_HOT_KEYS of all rows: sorting it spills, but does not stretch a stage.
MAX_HOT_KEYS = 16_384
# A group of ROWS_PER_GROUP rows is looked for by about this many of them.
LOOK_ROWS = 1_000
# The most range partitions of the hot rows, and the most chunks, whose summaries are broadcast.
MAX_PARTITIONS = 32_768
MAX_CHUNKS = 500_000


@dataclass(frozen=True)
class HotKeys:
    """Groups that must be split: hashes of their keys, and about how many rows they hold."""

    keys: tuple[str, ...]
    hashes: tuple[int, ...]
    rows: int
    rows_per_group: int

    @property
    def rows_per_chunk(self) -> int:
        return max(self.rows_per_group, math.ceil(self.rows / MAX_CHUNKS))

    def matches(self) -> Column:
        """True for the rows of hot groups. A hash clash sends a small group along: harmless."""
        return F.xxhash64(*self.keys).isin(*self.hashes)


def find_hot_keys(
    df: DataFrame, keys: Sequence[str], rows_per_group: int | None = ROWS_PER_GROUP
) -> HotKeys | None:
    """Look for groups of more than `rows_per_group` rows; None: there is none.

    Reads the key columns once. A thin random part of the rows is counted by key, which is enough to
    see a big group and leaves next to nothing to shuffle; a group near the limit may fall on either
    side of it. `rows_per_group=None` skips the look, for callers who know their groups are small.
    """
    if rows_per_group is None:
        return None
    keys = tuple(keys)
    share = min(1.0, LOOK_ROWS / rows_per_group)
    hashes = df.select(F.xxhash64(*keys).alias("hash"))
    seen = (hashes.sample(share, seed=1) if share < 1 else hashes).groupBy("hash").count()
    biggest = F.col("count").desc()
    hot = seen.where(F.col("count") > rows_per_group * share).orderBy(biggest).limit(MAX_HOT_KEYS).collect()
    if not hot:
        return None
    rows = math.ceil(sum(r["count"] for r in hot) / share)
    return HotKeys(keys, tuple(r["hash"] for r in hot), rows, rows_per_group)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names, or a folder in its warehouse, which is shared as well."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a NULL key matches a NULL key; the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    matches = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, matches, how).drop(*[f"_r_{k}" for k in keys])


def split_into_chunks(df: DataFrame, hot: HotKeys, order: Sequence[str]) -> DataFrame:
    """Add `chunk`, increasing with `order` inside every group, with at most `rows_per_chunk` rows each
    however uneven the range partitions are.

    The result is checkpointed, so that a recomputed or reused branch of the plan can never see other
    borders.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = min(max(2, math.ceil(hot.rows / hot.rows_per_chunk)), MAX_PARTITIONS)
    return (
        df.repartitionByRange(n, *hot.keys, *order)
        .sortWithinPartitions(*hot.keys, *order)
        # partition number and place in the partition, in one increasing number
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("chunk", F.expr(f"_place DIV {hot.rows_per_chunk}"))
        .drop("_place")
        .checkpoint()
    )


def rank_chunks(chunked: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rank from 1 in the whole group: rank in the chunk plus the rows of earlier chunks."""
    at = [*keys, "chunk"]
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*at)
        .agg(F.count("*").alias("_n"))
        .select(*at, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(Window.partitionBy(*at).orderBy(*order))
    # one row per chunk and hot group: at most MAX_CHUNKS + MAX_PARTITIONS + MAX_HOT_KEYS rows
    return (
        join_null_safe(chunked.withColumn("_local", local), F.broadcast(offsets), at)
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset")
    )


def rank_in_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "rank",
    rows_per_group: int | None = ROWS_PER_GROUP,
    bounded_by: DataFrame | None = None,
) -> DataFrame:
    """`row_number` from 1 per group, for groups of any size.

    `bounded_by` is a table with the same keys in which no group is smaller than in `df`, and which is
    cheaper to read: the hot groups are looked up there.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    hot = find_hot_keys(df if bounded_by is None else bounded_by, keys, rows_per_group)
    if hot is None:
        return df.withColumn(name, rank)
    chunked = split_into_chunks(df.where(hot.matches()), hot, order)
    return (
        df.where(~hot.matches())
        .withColumn(name, rank)
        .unionByName(rank_chunks(chunked, keys, order, name).drop("chunk"))
    )


def rank_all(
    df: DataFrame, order: Sequence[str], name: str = "rank", rows_per_group: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """Rank a whole table from 1: in one window while it is small, else by range partitions."""
    rows = df.count() if rows_per_group is not None else 0
    whole = df.withColumn("_all", F.lit(0))
    if rows_per_group is None or rows <= rows_per_group:
        window = Window.partitionBy("_all").orderBy(*order)
        return whole.withColumn(name, F.row_number().over(window).cast("long")).drop("_all")
    chunked = split_into_chunks(whole, HotKeys(("_all",), (), rows, rows_per_group), order)
    return rank_chunks(chunked, ["_all"], order, name).drop("_all", "chunk")
