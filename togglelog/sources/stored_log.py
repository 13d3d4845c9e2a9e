"""A log stored in the layout that pairing needs: bucketed by (device, event), in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from togglelog.operators.pairing import BY_DEVICE, usable_rows
from togglelog.schema import TIME_ORDER


def write_stored_log(log: DataFrame, table: str, path: str | None = None, buckets: int = 200, mode: str = "errorifexists") -> None:
    """Write the rows of a log that take part in pairing as a bucketed table of the session's catalog.

    Each bucket is one file with whole groups, sorted by group and time, so `pair_stored` and windows by (device, event)
    read it without a shuffle. Choose `buckets` so that one is a few hundred megabytes; a group is never divided,
    so a log with groups that are too big for a task is better left to `pair_executions`.
    `path` stores the files outside the warehouse.
    """
    rows = usable_rows(log).repartition(buckets, *BY_DEVICE)
    writer = rows.write.format("parquet").mode(mode).bucketBy(buckets, *BY_DEVICE).sortBy(*BY_DEVICE, *TIME_ORDER)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def read_stored_log(spark: SparkSession, table: str) -> DataFrame:
    """The stored rows. Pair them with `rows_per_group=None`, which leaves out the look for big groups."""
    return spark.read.table(table)
