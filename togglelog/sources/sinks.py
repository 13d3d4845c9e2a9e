"""Write results and topologies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def write_result(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
    order_by: Sequence[str] = (),
) -> None:
    """Write a result table; `order_by` sorts it as a whole, for reports that people read."""
    if order_by:
        df = df.orderBy(*order_by)
    writer = df.write.format(format).mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def export_topology(
    devices: DataFrame, edges: DataFrame, path: str, mode: str, format: str = "json", write_mode: str = "errorifexists"
) -> None:
    """Write a topology as two tables, `devices` and `connections`, each row naming the mode."""
    devices.withColumn("mode", F.lit(mode)).write.format(format).mode(write_mode).save(f"{path}/devices")
    edges.withColumn("mode", F.lit(mode)).write.format(format).mode(write_mode).save(f"{path}/connections")
