"""Intermediate tables in the folder that all executors share.

The folder is `spark.checkpoint.dir` of the session. Where it is unset (tests, a laptop) it becomes a
folder inside the warehouse. Tables are kept until the folder is cleared, so that a lost executor's
work can be read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def as_row(columns: list[str]) -> Column:
    """A caller's columns in one struct `row`, out of the way of the names that an operator uses itself."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")


def from_row(columns: list[str]) -> list[Column]:
    """The columns out of `row` again."""
    return [F.col("row").getField(c).alias(c) for c in columns]


# Rows that a Python task gets at once, where rows are whole texts.
TEXT_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts_of(docs: DataFrame) -> DataFrame:
    """docs, with the session's Arrow batches kept small enough for long texts from here on."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= TEXT_ROWS:
        conf.set(_BATCH, str(TEXT_ROWS))
    return docs


# Spark drops the shuffle files of a query as it ends, rather than when the driver's garbage goes.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back; cuts the lineage and frees its shuffles."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
