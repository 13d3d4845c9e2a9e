"""Toggle logs derived from the star-schema tables, so that the operators can run on them.

- timing_events: users are devices, event types are events; toggles are deliberately messy.
- chain_messages: an order is a message its customer's nation sends and its suppliers' nations receive.
- sync_pulses: an order is a pulse that its suppliers' nations start.
- log_lines: timing_events as raw lines of a log file, with comments, blanks and damaged values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


DAY_NS = 86_400 * 10**9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ns(column: str):
    """Nanoseconds of a zone-less timestamp, read as UTC whatever the session's time zone is."""
    return F.unix_micros(F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone())) * 1000


def timing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 3
    shift = F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("event"),
        _ns("ts").alias("time_ns"),
        (F.col("event_id") % 2 == 0).alias("toggled"),
        F.concat(F.lit("Device_"), "user_id").alias("device_id"),
        ((F.col("user_id") + shift) % 8 + 1).cast("double").alias("position"),
        F.when(k != 0, F.concat(F.lit("MSG_"), k)).alias("message_id"),
        F.col("event_id").alias("ord"),
    )


def _nation(column: str):
    return [
        F.concat(F.lit("N"), F.col(column)).alias("device_id"),
        (F.col(column) % 5).cast("double").alias("position"),
    ]


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    # lines of an order by their number; ship day and part settle numbers that are used twice
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    ord_ = F.col("l_linenumber") * F.lit(10**15) + day * F.lit(10**9) + F.col("l_partkey")
    return lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_orderkey", "l_linestatus", _ns("l_shipdate").alias("time_ns"), *_nation("s_nationkey"), ord_.alias("ord")
    )


def chain_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    sends = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.lit("UART_Send").alias("event"),
        _ns("o_orderdate").alias("time_ns"),
        F.lit(True).alias("toggled"),
        *_nation("c_nationkey"),
        F.concat(F.lit("MSG_"), "o_orderkey").alias("message_id"),
        F.lit(0).cast("long").alias("ord"),
    )
    receives = _shipments(spark, sf_dir).select(
        F.lit("UART_Receive").alias("event"),
        "time_ns",
        F.lit(True).alias("toggled"),
        "device_id",
        "position",
        F.concat(F.lit("MSG_"), "l_orderkey").alias("message_id"),
        "ord",
    )
    return sends.unionByName(receives)


def sync_pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shipments(spark, sf_dir).select(
        F.lit("Sync_Pulse").alias("event"),
        "time_ns",
        (F.col("l_linestatus") == "O").alias("toggled"),
        "device_id",
        "position",
        F.concat(F.lit("SYNC_"), "l_orderkey").alias("message_id"),
        "ord",
    )


LOG_HEADER = "Event,Time,Toggled,Device_ID,Position,Message_ID"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines (value, ord) without the header: by event_id, some rows are commented out, indented or
    not, or blank, and some have a damaged time or toggle value."""
    rows = timing_events(spark, sf_dir)
    i = F.col("ord")
    time = F.when(i % 17 == 3, F.lit("n/a")).when(i % 19 == 4, F.concat("time_ns", F.lit(".0"))).otherwise(
        F.col("time_ns").cast("string")
    )
    toggled = (
        F.when(i % 23 == 5, F.lit("maybe"))
        .when(i % 5 == 0, F.when(F.col("toggled"), F.lit("1")).otherwise(F.lit("0")))
        .otherwise(F.initcap(F.col("toggled").cast("string")))
    )
    fields = [F.col("event"), time, toggled, F.col("device_id"), F.col("position").cast("string")]
    line = F.concat_ws(",", *fields, F.coalesce("message_id", F.lit("")))
    line = (
        F.when(i % 29 == 6, F.concat(F.lit("// "), line))
        .when(i % 31 == 7, F.concat(F.lit("   # "), line))
        .when(i % 37 == 8, F.lit("  "))
        .otherwise(line)
    )
    # `inline`, so that each line is put together once, as if it had been read from a file
    return rows.select(F.inline(F.array(F.struct(line.alias("value"), "ord"))))


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_lines with headers, as if from two files: the lines of odd events are in one whose columns
    are in another order, with a note besides; its header comes twice."""
    lines = log_lines(spark, sf_dir).withColumn("file", F.when(F.col("ord") % 2 == 1, "odd").otherwise("even"))
    cell = F.split("value", ",")
    moved = F.concat_ws(",", cell[3], cell[0], F.concat(F.lit("n"), "ord"), cell[2], cell[1], cell[4], cell[5])
    text = F.col("value").rlike(r"^\s*(//|#)") | (F.trim("value") == "")
    lines = lines.withColumn("value", F.when((F.col("file") == "odd") & ~text, moved).otherwise(F.col("value")))
    other = "Device_ID,Event,Note,Toggled,Time,Position,Message_ID"
    headers = [(LOG_HEADER, -1, "even"), (other, -2, "odd"), (other, -1, "odd")]
    return lines.unionByName(spark.createDataFrame(headers, "value string, ord long, file string"))
