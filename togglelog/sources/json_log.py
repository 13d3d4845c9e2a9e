"""Nested JSON: logs and results that hold a device's or a message's rows in one document a line.

A document is parsed to a VARIANT once, and its levels are turned to rows by lateral explodes, so documents may
differ in their fields and need no schema. The shapes:

- log: `{"device": D, "position": P, "events": {E: [{"time": T, "toggled": B, "message": M, ...}, ...], ...}}`;
  a toggle may name its own position, and its `ord`;
- executions: `{"device": D, "events": {E: [{"start": S, "end": T, "message": M}, ...], ...}}`;
- messages: `{"message": M, "source": D, "details": [{"device": D, "hops": H, "time": T}, ...]}`.

Lines that are no such document, and toggles or details whose time can't be read, go to a quarantine table
with the reason. A field that is missing or null is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from togglelog.sources.csv_log import TimingLog


def json_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(value): the non-blank lines of text files."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(paths).where(F.trim("value") != "")


def parsed(lines: DataFrame) -> DataFrame:
    """(value, doc): each line with its VARIANT, NULL where it is not JSON."""
    return lines.select("value", F.try_parse_json("value").alias("doc"))


def field(doc: str | Column, name: str, kind: str) -> Column:
    """A field of an object, NULL where it is missing or of another kind."""
    return F.try_variant_get(F.col(doc) if isinstance(doc, str) else doc, f"$.{name}", kind)


def exploded(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows once for each member of an object or item of an array: with `{name}_key` (NULL in an array) and `name`."""
    spark = rows.sparkSession
    members = spark.tvf.variant_explode(value.outer()).select(F.col("key").alias(f"{name}_key"), F.col("value").alias(name))
    return rows.lateralJoin(members)


def _levels(docs: DataFrame, item: str) -> DataFrame:
    """device × event × item of documents with `device` and `events`."""
    events = field("doc", "events", "variant")
    by_event = exploded(docs.select("doc", field("doc", "device", "string").alias("device_id"), events.alias("events")), F.col("events"), "event")
    return exploded(by_event.withColumnRenamed("event_key", "event_name"), F.col("event"), item)


def _fault(name: str, kind: str) -> Column:
    """Why a line is no document whose field `name` is an object or an array; NULL if it is one."""
    found = F.schema_of_variant(field("doc", name, "variant"))
    return F.when(F.col("doc").isNull(), F.lit("bad_json")).when(
        ~F.coalesce(found.startswith(kind), F.lit(False)), F.lit(f"no_{name}")
    )


def flatten_log(lines: DataFrame) -> TimingLog:
    """The toggle rows of log documents (value), and the quarantine (value, reason).

    `ord` is the toggle's own where it has one, and else follows the order of the toggles in a file. Devices are there if
    any document names one.
    """
    docs = parsed(lines).withColumn("reason", _fault("events", "OBJECT"))
    bad = docs.where("reason IS NOT NULL").select("value", "reason")
    toggles = _levels(docs.where("reason IS NULL"), "toggle")
    rows = toggles.select(
        F.col("event_name").alias("event"),
        field("toggle", "time", "bigint").alias("time_ns"),
        field("toggle", "toggled", "boolean").alias("toggled"),
        "device_id",
        F.coalesce(field("toggle", "position", "double"), field("doc", "position", "double")).alias("position"),
        field("toggle", "message", "string").alias("message_id"),
        F.coalesce(field("toggle", "ord", "bigint"), F.monotonically_increasing_id()).alias("ord"),
        F.to_json("toggle").alias("value"),
    )
    why = F.when(F.col("time_ns").isNull(), F.lit("bad_time")).when(F.col("toggled").isNull(), F.lit("bad_toggle"))
    judged = rows.withColumn("reason", why)
    quarantine = bad.unionByName(judged.where("reason IS NOT NULL").select("value", "reason"))
    has_devices = not rows.where("device_id IS NOT NULL").isEmpty()
    return TimingLog(judged.where("reason IS NULL").drop("value", "reason"), quarantine, has_devices)


def read_nested_log(spark: SparkSession, paths: str | Sequence[str]) -> TimingLog:
    """A log of JSON documents, one a line, from files or folders."""
    return flatten_log(json_lines(spark, paths))


def flatten_executions(lines: DataFrame) -> DataFrame:
    """(device_id, event, start_ns, end_ns, duration_ns, message_id) of executions documents (value)."""
    found = _levels(parsed(lines).where(_fault("events", "OBJECT").isNull()), "run")
    start, end = field("run", "start", "bigint"), field("run", "end", "bigint")
    return found.select(
        "device_id", F.col("event_name").alias("event"), start.alias("start_ns"), end.alias("end_ns"),
        (end - start).alias("duration_ns"), field("run", "message", "string").alias("message_id"),
    )


def flatten_messages(lines: DataFrame) -> DataFrame:
    """(message_id, from_device, to_device, hops, time_ns) of message documents (value)."""
    docs = parsed(lines).where(_fault("details", "ARRAY").isNull())
    details = exploded(docs.withColumn("details", field("doc", "details", "variant")), F.col("details"), "detail")
    return details.select(
        field("doc", "message", "string").alias("message_id"), field("doc", "source", "string").alias("from_device"),
        field("detail", "device", "string").alias("to_device"), field("detail", "hops", "double").alias("hops"),
        field("detail", "time", "bigint").alias("time_ns"),
    )


DAY_NS = 86_400 * 10**9


def _nested(rows: DataFrame, item: Column, at: str, order: Column) -> DataFrame:
    """(value): one document for each device and day, so that its size does not grow with the log."""
    day = F.floor(F.col(at) / DAY_NS)
    items = rows.groupBy("device_id", day.alias("_day"), "event").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("i")))).alias("_all"))
    events = F.map_from_entries(F.collect_list(F.struct("event", F.transform("_all", lambda x: x["i"]))))
    docs = items.groupBy("device_id", "_day").agg(events.alias("events"))
    return docs.select(F.to_json(F.struct(F.col("device_id").alias("device"), "events")).alias("value"))


def nest_log(log: DataFrame) -> DataFrame:
    """Log documents (value) of a toggle log with devices, one for each device and day."""
    names = {"time_ns": "time", "toggled": "toggled", "position": "position", "message_id": "message", "ord": "ord"}
    usable = log.where("device_id IS NOT NULL AND event IS NOT NULL")
    return _nested(usable, F.struct(*[F.col(c).alias(n) for c, n in names.items()]), "time_ns", F.col("ord"))


def nest_executions(executions: DataFrame) -> DataFrame:
    """Executions documents (value), one for each device and day."""
    names = {"start_ns": "start", "end_ns": "end", "message_id": "message"}
    return _nested(executions, F.struct(*[F.col(c).alias(n) for c, n in names.items()]), "start_ns", F.col("start_ns"))


def nest_messages(propagations: DataFrame) -> DataFrame:
    """Message documents (value): a message has no more details than there are devices."""
    detail = F.struct(F.col("to_device").alias("device"), "hops", F.col("time_ns").alias("time"))
    docs = propagations.groupBy(F.col("message_id").alias("message"), F.col("from_device").alias("source")).agg(F.collect_list(detail).alias("details"))
    return docs.select(F.to_json(F.struct("message", "source", "details")).alias("value"))
