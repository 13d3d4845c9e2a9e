"""Read CSV toggle logs.

A log may hold comment lines (first text `//` or `#`) and blank lines. Columns are matched by the names
in the header and extra columns are kept. Rows whose time or toggle value cannot be read, or that have
more fields than the header, go to a quarantine table with the reason; nothing is dropped unseen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from togglelog.operators.skew import ensure_checkpoint_dir

# The log format.
REQUIRED_COLUMNS = ("Event", "Time", "Toggled")
MODEL_NAMES = {
    "Event": "event",
    "Time": "time_ns",
    "Toggled": "toggled",
    "Device_ID": "device_id",
    "Position": "position",
    "Message_ID": "message_id",
}
COMMENT = r"^\s*(//|#)"
# Texts that mean "no value" in a field, the default null markers of a public library.
NULL_TEXTS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

EXTRA = "_extra_fields"


@dataclass(frozen=True)
class TimingLog:
    """`rows` is a normalised toggle log; `has_devices` tells the extended from the basic format."""

    rows: DataFrame
    quarantine: DataFrame
    has_devices: bool


def read_timing_log(spark: SparkSession, paths: str | Sequence[str], time_type: str = "long") -> TimingLog:
    """Read one or more CSV files or folders of them; files may differ in their columns' order.

    `ord` follows the lines of a file; lines of different files keep no particular order.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths, pathGlobFilter="*[cC][sS][vV]*").select(
        "value",
        F.monotonically_increasing_id().alias("ord"),
        F.col("_metadata.file_path").alias("file"),
    )
    if not lines.inputFiles():
        raise ValueError("Please give a CSV file")
    if len(lines.inputFiles()) > 1:
        return parse_files(lines, time_type)
    first = content_lines(lines).select("value").first()
    if first is None:
        raise ValueError(f"Missing required columns: {', '.join(REQUIRED_COLUMNS)}")
    return parse_lines(lines, first["value"], time_type)


def read_first_log(spark: SparkSession, candidates: Sequence[str], time_type: str = "long") -> TimingLog:
    """Read the first of several paths that exists (a default log and its fallbacks)."""
    for path in candidates:
        try:
            return read_timing_log(spark, path, time_type)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no timing log at {', '.join(candidates)}")


def content_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither comments nor blank."""
    return lines.where(~F.col("value").rlike(COMMENT) & (F.trim("value") != ""))


def parse_lines(lines: DataFrame, header: str, time_type: str = "long") -> TimingLog:
    """Parse lines (value, ord) under a header line; repeats of the header itself are skipped."""
    if time_type not in ("long", "double"):
        raise ValueError("time_type must be 'long' or 'double'")
    names = _header_names(lines, header)
    missing = [c for c in REQUIRED_COLUMNS if c not in names]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    fields = ", ".join(f"`{n}` STRING" for n in [*names, EXTRA])
    # `inline` keeps the parsed and the typed fields from being worked out again in every filter and
    # column that uses them.
    parsed = content_lines(lines).where(F.col("value") != header)
    parsed = parsed.select("value", "ord", F.inline(F.array(F.from_csv("value", fields))))
    return _typed(parsed, names, time_type)


def parse_files(lines: DataFrame, time_type: str = "long") -> TimingLog:
    """Parse lines (value, ord, file) of files that may each have a layout of their own.

    The first line of a file that is neither comment nor blank is its header. A file's lines are joined
    with the places of its columns and read in one scan, whatever the number of layouts. A column that a
    file lacks is NULL in its rows.
    """
    if time_type not in ("long", "double"):
        raise ValueError("time_type must be 'long' or 'double'")
    ensure_checkpoint_dir(lines.sparkSession)
    kept = content_lines(lines)
    # one row for each file, worked out once
    headers = kept.groupBy("file").agg(F.min_by("value", "ord").alias("header")).checkpoint()
    width = headers.agg(F.max(F.regexp_count("header", F.lit(",")))).first()[0]
    if width is None:
        raise ValueError(f"Missing required columns: {', '.join(REQUIRED_COLUMNS)}")
    cells = [f"c{i}" for i in range(width + 2)]
    fields = ", ".join(f"{c} STRING" for c in cells)
    row = F.from_csv(F.regexp_replace("header", "^\ufeff+", ""), fields)
    headers = headers.withColumn("names", F.array_compact(F.array(*(row[c] for c in cells))))
    lacks = F.filter(F.array(*map(F.lit, REQUIRED_COLUMNS)), lambda n: ~F.array_contains("names", n))
    bad = headers.select(lacks.alias("lacks")).where(F.size("lacks") > 0).first()
    if bad is not None:
        raise ValueError(f"Missing required columns: {', '.join(bad['lacks'])}")
    # the columns of the result; every file is known to have a real header
    names = sorted(r[0] for r in headers.select(F.explode("names")).distinct().collect())
    places = F.struct(*((F.array_position("names", n) - 1).cast("int").alias(f"p{i}") for i, n in enumerate(names)))
    headers = headers.select("file", "header", places.alias("places"), F.size("names").alias("extra"))
    split = kept.join(headers, "file").where(F.col("value") != F.col("header"))
    split = split.withColumn("row", F.from_csv("value", fields))
    split = split.select("value", "ord", "places", "extra", F.array(*(F.col("row")[c] for c in cells)).alias("cells"))
    picked = [F.get("cells", F.col("places")[f"p{i}"]).alias(n) for i, n in enumerate(names)]
    parsed = F.struct(*picked, F.get("cells", F.col("extra")).alias(EXTRA))
    return _typed(split.select("value", "ord", F.inline(F.array(parsed))), names, time_type)


def _typed(parsed: DataFrame, names: Sequence[str], time_type: str) -> TimingLog:
    """Rows and quarantine of split lines: value, ord, a text column for each name, and EXTRA."""
    model = {MODEL_NAMES[n]: _read(n, time_type) for n in MODEL_NAMES if n in names}
    for name, kind in (("device_id", "string"), ("position", "double"), ("message_id", "string")):
        model.setdefault(name, F.lit(None).cast(kind))
    others = [_text(n).alias(n) for n in names if n not in MODEL_NAMES]
    row = F.struct(*[c.alias(n) for n, c in model.items()], *others, F.col(EXTRA))
    reason = (
        F.when(F.col(EXTRA).isNotNull(), "extra_fields")
        .when(F.col("time_ns").isNull(), "bad_time")
        .when(F.col("toggled").isNull(), "bad_toggle")
    )
    typed = parsed.select("value", "ord", F.inline(F.array(row))).withColumn("reason", reason).drop(EXTRA)
    return TimingLog(
        typed.where("reason IS NULL").drop("value", "reason"),
        typed.where("reason IS NOT NULL").select("ord", "value", "reason"),
        "Device_ID" in names,
    )


def _header_names(lines: DataFrame, header: str) -> list[str]:
    """Field names of the header line, split by the same CSV rules as the rows."""
    width = header.count(",") + 1
    fields = ", ".join(f"c{i} STRING" for i in range(width))
    row = lines.sparkSession.range(1).select(F.from_csv(F.lit(header.lstrip("﻿")), fields)).first()[0]
    return [name for name in row if name is not None]


def _text(name: str) -> Column:
    value = F.col(f"`{name}`")
    return F.when(~value.isin(*NULL_TEXTS), value)


def _read(name: str, time_type: str) -> Column:
    if name == "Time":
        return read_time(_text(name), time_type)
    if name == "Toggled":
        return read_toggle(_text(name))
    if name == "Position":
        number = _text(name).try_cast("double")
        return F.when(~F.isnan(number), number)
    return _text(name)


def read_time(text: Column, time_type: str = "long") -> Column:
    """Nanoseconds, or NULL. LONG time keeps every digit and also takes whole numbers written as
    `5.0` or `1e3`; a log with fractions of nanoseconds needs DOUBLE."""
    if time_type == "double":
        number = text.try_cast("double")
        return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    # exact: a DOUBLE cannot hold the nanoseconds of a present-day epoch time
    number = text.try_cast("decimal(38,10)")
    return F.coalesce(text.try_cast("bigint"), F.when(number == F.floor(number), number).try_cast("bigint"))


def read_toggle(text: Column) -> Column:
    """True, false, yes, no and the like; a number is true unless it is zero."""
    number = F.trim(text).try_cast("double")
    return F.coalesce(number != 0.0, F.trim(text).try_cast("boolean"))
