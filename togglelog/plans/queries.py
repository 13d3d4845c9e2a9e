"""The registered queries: every operator over whole tables.

Means and deviations are doubles whose last digits depend on the order of addition, so they are
rounded here (not in the operators) before they are compared with another engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from togglelog import operators as op
from togglelog.operators.skew import ensure_checkpoint_dir
from togglelog import sources, streaming
from togglelog.plans import views
from togglelog.sources import parse_files, parse_lines


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})


def small_table(df: DataFrame) -> DataFrame:
    """Work out a table once that a query reads many times; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A path that nothing has used, in the folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.pair_executions(views.timing_events(spark, sf_dir))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.exec_stats(_executions(spark, sf_dir))


def executions(spark, sf_dir):
    return op.pair_executions(views.timing_events(spark, sf_dir), match_message=False)


def executions_msg(spark, sf_dir):
    return _executions(spark, sf_dir)


def executions_basic(spark, sf_dir):
    paired = op.pair_executions(views.timing_events(spark, sf_dir), by_device=False)
    return paired.drop("device_id", "message_id")


def exec_stats(spark, sf_dir):
    return rounded(_stats(spark, sf_dir), mean_ns=-2, std_ns=-6)


def exec_stats_basic(spark, sf_dir):
    paired = op.pair_executions(views.timing_events(spark, sf_dir), by_device=False)
    return rounded(op.exec_stats(paired, keys=("event",)), mean_ns=-2, std_ns=-3)


def pooled_stats(spark, sf_dir):
    return rounded(op.pooled_stats(_executions(spark, sf_dir)), mean_ns=-4, std_ns=-6)


def kpis(spark, sf_dir):
    return rounded(op.kpis(_stats(spark, sf_dir)), mean_of_means_ns=-4)


def fastest_slowest(spark, sf_dir):
    return rounded(op.fastest_slowest(_stats(spark, sf_dir)), fastest_ns=-4, slowest_ns=-4)


def event_distribution(spark, sf_dir):
    return op.event_distribution(_executions(spark, sf_dir))


def trends(spark, sf_dir):
    log = views.timing_events(spark, sf_dir)
    return op.trends(op.pair_executions(log), log=log)


def histogram(spark, sf_dir):
    return rounded(op.histogram(_executions(spark, sf_dir)), bin_start_ns=0)


def box_summary(spark, sf_dir):
    log = views.timing_events(spark, sf_dir)
    return rounded(op.box_summary(op.pair_executions(log), log=log), q1_ns=0, median_ns=0, q3_ns=0)


def box_summary_basic(spark, sf_dir):
    log = views.timing_events(spark, sf_dir)
    boxes = op.box_summary(op.pair_executions(log, by_device=False), keys=("event",), log=log)
    return rounded(boxes, q1_ns=0, median_ns=0, q3_ns=0)


def device_comparison(spark, sf_dir):
    return rounded(op.device_comparison(_stats(spark, sf_dir)), mean_us=1)


def device_matrix(spark, sf_dir):
    matrix = op.device_matrix(_stats(spark, sf_dir), across="event")
    return rounded(matrix, **dict.fromkeys(matrix.columns[1:], 1))


def device_summary(spark, sf_dir):
    return rounded(op.device_summary(_stats(spark, sf_dir)), mean_of_means_ns=-4)


def device_summary_chosen(spark, sf_dir):
    """The summary of the devices that ever logged an error."""
    chosen = views.timing_events(spark, sf_dir).where("event = 'error'").select("device_id").distinct()
    return rounded(op.device_summary(_stats(spark, sf_dir), chosen), mean_of_means_ns=-4)


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ranked_starts(views.sync_pulses(spark, sf_dir))


def sync_starts(spark, sf_dir):
    return op.sync_starts(views.sync_pulses(spark, sf_dir))


def ranked_starts(spark, sf_dir):
    """The linear form of the pairs: any two devices' difference is that of their offsets."""
    return _starts(spark, sf_dir)


def sync_pairs(spark, sf_dir):
    return op.sync_pairs(_starts(spark, sf_dir))


def sync_stats(spark, sf_dir):
    return rounded(op.sync_stats(_starts(spark, sf_dir)), mean_diff_ns=-4, std_diff_ns=-6)


def sync_summary(spark, sf_dir):
    return rounded(op.sync_summary(_starts(spark, sf_dir)), mean_diff_ns=-6)


def _propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.propagation(views.chain_messages(spark, sf_dir))


def propagation(spark, sf_dir):
    return _propagation(spark, sf_dir)


def message_stats(spark, sf_dir):
    return op.message_stats(_propagation(spark, sf_dir))


def pair_means(spark, sf_dir):
    return rounded(op.pair_means(_propagation(spark, sf_dir)), mean_time_ns=-5)


def hop_cost(spark, sf_dir):
    return rounded(op.hop_cost(_propagation(spark, sf_dir)), time_per_hop_ns=-3)


def hop_trend(spark, sf_dir):
    return rounded(op.hop_trend(_propagation(spark, sf_dir)), slope_ns=-6, intercept_ns=-6, r2=9)


def _devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.device_table(views.timing_events(spark, sf_dir))


def device_table(spark, sf_dir):
    return _devices(spark, sf_dir)


def device_count(spark, sf_dir):
    return op.device_count(views.timing_events(spark, sf_dir))


def _topology(mode: str, order_by: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        return op.build_topology(_devices(spark, sf_dir), mode, order_by)

    return query


def _message_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _propagation(spark, sf_dir).select("from_device", "to_device").distinct()
    return links.withColumnsRenamed({"from_device": "source", "to_device": "target"})


def topo_custom(spark, sf_dir):
    return op.build_topology(_devices(spark, sf_dir), "custom", connections=_message_links(spark, sf_dir))


def topo_edit(spark, sf_dir):
    """The daisy chain as a connection list, with the star's connections added and the last removed."""
    devices = small_table(_devices(spark, sf_dir))
    chain = op.connection_list(devices, "daisy")
    star = op.connection_list(devices, "star", "appearance")
    return op.remove_last_connection(op.add_connections(chain, star))


def node_degree(spark, sf_dir):
    devices = small_table(_devices(spark, sf_dir))
    both = op.build_topology(devices, "daisy").union(op.build_topology(devices, "star", "appearance"))
    return op.node_degree(devices, both.distinct())


def topology_size(spark, sf_dir):
    """Nodes and edges of the message links over the logged devices: the link ends are new nodes."""
    return op.topology_size(_devices(spark, sf_dir), op.simple_edges(_message_links(spark, sf_dir)))


def placed_edges(spark, sf_dir):
    """Chain edges between devices that completed an execution."""
    chain = op.build_topology(_devices(spark, sf_dir), "daisy", "appearance")
    return op.placed_edges(chain, _executions(spark, sf_dir).select("device_id").distinct())


def unbalanced(spark, sf_dir):
    return op.unbalanced_groups(views.timing_events(spark, sf_dir))


def profile(spark, sf_dir):
    return op.profile(views.timing_events(spark, sf_dir))


def preview(spark, sf_dir):
    return op.preview(views.timing_events(spark, sf_dir))


def label_rows(spark, sf_dir):
    labelled = op.label_rows(views.timing_events(spark, sf_dir))
    return labelled.select("device_id", "event", "time_ns", "ord", "toggled", "role")


def groups_without_execution(spark, sf_dir):
    log = views.timing_events(spark, sf_dir)
    return op.groups_without_execution(log, op.pair_executions(log))


def parsed_lines(spark, sf_dir):
    return parse_lines(views.log_lines(spark, sf_dir), views.LOG_HEADER).rows


def quarantined_lines(spark, sf_dir):
    return parse_lines(views.log_lines(spark, sf_dir), views.LOG_HEADER).quarantine


def parsed_files(spark, sf_dir):
    """Lines of two files with different layouts."""
    return parse_files(views.layout_lines(spark, sf_dir)).rows


def mesh_summary(spark, sf_dir):
    """The linear form of the mesh: its size by formula."""
    return op.mesh_summary(_devices(spark, sf_dir))


def trends_basic(spark, sf_dir):
    log = views.timing_events(spark, sf_dir)
    return op.trends(op.pair_executions(log, by_device=False), log=log).drop("device_id")


def label_rows_basic(spark, sf_dir):
    labelled = op.label_rows(views.timing_events(spark, sf_dir), by_device=False)
    return labelled.select("event", "time_ns", "ord", "toggled", "role")


def executions_stored(spark, sf_dir):
    """Pairing of the log as a bucketed table: no shuffle after the write."""
    table = f"stored_log_{uuid.uuid4().hex}"
    sources.write_stored_log(views.timing_events(spark, sf_dir), table, scratch(spark, "stored"), buckets=8)
    return op.pair_executions(sources.read_stored_log(spark, table), rows_per_group=None)


# How late rows of the stream below may be: its files come in no order, and the log is shorter than that.
STREAM_DAYS = 400


def executions_stream(spark, sf_dir):
    """Pairing of the log as a stream of files, each a quarter of the time, with its rows in no order; a
    heartbeat comes last. State partitions are fixed for a stream's life: eight for this log's groups."""
    folder = scratch(spark, "stream")
    log = views.timing_events(spark, sf_dir)
    log.repartitionByRange(4, "time_ns").sortWithinPartitions("message_id", "ord").write.parquet(f"{folder}/log")
    last = log.agg((F.max("time_ns") + (STREAM_DAYS + 1) * views.DAY_NS).alias("time_ns")).where("time_ns IS NOT NULL")
    last.unionByName(log.where("false"), allowMissingColumns=True).select(*log.columns).write.mode("append").parquet(f"{folder}/log")
    session = spark.newSession()
    streaming.use_rocks_db(session)
    session.conf.set("spark.sql.shuffle.partitions", "8")
    stream = session.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/log")
    found = streaming.stream_executions(stream, f"{STREAM_DAYS} days")
    sink = found.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/executions")
    sink.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/executions")


def nested_log(spark, sf_dir):
    """The log written as JSON documents, one for each device and day, and read back."""
    path = scratch(spark, "nested-log")
    sources.nest_log(views.timing_events(spark, sf_dir)).write.text(path)
    return sources.read_nested_log(spark, path).rows


def nested_executions(spark, sf_dir):
    """Executions out of nested results."""
    path = scratch(spark, "nested-executions")
    sources.nest_executions(_executions(spark, sf_dir)).write.text(path)
    return sources.flatten_executions(sources.json_lines(spark, path))


def nested_messages(spark, sf_dir):
    """Details of messages out of nested results."""
    path = scratch(spark, "nested-messages")
    sources.nest_messages(_propagation(spark, sf_dir)).write.text(path)
    return sources.flatten_messages(sources.json_lines(spark, path))


def box_approximate(spark, sf_dir):
    """Boxes of events from the states of every device and day."""
    states = op.quantile_states(_executions(spark, sf_dir), ("event", "device_id"))
    return rounded(op.approximate_boxes(states, ("event",)), q1_ns=0, median_ns=0, q3_ns=0, low_whisker_ns=0, high_whisker_ns=0)


def quantile_buckets(spark, sf_dir):
    """The states of every event and day, bucket by bucket."""
    states = op.quantile_states(_executions(spark, sf_dir), ("event",))
    return states.select("event", "day", "min_ns", "max_ns", F.inline("buckets"))


def device_matrix_wide(spark, sf_dir):
    """The matrix with devices across, in blocks of 64; each block's means (tenths of a microsecond) as text."""
    stats = small_table(_stats(spark, sf_dir).select("device_id", "event", "mean_ns"))
    blocks = op.device_matrix_blocks(stats, block=64)
    tenths = F.transform(F.map_entries("means_us"), lambda x: F.concat_ws("=", x["key"], F.round(F.round(x["value"], 1) * 10).cast("long")))
    return blocks.select("event", "block", F.size("means_us").cast("long").alias("devices"), F.array_join(tenths, " ").alias("means"))


def sync_pairs_beyond(spark, sf_dir):
    """Pairs of devices that start a pulse more than 30 days apart."""
    return op.sync_pairs_beyond(_starts(spark, sf_dir), 30 * views.DAY_NS)


LOG_NAMES = {"event": "Event", "time_ns": "Time", "toggled": "Toggled", "device_id": "Device_ID", "position": "Position", "message_id": "Message_ID"}


def log_files(spark, sf_dir):
    """The log written as CSV files among others, and read from the first of two paths that exists."""
    path, log = scratch(spark, "csv-log"), views.timing_events(spark, sf_dir)
    named = log.select(*[F.col(c).alias(n) for c, n in LOG_NAMES.items()])
    sources.write_result(named, path, "csv")
    sources.write_result(named, path, "json", mode="append")  # no log file by its name
    return sources.read_first_log(spark, [f"{path}-missing", path]).rows.drop("ord")


def basic_files(spark, sf_dir):
    """Executions of a log in the basic format, told by its columns, from CSV files."""
    path, log = scratch(spark, "basic-log"), views.timing_events(spark, sf_dir)
    sources.write_result(log.select(*[F.col(c).alias(LOG_NAMES[c]) for c in ("time_ns", "event", "toggled")]), path, "csv")
    read = sources.read_timing_log(spark, path)
    return op.pair_executions(read.rows, by_device=read.has_devices).select("event", "start_ns", "end_ns", "duration_ns")


def topology_files(spark, sf_dir):
    """An exported topology, read back."""
    path, devices = scratch(spark, "topology"), small_table(_devices(spark, sf_dir))
    sources.export_topology(devices, op.build_topology(devices, "daisy"), path, "daisy")
    return spark.read.schema("src string, dst string, mode string").json(f"{path}/connections")


def sorted_report(spark, sf_dir):
    """A result table in the order it was written in: its rows' places from its files."""
    path = scratch(spark, "report")
    sources.write_result(_stats(spark, sf_dir).select("device_id", "event", "count"), path, order_by=["device_id", "event"])
    # a report for people: few rows, numbered together
    place = F.row_number().over(Window.orderBy("file_name", "row_index"))
    found = spark.read.parquet(path).select("*", "_metadata.file_name", "_metadata.row_index")
    return found.withColumn("place", place.cast("long")).drop("file_name", "row_index")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q_executions": executions,
    "q_executions_msg": executions_msg,
    "q_executions_basic": executions_basic,
    "q_exec_stats": exec_stats,
    "q_exec_stats_basic": exec_stats_basic,
    "q_pooled_stats": pooled_stats,
    "q_kpis": kpis,
    "q_fastest_slowest": fastest_slowest,
    "q_event_distribution": event_distribution,
    "q_trends": trends,
    "q_histogram": histogram,
    "q_box_summary": box_summary,
    "q_box_summary_basic": box_summary_basic,
    "q_device_comparison": device_comparison,
    "q_device_matrix": device_matrix,
    "q_device_summary": device_summary,
    "q_device_summary_chosen": device_summary_chosen,
    "q_sync_starts": sync_starts,
    "q_ranked_starts": ranked_starts,
    "q_sync_pairs": sync_pairs,
    "q_sync_stats": sync_stats,
    "q_sync_summary": sync_summary,
    "q_propagation": propagation,
    "q_message_stats": message_stats,
    "q_pair_means": pair_means,
    "q_hop_cost": hop_cost,
    "q_hop_trend": hop_trend,
    "q_device_table": device_table,
    "q_device_count": device_count,
    "q_topo_daisy": _topology("daisy", "position"),
    "q_topo_daisy_appearance": _topology("daisy", "appearance"),
    "q_topo_star": _topology("star", "appearance"),
    "q_topo_ring": _topology("ring", "appearance"),
    "q_topo_mesh": _topology("mesh", "appearance"),
    "q_topo_custom": topo_custom,
    "q_topo_edit": topo_edit,
    "q_node_degree": node_degree,
    "q_topology_size": topology_size,
    "q_placed_edges": placed_edges,
    "q_unbalanced": unbalanced,
    "q_profile": profile,
    "q_preview": preview,
    "q_label_rows": label_rows,
    "q_groups_without_execution": groups_without_execution,
    "q_parse_lines": parsed_lines,
    "q_quarantine": quarantined_lines,
    "q_parse_files": parsed_files,
    "q_mesh_summary": mesh_summary,
    "q_trends_basic": trends_basic,
    "q_label_rows_basic": label_rows_basic,
    "q_executions_stored": executions_stored,
    "q_executions_stream": executions_stream,
    "q_nested_log": nested_log,
    "q_nested_executions": nested_executions,
    "q_nested_messages": nested_messages,
    "q_box_approximate": box_approximate,
    "q_quantile_buckets": quantile_buckets,
    "q_device_matrix_wide": device_matrix_wide,
    "q_sync_pairs_beyond": sync_pairs_beyond,
    "q_log_files": log_files,
    "q_basic_files": basic_files,
    "q_topology_files": topology_files,
    "q_sorted_report": sorted_report,
}
