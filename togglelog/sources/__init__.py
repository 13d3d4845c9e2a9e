from togglelog.sources.csv_log import TimingLog, parse_files, parse_lines, read_first_log, read_timing_log
from togglelog.sources.json_log import (
    flatten_executions,
    flatten_log,
    flatten_messages,
    json_lines,
    nest_executions,
    nest_log,
    nest_messages,
    read_nested_log,
)
from togglelog.sources.sinks import export_topology, write_result
from togglelog.sources.stored_log import read_stored_log, write_stored_log
