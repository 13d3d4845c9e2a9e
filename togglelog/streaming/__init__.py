from togglelog.streaming.pairing import stream_executions, use_rocks_db
