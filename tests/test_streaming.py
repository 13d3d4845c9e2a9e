"""The stream of executions against those of the whole log."""

import random

from fleet import SCHEMA
from test_pairing import random_rows

from togglelog.operators import pair_executions
from togglelog.streaming import stream_executions, use_rocks_db

MS = 1_000_000


def stream(spark, tmp_path, files, delay, match=True):
    """Executions of a log that comes file by file."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/log/part={i}")
    session = spark.newSession()
    use_rocks_db(session)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    schema = spark.createDataFrame([], SCHEMA).schema
    log = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/log")
    found = stream_executions(log, delay, match)
    sink = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect()), key=repr)


def heartbeat(time):
    return (None, time, None, None, None, None, None)


def test_rows_in_any_order_within_the_delay(spark, tmp_path):
    rng = random.Random(5)
    rows = [(e, t * MS, toggled, d, p, m, o) for e, t, toggled, d, p, m, o in random_rows(5, 600, 3, hot=0.5)]
    rows.sort(key=lambda r: r[1] + rng.randrange(200 * MS))  # at most 0.2 seconds late
    files = [rows[i : i + 150] for i in range(0, 600, 150)] + [[heartbeat(10**13)]]
    want = sorted(map(tuple, pair_executions(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert len(want) > 40
    assert stream(spark, tmp_path, files, "200 milliseconds") == want


def test_late_rows_and_open_starts(spark, tmp_path):
    """A row behind the watermark is left out; what the watermark has not passed waits."""
    first = [("e", 0, True, "d", 1.0, "m", 0), ("e", 5_000 * MS, False, "d", 1.0, "other", 1)]
    second = [("e", 10 * MS, False, "d", 1.0, "m", 2), ("e", 6_000 * MS, False, "d", 1.0, "m", 3), ("e", 7_000 * MS, True, "d", 1.0, "m", 4)]
    got = stream(spark, tmp_path, [first, [heartbeat(5_500 * MS)], second, [heartbeat(6_500 * MS)]], "1 second")
    assert got == []  # the watermark stands at 5.5 s; the end at 6 s still waits
    got = stream(spark, tmp_path / "more", [first, [heartbeat(5_500 * MS)], second, [heartbeat(9_500 * MS)]], "1 second")
    assert got == [("d", "e", 0, 6_000 * MS, 6_000 * MS, "m", 0, 3)]


def test_groups_share_state(spark, tmp_path):
    """Many groups take a few calls a bucket: the state has rows by bucket and chunk, not by group; null `ord` and equal times."""
    rows = [("e", t * MS, t % 2 == 0, f"d{d}", 1.0, "m", None if d % 3 else t) for d in range(300) for t in range(1, 7)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/log")
    session = spark.newSession()
    use_rocks_db(session)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    log = session.readStream.schema(spark.read.parquet(f"{tmp_path}/log").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    sink = stream_executions(log, "1 day", buckets=4).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    query = sink.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    most = max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"])
    assert most <= 40  # 1800 rows wait
    spark.createDataFrame([heartbeat(10**15)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    sink.trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=repr)
    want = sorted(map(tuple, pair_executions(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert len(want) == 600 and got == want


def test_chunks_of_any_size(spark, tmp_path, monkeypatch):
    """Chunks of some rows each, some of which the watermark has passed in part."""
    import sys

    monkeypatch.setattr(sys.modules["togglelog.streaming.pairing"], "CHUNK_ROWS", 3)
    rng = random.Random(6)
    rows = [(e, t * MS, toggled, d, p, m, o) for e, t, toggled, d, p, m, o in random_rows(6, 300, 3, hot=0.5)]
    rows.sort(key=lambda r: r[1] + rng.randrange(200 * MS))
    files = [rows[i : i + 60] for i in range(0, 300, 60)] + [[heartbeat(10**13)]]
    for match in (True, False):
        want = sorted(map(tuple, pair_executions(spark.createDataFrame(rows, SCHEMA), match_message=match).collect()), key=repr)
        assert len(want) > 10
        assert stream(spark, tmp_path / str(match), files, "200 milliseconds", match) == want
