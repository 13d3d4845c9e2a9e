"""Forms of reports for many devices, large pulses and messages, and a log stored for pairing."""

import random
from itertools import combinations

import pytest
from fleet import SCHEMA, fleet_rows, log_of, rows_of
from pyspark.sql import functions as F
from test_pairing import random_rows

from togglelog.operators import (
    device_matrix,
    device_matrix_blocks,
    histogram,
    matrix_columns,
    pair_executions,
    propagation,
    ranked_starts,
    sync_pairs,
    sync_pairs_beyond,
)
from togglelog.sources import read_stored_log, write_stored_log


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- matrix with devices across ------------------------------------------------------------------


def stats_of(spark, devices, events=("e", "f", "g")):
    rows = spark.range(devices * len(events)).select(
        F.concat(F.lit("d"), F.lpad((F.col("id") / len(events)).cast("long").cast("string"), 7, "0")).alias("device_id"),
        F.element_at(F.array(*map(F.lit, events)), (F.col("id") % len(events) + 1).cast("int")).alias("event"),
        (F.col("id") * 1000.0).alias("mean_ns"),
    )
    return rows.where("id % 7 <> 3").unionByName(spark.createDataFrame([(None, "e", 1.0)], "device_id string, event string, mean_ns double"))


@pytest.mark.parametrize("devices, rows_per_group", [(150, None), (150, 40), (100_000, 4_000_000)])
def test_matrix_of_many_devices(spark, devices, rows_per_group):
    stats = stats_of(spark, devices)
    columns = matrix_columns(stats, 1024, rows_per_group).cache()
    assert columns.agg(F.count("*"), F.count_distinct("block", "place"), F.max("place")).first()[0:2] == (devices, devices)
    blocks = device_matrix_blocks(stats, columns)
    cells = blocks.select("event", "block", F.explode("means_us").alias("place", "mean_us")).join(columns, ["block", "place"])
    want = stats.where("device_id IS NOT NULL").select("event", "device_id", (F.col("mean_ns") / 1000).alias("mean_us"))
    got = cells.select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert blocks.count() == 3 * -(-devices // 1024)


def test_matrix_of_chosen_devices(spark):
    stats = stats_of(spark, 20)
    chosen = spark.createDataFrame([("d0000003", 0, 1), ("d0000005", 0, 0), ("none", 0, 2)], "device_id string, block long, place int")
    got = {r["event"]: r["means_us"] for r in device_matrix_blocks(stats, chosen).collect()}
    pivoted = device_matrix(stats, ["d0000005", "d0000003"]).collect()
    want = {r["event"]: {i: r[d] for i, d in enumerate(("d0000005", "d0000003")) if r[d] is not None} for r in pivoted}
    assert got == want
    assert device_matrix_blocks(stats.where("false")).count() == 0


# --- histogram --------------------------------------------------------------------------------


def test_histogram_shuffles_bins_only(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(10**12)) for _ in range(5000)] + [("a", None)]
    df = spark.createDataFrame(rows, "event string, duration_ns long").repartition(4)
    got = histogram(df, bins=10)
    assert sum(r["count"] for r in got.collect()) == 5000
    written = {m.strip(" +-:").split(", [plan_id")[0] for m in plan_of(got).split("\n") if "Exchange" in m}
    assert len(written) == 1 and "event" in min(written) and "duration" not in min(written)
    one = spark.createDataFrame([("a", 5), ("b", 5)], "event string, duration_ns long")
    assert sorted(map(tuple, histogram(one).collect())) == [("a", 0, 5.0, 1), ("b", 0, 5.0, 1)]
    assert histogram(one.where("false")).count() == 0


# --- band join of pulses --------------------------------------------------------------------------


def pulse_log(rng, pulses, devices):
    rows = []
    for p in range(pulses):
        for d in range(rng.randrange(1, devices)):
            rows.append(("Sync_Pulse", rng.randrange(0, 60), True, f"d{d}", 1.0, f"SYNC_{p}", len(rows)))
    return rows


@pytest.mark.parametrize("rows_per_group", [None, 5])
@pytest.mark.parametrize("limit", [0, 20, 1000])
def test_pairs_beyond_a_limit(spark, limit, rows_per_group):
    rows = pulse_log(random.Random(limit), 6, 15)
    ranked = ranked_starts(spark.createDataFrame(rows, SCHEMA).repartition(3)).cache()
    got = sync_pairs_beyond(ranked, limit, rows_per_group)
    want = sync_pairs(ranked).where(F.col("time_diff_ns") > limit)
    columns = ("message_id", "device1", "device2", "time_diff_ns")
    assert rows_of(got, *columns) == rows_of(want, *columns)
    by_hand = {}
    for _, time, _, device, _, message, _ in rows:
        by_hand.setdefault(message, {})[device] = time
    assert got.count() == sum(abs(s[a] - s[b]) > limit for s in by_hand.values() for a, b in combinations(s, 2))


def test_a_large_pulse_with_few_pairs(spark):
    """20,000 devices, two of them late: 200 million pairs, of which 40,000 - 3 matter."""
    starts = spark.range(20_000).select(
        F.lit("Sync_Pulse").alias("event"), F.when(F.col("id") < 2, F.col("id") * 5 + 10**6).otherwise(F.col("id") % 100).alias("time_ns"),
        F.lit(True).alias("toggled"), F.concat(F.lit("d"), "id").alias("device_id"), F.lit("SYNC_1").alias("message_id"), F.col("id").alias("ord"),
    )
    assert sync_pairs_beyond(ranked_starts(starts), 1000).count() == 2 * 19_998


# --- one message on many devices ------------------------------------------------------------------


def test_a_message_on_many_devices(spark, tmp_path):
    """No window, and no task that gathers the message: adaptive execution splits the join's large partition."""
    receives = spark.range(200_000).select(
        F.lit("UART_Receive").alias("event"), F.col("id").alias("time_ns"), F.lit(True).alias("toggled"), F.concat(F.lit("d"), "id").alias("device_id"),
        (F.col("id") % 9).cast("double").alias("position"), F.lit("MSG_1").alias("message_id"), F.col("id").alias("ord"),
    )
    others = receives.limit(3000).withColumn("message_id", F.concat(F.lit("MSG_"), F.col("ord") + 2))
    sends = others.unionByName(receives.limit(1)).withColumn("event", F.lit("UART_Send")).withColumn("device_id", F.lit("sender"))
    log = receives.unionByName(others).unionByName(sends)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = propagation(log)
        found.collect()
        plan = plan_of(found)
        found.write.parquet(f"{tmp_path}/found")  # a file for each task
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = spark.read.parquet(f"{tmp_path}/found").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 203_000 and max(r["count"] for r in files) < 60_000
    assert "Window" not in plan and "skew=true" in plan


# --- stored layout ----------------------------------------------------------------------------------


def test_stored_log_needs_no_shuffle(spark, tmp_path):
    rows = random_rows(4, 2000, 3)
    log = spark.createDataFrame(rows, SCHEMA)
    write_stored_log(log, "stored_log_test", f"{tmp_path}/stored", buckets=4)
    try:
        stored = read_stored_log(spark, "stored_log_test")
        columns = ("device_id", "event", "start_ns", "start_ord", "end_ns", "end_ord")
        for match in (False, True):
            got = pair_executions(stored, match_message=match, rows_per_group=None)
            assert rows_of(got, *columns) == rows_of(pair_executions(log, match_message=match), *columns)
            assert "Exchange" not in plan_of(got)
        with pytest.raises(Exception, match="already exists"):
            write_stored_log(log, "stored_log_test", f"{tmp_path}/stored", buckets=4)
    finally:
        spark.sql("DROP TABLE stored_log_test")
    assert log_of(spark, fleet_rows()).count() > 0
