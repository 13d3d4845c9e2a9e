"""Quantile states against exact quantiles."""

import random

import numpy as np
from pyspark.sql import functions as F

from togglelog.operators import approximate_boxes, box_summary, merge_states, quantile_states, sketch_quantiles
from togglelog.operators.sketches import DAY_NS, middle_of, with_buckets

SCHEMA = "event string, device_id string, start_ns long, duration_ns long, start_ord long"


def test_buckets_follow_the_values(spark):
    values = sorted({*range(600), *[2**k + d for k in range(8, 63) for d in (-1, 0, 1)], 2**63 - 1, *[random.Random(1).randrange(2**62) for _ in range(300)]})
    df = with_buckets(spark.createDataFrame([(v,) for v in values], "duration_ns long")).withColumn("m", middle_of(F.col("bucket")))
    rows = sorted(map(tuple, df.collect()))
    assert [r[1] for r in rows] == sorted(r[1] for r in rows) and rows[-1][1] == 7295
    for value, bucket, middle in rows:
        assert abs(middle - value) <= value / 256
        if value < 256:
            assert bucket == middle == value


def executions(spark):
    rng, rows = random.Random(2), []
    for i in range(3000):
        event = rng.choice(["short", "wide", "wide"])
        length = rng.randrange(300) if event == "short" else int(10 ** rng.uniform(0, 12))
        rows.append((event, rng.choice(["a", "b"]), rng.randrange(5) * DAY_NS, length, i))
    rows += [("one", "a", 0, 5, 0), ("zero", "a", 0, 0, 0), ("zero", "b", 0, 0, 1), ("short", "a", 0, None, 2)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_error_bound_after_any_merging(spark):
    rows, df = executions(spark)
    by_day = quantile_states(df)
    assert by_day.groupBy("event", "device_id", "day").count().where("count > 1").count() == 0
    probabilities = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    whole = sketch_quantiles(quantile_states(df, ("event",), by_day=False), ("event",), probabilities)
    for found in (sketch_quantiles(by_day, ("event",), probabilities), sketch_quantiles(merge_states(by_day, ["device_id", "event"]), ["event"], probabilities)):
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
    for r in whole.collect():
        exact = np.quantile([d for e, _, _, d, _ in rows if e == r["event"] and d is not None], probabilities)
        assert all(abs(a - b) <= b / 256 + 1e-6 for a, b in zip(r["quantiles"], exact))


def test_approximate_boxes(spark):
    _, df = executions(spark)
    exact = {r["event"]: r for r in box_summary(df.where("duration_ns IS NOT NULL"), keys=("event",)).collect()}
    for r in approximate_boxes(quantile_states(df), ("event",)).collect():
        want = exact[r["event"]]
        assert (r["count"], r["min_ns"], r["max_ns"]) == (want["count"], want["min_ns"], want["max_ns"])
        for c in ("q1_ns", "median_ns", "q3_ns", "low_whisker_ns"):
            assert abs(r[c] - want[c]) <= want[c] / 200
        assert abs(r["outliers"] - want["outliers"]) <= 10
    assert approximate_boxes(quantile_states(df.where("false")), ("event",)).count() == 0
