import numpy as np
import pandas as pd
import pytest
from fleet import EXECUTIONS, SYNC_EVENT, durations, fleet_rows, log_of, rows_of
from test_pairing import random_rows, SCHEMA

from togglelog.operators import (
    box_summary,
    device_comparison,
    device_matrix,
    device_summary,
    event_distribution,
    exec_stats,
    fastest_slowest,
    histogram,
    kpis,
    pair_executions,
    pooled_stats,
    trends,
)
from togglelog.operators.skew import find_hot_keys, rank_all, rank_in_groups

# event -> durations of its executions, basic format
BASIC = {"Grind": [310, 295, 347], "Brew": [2750, 2610], "Steam": [88, 93, 90, 71], "Rinse": [45]}


@pytest.fixture(scope="module")
def fleet(spark):
    return pair_executions(log_of(spark, fleet_rows())).cache()


@pytest.fixture(scope="module")
def basic(spark):
    rows, now = [], 0
    for event, lengths in BASIC.items():
        for duration in lengths:
            rows += [(event, now, True, None, None, None), (event, now + duration, False, None, None, None)]
            now += duration + 1000
    return pair_executions(log_of(spark, rows), by_device=False).cache()


@pytest.fixture(scope="module")
def messy(spark):
    rows = random_rows(5, 4000, 2)
    return pair_executions(spark.createDataFrame(rows, SCHEMA)).cache()


def test_pooled_stats(fleet):
    got = {r["event"]: (r["count"], r["mean_ns"], r["std_ns"]) for r in pooled_stats(fleet).collect()}
    assert got.keys() == durations(0).keys()
    for event, found in durations(0).items():
        assert got[event] == pytest.approx((len(found), np.mean(found), np.std(found)))


def test_kpis_weigh_groups_not_executions(fleet):
    stats = exec_stats(fleet)
    row = kpis(stats).first()
    assert row["total_executions"] == len(EXECUTIONS)
    assert row["mean_of_means_ns"] == pytest.approx(np.mean([np.mean(d) for d in durations(0, 1).values()]))
    assert fastest_slowest(stats).first().asDict() == {
        "fastest_event": SYNC_EVENT,
        "fastest_ns": (9 + 8 + 9.5 + 7) / 4,  # of the means of its devices
        "slowest_event": "Drain",
        "slowest_ns": (900 + 730) / 2,
    }


def test_fastest_slowest_ties_take_the_first_name(spark):
    stats = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 1.0)], "event string, mean_ns double")
    row = fastest_slowest(stats).first()
    assert (row["fastest_event"], row["slowest_event"]) == ("a", "a")


def test_empty_log(spark):
    none = pair_executions(log_of(spark, [("e", 1, True, "d", 1.0, None)]))
    assert exec_stats(none).count() == 0
    assert kpis(exec_stats(none)).first()["total_executions"] == 0
    assert histogram(none).count() == event_distribution(none).count() == 0


def test_basic_stats_use_the_population_deviation(basic):
    got = {r["event"]: r for r in exec_stats(basic, keys=("event",)).collect()}
    for event, lengths in BASIC.items():
        row = got[event]
        assert (row["count"], row["min_ns"], row["max_ns"]) == (len(lengths), min(lengths), max(lengths))
        assert row["mean_ns"] == pytest.approx(np.mean(lengths))
        assert row["std_ns"] == pytest.approx(np.std(lengths))


def test_distribution(fleet):
    got = {r["event"]: (r["count"], r["share"]) for r in event_distribution(fleet).collect()}
    assert got == {event: (len(d), len(d) / len(EXECUTIONS)) for event, d in durations(0).items()}


@pytest.mark.parametrize("rows_per_group", [None, 40])
def test_trends(messy, rows_per_group):
    got = trends(messy, rows_per_group).toPandas().sort_values(["event", "instance"])
    want = messy.toPandas().sort_values(["event", "start_ns", "device_id", "end_ns", "start_ord"])
    assert list(got["instance"]) == list(want.groupby("event").cumcount())
    assert list(got["duration_ns"]) == list(want["duration_ns"])


def test_histogram(messy):
    got = histogram(messy, 30).toPandas()
    data = messy.toPandas()
    low, high = data["duration_ns"].min(), data["duration_ns"].max()
    width = (high - low) / 30
    data["bin"] = np.minimum(np.floor((data["duration_ns"] - low) / width), 29).astype(int)
    want = data.groupby(["event", "bin"]).size()
    assert got.set_index(["event", "bin"])["count"].to_dict() == want.to_dict()
    assert np.allclose(got["bin_start_ns"], low + got["bin"] * width)


def test_histogram_of_equal_durations(spark):
    rows = [("e", t, t % 10 == 0, "d", 1.0, None) for t in (0, 5, 10, 15)]
    assert rows_of(histogram(pair_executions(log_of(spark, rows))), "event", "bin", "count") == [("e", 0, 2)]


@pytest.mark.parametrize("rows_per_group", [None, 30])
@pytest.mark.parametrize("keys", [("event", "device_id"), ("event",)])
def test_box_summary(messy, keys, rows_per_group):
    got = box_summary(messy, keys, rows_per_group).toPandas().set_index(list(keys)).sort_index()
    groups = messy.toPandas().groupby(list(keys))["duration_ns"]
    assert len(got) == groups.ngroups
    for key, d in groups:
        row = got.loc[key]
        q1, median, q3 = np.quantile(d, [0.25, 0.5, 0.75])
        inside = d[(d >= q1 - 1.5 * (q3 - q1)) & (d <= q3 + 1.5 * (q3 - q1))]
        assert (row["q1_ns"], row["median_ns"], row["q3_ns"]) == pytest.approx((q1, median, q3))
        assert (row["low_whisker_ns"], row["high_whisker_ns"]) == (inside.min(), inside.max())
        assert (row["outliers"], row["count"]) == (len(d) - len(inside), len(d))
        assert (row["min_ns"], row["max_ns"]) == (d.min(), d.max())


def test_device_reports(spark, fleet):
    stats = exec_stats(fleet)
    got = {r["device_id"]: (r["total_executions"], r["mean_of_means_ns"]) for r in device_summary(stats).collect()}
    assert got["west"] == (5, pytest.approx((42 + 300 + 27 + 9) / 4))
    assert got["well"] == (6, pytest.approx((61 + 14.5 + 22 + 9.5) / 4))
    chosen = spark.createDataFrame([("tank",), ("nowhere",)], "device_id string")
    for devices in (["tank", "nowhere"], chosen):
        assert rows_of(device_summary(stats, devices), "device_id") == [("tank",)]
        assert device_comparison(stats, devices).count() == 5
    matrix = device_matrix(stats, ["west", "well"])
    assert matrix.columns == ["event", "west", "well"]
    cells = {r["event"]: (r["west"], r["well"]) for r in matrix.collect()}
    assert cells["Fill"] == pytest.approx((0.042, 0.061))
    assert cells["Sample"] == (None, pytest.approx(0.0145))
    whole = device_matrix(stats)
    assert set(whole.columns) - {"event"} == set(got)


def test_hot_keys_and_ranks(spark):
    values = [("hot" if i % 3 else f"k{i % 50}", (i * 7919) % 1009, i) for i in range(3000)] + [(None, 5, 5000)] * 1
    df = spark.createDataFrame(values, "k string, v long, i long")
    assert find_hot_keys(df, ["k"], 2500) is None
    assert find_hot_keys(df, ["k"], None) is None
    hot = find_hot_keys(df, ["k"], 500)
    assert df.where(hot.matches()).select("k").distinct().collect() == [("hot",)]
    want = pd.DataFrame(values, columns=["k", "v", "i"]).sort_values(["v", "i"])
    want["rank"] = want.groupby("k", dropna=False).cumcount() + 1
    want["all"] = range(1, len(want) + 1)
    ranked = rank_in_groups(df, ["k"], ["v", "i"], "rank", 500)
    assert {r["i"]: r["rank"] for r in ranked.collect()} == dict(zip(want["i"], want["rank"]))
    ranked = rank_all(df, ["v", "i"], "all", 100)
    assert {r["i"]: r["all"] for r in ranked.collect()} == dict(zip(want["i"], want["all"]))


def test_hot_keys_are_seen_in_a_thin_part(spark):
    big = spark.range(200_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 20000) END AS k")
    hot = find_hot_keys(big, ["k"], 20_000)
    assert big.where(hot.matches()).select("k").distinct().collect() == [("hot",)]
    assert hot.rows == pytest.approx(200_000 / 3, rel=0.1)
    assert find_hot_keys(big, ["k"], 100_000) is None
