"""Chunks of big groups joined as a tree, against the fold."""

import random

import pytest
from test_pairing import COLUMNS, pair_by_hand, random_rows

from fleet import SCHEMA, rows_of
from togglelog.operators import label_rows, pair_or_open
from togglelog.operators.carry import states_by_tree


@pytest.mark.parametrize("messages, p_true, rows_per_group", [(3, 0.5, 40), (60, 0.5, 25), (0, 0.5, 150)])
def test_tree_equals_the_fold(spark, messages, p_true, rows_per_group):
    rows = random_rows(messages, 1500, messages, p_true, hot=0.6)
    log = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = pair_or_open(log, rows_per_group=rows_per_group, carry_exits=0)
    assert rows_of(got, *COLUMNS) == pair_by_hand(rows, True)


def by_hand(functions):
    """States of chunks given as {entry: exit}; None is idle."""
    state, out = None, []
    for chunk, exits in functions:
        if state is not None:
            out.append((chunk, *state))
        key = state and ("open", state[2])
        state = exits[key] if key in exits else state
    return out + ([(None, *state)] if state else [])


def test_random_exits(spark):
    """Functions of chunks as they come out of no log: every chunk number of exits, messages with NULL."""
    rng, rows, want = random.Random(3), [], {}
    for group in range(6):
        functions = []
        for i in range(rng.choice([1, 2, 3, 7, 16, 21])):
            chunk, exits = 5 * i + group, {}
            for entry in (None, *[("open", m) for m in ("a", "b", "c", None) if rng.random() < 0.5]):
                exits[entry] = rng.choice([None, (i, rng.randrange(99), rng.choice(["a", "b", "c", None]))])
                left = exits[entry] or (None, None, None)
                rows.append((f"g{group}", chunk, entry is None, entry and entry[1], exits[entry] is not None, *left))
            functions.append((chunk, exits))
        want[f"g{group}"] = by_hand(functions)
    rng.shuffle(rows)
    schema = "event string, chunk long, idle boolean, entry string, open boolean, time_ns long, ord long, message_id string"
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    got = states_by_tree(spark.createDataFrame(rows, schema), ["event"]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((g, *r)) for g, found in want.items() for r in found)


def test_roles_with_repeated_ord(spark):
    """A start and an end that share an ord keep their own roles, split or not."""
    rows = [("e", i, i % 2 == 0, "d", 1.0, None, i // 2) for i in range(20)]
    log = spark.createDataFrame(rows, SCHEMA)
    for rows_per_group in (None, 5):
        got = label_rows(log, rows_per_group=rows_per_group).select("time_ns", "role").collect()
        assert sorted(map(tuple, got)) == [(i, "start" if i % 2 == 0 else "end") for i in range(20)]
