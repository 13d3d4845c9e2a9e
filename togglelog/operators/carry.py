"""Which start is open at the beginning of every chunk of a group: a parallel prefix over the chunks' exits.

A chunk is a function of the state it is entered with: idle, or open with some start. It is given as a
table of exits, one row for entering idle and one for each message that has an end in the chunk; entered
with any other message, the start stays open. Such functions compose to functions of the same
kind: an exit of the first that is idle, or has a message the second has a row for, goes on with that
row; the second's other rows are kept, for messages that pass through the first.

So exits are combined two chunks at a time, level by level, up to one function for each group, and the states go
down the same tree: the left half of a node is entered as the node is, the right half as the left one
leaves it. Every step is a join on (group, node, message), which spreads over tasks however many exits one
group has; a tree of c chunks has log2(c) levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

STATE = ("time_ns", "ord", "message_id")


def states_by_tree(exits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, chunk, time_ns, ord, message_id): the open start of every chunk that is entered open, and, with a
    NULL chunk, the start that a group leaves open.

    `exits` has (keys, chunk, idle, entry, open, time_ns, ord, message_id); keys are not NULL. A group's list of chunks (one
    number each, at most MAX_CHUNKS) is numbered by one task; its exits never meet in one.
    """
    keys = list(keys)
    chunks = exits.where("idle").select(*keys, "chunk")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("chunk")) - 1
    numbers = chunks.withColumn("node", place.cast("long")).checkpoint()
    left = F.when(F.col("open"), F.struct(*STATE)).alias("left")
    level = exits.join(numbers, [*keys, "chunk"]).select(*keys, "node", "idle", "entry", left).checkpoint()
    most = numbers.agg(F.max("node")).first()[0]
    levels = [level]
    while most is not None and most > 0:
        level = _combined(level, keys).checkpoint()
        levels.append(level)
        most >>= 1
    if most is None:
        return _as_rows(level.withColumn("chunk", F.col("node")), keys, "left").where("false")

    # down: (keys, node, state) of each level; a node without a right half has no row for it
    root = level.where("idle").select(*keys, "node", "left")
    states = root.select(*keys, "node", F.lit(None).cast(level.schema["left"].dataType).alias("state"))
    for below in reversed(levels[:-1]):
        first = states.select(*keys, (F.col("node") * 2).alias("node"), "state")
        there = below.where("idle").select(*keys, F.col("node").alias("_right"))
        second = _applied(first, below, keys).select(*keys, (F.col("node") + 1).alias("_right"), "state")
        second = second.join(there, [*keys, "_right"], "left_semi").withColumnRenamed("_right", "node")
        states = first.unionByName(second.select(*first.columns)).checkpoint()
    inside = states.where("state IS NOT NULL").join(numbers, [*keys, "node"])
    at_end = root.where("left IS NOT NULL").withColumn("chunk", F.lit(None).cast("long"))
    return _as_rows(inside, keys, "state").unionByName(_as_rows(at_end, keys, "left"))


def _as_rows(df: DataFrame, keys: list[str], state: str) -> DataFrame:
    return df.select(*keys, F.col("chunk").cast("long").alias("chunk"), *[F.col(f"{state}.{c}").alias(c) for c in STATE])


def _rows_of(df: DataFrame, keys: list[str], node: Column) -> DataFrame:
    """Exits under other names, to look states up in, with the node they are looked up from."""
    return df.select(
        *[F.col(k).alias(f"_{k}") for k in keys], node.alias("_node"), F.col("idle").alias("_idle"), F.col("entry").alias("_entry"), F.col("left").alias("_left")
    )


def _goes_on(df: DataFrame, rows: DataFrame, keys: list[str], state: str) -> DataFrame:
    """df with the exit that `rows` have for a state: itself, where there is no row for its message."""
    opened = F.col(f"{state}.message_id")
    same = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("node") == F.col("_node"), F.col(state).isNull() == F.col("_idle")]
    joined = df.join(rows, [*same, opened.eqNullSafe(F.col("_entry"))], "left")
    return joined.withColumn(state, F.when(F.col("_node").isNotNull(), F.col("_left")).otherwise(F.col(state)))


def _combined(level: DataFrame, keys: list[str]) -> DataFrame:
    """The exits of pairs of neighbours, each as one node."""
    above = F.shiftright("node", 1)
    first = level.where("node % 2 = 0").withColumn("node", above)
    second = level.where("node % 2 = 1")
    through = _goes_on(first, _rows_of(second, keys, above), keys, "left").select(*level.columns)
    met = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("node") == F.col("_node"), F.col("entry").eqNullSafe(F.col("_entry"))]
    only = second.where("NOT idle").withColumn("node", above).join(_rows_of(first.where("NOT idle"), keys, F.col("node")), met, "left_anti")
    return through.unionByName(only.select(*level.columns))


def _applied(states: DataFrame, level: DataFrame, keys: list[str]) -> DataFrame:
    """States after the nodes they enter."""
    return _goes_on(states, _rows_of(level, keys, F.col("node")), keys, "state").select(*states.columns)
