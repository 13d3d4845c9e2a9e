"""Pair start rows (True) with end rows (False) into executions.

Within one group, taken in (time_ns, ord) order: an idle group opens at the next True; further Trues
are ignored while it is open; a False closes it, under message matching only when its message id
equals the start's (NULL equals NULL). A start that never closes gives no execution.

Without message matching that means: rows of the same value that follow each other form a run, and
the first row of a True run pairs with the first row of the next run: windows over one shuffle. With
message matching the rows are folded one by one, as a sorted Arrow stream with constant state; this was
measured to be faster than telling apart, by windows, the groups where runs are enough. Groups too big
for one task are cut into chunks (see `skew`), and the start that is open at the beginning of a chunk
is put in front of it as a carried row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from togglelog.functions.columns import type_of
from togglelog.operators.carry import states_by_tree
from togglelog.operators.skew import (
    ROWS_PER_GROUP,
    find_hot_keys,
    join_null_safe,
    split_into_chunks,
)
from togglelog.schema import TIME_ORDER, normalise

BY_DEVICE = ("device_id", "event")
BY_EVENT = ("event",)
# One task follows a group through its chunks' exits up to so many; beyond, they are combined as a tree.
CARRY_EXITS = 200_000


def pair_executions(
    log: DataFrame,
    by_device: bool = True,
    match_message: bool | None = None,
    rows_per_group: int | None = ROWS_PER_GROUP,
    carry_exits: int = CARRY_EXITS,
) -> DataFrame:
    """Executions (device_id, event, start_ns, end_ns, duration_ns, message_id, start_ord, end_ord).

    `by_device=False` is the basic format: groups are events, message ids are ignored, device_id is
    NULL. `match_message` defaults to `by_device`. Persist or write the result when several reports
    use it.
    """
    executions = pair_or_open(log, by_device, match_message, rows_per_group, carry_exits)
    return executions.where(F.col("end_ns").isNotNull()).select(
        "device_id",
        "event",
        "start_ns",
        "end_ns",
        (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"),
        "message_id",
        "start_ord",
        "end_ord",
    )


def pair_or_open(
    log: DataFrame,
    by_device: bool = True,
    match_message: bool | None = None,
    rows_per_group: int | None = ROWS_PER_GROUP,
    carry_exits: int = CARRY_EXITS,
) -> DataFrame:
    """Executions, plus one row with NULL end for the start a group may leave open.

    `carry_exits` bounds what one task reads of a group that is cut into chunks; it never changes the result.
    """
    match_message = by_device if match_message is None else match_message
    keys = BY_DEVICE if by_device else BY_EVENT
    rows = usable_rows(log, by_device)
    if not by_device:
        rows = rows.withColumn("message_id", F.lit(None).cast("string"))

    cold = _pair_matched if match_message else _pair_plain
    hot_keys = find_hot_keys(rows, keys, rows_per_group)
    if hot_keys is None:
        paired = cold(rows, keys)
    else:
        chunked = split_into_chunks(rows.where(hot_keys.matches()), hot_keys, TIME_ORDER)
        hot = pair_chunks(chunked, keys, match_message, carry_exits)
        paired = cold(rows.where(~hot_keys.matches()), keys).unionByName(hot)
    return paired if by_device else paired.withColumn("device_id", F.lit(None).cast("string"))


def usable_rows(log: DataFrame, by_device: bool = True) -> DataFrame:
    """The pairing columns of the rows that can take part: known group, time and value."""
    keys = BY_DEVICE if by_device else BY_EVENT
    rows = normalise(log).select(*keys, "time_ns", "ord", "toggled", "message_id")
    for column in (*keys, "time_ns", "toggled"):  # one by one, so that they reach the scan
        rows = rows.where(F.col(column).isNotNull())
    return rows


# --- run heads --------------------------------------------------------------------------------


def _run_heads(rows: DataFrame, window) -> DataFrame:
    before = F.lag("toggled").over(window)
    return rows.withColumn("_before", before).where(
        F.col("_before").isNull() | (F.col("_before") != F.col("toggled"))
    )


def _pair_heads(heads: DataFrame, keys: Sequence[str], window) -> DataFrame:
    return (
        heads.withColumn("_end", F.lead(F.struct("time_ns", "ord")).over(window))
        .where("toggled")
        .select(
            *keys,
            F.col("time_ns").alias("start_ns"),
            F.col("ord").alias("start_ord"),
            F.col("_end.time_ns").alias("end_ns"),
            F.col("_end.ord").alias("end_ord"),
            "message_id",
        )
    )


def _pair_plain(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*TIME_ORDER)
    return _pair_heads(_run_heads(rows, window), keys, window)


def _pair_matched(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The window shuffles and sorts the rows by group; the fold streams over them in that order.

    A True after a True and a False after a False with the same message id change nothing, whatever
    state they meet: they are dropped before the fold.
    """
    window = Window.partitionBy(*keys).orderBy(*TIME_ORDER)
    before = F.col("_before")
    same = (before["toggled"] == F.col("toggled")) & (
        F.col("toggled") | before["message_id"].eqNullSafe(F.col("message_id"))
    )
    ordered = (
        rows.withColumn("_before", F.lag(F.struct("toggled", "message_id")).over(window))
        .where(before.isNull() | ~same)
        .withColumn("first", before.isNull())
        .sortWithinPartitions(*keys, *TIME_ORDER)
        .select(*keys, "time_ns", "ord", "toggled", "message_id", "first")
    )
    return _fold(ordered, keys)


# --- sorted fold ------------------------------------------------------------------------------


def _paired_schema(rows: DataFrame, keys: Sequence[str]) -> str:
    time = type_of(rows, "time_ns")
    columns = [f"`{k}` {type_of(rows, k)}" for k in keys]
    columns += [f"start_ns {time}", "start_ord bigint", f"end_ns {time}", "end_ord bigint"]
    return ", ".join([*columns, "message_id string"])


def _arrow_readers():
    """Made inside a function, so that they travel to the executors with the code that uses them."""

    def values(column: pa.Array) -> list:
        """A column without NULLs as a list of plain values."""
        return column.to_numpy(zero_copy_only=False).tolist()

    def texts(column: pa.Array) -> list:
        """A text column as a list; repeated texts are converted once."""
        coded = column.dictionary_encode()
        distinct = [*coded.dictionary.to_pylist(), None]
        return [distinct[code] for code in values(coded.indices.fill_null(-1))]

    return values, texts


def _walker(message: str = "message_id"):
    """The state machine over one batch of rows sorted by group; `message` is the column that must agree."""
    values, _ = _arrow_readers()

    def walk(batch: pa.RecordBatch) -> tuple[list[int], list[int], list[int], int]:
        """Places of starts and their ends, of starts their group leaves open, and of the start that is
        open at the end of the batch (-1: none)."""
        codes = batch.column(message).dictionary_encode().indices.fill_null(-1)
        steps = zip(values(batch.column("first")), values(batch.column("toggled")), values(codes))
        starts, ends, left = [], [], []
        start, opened = -1, None
        for i, (first, toggled, code) in enumerate(steps):
            if first and start >= 0:
                left.append(start)
                start = -1
            if toggled:
                if start < 0:
                    start, opened = i, code
            elif start >= 0 and code == opened:
                starts.append(start)
                ends.append(i)
                start = -1
        return starts, ends, left, start

    return walk


def _fold(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Message-matched pairing of rows sorted by group; `first` marks where a group begins.

    Only places in the batch are followed row by row; the values are then taken by place. A start that
    is open at the end of a batch is put in front of the next one.
    """
    keys = list(keys)
    walk = _walker()

    def paired(batch: pa.RecordBatch, starts: list[int], ends: list[int], left: list[int]) -> pa.RecordBatch:
        opening = pa.array(starts + left, pa.int64())
        closing = pa.array(ends + [None] * len(left), pa.int64())
        columns = {k: batch.column(k).take(opening) for k in keys}
        columns["start_ns"] = batch.column("time_ns").take(opening)
        columns["start_ord"] = batch.column("ord").take(opening)
        columns["end_ns"] = batch.column("time_ns").take(closing)
        columns["end_ord"] = batch.column("ord").take(closing)
        columns["message_id"] = batch.column("message_id").take(opening)
        return pa.RecordBatch.from_pydict(columns)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row of the start that is open between two batches
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            starts, ends, left, start = walk(batch)
            if starts or left:
                yield paired(batch, starts, ends, left)
            held = batch.slice(start, 1) if start >= 0 else None
        if held is not None:
            yield paired(held, [], [], [0])

    return rows.mapInArrow(pair, _paired_schema(rows, keys))


def fold_roles(rows: DataFrame, keys: Sequence[str], match_message: bool) -> DataFrame:
    """Usable rows with their role in pairing, for groups that fit a task: one shuffle, one fold.

    The row of a start that is open at the end of a batch waits for its role."""
    columns = [*keys, "time_ns", "ord", "toggled", "message_id"]
    window = Window.partitionBy(*keys).orderBy(*TIME_ORDER)
    matched = F.col("message_id") if match_message else F.lit(None)
    ordered = (
        rows.withColumn("first", F.lag("toggled").over(window).isNull())
        .withColumn("matched", matched.cast("string"))
        .sortWithinPartitions(*keys, *TIME_ORDER)
        .select(*columns, "first", "matched")
    )
    walk = _walker("matched")

    def labelled(batch: pa.RecordBatch, roles: list[str | None]) -> pa.RecordBatch:
        out = [batch.column(c) for c in columns] + [pa.array(roles, pa.string())]
        found = pa.RecordBatch.from_arrays(out, names=[*columns, "role"])
        return found.filter(found.column("role").is_valid())

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            starts, ends, left, start = walk(batch)
            roles: list[str | None] = ["ignored"] * batch.num_rows
            for places, role in ((starts, "start"), (ends, "end"), (left, "unclosed"), ([start] if start >= 0 else [], None)):
                for place in places:
                    roles[place] = role
            yield labelled(batch, roles)
            held = batch.slice(start, 1) if start >= 0 else None
        if held is not None:
            yield labelled(held, ["unclosed"])

    fields = ", ".join(f"`{c}` {type_of(ordered, c)}" for c in columns)
    return ordered.mapInArrow(label, f"{fields}, role string")


# --- groups cut into chunks -------------------------------------------------------------------


def pair_chunks(chunked: DataFrame, keys: Sequence[str], match_message: bool, carry_exits: int = CARRY_EXITS) -> DataFrame:
    """Pairs, and the starts left open, of groups cut into chunks by `split_into_chunks`."""
    return _pair_matched_chunks(chunked, keys, carry_exits) if match_message else _pair_plain_chunks(chunked, keys)


def _pair_plain_chunks(chunked: DataFrame, keys: Sequence[str]) -> DataFrame:
    at = [*keys, "chunk"]
    heads = _run_heads(chunked, Window.partitionBy(*at).orderBy(*TIME_ORDER)).drop("_before")
    start = F.struct("time_ns", "ord", "message_id")

    # One row per chunk: is there a False, and which True run is still open at its end?
    chunks = heads.groupBy(*at).agg(
        F.max_by(F.when(F.col("toggled"), start), F.struct(*TIME_ORDER)).alias("_tail"),
        F.bool_or(~F.col("toggled")).alias("_closes"),
    )
    by_chunk = Window.partitionBy(*keys).orderBy("chunk")
    era = Window.partitionBy(*keys, "_era").orderBy("chunk")
    chunks = (
        chunks.withColumn("_era", F.count_if("_closes").over(by_chunk))
        .withColumn("_open", F.first("_tail", ignorenulls=True).over(era))
        .withColumn("_carried", F.lag("_open").over(by_chunk))
        .withColumn("_last", F.lead("chunk").over(by_chunk).isNull())
    )
    carried = chunks.where(F.col("_carried").isNotNull()).select(
        *at, "_carried.*", F.lit(True).alias("toggled"), F.lit(0).alias("_seq")
    )
    window = Window.partitionBy(*at).orderBy("_seq", *TIME_ORDER)
    rows = heads.withColumn("_seq", F.lit(1)).unionByName(carried)
    closed = _pair_heads(_run_heads(rows, window), keys, window).where("end_ord IS NOT NULL")
    still_open = chunks.where(F.col("_last") & F.col("_open").isNotNull())
    return closed.unionByName(_open_rows(still_open, keys, "_open", closed))


def _open_rows(chunks: DataFrame, keys: Sequence[str], start: str, like: DataFrame) -> DataFrame:
    return chunks.select(
        *keys,
        F.col(f"{start}.time_ns").alias("start_ns"),
        F.col(f"{start}.ord").alias("start_ord"),
        F.lit(None).cast(type_of(like, "end_ns")).alias("end_ns"),
        F.lit(None).cast("bigint").alias("end_ord"),
        F.col(f"{start}.message_id").alias("message_id"),
    )


def _pair_matched_chunks(chunked: DataFrame, keys: Sequence[str], carry_exits: int = CARRY_EXITS) -> DataFrame:
    states = _states(chunked, keys, carry_exits)
    at = [*keys, "chunk"]
    carried = states.where("chunk IS NOT NULL").select(
        *at, "time_ns", "ord", "message_id", F.lit(True).alias("toggled"), F.lit(0).alias("_seq")
    )
    window = Window.partitionBy(*at).orderBy("_seq", *TIME_ORDER)
    rows = (
        chunked.withColumn("_seq", F.lit(1))
        .unionByName(carried)
        .withColumn("first", F.lag("toggled").over(window).isNull())
        .sortWithinPartitions(*at, "_seq", *TIME_ORDER)
        .select(*keys, "time_ns", "ord", "toggled", "message_id", "first")
    )
    closed = _fold(rows, keys).where("end_ord IS NOT NULL")
    still_open = states.where("chunk IS NULL").withColumn(
        "_open", F.struct("time_ns", "ord", "message_id")
    )
    return closed.unionByName(_open_rows(still_open, keys, "_open", closed))


def _states(chunked: DataFrame, keys: Sequence[str], carry_exits: int) -> DataFrame:
    """The start that is open when a chunk is entered, and, with a NULL chunk, when a group ends."""
    exits = _chunk_exits(chunked, keys).checkpoint()
    # A chunk can only be entered idle, or open with a message that some chunk leaves open.
    left_open = exits.where("open").select(*keys, F.col("message_id").alias("entry")).distinct()
    entered = join_null_safe(exits.where("NOT idle"), left_open, [*keys, "entry"], "left_semi")
    exits = exits.where("idle").unionByName(entered).checkpoint()
    if exits.groupBy(*keys).count().where(F.col("count") > carry_exits).isEmpty():
        return _carry_states(exits, keys)
    return states_by_tree(exits, keys)


def _chunk_exits(chunked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How every chunk is left, for each way of entering it.

    Entering idle gives one row; entering open with message m gives one row per message that has a
    False in the chunk (any other message passes through unchanged). Read backwards, both follow
    from what comes after: a False of m closes and goes on idle; a True opens, and goes on from its
    message's next False if there is one, or else stays open to the end.
    """
    at = [*keys, "chunk"]
    backwards = [F.col(c).desc() for c in TIME_ORDER]
    window = Window.partitionBy(*at).orderBy(*backwards)
    rows = (
        chunked.withColumn("first", F.lag("toggled").over(window).isNull())
        .sortWithinPartitions(*at, *backwards)
        .select(*at, "time_ns", "ord", "toggled", "message_id", "first")
    )
    time = type_of(chunked, "time_ns")
    fields = ", ".join(f"`{k}` {type_of(chunked, k)}" for k in at)
    out = f"{fields}, idle boolean, entry string, open boolean, time_ns {time}, ord bigint, message_id string"
    n_rows = 50_000
    values, texts = _arrow_readers()

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None  # one-row slice of the chunk being read
        idle_exit, message_exit = None, {}

        def flush():
            ways = [(True, None, idle_exit)]
            ways += [(False, message, left) for message, left in message_exit.items()]
            for lo in range(0, len(ways), n_rows):
                part = ways[lo : lo + n_rows]
                where = pa.array([0] * len(part))
                columns = [place.column(k).take(where) for k in at]
                columns.append(pa.array([w[0] for w in part], pa.bool_()))
                columns.append(pa.array([w[1] for w in part], pa.string()))
                columns.append(pa.array([w[2] is not None for w in part], pa.bool_()))
                for j, kind in enumerate((place.schema.field("time_ns").type, pa.int64(), pa.string())):
                    columns.append(pa.array([w[2] and w[2][j] for w in part], kind))
                names = [*at, "idle", "entry", "open", "time_ns", "ord", "message_id"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            rows_here = zip(
                values(batch.column("time_ns")),
                values(batch.column("ord")),
                values(batch.column("toggled")),
                texts(batch.column("message_id")),
                values(batch.column("first")),
            )
            for i, (time, ord_, toggled, message, first) in enumerate(rows_here):
                if first:
                    if place is not None:
                        yield from flush()
                    place = batch.slice(i, 1)
                    idle_exit, message_exit = None, {}
                if not toggled:
                    message_exit[message] = idle_exit
                elif message in message_exit:
                    idle_exit = message_exit[message]
                else:
                    idle_exit = (time, ord_, message)
        if place is not None:
            yield from flush()

    return rows.mapInArrow(exits, out)


def _carry_states(exits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Follow each group through its chunks. One row per chunk that is entered open, and one with
    NULL chunk for a start that stays open at the end of the group."""
    time = type_of(exits, "time_ns")
    fields = ", ".join(f"`{k}` {type_of(exits, k)}" for k in keys)
    by_group = Window.partitionBy(*keys).orderBy("chunk")
    rows = (
        exits.withColumn("first", F.row_number().over(by_group) == 1)
        .sortWithinPartitions(*keys, "chunk", F.col("first").desc())
        .select(*keys, "chunk", "idle", "entry", "open", "time_ns", "ord", "message_id", "first")
    )
    keys = list(keys)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = after = None  # open start on entering / leaving the current chunk
        place, chunk = None, None

        def emit(number):
            columns = [place.column(k).take(pa.array([0])) for k in keys]
            columns.append(pa.array([number], pa.int64()))
            kinds = (place.schema.field("time_ns").type, pa.int64(), pa.string())
            columns += [pa.array([value], kind) for value, kind in zip(state, kinds)]
            names = [*keys, "chunk", "time_ns", "ord", "message_id"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            names = ("chunk", "idle", "entry", "open", "time_ns", "ord", "message_id", "first")
            rows_here = zip(*(batch.column(name).to_pylist() for name in names))
            for i, (number, idle, entry, open_, time, ord_, message, first) in enumerate(rows_here):
                if first:
                    state = after
                    if place is not None and state is not None:
                        yield emit(None)
                    place, chunk, state, after = batch.slice(i, 1), number, None, None
                elif number != chunk:
                    chunk, state = number, after
                    if state is not None:
                        yield emit(number)
                if (idle and state is None) or (not idle and state is not None and state[2] == entry):
                    after = (time, ord_, message) if open_ else None
        state = after
        if place is not None and state is not None:
            yield emit(None)

    return rows.mapInArrow(carry, f"{fields}, chunk bigint, time_ns {time}, ord bigint, message_id string")
