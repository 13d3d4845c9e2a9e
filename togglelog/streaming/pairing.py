"""Pairing of a log that is still being written, as a stateful stream.

(device, event) groups are dealt to buckets, which share their state: the open start of each group, and the rows that
wait until no earlier row can come, a chunk for each batch. A call to the state store costs more than the work on a row,
so calls go by bucket and chunk. Rows are
worked on in (time_ns, ord) order once the watermark has passed them, which a timer tells, so rows that come late by no more than
the delay find their place, and the executions are those that `pair_executions` finds in the whole
log. Rows later than that are dropped by Spark before they get here.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from itertools import islice
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from togglelog.schema import normalise

# Parameter names of the processor are those Spark calls it with.
NS_IN_MS = 1_000_000
# A watermark starts at the epoch and leaves no row at or before it; counters of devices may start at 0.
SHIFT_MS = 1_000
# How many buckets share out the groups, and the rows of a chunk at most. Buckets are fixed for a stream's life.
BUCKETS = 1024
CHUNK_ROWS = 50_000
EXECUTION = (
    "device_id string, event string, start_ns long, end_ns long, duration_ns long, message_id string, start_ord long, end_ord long"
)
COLUMNS = [field.split()[0] for field in EXECUTION.split(", ")]
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_executions(log: DataFrame, delay: str, match_message: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """Executions of a streaming toggle log, as a streaming DataFrame in append mode.

    `delay` is how much later than the latest row so far a row may still come, such as '10 minutes'. A row
    without event or device takes no part, but its time moves the watermark on: such rows are heartbeats
    that let the last executions of a quiet log out. A start without an end waits in the state. The session needs a state store
    for this kind of state (`use_rocks_db`); `time_ns` must be LONG and more than a second before the epoch is too late.
    One task holds the waiting rows of one of the `buckets` at a time.
    """
    # No nulls but those of messages, as pandas makes doubles of longs with nulls: `kind` is -1 for a row that takes no part,
    # else 1 for a start, and 2 more where there is an ord.
    takes_part = F.col("device_id").isNotNull() & F.col("event").isNotNull() & F.col("toggled").isNotNull()
    kind = F.col("toggled").cast("int") + F.when(F.col("ord").isNotNull(), 2).otherwise(0)
    rows = normalise(log).where(F.col("time_ns").isNotNull()).select(
        F.pmod(F.xxhash64("device_id", "event"), F.lit(buckets)).alias("bucket"),
        F.coalesce("device_id", F.lit("")).alias("device_id"),
        F.coalesce("event", F.lit("")).alias("event"),
        "time_ns",
        F.coalesce("ord", F.lit(0).cast("long")).alias("ord"),
        F.when(takes_part, kind).otherwise(-1).alias("kind"),
        "message_id",
    )
    at = F.timestamp_micros(F.expr(f"time_ns div 1000 + {SHIFT_MS * 1000}"))
    return (
        rows.withColumn("at", at)
        .withWatermark("at", delay)
        .groupBy("bucket")
        .transformWithStateInPandas(PairingProcessor(match_message), EXECUTION, "Append", "EventTime")
    )


def use_rocks_db(spark) -> None:
    """Let the session keep streaming state in the store that this state needs."""
    spark.conf.set(STATE_STORE, ROCKS_DB)


class PairingProcessor(StatefulProcessor):
    def __init__(self, match_message: bool):
        self.match = match_message

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # (device, event): time, ord and message of the open start
        self.open = handle.getValueState("open", "data binary")
        # (device, event, time, ord, toggled, message) of each waiting row
        self.waiting = handle.getMapState("waiting", "chunk long", "data binary")
        # the timer, the next chunk's number, and of each chunk the first time
        self.head = handle.getValueState("head", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = (row for frame in rows for row in _taking_part(frame))
        head = None
        while chunk := list(islice(new, CHUNK_ROWS)):
            head = self._kept(head or _loaded(self.head, (None, 0, {})), chunk)
        if head:
            self._wake(head)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        border = (timerValues.getCurrentWatermarkInMs() - SHIFT_MS) * NS_IN_MS
        _, number, firsts = _loaded(self.head, (None, 0, {}))
        head, ready = (None, number, firsts), []
        for chunk in sorted(k for k, first in firsts.items() if first < border):
            rows = pickle.loads(self.waiting.getValue((chunk,))[0])
            ready += [r for r in rows if r[2] < border]
            later = [r for r in rows if r[2] >= border]
            if later:
                self.waiting.updateValue((chunk,), (pickle.dumps(later),))
                firsts[chunk] = min(r[2] for r in later)
            else:
                self.waiting.removeKey((chunk,))
                del firsts[chunk]
        self._wake(head)
        starts = _loaded(self.open, {})
        ready.sort(key=lambda r: (r[2], r[3] is not None, r[3]))
        found = []
        for device, event, time_ns, ord_, toggled, message in ready:
            start = starts.get((device, event))
            if toggled:
                if start is None:
                    starts[device, event] = (time_ns, ord_, message)
            elif start is not None and (not self.match or start[2] == message):
                del starts[device, event]
                found.append((device, event, start[0], time_ns, time_ns - start[0], start[2], start[1], ord_))
        self.open.update((pickle.dumps(starts),))
        for at in range(0, len(found), CHUNK_ROWS):
            yield pd.DataFrame(found[at : at + CHUNK_ROWS], columns=COLUMNS, dtype=object)

    def _kept(self, head: tuple, rows: list[tuple]) -> tuple:
        timer, number, firsts = head
        self.waiting.updateValue((number,), (pickle.dumps(rows),))
        return timer, number + 1, firsts | {number: min(r[2] for r in rows)}

    def _wake(self, head: tuple) -> None:
        """One timer for a bucket: when the watermark has passed its first waiting row."""
        timer, number, firsts = head
        at_ms = min(firsts.values()) // NS_IN_MS + 1 + SHIFT_MS if firsts else None
        if at_ms != timer and at_ms is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at_ms)
        self.head.update((pickle.dumps((at_ms, number, firsts)),))

    def close(self) -> None:
        pass


def _taking_part(frame: pd.DataFrame) -> Iterator[tuple]:
    columns = (frame[c].tolist() for c in ("device_id", "event", "time_ns", "ord", "kind", "message_id"))
    for device, event, time_ns, ord_, kind, message in zip(*columns):
        if kind >= 0:
            yield device, event, time_ns, ord_ if kind & 2 else None, bool(kind & 1), message


def _loaded(state, default: Any) -> Any:
    found = state.get()
    return default if found is None else pickle.loads(found[0])


# The processor's code travels to the executors with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
