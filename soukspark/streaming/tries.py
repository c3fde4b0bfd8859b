"""Attempts at a product's page: what is sent once, and what is given up after so many tries.

An attempt comes with a payload or without one. The first payload of a session's item is sent, and nothing after it. An
attempt without one counts if the page was visible; the third such is sent as ``unloaded``, and nothing after it either.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TRIES = 3
ATTEMPT = "worker_id string, item_id string, ms long, seq long, visible boolean, payload string"
OUT = "worker_id string, item_id string, ms long, seq long, payload string, unloaded boolean"
KEY = ["worker_id", "item_id"]
#: Milliseconds that event time is ahead of attempts' own: Spark drops what is not after time zero as late.
AHEAD = 1 << 45
_Out = Row(*[c.split()[0] for c in OUT.split(", ")])


class Tries(StatefulProcessor):
    """Of each session and item whether it was sent, and how many empty attempts counted. Both are forgotten once no
    attempt has changed them for ``hours``, as a session's memory is; timers do that by the attempts' own time."""

    def __init__(self, tries: int = TRIES, hours: int = 24):
        self.tries, self.ttl = tries, hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "sent boolean, n int, ends long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        sent, n, ends = self.seen.get() if self.seen.exists() else (False, 0, None)
        before = ends
        for r in sorted(rows, key=lambda r: (r["ms"], r["seq"])):
            if sent:
                break
            counts = r["payload"] is None and bool(r["visible"])
            n += counts
            if counts or r["payload"] is not None:
                ends = r["ms"] + self.ttl
            if r["payload"] is not None or n >= self.tries:
                sent, n = True, 0
                yield _Out(*key, r["ms"], r["seq"], r["payload"], r["payload"] is None)
        if ends != before:
            if before is not None:
                self.handle.deleteTimer(before + AHEAD)
            self.handle.registerTimer(ends + AHEAD)
            self.seen.update((sent, n, ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def streamed(attempts: DataFrame, tries: int = TRIES, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """``OUT`` for a stream of ``ATTEMPT``: at most one row for each session and item, until it is forgotten. Attempts of one
    batch count in the order of their time; those of a later batch after them. Needs RocksDB as state store
    (``claims.use_store``)."""
    rows = attempts.withColumn("ts", F.timestamp_millis(F.col("ms") + AHEAD)).withWatermark("ts", late)
    return rows.groupBy(*KEY).transformWithState(Tries(tries, hours), OUT, "append", "eventTime")


def sent(attempts: DataFrame, tries: int = TRIES) -> DataFrame:
    """The same for a table: of each session and item the first attempt with a payload or the third that counts, whichever
    is earlier."""
    order = Window.partitionBy(*KEY).orderBy("ms", "seq")
    counts = F.col("payload").isNull() & F.coalesce("visible", F.lit(False))
    rows = attempts.withColumn("_n", F.count_if(counts).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.col("payload").isNotNull() | counts & (F.col("_n") >= tries)
    first = F.min(F.struct("ms", "seq", "payload"))
    return rows.where(last).groupBy(*KEY).agg(first.alias("r")).select(*KEY, "r.*", F.col("r.payload").isNull().alias("unloaded"))
