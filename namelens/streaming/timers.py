"""Timers: a keyed stream operator that gives a candidate when its next check is due.

Each domain has its newest schedule in the state.  A row for a domain replaces its schedule; one that
retires or clears the candidate takes it off the list.  A due candidate is given once, and not again before
a newer row schedules it anew.  The rows given are those that ``ranking.due`` finds in the table at that time.

Domains are dealt by hash into ``BUCKETS`` keys.  A key's schedules are one Arrow table in its state, and its timer
stands at the earliest time that one of them is due: a batch reads and writes the buckets of its domains once each, all
their rows at a time, and a timer gives all of its bucket that are due by then.  State is kept in RocksDB (``STORE``),
so it can be larger than an executor's memory; a task holds one bucket at a time.  Choose as many buckets
as the state has times 1 MB or so (a schedule has some 60 bytes); a checkpoint is bound to their number.

Defined results: a null domain, or a schedule without a time, is never due; of rows of a domain with one
version the latest time counts; repeated and older rows change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The setting of a session whose queries keep timers.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Keys that domains are dealt into.
BUCKETS = 1024
#: A bucket's schedules; given: the candidate was told already.
SCHEDULE = pa.schema({"domain": pa.string(), "version": pa.int64(), "due_ms": pa.int64(), "live": pa.bool_(), "id": pa.string(), "given": pa.bool_()})
DUE = "domain string, id string, due_at timestamp"


@contextmanager
def stores(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB; the session's own setting comes back after."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Rechecks(StatefulProcessor):
    def __init__(self, clock: str) -> None:
        self.clock = clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.schedules = handle.getValueState("schedules", "rows binary")

    def _held(self) -> pd.DataFrame:
        held = self.schedules.get() if self.schedules.exists() else None
        return SCHEDULE.empty_table().to_pandas() if held is None else pa.ipc.open_stream(bytes(held[0])).read_all().to_pandas()

    def _hold(self, rows: pd.DataFrame) -> None:
        """Keep the rows, and one timer at the first time that one of them is due."""
        table, sink = pa.Table.from_pandas(rows, SCHEDULE, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, SCHEDULE) as out:
            out.write_table(table)
        self.schedules.update((sink.getvalue().to_pybytes(),))
        waiting = rows.loc[rows["live"] & ~rows["given"], "due_ms"]
        wanted = {int(waiting.min())} if len(waiting) else set()
        timers = set(self.handle.listTimers())
        for timer in timers - wanted:
            self.handle.deleteTimer(timer)
        for timer in wanted - timers:
            self.handle.registerTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        new = [part[["domain", "version", "due_ms", "live", "id"]].assign(given=False) for part in rows]
        every = pd.concat([held, *new] if len(held) else new, ignore_index=True)
        # held rows come first, so that of equal ones they stay
        best = every.sort_values(["version", "due_ms"], ascending=False, kind="stable").drop_duplicates("domain")
        if (best.index >= len(held)).any():
            self._hold(best.astype({"live": bool, "given": bool}))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() if self.clock == "EventTime" else timerValues.getCurrentProcessingTimeInMs()
        rows = self._held()
        due = rows["live"] & ~rows["given"] & (rows["due_ms"] <= max(now, expiredTimerInfo.getExpiryTimeInMs()))
        if due.any():
            told = rows[due]
            yield pd.DataFrame({"domain": told["domain"], "id": told["id"], "due_at": pd.to_datetime(told["due_ms"], unit="ms", utc=True)})
        self._hold(rows.assign(given=rows["given"] | due))

    def close(self) -> None:
        pass


def schedules(candidates: DataFrame, version: Column) -> DataFrame:
    """What ``due_rows`` takes of a stream of candidates (domain, id, status, publish_state, next_recheck_at); version: later rows have larger ones."""
    live = (F.col("status") != "retired") & (F.col("publish_state") != "cleared")
    rows = candidates.select("domain", F.col("id").cast("string").alias("id"), F.unix_millis("next_recheck_at").alias("due_ms"), F.coalesce(live, F.lit(False)).alias("live"), version.cast("long").alias("version"), "next_recheck_at")
    return rows.where("domain IS NOT NULL AND due_ms IS NOT NULL AND version IS NOT NULL")


def due_rows(schedule: DataFrame, clock: str = "ProcessingTime", buckets: int = BUCKETS) -> DataFrame:
    """A stream of due candidates (DUE) from a stream of ``schedules``.

    clock: ProcessingTime, or EventTime for a stream with a watermark, whose timers then follow the watermark.
    """
    dealt = schedule.withColumn("bucket", F.pmod(F.xxhash64("domain"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(Rechecks(clock), DUE, "append", clock)
