"""Texts in chunks whose last chunk may never come, or come late.

As ``match_chunks``, with event time: each chunk has a time, and a text for
which nothing has come for ``wait`` is closed once the watermark has passed that.
It is taken to end where it stands, so scans that are open there are settled, and
one row with a null pattern says what was missing.

State is kept in RocksDB, each kind by itself: how far a text has been read, its
open scans (few), and chunks that came before their turn, a key each - a chunk
that waits is written once and read once, however many others come meanwhile, and
one that comes in its turn is not written at all.
A closed or complete text leaves a mark; what comes for it afterwards is told as
late and not scanned.

Defined cases: a null chunk is empty; of chunks with one number the first counts;
a chunk with a number before the next one is told as late; a null time never
closes a text by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import sievewright
from sievewright.patterns import PatternSet
from sievewright.patterns.automaton import Table
from sievewright.shipping import ship

from .stream import _feed, run_to_table

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a row without pattern says.
MISSING, LATE = "missing", "late"


class ChunkScan(StatefulProcessor):
    def __init__(self, tables: list[Table], wait_ms: int):
        self.tables, self.wait_ms = tables, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.read = handle.getValueState("read", "at long, seq long, closed boolean")
        self.timer = handle.getValueState("timer", "at long")
        self.scans = handle.getListState("scans", "tab int, start long, state int")
        self.held = handle.getMapState("held", "seq long", "body string, is_last boolean")

    def _rows(self, key, found: list, told: list) -> pd.DataFrame:
        columns = {
            "key": [key[0]] * (len(found) + len(told)),
            "pattern_id": [m[0] for m in found] + [None] * len(told),
            "start_pos": [m[1] for m in found] + [p for _, p in told],
            "end_pos": [m[2] for m in found] + [None] * len(told),
            "told": [None] * len(found) + [t for t, _ in told],
        }
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.read.exists()
        at, want, closed = self.read.get() if known else (0, 0, False)
        waiting = known and not closed and self.held.exists()
        found, told, latest = [], [], None
        here: dict[int, tuple[str, bool]] = {}
        for f in rows:
            for seq, body, last, time in zip(f["seq"], f["text"], f["is_last"], f["time"], strict=True):
                seq = int(seq)
                if closed or seq < want or seq in here or waiting and self.held.containsKey((seq,)):
                    told.append((LATE, seq))
                    continue
                here[seq] = (body if isinstance(body, str) else "", bool(last))
                if pd.notna(time):
                    latest = max(latest or 0, int(pd.Timestamp(time).timestamp() * 1000))
        # what follows on one another is scanned at once
        bodies, last = [], closed
        while not last:
            if want in here:
                body, last = here.pop(want)
            elif waiting and self.held.containsKey((want,)):
                body, last = self.held.getValue((want,))
                self.held.removeKey((want,))
            else:
                break
            bodies.append(body)
            want += 1
        if bodies:
            had = known and self.scans.exists()
            body, closed = "".join(bodies), last
            left, found = _feed(self.tables, list(self.scans.get()) if had else [], body, at, last)
            at += len(body)
            if left:
                self.scans.put(left)
            elif had:
                self.scans.clear()
        if not closed:
            for seq, chunk in here.items():
                self.held.updateValue((seq,), chunk)
        if closed:
            self._close()
        elif latest is not None:
            self._wait(latest + self.wait_ms)
        self.read.update((at, want, closed))
        yield self._rows(key, found, told)

    def _wait(self, until: int) -> None:
        """One timer a text: the latest."""
        if self.timer.exists():
            (old,) = self.timer.get()
            if old >= until:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(until)
        self.timer.update((until,))

    def _close(self) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        self.scans.clear()
        self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, want, closed = self.read.get() if self.read.exists() else (0, 0, False)
        if closed:
            return
        _, found = _feed(self.tables, list(self.scans.get()) if self.scans.exists() else [], "", at, True)
        self.timer.clear()
        self._close()
        self.read.update((at, want, True))
        yield self._rows(key, found, [(MISSING, want)])

    def close(self) -> None:
        pass


def match_chunks_timed(chunks: DataFrame, patterns: PatternSet, wait: str, late: str = "0 seconds", key: str = "doc_id", seq: str = "seq", text: str = "text", last: str = "is_last", time: str = "time") -> DataFrame:
    """(key, pattern_id, start_pos, end_pos, told) of texts in chunks (seq from 0) with a time.

    ``wait``: how long after its latest chunk a text is closed, ``late``: how far times
    may be out of order, both as intervals.  A row without pattern has ``told``:
    ``missing`` (start_pos: the chunk that did not come) or ``late`` (the chunk that did).
    """
    ship(chunks.sparkSession)
    wait_ms = chunks.sparkSession.sql(f"select cast(unix_millis(timestamp_seconds(0) + interval {wait}) as long)").first()[0]
    kind = dict(chunks.dtypes)[key]
    rows = chunks.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), F.col(text).alias("text"), F.col(last).alias("is_last"), F.col(time).cast("timestamp").alias("time")).withWatermark("time", late)
    # the runner that starts the query on the driver doesn't get what is sent to executors
    cloudpickle.register_pickle_by_value(sievewright)
    try:
        out = rows.groupBy("key").transformWithStateInPandas(ChunkScan(patterns.tables(), wait_ms), f"key {kind}, pattern_id int, start_pos int, end_pos int, told string", "append", "eventTime")
    finally:
        cloudpickle.unregister_pickle_by_value(sievewright)
    return out.withColumnRenamed("key", key)


def run_timed_to_table(stream: DataFrame, name: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """``run_to_table`` with state in RocksDB."""
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        return run_to_table(stream, name, checkpoint, path)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
