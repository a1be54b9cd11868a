"""Stateful streams: reordering across sources, and sources that fall silent, with state and timers of transformWithState."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scalars import stream_id

REORDER_DELAY_MS, HEARTBEAT_MS, PEER_MS = 3_000, 60_000, 65_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_stateful(writer: DataStreamWriter, spark) -> StreamingQuery:  # noqa: ANN001
    """Start a stream of this module with the state store that its states need; the session's own setting stays as it is."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class _Reorder(StatefulProcessor):
    """Waiting messages by the time at which they arrived: an entry is written once, and removed when its timer goes off."""

    def __init__(self, delay_ms: int) -> None:
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "arrived bigint", "ms array<bigint>, seq array<bigint>, payload array<string>")
        self.released = handle.getValueState("released", "n bigint")

    def _out(self, lane: str, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            n = self.released.get()[0] if self.released.exists() else 0
            self.released.update((n + len(rows),))
            rows.sort(key=lambda r: r[:3])
            yield pd.DataFrame({"lane": lane, "ms": [r[0] for r in rows], "seq": [r[1] for r in rows], "payload": [r[3] for r in rows], "release": range(n, n + len(rows))})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        new = pd.concat(list(rows))
        columns = [new[c].tolist() for c in ("ms", "seq", "payload")]
        if self.delay_ms <= 0:
            yield from self._out(key[0], list(zip(*columns[:2], range(len(new)), columns[2], strict=True)))
        else:
            self.waiting.updateValue((now,), tuple(columns))
            self.handle.registerTimer(now + self.delay_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        due = sorted(k[0] for k in self.waiting.keys() if k[0] + self.delay_ms <= expiredTimerInfo.getExpiryTimeInMs())  # noqa: SIM118
        rows = []
        for arrived in due:
            ms, seq, payload = self.waiting.getValue((arrived,))
            rows += [(a, b, arrived, p) for a, b, p in zip(ms, seq, payload, strict=True)]
            self.waiting.removeKey((arrived,))
        yield from self._out(key[0], rows)

    def close(self) -> None:
        pass


def reorder(stream: DataFrame, lane: str, delay_ms: int = REORDER_DELAY_MS) -> DataFrame:
    """(lane, ms, seq, payload, release): each message of (stream_id, payload) is held for delay_ms and released in order of
    (ms, seq) with its place in the lane's order. Later ones are released out of order, never dropped.

    A lane is an ordered sequence, such as one object's messages: one task holds what a lane has waiting, so a stream as a
    whole must not be one. Across lanes, `reorder_batch` sorts what is released by ranges of the position. Timers go off
    between batches, also without new messages; start it by `start_stateful`.
    """
    position = stream_id("stream_id")
    own = stream.select(F.col(lane).cast("string").alias("lane"), position["ms"].alias("ms"), position["seq"].alias("seq"), F.col("payload").cast("string").alias("payload"))
    return own.groupBy("lane").transformWithStateInPandas(_Reorder(delay_ms), "lane string, ms bigint, seq bigint, payload string, release bigint", "append", "processingTime")


class _Heartbeats(StatefulProcessor):
    """A source's deadline; its timer is put off by every beat."""

    def __init__(self, silence_ms: int) -> None:
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deadline = handle.getValueState("deadline", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for _ in rows:
            pass
        at = timerValues.getCurrentProcessingTimeInMs() + self.silence_ms
        known = self.deadline.get() if self.deadline.exists() else None
        if known is not None:
            self.handle.deleteTimer(known[0])
        self.deadline.update((at,))
        self.handle.registerTimer(at)
        if known is None:
            yield pd.DataFrame({"source": [key[0]], "event": ["active"]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.deadline.clear()
        yield pd.DataFrame({"source": [key[0]], "event": ["lost"]})

    def close(self) -> None:
        pass


def heartbeats(stream: DataFrame, source: str = "source", silence_ms: int = HEARTBEAT_MS) -> DataFrame:
    """(source, event): active with the first beat and the first after a loss, lost after silence. Start it by `start_stateful`."""
    own = stream.select(F.col(source).cast("string").alias("source"))
    return own.groupBy("source").transformWithStateInPandas(_Heartbeats(silence_ms), "source string, event string", "append", "processingTime")


def silent_sources(beats: DataFrame, now_ms: int, silence_ms: int = PEER_MS) -> DataFrame:
    """The same for a table of (source, ms): sources whose last beat is too old."""
    return beats.groupBy("source").agg(F.max("ms").alias("last_ms")).filter(F.col("last_ms") + silence_ms < now_ms)


def reorder_batch(messages: DataFrame) -> DataFrame:
    """Messages of several streams in one order of position and arrival."""
    return messages.select("*", stream_id("stream_id").alias("at")).orderBy("at.ms", "at.seq", "arrival").drop("at")
