"""State that ends: evidence put in order, and the latest state of keys in use, with timers on event time.

Rows may come in any order within ``late``. What the watermark has passed can't be preceded any more, so it is given out and
its state goes; a key that is idle loses its state too. State so grows with the rows of the last ``late`` or ``idle``,
not with the stream. Both need the RocksDB state store: ``use_state_store`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ordered(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then gives them out by time and id, with their place. A call to the state
    store costs far more than a row does: rows are held in parts that grow from ``LEAST`` to ``MOST`` rows, so a call's rows need few and the
    store's count still follows what is held; a key has one timer, at its first time."""

    LEAST, MOST = 2, 2048

    def __init__(self, by: Sequence[str]):
        self.by = list(by)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "part long", "ms array<long>, id array<long>, payload array<string>")
        self.place = handle.getValueState("place", "n long, parts long, due long")  # rows given out, parts held, and the timer's time

    def _hold(self, rows: Iterator[tuple], part: int) -> tuple[int, int | None]:
        """Adds parts from number ``part`` on: the number after them, and their first time."""
        size, first = self.LEAST, None
        while some := list(islice(rows, size)):
            ms, ids, payloads = map(list, zip(*some))
            self.held.updateValue((part,), (ms, ids, payloads))
            part, size, first = part + 1, min(2 * size, self.MOST), min(ms) if first is None else min(first, *ms)
        return part, first

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        place, parts, due = self.place.get() or (0, 0, None)
        upto, first = self._hold(((r["_ms"], r["_id"], r["_payload"]) for r in rows if r["_ms"] > passed or not passed), parts)  # what is earlier has been given out
        if first is not None:
            if due is None or first < due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(first)
                due = first
            self.place.update((place, upto, due))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        upto = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = {}
        for _, parts in sorted((tuple(k), tuple(v)) for k, v in self.held.iterator()):
            held.update(((ms, id_), payload) for ms, id_, payload in zip(*parts))  # of one id and time the last
        due = sorted(at for at in held if at[0] <= upto)
        place = (self.place.get() or (0,))[0]
        self.held.clear()
        parts, after = self._hold(((*at, payload) for at, payload in held.items() if at[0] > upto), 0)
        if after is not None:
            self.handle.registerTimer(after)
        self.place.update((place + len(due), parts, after))
        row = Row(*self.by, "_ms", "_id", "_payload", "place")
        return (row(*key, *at, held[at], i) for i, at in enumerate(due, place + 1))

    def close(self) -> None:
        pass


class Latest(StatefulProcessor):
    """A key's last row by time and id, given out when it changes; a key without rows for ``idle`` is forgotten."""

    def __init__(self, by: Sequence[str], idle_ms: int):
        self.by, self.idle_ms = list(by), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, id long, payload string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = tuple(self.last.get()) if self.last.exists() else None
        best = max([(r["_ms"], r["_id"], r["_payload"]) for r in rows] + ([old] if old else []), key=lambda x: x[:2])
        if best == old:
            return iter(())
        if old:
            self.handle.deleteTimer(old[0] + self.idle_ms)
        self.last.update(best)
        self.handle.registerTimer(best[0] + self.idle_ms)
        return iter([Row(**dict(zip(self.by, key)), _ms=best[0], _id=best[1], _payload=best[2])])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _keyed(events: DataFrame, by: Sequence[str], values: Sequence[str], id_col: str, late: str):
    rows = events.withWatermark("ts", late).select(*by, "ts", F.unix_millis("ts").alias("_ms"), F.col(id_col).cast("long").alias("_id"), F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("_payload"))
    return rows.groupBy(*by)


def _schema(events: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in names)


def _opened(rows: DataFrame, events: DataFrame, by: Sequence[str], values: Sequence[str], id_col: str, *more: str) -> DataFrame:
    own = F.from_json("_payload", _schema(events, values)).alias("_v")
    return rows.select(*by, F.timestamp_millis("_ms").alias("ts"), F.col("_id").alias(id_col), own, *more).select(*by, "ts", id_col, "_v.*", *more)


def ordered(events: DataFrame, by: Sequence[str], values: Sequence[str], id_col: str = "event_id", late: str = "1 hour") -> DataFrame:
    """``by, ts, id, values, place``: each key's rows once, in the order of time (to the millisecond) and id, numbered from 1. A row that comes later than ``late``
    behind the stream is left out; one id and time has one row. For append mode."""
    rows = _keyed(events, by, values, id_col, late).transformWithState(Ordered(by), f"{_schema(events, by)}, _ms long, _id long, _payload string, place long", "Append", "EventTime")
    return _opened(rows, events, by, values, id_col, "place")


def latest(events: DataFrame, by: Sequence[str], values: Sequence[str], id_col: str = "event_id", late: str = "1 hour", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """``by, ts, id, values``: a row each time that a key's last row changes. For update mode."""
    rows = _keyed(events, by, values, id_col, late).transformWithState(Latest(by, idle_ms), f"{_schema(events, by)}, _ms long, _id long, _payload string", "Update", "EventTime")
    return _opened(rows, events, by, values, id_col)
