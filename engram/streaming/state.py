"""Keyed state of the message streams, as stateful processors.

State lives in the store of the executors: single values, and a list that rows are appended to without reading it.
Event-time timers end what is idle, so no key stays for ever. Rows of a key in one micro-batch are
taken in time order; late ones beyond the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need a store with several columns; the default one has none."""
    if spark.conf.get(PROVIDER, "") != STORE:
        spark.conf.set(PROVIDER, STORE)


def with_state(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """A null key is a key like others."""
    use_state_store(stream.sparkSession)
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def micros(ts: pd.Series) -> np.ndarray:
    return ts.astype("datetime64[us]").astype("int64").to_numpy()


def in_order(rows: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(columns, kind="stable", ignore_index=True)


class _Idle(StatefulProcessor):
    """One timer per key, moved on whenever the key is seen."""

    def _wait(self, until_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            if timer == until_ms:
                return
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(until_ms)

    def close(self) -> None:
        pass


class Gate(_Idle):
    """``accepted``: at least ``interval`` microseconds after the last accepted row of the key."""

    def __init__(self, key: str, interval: int, keep_ms: int):
        self.key, self.interval, self.keep_ms = key, interval, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = in_order(rows, ["ts", "message_id"])
        times = micros(rows["ts"])
        last = self.last.get()[0] if self.last.exists() else None
        accepted = np.zeros(len(times), bool)
        at = 0 if last is None else int(np.searchsorted(times, last + self.interval))
        while at < len(times):  # from one accepted row to the next
            accepted[at], last = True, int(times[at])
            at = max(at + 1, int(np.searchsorted(times, last + self.interval)))
        if last is not None:
            self.last.update((last,))
            self._wait(max(last // 1000 + self.interval // 1000 + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield rows.assign(accepted=accepted)[[self.key, "message_id", "ts", "accepted"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()


class Counter(_Idle):
    """Place of a row in the window that its key has open; a window opens with the first row after the last one ended."""

    def __init__(self, key: str, interval: int, limit: int, keep_ms: int):
        self.key, self.interval, self.limit, self.keep_ms = key, interval, limit, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = in_order(rows, ["ts", "message_id"])
        times = micros(rows["ts"])
        start, n = self.window.get() if self.window.exists() else (None, 0)
        places = np.zeros(len(times), np.int64)
        at = 0
        while at < len(times):  # window by window
            if start is None or times[at] - start >= self.interval:
                start, n = int(times[at]), 0
            end = max(at + 1, int(np.searchsorted(times, start + self.interval)))
            places[at:end] = n + 1 + np.arange(end - at)
            n, at = int(places[end - 1]), end
        self.window.update((int(start), int(n)))
        self._wait(max(int(start) // 1000 + self.interval // 1000 + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield rows.assign(n_in_window=places, allowed=places <= self.limit)[[self.key, "message_id", "ts", "n_in_window", "allowed"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        yield from ()


SEGMENT = (
    "session_id string, segment bigint, summary string, narrative string, topics array<string>, importance_score double, valence double, "
    "arousal double, trajectory string, n_messages bigint, first_ts timestamp, last_ts timestamp"
)
_LINE = "line string, entities array<string>, intent string, valence double, arousal double, ts bigint"


class Segments(_Idle):
    """An episode per ``size`` rows; the open rest after ``idle_ms``, and the number is forgotten after ``keep_ms``."""

    def __init__(self, size: int, idle_ms: int, keep_ms: int):
        self.size, self.idle_ms, self.keep_ms = size, idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "segment bigint, n bigint, last bigint")
        self.lines = handle.getListState("lines", _LINE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = in_order(rows, ["ts", "seq"])
        segment, n, last = self.open.get() if self.open.exists() else (0, 0, 0)
        times = micros(rows["ts"])
        lines = [
            (line, list(names), intent, float(v), float(a), int(t))
            for line, names, intent, v, a, t in zip(rows["line"], rows["entities"], rows["intent"], rows["valence"], rows["arousal"], times, strict=True)
        ]
        done, at = [], 0
        while n + len(lines) - at >= self.size:
            held = [tuple(x) for x in self.lines.get()] if n else []
            done.append(self._episode(key[0], segment, held + lines[at : at + self.size - n]))
            if n:
                self.lines.clear()
            at, n, segment = at + self.size - n, 0, segment + 1
        if at < len(lines):
            self.lines.appendList(lines[at:])
            n += len(lines) - at
        last = max(int(last), int(times[-1]))
        self.open.update((segment, n, last))
        self._wait(max(last // 1000 + (self.idle_ms if n else self.keep_ms), timerValues.getCurrentWatermarkInMs() + 1))
        if done:
            yield pd.DataFrame(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        segment, n, last = self.open.get()
        if not n:
            self.open.clear()
            return
        yield pd.DataFrame([self._episode(key[0], segment, [tuple(x) for x in self.lines.get()])])
        self.lines.clear()
        # the number stays for a while, so that a session that goes on does not repeat one
        self.open.update((segment + 1, 0, last))
        self.handle.registerTimer(max(int(last) // 1000 + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1))

    @staticmethod
    def _episode(session, segment: int, lines: list[tuple]) -> dict:
        said, entities, intents, valence, arousal, times = zip(*lines, strict=True)
        names = list(dict.fromkeys(x for found in entities for x in found))
        v = sum(valence) / len(valence)
        return {
            "session_id": session, "segment": segment,
            "summary": f"Conversation segment: {', '.join(dict.fromkeys(intents))} | Entities: {', '.join(names[:5])}",
            "narrative": "\n".join(said)[:4000], "topics": names[:20], "importance_score": min(1.0, 0.3 + len(names) * 0.05),
            "valence": v, "arousal": sum(arousal) / len(arousal), "trajectory": "positive" if v > 0.3 else "negative" if v < -0.3 else "stable",
            "n_messages": len(lines), "first_ts": pd.Timestamp(min(times), unit="us"), "last_ts": pd.Timestamp(max(times), unit="us"),
        }
