"""Request limits on a live stream: the decisions of ``admit``, each as soon as it is certain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomdex.functions.constants import REQUESTS_PER_MINUTE

#: The state store that keeps lists and timers.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Admission(StatefulProcessor):
    """First come, first served by (ts, id) within a key and window, whatever the order of arrival.

    The state of a key holds, for each of its windows that the watermark has not closed, at
    most ``limit`` requests that may still be pushed out by earlier ones, and how many have
    passed for good. What is pushed out is refused at once; a request passes when the
    watermark has reached it, at the latest when it reaches the end of the window, which also
    clears the window. A call for each key, not for each window, and one timer: the first end.
    """

    def __init__(self, limit: int, period_ms: int, id_type: str):
        self.limit, self.period_ms, self.id_type = limit, period_ms, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"window_us long, us long, id {self.id_type}")
        self.passed = handle.getListState("passed", "window_us long, n int")

    def decided(self, key, rows: list, admitted: bool) -> pd.DataFrame:
        return pd.DataFrame({"id": [r[2] for r in rows], "key": key[0], "window_us": [r[0] for r in rows], "admitted": admitted})

    def settle(self, key, new: list, timerValues) -> Iterator[pd.DataFrame]:
        """Decide what can be decided of the waiting and the ``new`` requests, and store the rest."""
        waited, counted = [tuple(r) for r in self.waiting.get()], [tuple(r) for r in self.passed.get()]
        watermark = timerValues.getCurrentWatermarkInMs()
        passed, waiting, left, refused, admitted = dict(counted), {}, [], [], []
        for row in sorted(waited + new):
            waiting.setdefault(row[0], []).append(row)
        for window, rows in waiting.items():
            room = self.limit - passed.get(window, 0)
            refused += rows[room:]
            closed = self.ends(window) <= watermark
            final = [r for r in rows[:room] if closed or r[1] <= watermark * 1000]
            admitted += final
            left += rows[len(final) : room]
            if final:
                passed[window] = passed.get(window, 0) + len(final)
        passed = {window: n for window, n in passed.items() if self.ends(window) > watermark}
        for state, before, after in ((self.waiting, waited, left), (self.passed, counted, list(passed.items()))):
            if after and after != before:
                state.put(after)
            elif before and not after:
                state.clear()
        # a window that let rows pass or keeps some is open: the first of them to end wakes the key again
        if passed or left:
            self.handle.registerTimer(min(self.ends(w) for w in {*passed, *(r[0] for r in left)}))
        if refused:
            yield self.decided(key, refused, False)
        if admitted:
            yield self.decided(key, admitted, True)

    def ends(self, window_us: int) -> int:
        return window_us // 1000 + self.period_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            new += zip(frame["window_us"].tolist(), frame["us"].tolist(), frame["id"].tolist())
        yield from self.settle(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settle(key, [], timerValues)

    def close(self) -> None:
        pass


def admit_stream(log: DataFrame, late: str = "10 minutes", period: str = "1 minute", limit: int = REQUESTS_PER_MINUTE) -> DataFrame:
    """``id, key, window_start, admitted`` of a stream ``log(id, key, ts)``: equal to ``admit`` of all rows not later than ``late``.

    Every row not too late gets one decision; refusals come at once, admissions
    when the watermark allows no earlier request any more. Sets the state store
    of the session to the one on disk that timers and lists need.
    """
    session = log.sparkSession
    session.conf.set(PROVIDER, ROCKS)
    types = {f.name: f.dataType.simpleString() for f in log.schema}
    span = session.range(1).select((F.expr(f"unix_micros(timestamp_micros(0) + interval {period})") / 1000).cast("long")).first()[0]
    window = F.unix_micros(F.window("ts", period)["start"])
    rows = log.withWatermark("ts", late).select("id", "key", "ts", F.unix_micros("ts").alias("us"), window.alias("window_us"))
    decided = rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Admission(limit, span, types["id"]),
        outputStructType=f"id {types['id']}, key {types['key']}, window_us long, admitted boolean",
        outputMode="Append", timeMode="EventTime",
    )
    return decided.select("id", "key", F.timestamp_micros("window_us").alias("window_start"), "admitted")
