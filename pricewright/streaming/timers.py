"""Streams whose results come from timers: trips that end by idling, and settlements that lapse.

The state of a key is a few numbers and one timer in event time. Rows of a batch are taken in order of time, and what a
timer would have done before a row is done first, so results don't hang on how events fall into batches. When a
timer fires or a key is settled, its state is dropped. Events later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def milliseconds(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class OneTimer(StatefulProcessor):
    """Keeps one tuple of numbers a key and a timer for it; subclasses say what an event does to them."""

    #: The state's fields, as a schema, and the columns of a result after the key.
    state_schema: str
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)

    def due(self, state: tuple) -> int:
        """When the timer of a state fires."""
        raise NotImplementedError

    def fired(self, state: tuple) -> tuple:
        """The result of the timer."""
        raise NotImplementedError

    def step(self, state: tuple | None, at: int, kind: str) -> tuple[tuple | None, tuple | None]:
        """The state after an event, and a result or None."""
        raise NotImplementedError

    def _frame(self, key: tuple, results: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in results], columns=["key", *self.columns])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = state = self.state.get() if self.state.exists() else None
        events = sorted(x for pdf in rows for x in zip(pdf["ts"].astype("datetime64[ms]").astype("int64").tolist(), pdf["order"].tolist(), pdf["kind"].tolist(), strict=True))
        results = []
        for at, _, kind in events:
            if state is not None and at > self.due(state):
                results.append(self.fired(state))
                state = None
            state, result = self.step(state, at, kind)
            if result is not None:
                results.append(result)
        if before is not None and (state is None or self.due(state) != self.due(before)):
            self.handle.deleteTimer(self.due(before))
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
            if before is None or self.due(state) != self.due(before):
                self.handle.registerTimer(self.due(state))
        yield self._frame(key, results)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        results = []
        if self.state.exists() and self.due(self.state.get()) <= expiredTimerInfo.getExpiryTimeInMs():
            results.append(self.fired(self.state.get()))
            self.state.clear()
        yield self._frame(key, results)

    def close(self) -> None:
        pass


class IdleTrips(OneTimer):
    """A trip ends after ``idle`` hours without an event, or ``idle_planned`` once a list belongs to it."""

    state_schema = "began long, last long, planned boolean, n long"
    columns = ["began", "ended", "planned", "n"]

    def __init__(self, idle: int = 48, idle_planned: int = 168):
        self.idle, self.idle_planned = idle * HOUR, idle_planned * HOUR

    def due(self, state):
        return state[1] + (self.idle_planned if state[2] else self.idle)

    def fired(self, state):
        return (state[0], state[1], state[2], state[3])

    def step(self, state, at, kind):
        began, last, planned, n = state or (at, at, False, 0)
        return (began, max(last, at), planned or kind == "list", n + 1), None


class LapsingSettlements(OneTimer):
    """A proposal is settled by the other side's answer, or lapses; while one is open no other is taken."""

    state_schema = "proposed long"
    columns = ["proposed", "outcome", "at"]

    def __init__(self, days: int = 7):
        self.period = days * 24 * HOUR

    def due(self, state):
        return state[0] + self.period

    def fired(self, state):
        return (state[0], "lapsed", state[0] + self.period)

    def step(self, state, at, kind):
        if state is None:
            return ((at,), None) if kind == "propose" else (None, None)
        if kind in ("confirm", "decline"):
            return None, (state[0], "confirmed" if kind == "confirm" else "declined", at)
        return state, None


IDLE_SCHEMA = "key long, began long, ended long, planned boolean, n long"
SETTLED_SCHEMA = "key long, proposed long, outcome string, at long"


def timed(events: DataFrame, processor: OneTimer, schema: str, delay: str = "1 hour") -> DataFrame:
    """Results of ``processor`` over a stream with key, ts (a timestamp), order (of equal times) and kind; times come in milliseconds."""
    rows = events.select("key", "ts", "order", "kind").withWatermark("ts", delay)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def with_timers(spark: SparkSession, run):
    """``run()`` under the state store that timers need; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return run()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def as_events(stream: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The feed's events of some types as key, ts, order and kind."""
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in kinds.items()))
    return stream.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("order"), kind.alias("kind")).where("kind IS NOT NULL AND key IS NOT NULL AND ts IS NOT NULL")
