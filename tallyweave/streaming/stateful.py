"""The rules of streaming.limits over event streams, as stateful processors.

Each key's state is one value of the RocksDB state store, so it survives a restart from the checkpoint and moves with its partition. A micro-batch's
events of a key are sorted before they are stepped through. A timer at the event time from which a state says nothing any more clears it,
so keys that fall silent cost nothing; clearing changes no answer. Events later than the watermark's delay are dropped by Spark; without an
event-time column (timers=False) none are.

Sessions must set spark.sql.streaming.stateStore.providerClass to Spark's RocksDBStateStoreProvider.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyweave.streaming import limits

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rule(StatefulProcessor):
    """A step over the events of a key, in order of time; spent(state) is the second from which its state is as good as none."""

    def __init__(self, step: Callable, spent: Callable[[tuple], int] | None) -> None:
        self.step, self.spent = step, spent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["seconds", "event_id"], kind="stable")
        state = tuple(json.loads(self.state.get()[0])) if self.state.exists() else None
        values = []
        for seconds, ok in zip(events["seconds"].tolist(), events["ok"].tolist(), strict=True):
            state, value = self.step(state, seconds, ok)
            values.append(value)
        if state is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(state),))
            if self.spent is not None:
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at)
                self.handle.registerTimer(max(self.spent(state), 1) * 1000)
        yield pd.DataFrame({"key": key[0], "event_id": events["event_id"].to_numpy(), "value": values})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def applied(stream: DataFrame, step: Callable, spent: Callable[[tuple], int] | None, kind: str, late: str | None = None) -> DataFrame:
    """(key, event_id, value) of a stream of (key, event_id, seconds, ok). late: how far behind events may be; with it, spent states are cleared."""
    events = stream.select("key", "event_id", "seconds", "ok")
    if late is None:
        spent = None
    else:
        events = events.withColumn("at", F.timestamp_seconds("seconds")).withWatermark("at", late)
    key = stream.schema["key"].dataType.simpleString()
    return events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Rule(step, spent), outputStructType=f"key {key}, event_id long, value {kind}", outputMode="Append", timeMode="None" if late is None else "EventTime"
    )


def rate_limit(stream: DataFrame, limit: int = 40, seconds: int = 600, late: str | None = None) -> DataFrame:
    """Whether each request is accepted."""
    return applied(stream, limits.rate_step(limit, seconds), lambda s: max(s[0], default=0) + seconds + 1, "boolean", late)


def lockout(stream: DataFrame, failures: int = 5, seconds: int = 900, late: str | None = None) -> DataFrame:
    """The outcome of each attempt. A counter of failures has no end, so only states without one are cleared."""
    forever = 2**40
    return applied(stream, limits.lockout_step(failures, seconds), lambda s: forever if s[0] else s[1], "string", late)


def sessions(stream: DataFrame, lifetime: int = 8 * 3600, touch: int = 60) -> DataFrame:
    """What each request meets. An expired session must be told from none, so its state stays until the next request."""
    return applied(stream, limits.session_step(lifetime, touch), None, "string")


def stage_changes(stream: DataFrame) -> DataFrame:
    """The stage before, of each event after which an invoice waits at another stage; ok holds the stage."""
    return applied(stream, limits.stage_step(), None, "string").filter("value IS NOT NULL")
