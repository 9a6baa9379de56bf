"""Limits over event logs, as sequential folds: rate limits, lockouts, sessions, changes of stage.

All depend on their own earlier decisions (a rejected request isn't counted; a lock resets the counter; a session lives on by being
used), so they are no plain windows. A rule is a step from a small state and an event to the next state and an answer. Over a table, events are
dealt by key and sorted by time, and each task streams its events and keeps one key's state, which the rule bounds: a very active key
costs time but no memory. Over a stream the same steps run in a stateful processor, see streaming.stateful.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

State = tuple | None


def rate_step(limit: int, seconds: int) -> Callable[[State, int, bool], tuple[State, bool]]:
    """Whether a request is accepted: fewer than limit were in the last seconds. Rejected ones leave no trace. State: accepted times."""

    def step(state: State, now: int, ok: bool) -> tuple[State, bool]:
        times = [t for t in (state[0] if state else ()) if now - t <= seconds]
        accepted = len(times) < limit
        return ([*times, now] if accepted else times,), accepted

    return step


def lockout_step(failures: int, seconds: int) -> Callable[[State, int, bool | None], tuple[State, str]]:
    """ok, failed, locked (this failure locks) or refused (locked before). A lock resets the counter. State: failures, locked until. An
    attempt of an exempt account is None where it failed: it is answered but never counted."""

    def step(state: State, now: int, ok: bool | None) -> tuple[State, str]:
        failed, until = state or (0, 0)
        if now < until:
            return (failed, until), "refused"
        if ok:
            return (0, until), "ok"
        if ok is None:
            return (failed, until), "failed"
        if failed + 1 < failures:
            return (failed + 1, until), "failed"
        return (0, now + seconds), "locked"

    return step


def session_step(lifetime: int, touch: int = 60) -> Callable[[State, int, bool], tuple[State, str]]:
    """What a request meets: opened (ok: it signs in), none, expired (and ended), valid, or touched: valid, and kept alive from now on,
    which is noted once in `touch` seconds at most. State: last seen, expires."""

    def step(state: State, now: int, ok: bool) -> tuple[State, str]:
        if ok:
            return (now, now + lifetime), "opened"
        if state is None:
            return None, "none"
        seen, expires = state
        if expires < now:
            return None, "expired"
        return ((now, now + lifetime), "touched") if now - seen > touch else (state, "valid")

    return step


def stage_step() -> Callable[[State, int, str], tuple[State, str | None]]:
    """The stage before, where an invoice comes to wait at another one ('' for a new one); null where it doesn't, or waits no more."""

    def step(state: State, now: int, stage: str) -> tuple[State, str | None]:
        before = state[0] if state else ""
        return (stage,), before if stage not in ("done", before) else None

    return step


def fold(events: DataFrame, step, kind: str) -> DataFrame:
    """(key, event_id, value of the kind) of events (key, event_id, seconds, ok) under a rule; ties of time go by event_id."""
    key_type = events.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for b in batches:
            values = []
            for key, seconds, ok in zip(*(b.column(c).to_pylist() for c in ("key", "seconds", "ok")), strict=True):
                if key != last:
                    last, state = key, None
                state, value = step(state, seconds, ok)
                values.append(value)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("event_id"), pa.array(values, pa.bool_() if kind == "boolean" else pa.string())], ["key", "event_id", "value"])

    ordered = events.select("key", "event_id", "seconds", "ok").repartition("key").sortWithinPartitions("key", "seconds", "event_id")
    return ordered.mapInArrow(run, f"key {key_type}, event_id long, value {kind}")


def prepared(events: DataFrame) -> DataFrame:
    """user_id, event_id, seconds and ok of the standard events table."""
    return events.select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"), (F.col("event_type") != "error").alias("ok"))


def _by_user(events: DataFrame, step, kind: str, name: str) -> DataFrame:
    return fold(events.withColumnRenamed("user_id", "key"), step, kind).withColumnsRenamed({"key": "user_id", "value": name})


def rate_limit(events: DataFrame, limit: int = 40, seconds: int = 600) -> DataFrame:
    """user_id, event_id and whether the request is accepted."""
    return _by_user(events, rate_step(limit, seconds), "boolean", "accepted")


def lockout(events: DataFrame, failures: int = 5, seconds: int = 900) -> DataFrame:
    """user_id, event_id and outcome of attempts; those with a true column exempt, if there is one, don't count."""
    if "exempt" in events.columns:
        events = events.withColumn("ok", F.when(F.col("ok") | ~F.coalesce("exempt", F.lit(False)), F.col("ok")))
    return _by_user(events, lockout_step(failures, seconds), "string", "outcome")


def sessions(events: DataFrame, lifetime: int = 8 * 3600, touch: int = 60) -> DataFrame:
    """user_id, event_id and what the request meets; ok marks those that sign in."""
    return _by_user(events, session_step(lifetime, touch), "string", "session")


def usage_by_day(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls and cost by UTC day of an event stream; for readStream inputs, in append or update mode."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    by_day = timed.groupBy(F.window("at", "1 day")).agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("cost"))
    return by_day.select(F.col("window.start").cast("date").alias("day"), "calls", "cost")


def last_seen(stream: DataFrame) -> DataFrame:
    """The largest event of each user so far, of a stream or a table: it never falls."""
    return stream.groupBy("user_id").agg(F.max("event_id").alias("last_id"))
