"""Rules over streams: a replayed stream equals the fold over the table, over many micro-batches and over a restart."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.streaming import limits, replay, stateful

KIND = "key long, event_id long, seconds long, ok boolean"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Events in four files, in order of time, with ties, hot keys and keys that fall silent."""
    rng, now, files = random.Random(6), 1_000_000, []
    folder = str(tmp_path_factory.mktemp("log"))
    events = []
    for k in range(900):
        now += rng.choice([0, 0, 1, 5, 30, 200])
        events.append((rng.choice([1, 1, 1, 2, 3, 4 + k // 200]), k, now, rng.choice([True, False, False, None])))
    for at in range(0, 900, 225):
        spark.createDataFrame(events[at : at + 225], KIND).coalesce(1).write.parquet(f"{folder}/{at:04d}")
        files.append(f"{folder}/{at:04d}")
    return files, spark.createDataFrame(events, KIND)


def fed(spark, files, into, rule, tmp_path):
    """Copies of the files arrive one after another; every part of the stream starts anew from the checkpoint."""
    import shutil
    from pathlib import Path

    inbox = tmp_path / "in"
    inbox.mkdir()
    for k, f in enumerate(files):
        for p in Path(f).glob("*.parquet"):
            shutil.copy(p, inbox / f"{k}-{p.name}")
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(inbox))
        done = replay.drained(rule(stream), str(tmp_path / into))
    return {r.event_id: r.value for r in done.collect()}


@pytest.mark.parametrize("late", [None, "1 day", "1 second"])
def test_rate_limit_equals_the_fold(spark, log, tmp_path, late):
    files, events = log
    want = {r.event_id: r.value for r in limits.fold(events, limits.rate_step(3, 60), "boolean").collect()}
    assert fed(spark, files, "rate", lambda s: stateful.rate_limit(s, 3, 60, late), tmp_path) == want
    assert 100 < sum(want.values()) < 800


@pytest.mark.parametrize("late", [None, "1 second"])
def test_lockout_equals_the_fold(spark, log, tmp_path, late):
    files, events = log
    want = {r.event_id: r.value for r in limits.fold(events, limits.lockout_step(3, 120), "string").collect()}
    assert fed(spark, files, "lock", lambda s: stateful.lockout(s, 3, 120, late), tmp_path) == want
    assert set(want.values()) == {"ok", "failed", "locked", "refused"}


def test_sessions_and_stages_equal_the_fold(spark, log, tmp_path):
    files, events = log
    signed = events.withColumn("ok", F.coalesce("ok", F.lit(False)) & (F.col("event_id") % 9 == 0))
    want = {r.event_id: r.value for r in limits.fold(signed, limits.session_step(400, 60), "string").collect()}
    rule = lambda s: stateful.sessions(s.withColumn("ok", F.coalesce("ok", F.lit(False)) & (F.col("event_id") % 9 == 0)), 400, 60)
    assert fed(spark, files, "session", rule, tmp_path) == want
    assert set(want.values()) == {"opened", "none", "expired", "valid", "touched"}


def test_changes_of_stage(spark, tmp_path):
    rows = [(1, 1, 10, "ap_review"), (1, 2, 20, "ap_review"), (1, 3, 30, "approval"), (2, 4, 5, "done"), (2, 5, 6, "approval"), (1, 6, 40, "done"), (1, 7, 50, "approval")]
    kind = "key long, event_id long, seconds long, ok string"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in"))
    done = replay.drained(stateful.stage_changes(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))), str(tmp_path / "out"))
    folded = limits.fold(spark.createDataFrame(rows, kind), limits.stage_step(), "string").filter("value IS NOT NULL")
    assert {r.event_id: r.value for r in folded.collect()} == {1: "", 3: "ap_review", 5: "done", 7: "done"}
    assert {r.event_id for r in done.collect()} >= {1, 5}


def test_last_seen_never_falls(spark, log):
    assert {r.user_id: r.last_id for r in limits.last_seen(log[1].withColumnRenamed("key", "user_id")).collect()} == {
        k: m for k, m in log[1].groupBy("key").agg(F.max("event_id")).collect()
    }
