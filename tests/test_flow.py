"""Flush timers, holds, the partition's clock and journals in the streaming processor."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keyfold.operators.timers import TimerPolicy
from keyfold.sources import segments, tables
from keyfold.streaming import engine, flow

AT = datetime(2020, 3, 1)
LOG = "topic string, partition int, offset long, timestamp timestamp, key string, value int"


def records(spark, rows):
    """(offset, minutes, key, value) in partition 0 of topic t."""
    return spark.createDataFrame([("t", 0, o, AT + timedelta(minutes=m), k, v) for o, m, k, v in rows], LOG)


#: Workers get it by value, for they do not know this module.
step = (lambda: lambda state, record: {"n": (state or {"n": 0})["n"] + record["value"]} if record["value"] else None)()


def polls(spark, tmp_path, batches, policy, **options):
    """The output rows of each poll, run one after another from one checkpoint; polls have records of (offset, minutes, key, value)."""
    out = []
    for n, rows in enumerate(batches):
        segments.append(records(spark, rows), f"file://{tmp_path}/log")
        stream = flow.flow_stream(segments.scan(spark, f"file://{tmp_path}/log", "t", streaming=True), step, ("value",), policy, segments=2, **options)
        got = []
        q = engine.start(stream, f"{tmp_path}/check", lambda df, _, got=got: got.extend(df.collect()))
        q.awaitTermination(120)
        assert q.exception() is None
        out.append(got)
    return out


def told(rows, *kinds):
    return sorted((r["kind"], r["key"], r["offset"], r["after"] and json.loads(r["after"])["n"], r["hold"]) for r in rows if r["kind"] in kinds)


def low(rows):
    """What may be committed after a poll."""
    holds = [r["hold"] for r in rows if r["kind"] == "hold"]
    assert len(holds) == 2  # both segments told theirs
    return min((h for h in holds if h is not None), default=max(r["offset"] for r in rows if r["kind"] == "hold"))


def test_periodic_flushes_move_the_hold(spark, tmp_path):
    """A key that gets one record is flushed once; each later minute moves its hold to the partition's offset, though only keyless records come."""
    policy = TimerPolicy(fire_every=60, persist_every=60)
    out = polls(spark, tmp_path, [[(100, 0, "k", 5)], [(101, 1, None, 1)], [(102, 2, None, 1)], [(103, 3, "k", 2)], [(104, 3.5, None, 1)], [(105, 5, "k", 0)]], policy)
    assert [told(rows, "flush", "unload", "gone") for rows in out] == [[], [("flush", "k", 100, 5, 102)], [], [("flush", "k", 103, 7, 104)], [], [("gone", "k", 105, None, None)]]
    assert [low(rows) for rows in out] == [100, 102, 103, 104, 104, 106]


def test_a_key_that_never_returns_is_unloaded(spark, tmp_path):
    """By offsets: nothing at a distance of three, a flush and the release of its hold at four. By time: not at ten minutes, but after."""
    out = polls(spark, tmp_path / "a", [[(1000, 0, "silent", 1)], [(1001, 1, "x", 1), (1002, 1, None, 1)], [(1003, 2, "x", 1)]], TimerPolicy(fire_every=0, max_behind=3))
    assert [told(rows, "flush", "unload") for rows in out] == [[], [], [("flush", "silent", 1000, 1, 1004), ("unload", "silent", 1000, 1, None)]]
    assert [low(rows) for rows in out] == [1000, 1000, 1001]
    out = polls(spark, tmp_path / "b", [[(0, 0, "silent", 1)], [(1, 10, "x", 1)], [(2, 10.1, "x", 1)]], TimerPolicy(fire_every=60, persist_every=60, max_idle=600, max_behind=1000))
    assert [told(rows, "flush", "unload") for rows in out] == [[], [("flush", "silent", 0, 1, 2)], []]
    # Its timer was registered again a minute later; at that time it has been idle for too long.
    out = polls(spark, tmp_path / "c", [[(0, 0, "silent", 1)], [(1, 5, None, 1)], [(2, 10.5, None, 1)]], TimerPolicy(fire_every=60, persist_every=60, max_idle=600))
    assert told(out[2], "flush", "unload") == [("unload", "silent", 0, 1, None)] and low(out[2]) == 3


def test_filtered_records_move_the_clock_and_redelivered_ones_change_nothing(spark, tmp_path):
    log = records(spark, [(1, 0, "a", 1), (2, 1, "a", 2), (2, 1, "a", 2), (3, 2, "b", 99), (4, 9, None, 1)])
    out = flow.flow_stream(log, step, ("value",), TimerPolicy(fire_every=60, persist_every=60), keep=F.col("value") < 50, segments=2).collect()
    assert told(out, "fold", "flush") == [("flush", "a", 2, 3, 5), ("fold", "a", 1, 1, None), ("fold", "a", 2, 3, None)]
    assert low(out) == 5


@pytest.mark.parametrize("journal", [False, True])
def test_a_new_query_goes_on_from_flushes_or_from_the_journal(spark, tmp_path, journal):
    """Two queries with checkpoints of their own, the second from what the first persisted and from the offsets that were safe, end where one would."""
    path = f"file://{tmp_path}/log"
    changelog = tables.Changelog(spark, f"file://{tmp_path}/states").create()
    table = tables.Table(spark, f"file://{tmp_path}/events", flow.FlowSink.JOURNAL, ("topic", "partition", "key", "offset")).create() if journal else None
    policy = TimerPolicy(fire_every=60, persist_every=120)
    parts = [
        [(0, 0, "a", 1), (1, 0, "b", 2), (2, 1, "ends", 3), (3, 3, "a", 10)],  # flushes a, b and "ends" at the partition's offset 4
        [(4, 3.1, "a", 100), (5, 3.2, "c", 7), (6, 3.3, "ends", 0)],  # a and c are not flushed again before the query stops
        [(7, 9, "b", 20), (8, 9, "c", 70)],
    ]
    offsets = []
    for generation, part in enumerate(parts[:2] + [None, parts[2]], 1):
        if part:
            segments.append(records(spark, part), path)
        sink = flow.FlowSink(changelog, generation, table, 2)
        started, at = sink.recover() if generation >= 3 else (None, {})
        check = f"{tmp_path}/check{max(generation, 2) if generation < 4 else 4}"
        stream = flow.flow_stream(segments.scan(spark, path, "t", start=at or None, streaming=True), step, ("value",), policy, segments=2, initial=started, journal=journal, steps=False)
        q = engine.start(stream, check, sink)
        q.awaitTermination(120)
        assert q.exception() is None
        offsets.append(changelog.offsets()["t-0"])
    assert offsets == [4, 4, 5, 9]  # a recovered key without a known time is flushed at once; c holds its first record
    assert {(r["key"], json.loads(r["value"])["n"]) for r in changelog.read().collect()} == {("a", 111), ("b", 22), ("c", 77)}
    if journal:
        assert sorted((r["key"], r["offset"]) for r in table.read().collect()) == [("a", 0), ("a", 3), ("a", 4), ("b", 1), ("b", 7), ("c", 5), ("c", 8)]


def test_stored_fold_runs_once_and_commits_past_filtered_and_keyless_records(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    segments.append(records(spark, [(o, o, "k" if o < 8 else None, o) for o in range(1, 13)] + [(13, 13, "other", 99)]), path)
    steps = spark.sparkContext.accumulator(0)

    def counted(state, record, steps=steps):
        steps.add(1)
        return (state or 0) + 1

    changelog = tables.Changelog(spark, f"file://{tmp_path}/states").create()
    loop = engine.StoredFold(changelog, 1)

    def run():
        stream = loop.stream(segments.scan(spark, path, "t", streaming=True), counted, (), keep=F.col("value") < 50)
        q = engine.start(stream, f"{tmp_path}/check", loop.sink)
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    assert changelog.offsets() == {"t-0": 14} and steps.value == 7
    assert [(r["key"], r["offset"], r["value"]) for r in changelog.read().collect()] == [("k", 7, "7")]
    segments.append(records(spark, [(14, 14, None, 1), (15, 15, "other", 99)]), path)  # nothing to fold, but offsets to commit
    run()
    assert changelog.offsets() == {"t-0": 16} and steps.value == 7


def test_a_state_that_outlives_its_time_is_gone(spark, tmp_path):
    import time

    path, out = f"file://{tmp_path}/log", f"{tmp_path}/out"
    segments.append(records(spark, [(0, 0, "k", 1), (1, 0, "k", 2)]), path)
    stream = engine.fold_stream(segments.scan(spark, path, "t", streaming=True), step, ("value",), ttl_ms=3000)
    q = engine.start(stream, f"{tmp_path}/check", engine.once_per_batch(out), every="0 seconds")
    try:
        for _ in range(600):
            if q.lastProgress and spark.read.schema(engine.OUTPUT).parquet(out).count() >= 2:
                break
            time.sleep(0.1)
        time.sleep(4)
        segments.append(records(spark, [(2, 0, "k", 40)]), path)
        for _ in range(600):
            if spark.read.schema(engine.OUTPUT).parquet(out).count() >= 3:
                break
            time.sleep(0.1)
    finally:
        q.stop()
    rows = sorted((r["offset"], r["before"], r["after"]) for r in spark.read.parquet(out).collect())
    assert rows == [(0, None, '{"n": 1}'), (1, '{"n": 1}', '{"n": 3}'), (2, None, '{"n": 40}')]
    with pytest.raises(ValueError):
        engine.KeyFold(step, (), idle_ms=1, ttl_ms=1)
