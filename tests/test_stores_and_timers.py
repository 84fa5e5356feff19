"""Writers that die or meet, the whole loop over restarts, and the timer policies."""

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keyfold.functions.scalar import Compressor, java_hash
from keyfold.operators import callables, commit, timers
from keyfold.operators.timers import At, TimerPolicy
from keyfold.sources import memory, tables
from keyfold.sources.log import read_log
from keyfold.streaming import engine
from keyfold.streaming.metrics import NAMES, MeasuredCompressor, Metrics, ProgressMetrics, measured_stores

ROW = "key string, value string"


def make(spark, path):
    t = tables.Table(spark, str(path), ROW, ("key",)).create()
    return t, lambda *rows: spark.createDataFrame(list(rows), ROW)


def rows(t):
    return sorted(tuple(r) for r in t.read().collect())


def test_a_writer_that_dies_leaves_the_table(spark, tmp_path):
    t, df = make(spark, tmp_path / "t")
    t.upsert(df(("a", "1")))
    fs, p = t._fs(f"{t.path}/pointers/{t._pointers()[-1] + 1:012d}")
    fs.create(p, False).close()  # it died between creating its pointer and writing it
    t._write(df(("a", "lost")))  # or before
    assert rows(t) == [("a", "1")]
    t.upsert(df(("b", "2")))
    assert rows(t) == [("a", "1"), ("b", "2")]


def test_two_writers_lose_no_row(spark, tmp_path):
    t, df = make(spark, tmp_path / "t")
    other = tables.Table(spark, str(tmp_path / "t"), ROW, ("key",))
    write, once = t._write, []

    def slow(*a, **k):
        name = write(*a, **k)
        if not once:
            once.append(1)
            other.upsert(df(("b", "theirs")))
        return name

    t._write = slow
    t.upsert(df(("a", "ours")))
    point, again = t._point, []

    def late(number, base, content):
        if not again:
            again.append(1)
            other.upsert(df(("c", "theirs")))  # between reading the state and creating the pointer
        return point(number, base, content)

    t._point = late
    t.upsert(df(("d", "ours")))
    assert rows(t) == [("a", "ours"), ("b", "theirs"), ("c", "theirs"), ("d", "ours")]


def test_folders_are_merged_and_removed(spark, tmp_path):
    t, df = make(spark, tmp_path / "t")
    for k in range(tables.COMPACT + 2):
        t.upsert(df(("a", str(k)), (f"k{k}", "x")))
    t.delete(df(("k1", "")).select("key"))
    assert len(t._state()[1]["folders"]) < tables.COMPACT
    want = sorted([("a", str(tables.COMPACT + 1)), *[(f"k{k}", "x") for k in range(tables.COMPACT + 2) if k != 1]])
    assert rows(t) == want and t.vacuum() > 0 and rows(t) == want


def test_changelog_fences_and_keeps_offsets_with_rows(spark, tmp_path):
    log = tables.Changelog(spark, str(tmp_path / "c")).create()
    writes = lambda *r: spark.createDataFrame([("t", 0, *x) for x in r], "topic string, partition int, key string, offset long, value string")
    log.commit(writes(("k", 1, "e1"), ("k", 5, "e5"), ("gone", 2, "x")), 1, {"t-0": 6})
    log.commit(writes(("k", 10, "e10"), ("gone", 7, None)), 2, {"t-0": 11, "t-1": 3})
    with pytest.raises(tables.Fenced):
        log.commit(writes(("k", 5, "e5")), 1, {"t-0": 6})
    assert [(r.key, r.offset, r.value) for r in log.read().collect()] == [("k", 10, "e10")] and log.offsets() == {"t-0": 11, "t-1": 3}


def test_fold_persist_commit_recover(spark, tmp_path):
    """A query that stops, and one with a new checkpoint that goes on from the stores, end where one run would; a batch that is repeated changes nothing."""
    schema = "topic string, partition int, offset long, timestamp timestamp, key string, value int"
    at = datetime(2020, 3, 1)
    drop = lambda r: spark.createDataFrame([("t", 0, o, at + timedelta(minutes=o), k, v) for o, k, v in r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    step = lambda s, r: {"n": (s or {"n": 0})["n"] + r["value"]} if r["value"] else None
    changelog = tables.Changelog(spark, str(tmp_path / "states")).create()
    drop([(0, "a", 1), (1, "b", 2), (2, "a", 3)])
    for generation, more in ((1, [(3, "a", 10), (4, "b", 0), (5, "c", 7)]), (2, None)):
        loop = engine.StoredFold(changelog, generation)
        states, _ = loop.recover(spark.createDataFrame([], schema))
        stored = spark.createDataFrame(states.select("topic", "partition", "key", "offset", "value").collect(), "topic string, partition int, key string, offset long, value string")
        log = loop.recover(read_log(spark, "parquet", ["t"], True, schema, path=str(tmp_path / "in")))[1]
        kept = []

        def sink(df, batch_id, loop=loop, kept=kept):
            kept.append(batch_id)
            loop.sink(df, batch_id)
            loop.sink(df, batch_id)

        q = engine.start(engine.fold_stream(log, step, ("value",), initial=stored if generation > 1 else None), str(tmp_path / f"check{generation}"), sink)
        q.awaitTermination(120)
        assert q.exception() is None and kept
        if more:
            assert changelog.offsets() == {"t-0": 3}
            drop(more)
    assert {(r.key, json.loads(r.value)["n"]) for r in changelog.read().collect()} == {("a", 14), ("c", 7)} and changelog.offsets() == {"t-0": 6}


def test_timer_policies():
    flushes = []
    flush = lambda: flushes.append(1)
    for policy in (TimerPolicy(persist_every=60), TimerPolicy(persist_every=60, max_idle=600, max_behind=100_000)):
        flushes.clear()
        key = policy.begin(At(0, 100))
        assert key.hold == 100 and [policy.fire(key, At(60 * k, 100 + k), flush) for k in (1, 2, 3)] == [True] * 3
        assert len(flushes) == 3 and key.hold == 103 and key.next_fire == 240
    far = TimerPolicy(max_behind=3)
    flushes.clear()
    key = far.begin(At(0, 1000))
    assert far.fire(key, At(60, 1003), flush) and not flushes and key.next_fire == 60  # from its last touch
    assert not far.fire(key, At(120, 1004), flush) and len(flushes) == 1 and key.removed and key.hold is None
    idle = TimerPolicy(max_idle=600)
    key = idle.begin(At(0, 5), persisted=At(0, 3))  # recovered, and silent since
    assert key.hold == 3 and idle.fire(key, At(600, 6), flush) and not idle.fire(key, At(601, 6), flush)

    def fail():
        raise OSError

    lenient = TimerPolicy(persist_every=60, max_idle=600, ignore_errors=True, flush_on_revoke=True)
    key = lenient.begin(At(0, 100))
    assert lenient.fire(key, At(1000, 200), fail) and key.hold == 100 and not key.removed and len(key.errors) == 1
    assert not lenient.revoke(key, At(1001, 200), fail) and lenient.revoke(key, At(1002, 200), flush) and key.removed
    with pytest.raises(OSError):
        TimerPolicy(persist_every=60).fire(lenient.begin(At(0, 1)), At(60, 2), fail)
    assert not TimerPolicy().revoke(lenient.begin(At(0, 1)), At(1, 1), flush)


def test_failed_write_forgets_nothing():
    m = callables.KeyMemory()
    m.journal.append("r")
    m.remember("s")

    def fail(out):
        raise OSError

    with pytest.raises(OSError):
        m.flush(fail)
    assert m.dirty and m.journal == ["r"]
    seen = []
    m.flush(seen.append)
    assert seen == [{"key": True, "journal": ["r"], "snapshot": "s"}] and not m.dirty and not m.journal


def test_orphans_and_holds(spark):
    t = lambda h: datetime(2020, 3, 1) + timedelta(hours=h)
    log = spark.createDataFrame([("t", 0, 100, t(0), "a", 1), ("t", 0, 101, t(1), "b", 2), ("t", 0, 102, t(96), "b", 3), ("t", 1, 5, t(0), "c", 4)], "topic string, partition int, offset long, timestamp timestamp, key string, value int")
    assert {(r.key, r.offset, r.next_timestamp) for r in timers.idle_unloads(log, "6 hours").collect()} == {("a", 100, None), ("b", 101, t(96))}
    assert {(r.key, r.behind) for r in timers.distance_unloads(log, 2).collect()} == {("a", 3)}
    day = {(r.key, r.offset, r.hold) for r in timers.periodic_persists(log, "day", "value").collect()}
    assert day == {("a", 100, 102), ("b", 101, 102), ("b", 102, 103), ("c", 5, 6)}


def test_places_in_a_partition(spark):
    log = spark.range(1000).select(F.lit("t").alias("topic"), (F.col("id") % 2).cast("int").alias("partition"), (F.col("id") * 3).alias("offset"))
    got = sorted((r.partition, r.offset, r.at) for r in commit.numbered(log, block=64).collect())
    assert got == [(p, (2 * k + p) * 3, k) for p in (0, 1) for k in range(500)]


def test_java_hash_of_surrogates(spark):
    def brute(s):
        h = 0
        raw = s.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = (31 * h + int.from_bytes(raw[k : k + 2], "big")) % (1 << 32)
        return h - (1 << 32) if h >= 1 << 31 else h

    texts = ["", "key-1", "été", "漢字", "😀👍x", "a" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", java_hash(F.col("t")).alias("h"))
    assert {r.t: r.h for r in df.collect()} == {t: brute(t) for t in texts}


def test_stall_listener_stops():
    now, stopped = [0.0], []
    listener = engine.StallListener(60, stopped.append, lambda: now[0])

    class Event:
        id = "q"

    listener.onQueryStarted(Event)
    for at, n in ((10, 5), (50, 0), (69, 0)):
        now[0] = at
        listener._note("q", n)
    assert not stopped
    now[0] = 71
    listener.onQueryIdle(Event)
    assert stopped == ["q"]


def test_memory_tables(spark):
    t = memory.MemoryTable(spark, ROW, ("key",)).create()
    df = lambda *r: spark.createDataFrame(list(r), ROW)
    t.upsert(df(("a", "1"), ("b", "2")))
    t.upsert(df(("a", "3")))
    t.delete(df(("b", "")).select("key"))
    assert rows(t) == [("a", "3")]
    t.truncate()
    assert rows(t) == []
    cache = memory.RecoveredSnapshots([("a", 1), ("b", 2)])
    assert (cache.take("a"), cache.take("a"), cache.take("x"), len(cache)) == (1, None, None, 1)
    registry = memory.EntityRegistry()
    registry.put("a", 1)
    registry.put("b", 2)
    registry.put("a", None)
    assert registry.all() == {"b": 2} and registry.get("a") is None and memory.EntityRegistry.const(7).get("x") == 7 and memory.EntityRegistry.empty().get("x") is None


def test_serdes(spark):
    for serde, state in ((engine.JSON, {"n": [1, "é"]}), (engine.TEXT, "é"), (engine.LONG, -5)):
        assert serde.from_bytes(serde.to_bytes(state)) == state
    log = spark.createDataFrame([("t", 0, k, datetime(2020, 3, 1), "k", k) for k in range(4)], "topic string, partition int, offset long, timestamp timestamp, key string, value int")
    out = engine.fold_stream(log, lambda s, r: (s or 0) + r["value"], ("value",), serde=engine.LONG).orderBy("offset").collect()
    assert [r.after for r in out] == ["0", "1", "3", "6"]


def test_metrics_of_stores_folds_and_compressors(spark, tmp_path):
    m = Metrics(spark)
    s = measured_stores(tables.Stores(spark, str(tmp_path)).create(), m)
    for t in (s.keys, s.journals, s.snapshots):
        none = t.read()
        t.upsert(none)
        t.delete(none.select("key"))
    step = m.fold(lambda s, a: (s or 0) + a)
    assert step(None, 2) == 2
    with pytest.raises(TypeError):
        step("x", 2)
    packer = MeasuredCompressor(Compressor(threshold=9), m)
    assert packer.unpack(packer.pack(b"a" * 1000)) == b"a" * 1000
    sent = spark.createDataFrame([(b"b" * 50,)] * 3, "x binary")
    assert sent.select(packer.column(packer.pack, F.col("x"))).count() == 3  # pruned: nothing is packed
    assert len(sent.select(packer.column(packer.pack, F.col("x"))).collect()) == 3
    got = m.read()
    assert {n for n in NAMES if "database" in n} <= got.keys() and all(got[n]["count"] == 1 for n in got if "database" in n)
    assert got["fold_apply_duration_seconds"]["count"] == 2
    raw, packed = got["kafka_flow_compressor_raw_bytes"], got["kafka_flow_compressor_compressed_bytes"]
    assert raw == {"count": 4, "sum": 1150, "max": 1000} and packed["count"] == 4 and packed["sum"] < 400
    with pytest.raises(ValueError):
        m.observe("other", 1)


def test_metrics_of_queries_and_processing_clock(spark, tmp_path):
    """A key that stays idle by the wall clock is unloaded in a later batch, whatever its records' times; the listener names what it saw."""
    path, check, out = (str(tmp_path / x) for x in ("in", "check", "out"))
    schema = "topic string, partition int, offset long, timestamp timestamp, key string, value int"
    drop = lambda o, k: spark.createDataFrame([("t", 0, o, datetime(2020, 3, 1), k, 1)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: engine.fold_stream(read_log(spark, "parquet", ["t"], True, schema, path=path), lambda s, r: {"n": (s or {"n": 0})["n"] + 1}, ("value",), idle_ms=2000, clock="processing")
    m = Metrics(spark)
    listener = ProgressMetrics(m)
    spark.streams.addListener(listener)
    try:
        drop(1, "idle")
        engine.start(stream(), check, engine.once_per_batch(out)).awaitTermination(120)
        time.sleep(2.5)
        drop(2, "late")
        engine.start(stream(), check, engine.once_per_batch(out)).awaitTermination(120)
        for _ in range(50):
            if len(listener.seen) >= 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    rows = {(r.key, r.kind, r.after) for r in spark.read.parquet(out).collect()}
    assert {("idle", "fold", '{"n": 1}'), ("late", "fold", '{"n": 1}'), ("idle", "tick", None)} <= rows
    assert {n for n in NAMES if n.startswith(("partition_flow", "topic_flow", "key_flow"))} <= m.read().keys()
    with pytest.raises(ValueError):
        engine.KeyFold(None, (), clock="moon")
