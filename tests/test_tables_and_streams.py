import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keyfold.sources import tables
from keyfold.sources.log import read_log
from keyfold.streaming import engine

AT = datetime(2020, 3, 1)
LOG = "topic string, partition int, offset long, timestamp timestamp, key string, value int"


def test_stores(spark, tmp_path):
    s = tables.Stores(spark, str(tmp_path)).create()
    s.create()
    rows = spark.createDataFrame([("app", "g", 1, "t", p, f"k{i}", AT, AT.date(), "") for i, p in enumerate([1, 1, 2])], tables.SCHEMAS["keys"])
    s.keys.upsert(rows)
    s.keys.upsert(rows.limit(1))
    assert s.all_keys("app", "g", "t", 1).count() == 2 and s.all_keys("app", "g", "t", 2).count() == 1
    s.keys.delete(rows.where("partition = 1").select("topic", "partition", "key"))
    assert s.keys.read().count() == 1
    s.keys.truncate()
    assert s.keys.read().count() == 0
    j = spark.createDataFrame([("app", "g", "t", 0, "k", o, AT, AT, "C", {"h": "v"}, "", b"x") for o in (2, 1, 2)], tables.SCHEMAS["records"])
    s.journals.upsert(j)
    assert [r.offset for r in tables.journal_of(s.journals.read(), {"key": "k"}).collect()] == [1, 2]
    snap = lambda o, v: spark.createDataFrame([("app", "g", "t", 0, "k", o, AT, "", v)], tables.SCHEMAS["snapshots_v2"])
    s.snapshots.upsert(snap(5, b"new"))
    s.snapshots.upsert(snap(3, b"old"))  # no offset check: the last write wins
    assert s.snapshots.read().first().value == b"old"
    now = lambda hours: F.lit(AT + timedelta(hours=hours))
    assert s.snapshots.live(now(0.5), 3600).count() == 1 and s.snapshots.live(now(2), 3600).count() == 0 and s.snapshots.live(now(2), None).count() == 1


def test_write_elision(spark):
    make = lambda rows: spark.createDataFrame(rows, "key string, value string")
    out = tables.changed_only(make([("a", "1"), ("b", "2"), ("c", None), ("d", None)]), make([("a", "1"), ("b", "x"), ("c", None)]), ("key",), "value")
    assert {r.key for r in out.collect()} == {"b", "d"}
    with pytest.raises(ValueError):
        tables.restore("odd", None, None, None)


def drop(spark, path, rows):
    spark.createDataFrame([("t", 0, o, AT + timedelta(minutes=m), "k", v) for o, m, v in rows], LOG).coalesce(1).write.mode("append").parquet(path)


def test_golden_scenario_over_restarts(spark, tmp_path):
    path, check, out = (str(tmp_path / x) for x in ("in", "check", "out"))
    step = lambda state, record: {"n": record["value"]} if record["value"] else None
    at = 0
    for polls in ([1, 2, 3], [4, 5, 6], [0], [9]):
        drop(spark, path, [(at + i, at + i, v) for i, v in enumerate(polls)])
        at += len(polls)
        q = engine.start(engine.fold_stream(read_log(spark, "parquet", ["t"], True, LOG, path=path), step, ("value",)), check, engine.once_per_batch(out))
        q.awaitTermination(120)
        assert q.exception() is None
    got = [(None if r.before is None else json.loads(r.before)["n"], json.loads(r.record)["value"]) for r in spark.read.parquet(out).orderBy("offset").collect()]
    assert got == [(None, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 0), (None, 9)]
    assert [(r.key, json.loads(r.value)) for r in engine.registry(spark, check).collect()] == [("k", {"n": 9})]


def test_idle_timer_and_initial_state(spark, tmp_path):
    path, check, out = (str(tmp_path / x) for x in ("in", "check", "out"))
    drop(spark, path, [(1, 0, 5)])
    initial = spark.createDataFrame([("t", 0, "k", 0, '{"n": 40}')], "topic string, partition int, key string, offset long, value string")
    stream = lambda: engine.fold_stream(read_log(spark, "parquet", ["t"], True, LOG, path=path), lambda s, r: {"n": (s or {"n": 0})["n"] + r["value"]}, ("value",), idle_ms=600_000, initial=initial)
    engine.start(stream(), check, engine.once_per_batch(out)).awaitTermination(120)
    spark.createDataFrame([("t", 0, 2, AT + timedelta(hours=2), "other", 1)], LOG).coalesce(1).write.mode("append").parquet(path)
    engine.start(stream(), check, engine.once_per_batch(out)).awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert {(r.key, r.kind, r.after) for r in rows} == {("k", "fold", '{"n": 45}'), ("other", "fold", '{"n": 1}'), ("k", "tick", None)}


def test_retry_and_stall():
    calls, waits = [], []

    def begin():
        calls.append(1)
        if len(calls) < 4:
            raise RuntimeError
        return "done"

    assert engine.Retry().run(begin, waits.append, lambda: 0.0) == "done" and len(waits) == 3
    with pytest.raises(RuntimeError):
        calls.clear()
        engine.Retry(attempts=1).run(begin, lambda s: None)
    assert engine.stalled([{"at": 0, "rows": 1}, {"at": 50, "rows": 0}], 60, 61) and not engine.stalled([{"at": 50, "rows": 1}], 60, 61)
