"""The partitioned log: what is read between offsets, over restarts and after failures."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keyfold.sources import segments
from keyfold.sources.log import LOG_SCHEMA
from keyfold.streaming import engine

AT = datetime(2020, 3, 1)


def records(spark, first, end, topic="t", partitions=3):
    rows = [(topic, p, o, AT + timedelta(seconds=o), "C", [("h", b"v")], None if o % 5 == 0 else f"k{o % 4}", b"%d" % o) for p in range(partitions) for o in range(first, end)]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def places(df):
    return sorted((r["topic"], r["partition"], r["offset"]) for r in df.collect())


def test_ends_are_fixed_and_pieces_of_segments_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert segments.append(records(spark, 0, 25), path, 10) == 9  # three blocks of offsets in each of three partitions
    held = segments.ends(path)
    assert held == {"t": {"0": 25, "1": 25, "2": 25}}
    segments.append(records(spark, 25, 40), path, 10)
    segments.append(records(spark, 7, 12, "other topic/1", 1), path)
    every = segments.scan(spark, path)
    assert every.schema == records(spark, 0, 1).schema
    assert places(every) == sorted([("t", p, o) for p in range(3) for o in range(40)] + [("other topic/1", 0, o) for o in range(7, 12)])
    assert places(segments.scan(spark, path, "t", end=held)) == [("t", p, o) for p in range(3) for o in range(25)]
    part = segments.scan(spark, path, start={"t": {"0": 8, "1": 22}}, end={"t": {"0": 33, "1": 23}})
    assert places(part) == [("t", 0, o) for o in range(8, 33)] + [("t", 1, 22)]
    assert part.rdd.getNumPartitions() == 6  # one task a piece: offsets 8 to 9, 10 to 19, 20 to 24, 25 to 29 and 30 to 32 of one partition, 22 of the other
    row = every.where("topic = 't' and partition = 2 and offset = 13").first()
    assert (row["timestamp"], row["key"], bytes(row["value"]), row["headers"][0]["key"]) == (AT + timedelta(seconds=13), "k1", b"13", "h")
    assert places(segments.scan(spark, path, "other topic/1", repeat=3)) == sorted([("other topic/1", 0, o) for o in range(7, 12)] * 3)


def test_only_commits_count_and_offsets_grow(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    with pytest.raises(Exception, match="no log"):
        segments.scan(spark, path).count()
    segments.append(records(spark, 0, 10), path)
    with monkeypatch.context() as m:
        m.setattr(segments, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            segments.append(records(spark, 10, 20), path)
    assert segments.scan(spark, path).count() == 30
    with pytest.raises(ValueError, match="not past"):
        segments.append(records(spark, 9, 12), path)
    with pytest.raises(ValueError, match="other columns"):
        segments.append(records(spark, 10, 12).drop("headers"), path)
    late = segments.Log(path)
    late.commits()
    (tmp_path / "log/commits/000000000001.json").touch()  # another writer is at it
    with pytest.raises(OSError, match="another writer"):
        segments.append(records(spark, 10, 12), path)
    assert segments.scan(spark, path).count() == 30


def test_a_stream_goes_on_at_its_offsets(spark, tmp_path):
    path, check, out = f"file://{tmp_path}/log", f"{tmp_path}/check", f"{tmp_path}/out"
    segments.append(records(spark, 0, 12), path, 5)

    def run():
        q = engine.start(segments.scan(spark, path, "t", streaming=True), check, engine.once_per_batch(out))
        q.awaitTermination(120)
        assert q.exception() is None
        return q.lastProgress

    first = run()
    assert first["numInputRows"] == 36
    segments.append(records(spark, 12, 20), path, 5)
    segments.append(records(spark, 0, 3, "unread"), path, 5)
    assert run()["numInputRows"] == 24
    assert run() is None or run()["numInputRows"] == 0
    assert places(spark.read.parquet(out)) == [("t", p, o) for p in range(3) for o in range(20)]


def test_polls_repeat(spark, tmp_path):
    path, check, out = f"file://{tmp_path}/log", f"{tmp_path}/check", f"{tmp_path}/out"
    segments.append(records(spark, 0, 4), path)
    stream = segments.scan(spark, path, "t", repeat=3, streaming=True)
    q = stream.writeStream.foreachBatch(engine.once_per_batch(out)).option("checkpointLocation", check).trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    q.stop()
    polls = spark.read.parquet(out).groupBy("batch_id").agg(F.count("*").alias("n")).collect()
    assert [r["n"] for r in polls] == [12, 12, 12]


def test_a_stream_is_drained_to_a_captured_end_or_says_who_stands_still(spark, tmp_path):
    path, out = f"file://{tmp_path}/log", f"{tmp_path}/out"
    segments.append(records(spark, 0, 12), path)
    target = segments.ends(path)
    begin = lambda: engine.start(segments.scan(spark, path, "t", streaming=True), f"{tmp_path}/check", engine.once_per_batch(out), every="0 seconds")
    q = begin()
    engine.drain(q, target, 60)
    assert not q.isActive and places(spark.read.parquet(out)) == [("t", p, o) for p in range(3) for o in range(12)]
    segments.append(records(spark, 12, 15, partitions=1), path)
    q = begin()
    with pytest.raises(engine.Stalled, match="t-1 stands at 12 of 15, t-2 stands at 12 of 13") as e:
        engine.drain(q, {"t": {"0": 15, "1": 15, "2": 13}}, 8)
    assert e.value.behind == {"t-1": (12, 15), "t-2": (12, 13)} and not q.isActive
