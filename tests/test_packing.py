"""Processors get records put together by key or segment, in few rows, and give what single records gave."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from keyfold.operators.timers import TimerPolicy
from keyfold.sources import segments
from keyfold.streaming import engine, flow

AT = datetime(2020, 3, 1)


def test_a_key_comes_in_few_rows(spark, monkeypatch):
    """1,000 records of a key and one each of 50 others, in four tasks: the processor is called with rows of many records, and folds each once in order."""
    rows = spark.sparkContext.accumulator(0)

    class Counted(engine.KeyFold):
        def handleInputRows(self, key, got, timerValues):  # noqa: N802, N803
            got = list(got)
            rows.add(len(got))
            yield from super().handleInputRows(key, iter(got), timerValues)

    monkeypatch.setattr(engine, "KeyFold", Counted)
    log = spark.range(1000, numPartitions=4).select("id", F.lit("hot").alias("key")).unionByName(spark.range(1000, 1050, numPartitions=1).select("id", F.col("id").cast("string").alias("key")))
    at = F.lit(AT) + F.make_dt_interval(secs=F.col("id"))
    log = log.select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), at.alias("timestamp"), "key", F.when(F.col("id") % 7 > 0, F.struct(F.col("id").alias("n"), at.alias("at"))).alias("part"), F.array("id", F.lit(None)).alias("list"))
    out = engine.fold_stream(log.unionByName(log), lambda s, r: [*(s or []), r["offset"]][-2:], ("part", "list", "timestamp")).collect()
    assert rows.value <= 2 * 4 * 4 + 2 * 50  # 2,100 records; each of the eight tasks that read "hot" gathers 250
    hot = sorted((r for r in out if r["key"] == "hot"), key=lambda r: r["offset"])
    assert len(out) == 1050 and [r["offset"] for r in hot] == list(range(1000))
    assert json.loads(hot[9]["after"]) == [8, 9] and hot[9]["before"] == hot[8]["after"] and hot[0]["before"] is None
    record = json.loads(hot[8]["record"])
    assert record["part"]["n"] == 8 and record["list"] == [8, None] and json.loads(hot[7]["record"])["part"] is None
    assert record["timestamp"].startswith(str(AT + timedelta(seconds=8)))


def test_a_segment_comes_in_few_rows_from_one_pass_over_the_log(spark, monkeypatch):
    """2,000 records of 100 keys in four tasks: the log is read once, and segments get rows of many records. Keyless and left out records move the offset."""
    rows, read = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    class Counted(flow.SegmentFlow):
        def handleInputRows(self, key, got, timerValues):  # noqa: N802, N803
            got = list(got)
            rows.add(len(got))
            yield from super().handleInputRows(key, iter(got), timerValues)

    def watched(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(flow, "SegmentFlow", Counted)
    ids = spark.range(2000, numPartitions=4)
    key = F.when(F.col("id") < 1900, F.concat(F.lit("k"), F.col("id") % 100)).when(F.col("id") < 1990, F.lit("out"))
    log = ids.select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), (F.lit(AT) + F.make_dt_interval(secs=F.col("id"))).alias("timestamp"), key.alias("key"))
    log = log.mapInArrow(watched, log.schema)
    policy = TimerPolicy(fire_every=0, max_behind=150)
    out = flow.flow_stream(log, lambda s, r: (s or 0) + 1, (), policy, keep=F.col("key") != "out", segments=2, steps=False).collect()
    assert read.value == 2000
    assert rows.value <= 4 * 2 * 3  # of four tasks, for each of two segments: at most two rows of records and the clock
    gone = sorted((r["key"], r["offset"], r["after"]) for r in out if r["kind"] == "unload")
    assert gone == sorted((f"k{k}", 1800 + k, "19") for k in range(50))  # more than 150 behind 2,000
    assert len([r for r in out if r["kind"] == "flush"]) == 50 and {(r["offset"]) for r in out if r["kind"] == "hold"} == {2000}
    assert min(r["hold"] for r in out if r["kind"] == "hold") == 50


def test_events_that_are_flushed_at_once_do_not_go_through_the_state_store(spark, tmp_path):
    """400 records of five keys, all flushed in the poll that brings them: their journal is told, and the store is written once a key and segment."""
    ids = spark.range(400)
    log = ids.select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), (F.lit(AT) + F.make_dt_interval(secs=F.col("id"))).alias("timestamp"), F.concat(F.lit("k"), F.col("id") % 5).alias("key"))
    segments.append(log, f"file://{tmp_path}/log")
    stream = flow.flow_stream(segments.scan(spark, f"file://{tmp_path}/log", "t", streaming=True), lambda s, r: (s or 0) + 1, (), TimerPolicy(fire_every=0, persist_every=0), segments=2, journal=True, steps=False)
    got = []
    q = engine.start(stream, f"{tmp_path}/check", lambda df, _: got.extend(df.collect()))
    assert q.awaitTermination(100) and q.exception() is None
    assert sorted(r["offset"] for r in got if r["kind"] == "journal") == list(range(400))
    assert sorted((r["key"], r["after"], r["hold"]) for r in got if r["kind"] == "flush") == [(f"k{k}", "80", 400) for k in range(5)]
    assert sum(o.numRowsUpdated for o in q.lastProgress.stateOperators) <= 5 + 2
