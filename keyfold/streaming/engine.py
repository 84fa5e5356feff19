"""Keyed folds over streams: state store, timers, idempotent sinks, recovery, registry."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType

from keyfold.sources.custom import SnapshotStore
from keyfold.streaming.metrics import ProgressMetrics  # noqa: F401
from keyfold.streaming.packing import packed, unpacked

#: State lives in RocksDB, on disk beyond memory and checkpointed by changelog.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
OUTPUT = "topic string, partition int, key string, kind string, offset long, before string, record string, after string"
#: What a processor tells of a key at once: arrays, of one length.
_TOLD = ("kind", "offset", "before", "record", "after")
_ARRAYS = "topic string, partition int, key string, kind array<string>, offset array<long>, before array<string>, record array<string>, after array<string>"
_OUT = Row("topic", "partition", "key", *_TOLD)
#: A record as JSON; what JSON does not know, as text.
record_text = json.JSONEncoder(default=str).encode


@dataclass(frozen=True)
class Serde:
    """How a state becomes bytes in the state store and back."""

    to_bytes: Callable[[object], bytes]
    from_bytes: Callable[[bytes], object]


JSON = Serde(lambda state: json.dumps(state).encode(), lambda raw: json.loads(bytes(raw)))
TEXT = Serde(lambda state: state.encode(), lambda raw: bytes(raw).decode())
LONG = Serde(lambda state: state.to_bytes(8, "big", signed=True), lambda raw: int.from_bytes(bytes(raw), "big", signed=True))


class KeyFold(StatefulProcessor):
    """Folds a key's records; ``serde`` keeps states, as JSON unless told otherwise. Outputs show them as JSON.

    A row of kind "fold" tells each step (state before, record, state after);
    the key is deleted when the state after a batch's last record is None.
    With ``ttl_ms`` a state that is not written for that long, by the wall
    clock, is gone, and its key starts from nothing.
    With ``idle_ms`` a timer unloads keys that stay idle: ``tick`` gives the
    new state or None, in a row of kind "tick". ``clock`` is "event" (the
    records' times, against the watermark) or "processing" (the wall clock,
    looked at in each batch).
    """

    def __init__(self, step: Callable, fields: tuple[str, ...], tick: Callable | None = None, idle_ms: int | None = None, serde: Serde = JSON, clock: str = "event", ttl_ms: int | None = None):
        if ttl_ms and idle_ms and clock == "event":
            raise ValueError("a time to live runs by the processing clock, and so must the idle timer beside it")
        if clock not in ("event", "processing"):
            raise ValueError(f"unknown clock {clock}")
        self.step, self.fields, self.tick, self.idle_ms, self.serde, self.clock, self.ttl_ms = step, fields, tick, idle_ms, serde, clock, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("state", "offset long, value binary", self.ttl_ms)

    def _get(self):
        if not self.held.exists():
            return None, None
        offset, value = self.held.get()
        return offset, self.serde.from_bytes(value)

    def _due(self, last_time, timerValues) -> int:  # noqa: N803
        now = int(last_time.timestamp() * 1000) if self.clock == "event" else timerValues.getCurrentProcessingTimeInMs()
        return now + self.idle_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        offset, state = self._get()
        last_time, names, told = None, ("offset", *self.fields), ([], [], [], [])
        arrays = [f"_{i}" for i in range(len(names))]
        timed = self.idle_ms and self.clock == "event"  # then a row has one record
        records = ((r["timestamp"] if timed else True, values) for r in rows for values in zip(*[r[a] for a in arrays]))
        text = None if state is None else json.dumps(state)
        for time_of, values in sorted(records, key=lambda r: r[1][0]):
            if offset is not None and values[0] <= offset:  # delivered again
                continue
            record, before = dict(zip(names, values)), text
            state, offset = self.step(state, record), values[0]
            last_time, text = time_of, None if state is None else json.dumps(state)
            for column, value in zip(told, (offset, before, record_text(record), text)):
                column.append(value)
        if told[0]:
            yield _OUT(*key, ["fold"] * len(told[0]), *told)
        if state is None:
            self.held.clear()
            for t in list(self.handle.listTimers()) if self.idle_ms else []:
                self.handle.deleteTimer(t)
            return
        self.held.update((offset, self.serde.to_bytes(state)))
        if self.idle_ms and last_time is not None:
            for t in list(self.handle.listTimers()):  # one timer a key: a later record moves it
                self.handle.deleteTimer(t)
            self.handle.registerTimer(self._due(last_time, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        offset, before = self._get()
        if before is None:
            return
        state = self.tick(before) if self.tick else None
        if state is None:
            self.held.clear()
        else:
            self.held.update((offset, self.serde.to_bytes(state)))
            self.handle.registerTimer(int(expiredTimerInfo.getExpiryTimeInMs()) + self.idle_ms)  # it stays, so it is looked at again
        yield _OUT(*key, ["tick"], [offset], [json.dumps(before)], [None], [None if state is None else json.dumps(state)])

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.held.update((initialState["offset"], self.serde.to_bytes(json.loads(initialState["value"]))))
        last_time = initialState["timestamp"] if "timestamp" in initialState else None
        if self.idle_ms and (last_time is not None or self.clock == "processing"):  # it may never get a record
            self.handle.registerTimer(self._due(last_time, timerValues))

    def close(self) -> None:
        pass


def fold_stream(log: DataFrame, step: Callable, fields: tuple[str, ...], tick: Callable | None = None, idle_ms: int | None = None, watermark: str = "0 seconds", initial: DataFrame | None = None, serde: Serde = JSON, clock: str = "event", ttl_ms: int | None = None, keep: Column | None = None) -> DataFrame:
    """A streaming (or batch) log folded per key, but for records that ``keep`` leaves out. ``initial`` (topic, partition, key, offset, value JSON, and timestamp for a timer) starts from snapshots."""
    log.sparkSession.streams.active  # noqa: B018  the state store's coordinator starts with the first use of streams
    rows = log.where("key is not null") if keep is None else log.where(F.col("key").isNotNull() & keep)
    place, names = ("topic", "partition", "key"), dict.fromkeys(["offset", *fields])
    if idle_ms and clock == "event":  # late records are told by their own times
        if rows.isStreaming:
            rows = rows.withWatermark("timestamp", watermark)
        rows = rows.select(*place, "timestamp", *[F.array(n).alias(f"_{i}") for i, n in enumerate(names)])
    else:
        rows = packed(rows.select(*place, *[F.col(n).alias(f"_{i}") for i, n in enumerate(names)]), place, "_0")
    out = rows.groupBy(*place).transformWithState(
        statefulProcessor=KeyFold(step, tuple(names)[1:], tick, idle_ms, serde, clock, ttl_ms), outputStructType=StructType.fromDDL(_ARRAYS), outputMode="Update", timeMode="ProcessingTime" if ttl_ms or idle_ms and clock == "processing" else "EventTime" if idle_ms else "None", initialState=None if initial is None else initial.groupBy(*place)
    )
    return unpacked(out, *_TOLD)


def once_per_batch(path: str, write: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink whose folder a repeated batch cannot write twice: each batch overwrites its own. ``write`` runs again with a repeated batch and its id, and must be idempotent."""

    def sink(df: DataFrame, batch_id: int) -> None:
        if write:
            df.persist()
            write(df, batch_id)
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if write:
            df.unpersist()

    return sink


def marks(log: DataFrame) -> DataFrame:
    """Rows of kind "mark": the last offset of what each task has read of a partition, whatever a fold makes of the records. One row a partition and Arrow batch."""

    def run(batches):
        for batch in batches:
            of = pa.Table.from_batches([batch]).group_by(["topic", "partition"]).aggregate([("offset", "max")])
            yield from of.select(["topic", "partition", "offset_max"]).rename_columns(["topic", "partition", "offset"]).to_batches()

    read = log.select("topic", "partition", "offset").mapInArrow(run, "topic string, partition int, offset long")
    return read.select("topic", "partition", F.lit(None).cast("string").alias("key"), F.lit("mark").alias("kind"), "offset", *[F.lit(None).cast("string").alias(c) for c in ("before", "record", "after")])


class StoredFold:
    """The whole loop: fold, persist states and commit input offsets in one transaction, recover.

    ``stream`` folds a log and marks how far it was read; ``sink`` is for
    ``start``: of each batch it commits the last state of every key (None: a
    tombstone) with the offsets to read next, past records that were filtered
    out, have no key or came again as well. The fold runs once a batch.
    ``recover`` gives the states and the log from the committed offsets on, for
    a query with a new checkpoint. A batch that is repeated commits the same
    rows again, so nothing is folded twice. A stale generation is rejected.
    Any ``SnapshotStore`` will do. It gets states as JSON, or with ``state``
    (DDL of their fields) as a struct of typed columns.
    """

    def __init__(self, changelog: SnapshotStore, generation: int, state: str | None = None):
        self.changelog, self.generation, self.state = changelog, generation, state

    def stream(self, log: DataFrame, step: Callable, fields: tuple[str, ...], **options) -> DataFrame:
        """``fold_stream`` with the marks of the same log."""
        return fold_stream(log, step, fields, **options).unionByName(marks(log))

    def sink(self, outputs: DataFrame, batch_id: int) -> None:
        outputs = outputs.persist()
        try:
            read = outputs.where("kind in ('fold', 'mark')").groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next"))
            before = self.changelog.offsets()
            offsets = {f"{r['topic']}-{r['partition']}": r["next"] for r in read.collect()}  # one row a partition of the input
            offsets = {name: at for name, at in offsets.items() if at > before.get(name, -1)}
            states = outputs.where("kind <> 'mark'")
            if offsets or not states.isEmpty():
                order = F.struct("offset", (F.col("kind") == "tick").alias("late"))
                value = F.col("after") if self.state is None else F.from_json("after", self.state, {"mode": "FAILFAST"})
                last = states.groupBy("topic", "partition", "key").agg(F.max_by(F.struct("offset", value.alias("value")), order).alias("row"))
                self.changelog.commit(last.select("topic", "partition", "key", "row.*"), self.generation, offsets)
        finally:
            outputs.unpersist()

    def recover(self, log: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(states to start from, records that are not yet committed)."""
        cond = F.lit(True)
        for name, at in sorted(self.changelog.offsets().items()):
            topic, _, partition = name.rpartition("-")
            cond = cond & ~((F.col("topic") == topic) & (F.col("partition") == int(partition)) & (F.col("offset") < at))
        states = self.changelog.read()
        if self.state is not None:
            states = states.withColumn("value", F.to_json("value", {"ignoreNullFields": "false"}))
        return states, log.where(cond)


def start(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], every: str | None = None, **options: str):
    """Start a query. Without ``every`` it takes everything that is there and stops; run again it goes on from the checkpoint. With it ("10 seconds") a batch is triggered, and its offsets are committed, at that cadence."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    conf = df.sparkSession.conf
    before = {name: conf.get(name, None) for name in STATE_STORE}
    try:
        for name, value in STATE_STORE.items():  # a query keeps the settings that it starts with
            conf.set(name, value)
        return df.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint).options(**options).trigger(**trigger).start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


@dataclass
class Retry:
    """Exponential backoff with jitter, reset after a long good run."""

    first: float = 0.1
    most: float = 60.0
    reset: float = 300.0
    attempts: int | None = None

    def run(self, begin: Callable[[], object], sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> object:
        """Call ``begin`` until it returns; its errors are retried."""
        n = 0
        while True:
            at = clock()
            try:
                return begin()
            except Exception:
                n = 1 if clock() - at >= self.reset else n + 1
                if self.attempts is not None and n > self.attempts:
                    raise
                sleep(random.uniform(0, min(self.most, self.first * 2 ** (n - 1))))


def registry(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Current states of a query, read from its state store: topic, partition, key, offset, value (as its serde wrote it)."""
    s = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "state").load()
    return s.select("key.*", "value.*")


class StallListener(StreamingQueryListener):
    """Stops queries that make no progress for longer than the deadline; ``stop`` is called with the query's id."""

    def __init__(self, deadline_s: float, stop: Callable[[str], None], clock: Callable[[], float] = time.monotonic):
        self.deadline_s, self.stop, self.clock = deadline_s, stop, clock
        self.moved: dict[str, float] = {}

    def _note(self, query: str, rows: int) -> None:
        now = self.clock()
        if rows or query not in self.moved:
            self.moved[query] = now
        if now - self.moved[query] > self.deadline_s:
            self.stop(query)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.moved[str(event.id)] = self.clock()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._note(str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._note(str(event.id), 0)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.moved.pop(str(event.id), None)


class Stalled(Exception):
    """A stream that did not come to its target's end; ``behind`` has (where it stands, where it should be) of each partition."""

    def __init__(self, behind: dict[str, tuple[int, int]], deadline_s: float):
        self.behind = behind
        super().__init__(f"no progress for {deadline_s} s: " + ", ".join(f"{name} stands at {at} of {end}" for name, (at, end) in sorted(behind.items())))


def behind(query, target: dict[str, dict[str, int]]) -> dict[str, tuple[int, int]]:
    """Partitions whose committed batches have not come to ``target`` ({topic: {partition: offset}}): "topic-partition": (at, end)."""
    at: dict[str, dict[str, int]] = {}
    for source in json.loads(query.lastProgress.json)["sources"] if query.lastProgress else []:
        end = source["endOffset"]
        for topic, of in (json.loads(end) if isinstance(end, str) else end or {}).items():
            at.setdefault(topic, {}).update(of)
    pairs = ((f"{t}-{p}", at.get(t, {}).get(p, 0), end) for t, of in target.items() for p, end in of.items())
    return {name: (now, end) for name, now, end in pairs if now < end}


def drain(query, target: dict[str, dict[str, int]], deadline_s: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
    """Let a started query run until it has come to ``target``, which was captured before, and stop it there. Stalled if nothing moves for ``deadline_s``; an error of the query is raised."""
    last, moved = None, clock()
    try:
        while left := behind(query, target):
            if query.exception():
                raise query.exception()
            if left != last:
                last, moved = left, clock()
            elif clock() - moved > deadline_s:
                raise Stalled(left, deadline_s)
            sleep(0.1)
    finally:
        query.stop()


def stalled(progress: list[dict], deadline_s: float, now: float) -> bool:
    """Whether a query has made no progress for longer than the deadline; entries have ``at`` and ``rows``."""
    moved = [p["at"] for p in progress if p["rows"]]
    return bool(progress) and now - (max(moved) if moved else progress[0]["at"]) > deadline_s


def wait_for_step(n: int) -> Callable:
    """The wait-for-n fold as a callable over JSON states."""

    def step(state, record):
        count = (state or {"n": 0})["n"] + 1
        return {"n": count} if count < n else None

    return step


def fold_in_batch(log: DataFrame, step: Callable, fields: tuple[str, ...]) -> DataFrame:
    """The same processor over a finished log."""
    return fold_stream(log, step, fields).select("topic", "partition", "key", "kind", F.col("offset"), "before", "record", "after")
