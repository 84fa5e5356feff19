"""Folds with flush timers, holds and journals, driven by each partition's own clock.

Keys are dealt to segments of their partition. Every micro-batch, each segment
gets its records and one "clock" row: the partition's current offset (one past
its last record, whether that was folded or not) and its largest timestamp. So
a key that never returns still sees its partition go on, and a hot partition is
folded by as many tasks as it has segments.

``SegmentFlow`` keeps the states of a segment's keys with what the timer policy
knows of each (``operators.timers.TimerPolicy``), and a journal of the events
that no flush has written yet. Its rows:

* fold: a step, as in ``engine.KeyFold``;
* flush: a state to persist; unload: a key that leaves memory after its flush;
* journal: an event to persist; gone: a persisted key whose state has ended;
* hold: the segment's smallest held offset (null: none) beside the current one.

``FlowSink`` persists flushes and journals and commits, for each partition, the
smallest hold of its segments, or its current offset: what is not persisted is
read again. ``recover`` starts a query with a new checkpoint from there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from keyfold.operators.timers import At, KeyTimers, TimerPolicy
from keyfold.sources.tables import Changelog, Table
from keyfold.streaming.engine import JSON, Serde, record_text
from keyfold.streaming.packing import gathered, pieces, unpacked

#: Segments that the keys of a partition are dealt to.
SEGMENTS = 64
OUTPUT = "topic string, partition int, key string, kind string, offset long, before string, record string, after string, hold long"
#: What a segment tells at once: arrays, of one length, of at most ``TOLD`` rows.
_TOLD = ("key", "kind", "offset", "before", "record", "after", "hold")
_ARRAYS = "topic string, partition int, key array<string>, kind array<string>, offset array<long>, before array<string>, record array<string>, after array<string>, hold array<long>"
_OUT = Row("topic", "partition", *_TOLD)
TOLD = 1000
_ENTRY = "offset long, value binary, start_clock double, start_offset long, touched_clock double, touched_offset long, flushed_clock double, flushed_offset long, hold long, next double, dirty boolean"
GROUP = ("topic", "partition", "segment")


def _at(clock: float | None, offset: int | None) -> At | None:
    return None if offset is None else At(clock, offset)


class _Key:
    """A key in memory: its state, the last offset folded into it, its timers, and whether it changed since its last flush."""

    def __init__(self, timers: KeyTimers, offset: int | None = None, state=None, dirty: bool = False):
        self.timers, self.offset, self.state, self.dirty = timers, offset, state, dirty

    @classmethod
    def load(cls, row, serde: Serde) -> _Key:
        offset, value, sc, so, tc, to, fc, fo, hold, fire, dirty = row
        return cls(KeyTimers(At(sc, so), hold, _at(tc, to), _at(fc, fo), fire), offset, serde.from_bytes(value), dirty)

    def dump(self, serde: Serde) -> tuple:
        t, none = self.timers, (None, None)
        place = lambda at: (at.clock, at.offset) if at else none
        return (self.offset, serde.to_bytes(self.state), *place(t.committed), *place(t.processed), *place(t.persisted), t.hold, t.next_fire, self.dirty)


def _text(state) -> str | None:
    return None if state is None else json.dumps(state)


class SegmentFlow(StatefulProcessor):
    """The keys of one segment of a partition. ``clock`` is "event" (the partition's records' times) or "processing" (the wall clock, which goes on without records)."""

    def __init__(self, step: Callable, fields: tuple[str, ...], policy: TimerPolicy, serde: Serde = JSON, clock: str = "event", journal: bool = False, steps: bool = True):
        if clock not in ("event", "processing"):
            raise ValueError(f"unknown clock {clock}")
        self.step, self.fields, self.policy, self.serde, self.clock, self.journal, self.steps = step, fields, policy, serde, clock, journal, steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getMapState("keys", "key string", _ENTRY)
        self.at = handle.getValueState("clock", "clock double, offset long")
        self.events = handle.getListState("journal", "key string, offset long, record string") if self.journal else None

    def _now(self, timerValues) -> At:  # noqa: N803
        stored = At(*self.at.get()) if self.at.exists() else At(float("-inf"), 0)
        return stored if self.clock == "event" else At(timerValues.getCurrentProcessingTimeInMs() / 1000, stored.offset)

    def _told(self, group, rows) -> Iterator[Row]:
        """``rows``, tuples of ``_TOLD``, as arrays."""
        topic, partition, _ = group
        columns = [[] for _ in _TOLD]
        for row in rows:
            for column, value in zip(columns, row):
                column.append(value)
            if len(columns[0]) == TOLD:
                yield _OUT(topic, partition, *columns)
                columns = [[] for _ in _TOLD]
        if columns[0]:
            yield _OUT(topic, partition, *columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        got, now = [], At(*self.at.get()) if self.at.exists() else At(float("-inf"), 0)
        for r in rows:
            if r["now"] is not None:
                now = At(max(now.clock, r["clock"]), max(now.offset, r["now"]))
            else:
                got.extend(zip(r["offset"], r["key"], r["time"], *[r[f"_{i}"] for i in range(len(self.fields))]))
        self.at.update((now.clock, now.offset))
        got.sort(key=lambda r: r[0])
        yield from self._told(key, self._poll(got, timerValues))

    def _poll(self, records: list[tuple], timerValues) -> Iterator[tuple]:  # noqa: N803
        """Fold records (offset, key, time, fields) by offset, fire the timers that are due, once for each key, and tell the smallest hold. One pass over the segment's keys; each is written once."""
        now, live, events, fields = self._now(timerValues), {}, [], ("offset", *self.fields)
        wall = None if self.clock == "event" else timerValues.getCurrentProcessingTimeInMs() / 1000
        moved, there, out, changed = {r[1] for r in records}, set(), [], []
        low, flushed = None, False

        def hold(at: int | None) -> None:
            nonlocal low
            low = at if low is None else low if at is None else min(low, at)

        def settle(k, held: _Key) -> bool:
            """Fire a key's timer if it is due; whether it flushed."""
            before, stays = held.timers.persisted, True
            if held.timers.next_fire is not None and held.timers.next_fire <= now.clock:

                def flush():
                    if held.dirty:
                        out.append((k, "flush", held.offset, None, None, _text(held.state), now.offset))

                stays = self.policy.fire(held.timers, now, flush)
                if held.timers.persisted is not before:
                    held.dirty = False
                if not stays:
                    out.append((k, "unload", held.offset, None, None, _text(held.state), None))
            changed.append((k, held.dump(self.serde) if stays else None))
            if stays:
                hold(held.timers.hold)
            return held.timers.persisted is not before

        for (k,), row in self.keys.iterator():
            if k in moved:
                live[k] = _Key.load(row, self.serde)
                there.add(k)
            elif row[9] is not None and row[9] <= now.clock:
                flushed |= settle(k, _Key.load(row, self.serde))
                there.add(k)
            else:
                hold(row[8])
        for offset, k, time, *values in records:
            at = At(time if wall is None else wall, offset)
            held = live.get(k)
            if held is None:
                held = live[k] = _Key(self.policy.begin(at))
            if held.offset is not None and offset <= held.offset:  # delivered again
                continue
            record, before = dict(zip(fields, (offset, *values))), held.state
            told = _text(before) if self.steps else None
            held.state, held.offset, held.dirty = self.step(before, record), offset, True
            held.timers.processed = at
            if self.steps or self.journal:
                text = record_text(record)
                if self.journal:
                    events.append((k, offset, text))
                if self.steps:
                    yield k, "fold", offset, told, text, _text(held.state), None
        gone = set()
        for k, held in live.items():
            if held.state is not None:
                flushed |= settle(k, held)
                continue
            gone.add(k)
            changed.append((k, None))
            if held.timers.persisted is not None:
                yield k, "gone", held.offset, None, None, None, None
        for k, row in changed:
            if row is not None:
                self.keys.updateValue((k,), row)
            elif k in there:
                self.keys.removeKey((k,))
        if self.journal:
            yield from self._journal(events, gone, flushed)
        yield from out
        yield None, "hold", now.offset, None, None, None, low
        if self.clock == "processing":
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if low is not None:
                self.handle.registerTimer(int((now.clock + self.policy.fire_every) * 1000))

    def _journal(self, events: list[tuple], gone: set, flushed: bool) -> Iterator[tuple]:
        """Tell the events that no flush has written, if there was one now, or keep them; those of keys that are gone are forgotten."""
        events = [e for e in events if e[0] not in gone]
        if (flushed or gone) and self.events.exists():
            events = [*(e for e in map(tuple, self.events.get()) if e[0] not in gone), *events]
            self.events.clear()
        if flushed:
            for k, offset, text in events:
                yield k, "journal", offset, None, text, None, None
        elif events:
            self.events.appendList(events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._told(key, self._poll([], timerValues))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        r = initialState.asDict()
        state, offset = None if r.get("value") is None else json.loads(r["value"]), r.get("offset")
        for e in sorted(r.get("events") or [], key=lambda e: e["offset"]):  # the journal goes through the fold again
            state, offset = self.step(state, json.loads(e["record"])), e["offset"]
        if state is None:
            return
        clock = r["timestamp"].timestamp() if r.get("timestamp") is not None and self.clock == "event" else 0.0 if self.clock == "event" else timerValues.getCurrentProcessingTimeInMs() / 1000
        hold = offset + 1 if r.get("hold") is None else r["hold"]
        timers = self.policy.begin(At(clock, hold), At(clock, hold))
        self.keys.updateValue((r["key"],), _Key(timers, offset, state).dump(self.serde))

    def close(self) -> None:
        pass


def dealt(log: DataFrame, keep, fields: tuple[str, ...], segments: int) -> DataFrame:
    """What a segment gets, from one pass over the log: its records put together in rows of arrays, and, from each task for all segments of a partition, the largest timestamp (clock) and one past the last offset (now) of all that was read of it."""
    seconds = lambda c: pc.divide(pc.cast(c, pa.int64()).cast(pa.float64(), safe=False), 1e6)
    names = {f"_{i}": f for i, f in enumerate(fields)}
    rows = log.select("topic", "partition", segment_of(segments).alias("segment"), "offset", "key", F.col("timestamp").alias("time"), *[F.col(f).alias(n) for n, f in names.items()], F.coalesce(F.col("key").isNotNull() & (F.lit(True) if keep is None else keep), F.lit(False)).alias("kept"))
    types = {f.name: f.dataType for f in rows.schema} | {"time": DoubleType()}
    lists = ("offset", "key", "time", *names)
    schema = StructType([*[StructField(c, types[c]) for c in GROUP], *[StructField(c, ArrayType(types[c])) for c in lists], StructField("clock", DoubleType()), StructField("now", LongType())])

    def run(batches):
        for table in gathered(batches):
            table = table.set_column(table.schema.get_field_index("time"), "time", seconds(table.column("time")))
            ends = table.group_by(["topic", "partition"]).aggregate([("time", "max"), ("offset", "max")])
            told = pa.table({"topic": ends.column("topic"), "partition": ends.column("partition"), "clock": ends.column("time_max"), "now": pc.add(ends.column("offset_max"), 1)})
            own = pieces(table.filter(table.column("kept")).drop_columns("kept"), GROUP, "offset")
            both = pa.concat_tables([own, told], promote_options="default")
            yield from both.select([f.name for f in schema]).to_batches()

    every = F.when(F.col("now").isNull(), F.array("segment")).otherwise(F.sequence(F.lit(0), F.lit(segments - 1)))
    return rows.mapInArrow(run, schema).withColumn("segment", F.explode(every))


def segment_of(segments: int):
    return F.pmod(F.xxhash64("key"), F.lit(segments)).cast("int")


def flow_stream(log: DataFrame, step: Callable, fields: tuple[str, ...], policy: TimerPolicy, keep=None, segments: int = SEGMENTS, initial: DataFrame | None = None, serde: Serde = JSON, clock: str = "event", journal: bool = False, steps: bool = True) -> DataFrame:
    """The rows of ``SegmentFlow`` over a log, a stream or not. Records without a key, and those that ``keep`` (a Column) leaves out, are not folded but move the partition's clock and offset.

    ``initial`` has topic, partition, key, offset, value (JSON) or events (the
    journal: array of offset and record), and may have timestamp and hold. The
    timers of a recovered key without a timestamp are due at once.
    """
    log.sparkSession.streams.active  # noqa: B018  the state store's coordinator starts with the first use of streams
    started = None if initial is None else initial.withColumn("segment", segment_of(segments)).groupBy(*GROUP)
    out = dealt(log, keep, fields, segments).groupBy(*GROUP).transformWithState(
        statefulProcessor=SegmentFlow(step, fields, policy, serde, clock, journal, steps), outputStructType=StructType.fromDDL(_ARRAYS), outputMode="Update", timeMode="None" if clock == "event" else "ProcessingTime", initialState=started
    )
    return unpacked(out, *_TOLD)


class FlowSink:
    """A ``foreachBatch`` sink for the rows of ``flow_stream``: journals, then states and offsets in one transaction. A repeated batch changes nothing.

    ``journal`` is a table of JOURNAL, if events are kept. A partition's offset
    moves only with a batch in which all of its segments told their holds.
    """

    JOURNAL = "topic string, partition int, key string, offset long, record string"

    def __init__(self, changelog: Changelog, generation: int, journal: Table | None = None, segments: int = SEGMENTS):
        self.changelog, self.generation, self.journal, self.segments = changelog, generation, journal, segments

    def __call__(self, outputs: DataFrame, batch_id: int) -> None:
        outputs = outputs.persist()
        try:
            holds = outputs.where("kind = 'hold'").groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("hold"), F.max("offset")).alias("at"))
            told = {f"{r['topic']}-{r['partition']}": r["at"] for r in holds.where(F.col("n") >= self.segments).collect()}  # one row a partition
            before = self.changelog.offsets()
            offsets = {name: at for name, at in told.items() if at > before.get(name, -1)}
            gone = outputs.where("kind = 'gone'")
            if self.journal is not None:
                if not gone.isEmpty():
                    self.journal.delete(gone.select("topic", "partition", "key"))
                events = outputs.where("kind = 'journal'")
                if not events.isEmpty():
                    self.journal.upsert(events.select("topic", "partition", "key", "offset", "record"))
            states = outputs.where("kind in ('flush', 'gone')")
            if offsets or not states.isEmpty():
                self.changelog.commit(states.select("topic", "partition", "key", "offset", F.col("after").alias("value")), self.generation, offsets)
        finally:
            outputs.unpersist()

    def recover(self) -> tuple[DataFrame | None, dict[str, dict[str, int]]]:
        """(what to start from, by state or by journal; offsets to read the log from). None and {} for a new flow."""
        start: dict[str, dict[str, int]] = {}
        for name, at in self.changelog.offsets().items():
            topic, _, partition = name.rpartition("-")
            start.setdefault(topic, {})[partition] = at
        if not start:
            return None, {}
        holds = F.create_map(*[F.lit(x) for item in self.changelog.offsets().items() for x in item])
        hold = holds[F.concat_ws("-", "topic", F.col("partition").cast("string"))].alias("hold")
        if self.journal is None:
            return self.changelog.read().select("*", hold), start
        events = self.journal.read().groupBy("topic", "partition", "key").agg(F.array_sort(F.collect_list(F.struct("offset", "record"))).alias("events"))
        return events.select("*", hold), start
