"""Timer policies over a log, in batch form, and the same as a state machine of one key.

The clock of a partition is the largest timestamp of its records, its current
offset one past the last of them: both go on while a key is silent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTITION = ("topic", "partition")
KEY = (*PARTITION, "key")


def window_floor(value: Column, size: int) -> Column:
    """Start of the window that a number lies in."""
    return value - F.pmod(value, F.lit(size))


def _beside(log: DataFrame, now: Column) -> DataFrame:
    """Keyed records of ``log`` with ``now``, an aggregate over their partition; one row a partition is broadcast."""
    rows = log.groupBy(*PARTITION).agg(now.alias("now"))
    return log.where("key is not null").join(F.broadcast(rows), list(PARTITION))


def idle_unloads(log: DataFrame, max_idle: str) -> DataFrame:
    """Keys unloaded because their partition's clock passed ``max_idle`` after their last record: key, offset, timestamp, and the timestamp of the record that brings the key back (null: an orphan, none came)."""
    after = F.lead("timestamp").over(Window.partitionBy(*KEY).orderBy("offset"))
    rows = _beside(log, F.max("timestamp")).select(*KEY, "offset", "timestamp", "now", after.alias("next_timestamp"))
    return rows.where(F.coalesce("next_timestamp", "now") > F.col("timestamp") + F.expr(f"interval {max_idle}")).drop("now")


def distance_unloads(log: DataFrame, most: int) -> DataFrame:
    """Keys unloaded because more than ``most`` offsets of the partition passed after their last record: key, offset, behind (offsets to the record that brings the key back, or to the partition's current one)."""
    after = F.lead("offset").over(Window.partitionBy(*KEY).orderBy("offset"))
    rows = _beside(log, F.max("offset") + 1).select(*KEY, "offset", (F.coalesce(after, "now") - F.col("offset")).alias("behind"))
    return rows.where(F.col("behind") > most)


def periodic_persists(log: DataFrame, every: str, value: str) -> DataFrame:
    """What a flush at the end of each period writes: the last value and offset of each key that had records in it, and the hold after it, the partition's current offset then."""
    tick = F.date_trunc(every, "timestamp")
    out = log.where("key is not null").groupBy(*KEY, tick.alias("tick")).agg(F.max("offset").alias("offset"), F.max_by(value, "offset").alias(value))
    current = log.groupBy(*PARTITION, tick.alias("tick")).agg((F.max("offset") + 1).alias("hold"))
    return out.join(current, [*PARTITION, "tick"]).select(*KEY, "tick", "offset", value, "hold")


def persists_and_unloads(log: DataFrame, every: str, max_idle: str, value: str) -> DataFrame:
    """Periodic persists of which each key's last one before it falls idle unloads it: the rows of ``periodic_persists`` with ``unloaded``."""
    last = idle_unloads(log, max_idle).select(*KEY, "offset")
    flushed = periodic_persists(log, every, value)
    gone = flushed.join(last.withColumn("unloaded", F.lit(True)), [*KEY, "offset"], "left")
    return gone.select(*KEY, "tick", "offset", value, "hold", F.coalesce("unloaded", F.lit(False)).alias("unloaded"))


def ttl(rows: DataFrame, created: str, seconds: int, now: Column) -> DataFrame:
    """Rows that have not expired."""
    return rows.where(F.col(created) + F.make_dt_interval(secs=F.lit(seconds)) > now)


@dataclass(frozen=True)
class At:
    """A moment of a partition: its clock in seconds and its current offset."""

    clock: float
    offset: int


@dataclass
class KeyTimers:
    """What a policy knows and changes of one key."""

    committed: At
    hold: int | None = None
    processed: At | None = None
    persisted: At | None = None
    next_fire: float | None = None
    removed: bool = False
    errors: list[Exception] = field(default_factory=list)


@dataclass(frozen=True)
class TimerPolicy:
    """When a key's state is flushed and when it is unloaded.

    ``persist_every`` flushes periodically; ``max_idle`` and ``max_behind``
    flush and unload keys that their partition has left behind; both together
    are the combined policy. Every fire that leaves the key in place registers
    the next one: from now on if states are persisted periodically, else from
    the key's last touch, which may be past already. A flush that succeeds holds the partition's current offset;
    one that fails with ``ignore_errors`` leaves the hold where it was, so that
    nothing behind it is committed, and the key is not unloaded either.
    """

    fire_every: float = 60.0
    persist_every: float | None = None
    max_idle: float | None = None
    max_behind: int | None = None
    flush_on_revoke: bool = False
    ignore_errors: bool = False

    def begin(self, now: At, persisted: At | None = None) -> KeyTimers:
        """A key enters memory, new or recovered: it holds its committed offset and gets a timer even if no record follows."""
        at = persisted or now
        only_persists = self.persist_every is not None and self.max_idle is None and self.max_behind is None
        return KeyTimers(at, at.offset, None, persisted, (now if only_persists else at).clock + self.fire_every)

    def _flush(self, key: KeyTimers, now: At, flush: Callable[[], None]) -> bool:
        try:
            flush()
        except Exception as e:
            if not self.ignore_errors:
                raise
            key.errors.append(e)
            return False
        key.hold, key.persisted = now.offset, now
        return True

    def fire(self, key: KeyTimers, now: At, flush: Callable[[], None]) -> bool:
        """The timer fires at ``now``; whether the key stays in memory."""
        touched = key.processed or key.committed
        flushed = key.persisted or key.committed
        orphan = self.max_idle is not None and now.clock > touched.clock + self.max_idle
        orphan = orphan or self.max_behind is not None and now.offset - touched.offset > self.max_behind
        due = self.persist_every is not None and now.clock >= flushed.clock + self.persist_every
        done = self._flush(key, now, flush) if orphan or due else False
        if orphan and done:
            key.removed, key.hold, key.next_fire = True, None, None
            return False
        key.next_fire = (touched if self.persist_every is None else now).clock + self.fire_every
        return True

    def revoke(self, key: KeyTimers, now: At, flush: Callable[[], None]) -> bool:
        """The partition is taken away: whether the key was flushed. A key that holds nothing has nothing to flush."""
        if not self.flush_on_revoke or key.hold is None:
            return False
        if self._flush(key, now, flush):
            key.removed, key.hold = True, None
            return True
        return False
