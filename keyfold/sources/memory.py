"""Tables in the driver's memory with the interface of ``tables.Table``, for tests and small jobs, and a cache of recovered snapshots."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfold.sources.tables import upserted


class MemoryTable:
    """Rows are kept as a list, so it is for as many as the driver holds."""

    def __init__(self, spark: SparkSession, schema: str, identity: tuple[str, ...]):
        self.spark, self.schema, self.identity = spark, schema, identity
        self.rows: list[tuple] = []

    def create(self) -> MemoryTable:
        return self

    def truncate(self) -> None:
        self.rows = []

    def read(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, self.schema)

    def replace(self, rows: DataFrame) -> None:
        self.rows = [tuple(r) for r in rows.select(*T._parse_datatype_string(self.schema).names).collect()]

    def upsert(self, rows: DataFrame, order: Column | None = None) -> None:
        self.replace(upserted(self.read(), rows, self.identity, order))

    def delete(self, keys: DataFrame) -> None:
        self.replace(self.read().join(keys.distinct(), keys.columns, "left_anti"))

    def live(self, now: Column, ttl_seconds: int | None) -> DataFrame:
        rows = self.read()
        return rows if ttl_seconds is None else rows.where(F.col("created") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > now)


class RecoveredSnapshots:
    """Snapshots read at start, each handed out once: a key takes its own and the cache forgets it, so memory shrinks as keys recover."""

    def __init__(self, rows: Iterable[tuple[Any, Any]]):
        self._held = dict(rows)

    def __len__(self) -> int:
        return len(self._held)

    def take(self, key: Any) -> Any:
        """The key's snapshot, None if there is none or it was taken."""
        return self._held.pop(key, None)


class EntityRegistry:
    """States of live keys for readers beside the fold. ``const`` answers every key alike, ``empty`` none."""

    def __init__(self, get=None):
        self._get, self._states = get, {}

    @classmethod
    def empty(cls) -> EntityRegistry:
        return cls(lambda key: None)

    @classmethod
    def const(cls, value: Any) -> EntityRegistry:
        return cls(lambda key: value)

    def put(self, key: Any, state: Any) -> None:
        """A None state removes the key."""
        if state is None:
            self._states.pop(key, None)
        else:
            self._states[key] = state

    def get(self, key: Any) -> Any:
        return self._get(key) if self._get else self._states.get(key)

    def all(self) -> dict[Any, Any]:
        return dict(self._states)
