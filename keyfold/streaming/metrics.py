"""Metrics of folds, tables, compressors and queries: counts, sums and largest values by name.

Values are gathered in a Spark accumulator, so a wrapped callable may run on
the driver or in a task. A task that is run again counts again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark import AccumulatorParam
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from keyfold.functions.scalar import Compressor

#: The names under which metrics are published.
NAMES = (
    "fold_apply_duration_seconds",
    "key_flow_count",
    "partition_flow_apply_duration_seconds",
    "partition_flow_triggerTimers_duration_seconds",
    "topic_flow_apply_duration_seconds",
    "topic_flow_add_duration_seconds",
    "key_database_persist_duration_seconds",
    "key_database_get_duration_seconds",
    "key_database_delete_duration_seconds",
    "journal_database_persist_duration_seconds",
    "journal_database_get_duration_seconds",
    "journal_database_delete_duration_seconds",
    "snapshot_database_persist_duration_seconds",
    "snapshot_database_get_duration_seconds",
    "snapshot_database_delete_duration_seconds",
    "kafka_flow_compressor_raw_bytes",
    "kafka_flow_compressor_compressed_bytes",
)


class _Summaries(AccumulatorParam):
    """{name: (count, sum, largest)}."""

    def zero(self, value):
        return {}

    def addInPlace(self, a, b):  # noqa: N802
        for name, (n, total, most) in b.items():
            was = a.get(name, (0, 0.0, float("-inf")))
            a[name] = (was[0] + n, was[1] + total, max(was[2], most))
        return a


class Metrics:
    def __init__(self, spark: SparkSession):
        self._held = spark.sparkContext.accumulator({}, _Summaries())

    def observe(self, name: str, value: float) -> None:
        if name not in NAMES:
            raise ValueError(f"unknown metric {name}")
        self._held.add({name: (1, float(value), float(value))})

    @contextmanager
    def timed(self, name: str):
        at = time.perf_counter()
        try:
            yield
        finally:
            self.observe(name, time.perf_counter() - at)

    def wrap(self, name: str, f: Callable) -> Callable:
        """``f`` with its duration observed, whether it fails or not."""

        def run(*args, **kwargs):
            with self.timed(name):
                return f(*args, **kwargs)

        return run

    def fold(self, step: Callable) -> Callable:
        """A fold callable whose every step is timed."""
        return self.wrap("fold_apply_duration_seconds", step)

    def read(self) -> dict[str, dict[str, float]]:
        """What was observed so far; on the driver."""
        return {name: {"count": n, "sum": total, "max": most} for name, (n, total, most) in sorted(self._held.value.items())}


#: Size of a sketch: its quantiles' ranks are off by about 0.002, within the 0.05 for 0.9 and the 0.005 for 0.99 that summaries promise.
SKETCH = 1_600
#: The quantiles that summaries publish.
QUANTILES = (0.9, 0.99)


def summaries(values: DataFrame, value: str, *labels: str) -> DataFrame:
    """labels, count, sum, max and a mergeable sketch of a measured value: sketched on the map side, so no buffer holds the values."""
    v = F.col(value).cast("double")
    return values.where(v.isNotNull()).groupBy(*labels).agg(F.count(F.lit(1)).alias("count"), F.sum(v).alias("sum"), F.max(v).alias("max"), F.kll_sketch_agg_double(v, SKETCH).alias("sketch"))


def merged(parts: DataFrame, *labels: str) -> DataFrame:
    """Summaries by fewer labels, or of several stretches of time, from those there are; the values are not needed again."""
    return parts.groupBy(*labels).agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch", SKETCH).alias("sketch"))


def quantiles(parts: DataFrame, *labels: str) -> DataFrame:
    """labels, count, sum, q90, q99 and q100 (the exact largest value) of summaries."""
    named = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"q{round(100 * q)}") for q in QUANTILES]
    return parts.select(*labels, "count", "sum", *named, F.col("max").alias("q100"))


class MeasuredTable:
    """A table (``tables.Table`` or ``memory.MemoryTable``) whose writes, reads and deletions are timed; ``kind`` is key, journal or snapshot.

    A read is planned when it is asked for and scanned with the job that uses
    it: only the planning is timed here.
    """

    def __init__(self, table, kind: str, metrics: Metrics):
        self._table, self._kind, self._metrics = table, kind, metrics

    def __getattr__(self, name: str):
        if name in ("_table", "_kind", "_metrics"):  # while it is unpickled
            raise AttributeError(name)
        return getattr(self._table, name)

    def _timed(self, what: str):
        return self._metrics.timed(f"{self._kind}_database_{what}_duration_seconds")

    def read(self) -> DataFrame:
        with self._timed("get"):
            return self._table.read()

    def upsert(self, rows: DataFrame, order: Column | None = None) -> None:
        with self._timed("persist"):
            self._table.upsert(rows, order)

    def delete(self, keys: DataFrame) -> None:
        with self._timed("delete"):
            self._table.delete(keys)


def measured_stores(stores, metrics: Metrics):
    """The same stores, with their three tables measured."""
    stores.keys = MeasuredTable(stores.keys, "key", metrics)
    stores.journals = MeasuredTable(stores.journals, "journal", metrics)
    stores.snapshots = MeasuredTable(stores.snapshots, "snapshot", metrics)
    return stores


class MeasuredCompressor(Compressor):
    """A compressor that observes the sizes of what it packs."""

    def __init__(self, inner: Compressor, metrics: Metrics):
        super().__init__(inner.threshold, inner.header)
        object.__setattr__(self, "metrics", metrics)

    def pack(self, data: bytes) -> bytes:
        out = super().pack(data)
        self.metrics.observe("kafka_flow_compressor_raw_bytes", len(data))
        self.metrics.observe("kafka_flow_compressor_compressed_bytes", len(out))
        return out


class ProgressMetrics(StreamingQueryListener):
    """Batch durations, timer durations and state sizes of running queries, by metric name, in ``seen`` and in ``metrics``.

    A topic is added when its query starts; that lasts until the first progress.
    """

    def __init__(self, metrics: Metrics | None = None, clock: Callable[[], float] = time.monotonic):
        self.metrics, self.clock = metrics, clock
        self.seen: list[dict] = []
        self._started: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._started[str(event.id)] = self.clock()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        row = {
            "partition_flow_apply_duration_seconds": p.durationMs.get("addBatch", 0) / 1000,
            "partition_flow_triggerTimers_duration_seconds": sum(dict(s.customMetrics).get("timerProcessingTimeMs", 0) for s in p.stateOperators) / 1000,
            "topic_flow_apply_duration_seconds": p.durationMs.get("triggerExecution", 0) / 1000,
            "key_flow_count": sum(s.numRowsTotal for s in p.stateOperators),
        }
        started = self._started.pop(str(p.id), None)
        if started is not None:
            row["topic_flow_add_duration_seconds"] = self.clock() - started
        if self.metrics:
            for name, value in row.items():
                self.metrics.observe(name, value)
        self.seen.append({"batch_id": p.batchId, "rows": p.numInputRows} | row)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._started.pop(str(event.id), None)
