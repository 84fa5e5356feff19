"""What happens to records before a fold: filter, re-key, route, place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remap_key(log: DataFrame, new_key: Callable[[Column], Column]) -> DataFrame:
    """A new key from (old key, record); null keys and the partition stay as they are."""
    return log.withColumn("key", F.when(F.col("key").isNotNull(), new_key(F.col("key"))))


def keyed(log: DataFrame) -> DataFrame:
    """Records that a fold sees: those with a key."""
    return log.where("key is not null")


def next_offsets(log: DataFrame) -> DataFrame:
    """topic, partition, next_offset: one past the last record, filtered out, keyless or not."""
    return log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))


def split(log: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """(records to fold, offsets to advance to). Records that the filter skips are not folded but still advance the offset."""
    return keyed(log).where(keep), next_offsets(log)


def route(log: DataFrame, flows: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Give each topic's records to its own flow and put the results together; other topics are dropped."""
    parts = [flow(log.where(F.col("topic") == topic)) for topic, flow in flows.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def explode_events(log: DataFrame, events: Column) -> DataFrame:
    """One row for each event of a record, in their order: the log's columns, ``index`` and ``event``. A record without events gives none, but still advances the offset (next_offsets of the log)."""
    return log.select("*", F.posexplode(events).alias("index", "event"))


def identity_partition(partition: Column) -> Column:
    return partition


def modulo_partition(partition: Column, state_partitions: int) -> Column:
    """Partition of the state topic that holds the state of an input partition."""
    if state_partitions < 1:
        raise ValueError("at least one state partition is needed")
    return F.pmod(partition, F.lit(state_partitions)).cast("int")


def owned(states: DataFrame, source_partition: Column, partition_of_key: Column) -> DataFrame:
    """Of the states in a shared state partition, those whose key the source partition owns."""
    return states.where(partition_of_key == source_partition)


def key_segment(key_hash: Column, segments: int = 10_000) -> Column:
    """Segment of the keys table that a key is stored in: |hash % segments|.

    Use the same count for writing and reading: with fewer, keys of the upper segments are not found.
    """
    if not 1 <= segments <= 10_000:
        raise ValueError("segments must be 1 to 10000")
    return F.abs(key_hash % segments).cast("long")
