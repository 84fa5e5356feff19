"""Offsets that are safe to commit, computed as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTITION = ("topic", "partition")


def offset_to_commit(offset: Column) -> Column:
    """A commit names the next offset to read."""
    return offset + 1


def committable(holds: DataFrame, nexts: DataFrame) -> DataFrame:
    """topic, partition, commit_offset: the smallest offset that a live key holds, else one past the last record.

    ``holds`` has a nullable ``hold`` for each live key (null: it holds none),
    ``nexts`` a ``next_offset`` for each partition. Both sides aggregate first.
    """
    low = holds.groupBy(*PARTITION).agg(F.min("hold").alias("hold"))
    return nexts.join(low, list(PARTITION), "left").select(*PARTITION, F.coalesce("hold", "next_offset").alias("commit_offset"))


def advances(candidates: DataFrame, batch: str = "batch_id", offset: str = "commit_offset") -> DataFrame:
    """Of a partition's candidates in batch order, those above all earlier ones: commits never go back."""
    past = Window.partitionBy(*PARTITION).orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    return candidates.withColumn("__top", F.max(offset).over(past)).where(F.col("__top").isNull() | (F.col(offset) > F.col("__top"))).drop("__top")


def commit_on_revoke(keys: DataFrame, nexts: DataFrame) -> DataFrame:
    """What to commit when partitions are taken away: ``keys`` has hold and flushed (its final flush succeeded). Keys that failed hold; if none did, one past the last record."""
    return committable(keys.where(~F.col("flushed")), nexts)


def wait_holds(log: DataFrame, n: int) -> DataFrame:
    """Hold of each key that waits for n records: the first offset of its unfinished group."""
    by = (*PARTITION, "key")
    keyed = log.where("key is not null")
    place = keyed.select(*by, "offset", F.row_number().over(Window.partitionBy(*by).orderBy("offset")).alias("__k"))  # a running rank: no group is buffered
    return place.groupBy(*by).agg(F.max_by(F.struct("__k", "offset"), "__k").alias("__last"), F.max(F.when((F.col("__k") - 1) % n == 0, F.col("offset"))).alias("hold")).where(F.col("__last.__k") % n != 0).select(*by, "hold")


def numbered(rows: DataFrame, order: str = "offset", block: int = 65_536) -> DataFrame:
    """``rows`` with ``at``, their place in their partition by ``order`` (a number), from 0.

    Rows are counted per block of the order, the counts summed over the few
    blocks before, and places given within blocks: no task takes a whole partition.
    """
    blocks = rows.withColumn("__block", F.floor(F.col(order) / block))
    counts = blocks.groupBy(*PARTITION, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*PARTITION).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*PARTITION, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    within = F.row_number().over(Window.partitionBy(*PARTITION, "__block").orderBy(order)) - 1
    return blocks.withColumn("__in", within).join(starts, [*PARTITION, "__block"]).withColumn("at", F.col("__from") + F.col("__in")).drop("__block", "__in", "__from")


def group_commit(writes: DataFrame, most: int = 256, order: str = "offset") -> DataFrame:
    """Number each partition's writes into transactions of at most ``most``; a transaction's marker is its last offset + 1."""
    txn = numbered(writes, order).withColumn("txn", F.floor(F.col("at") / most))
    return txn.groupBy(*PARTITION, "txn").agg(F.count(F.lit(1)).alias("writes"), (F.max(order) + 1).alias("next_offset"))
