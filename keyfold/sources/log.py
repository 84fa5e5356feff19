"""Logs: their schema, adapters from tables and brokers, and scans over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A record as a broker delivers it.
LOG_SCHEMA = "topic string, partition int, offset long, timestamp timestamp, timestamp_type string, headers array<struct<key:string,value:binary>>, key string, value binary"
#: Consumer defaults: nothing is committed by the client, and a new group starts at the earliest offset.
CONSUMER_DEFAULTS = {"startingOffsets": "earliest", "kafka.isolation.level": "read_committed", "failOnDataLoss": "true"}
RECORD = ("topic", "partition", "offset", "timestamp", "key")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_log(df: DataFrame, topic: str, partition: Column, offset: Column, timestamp: Column, key: Column, *values: Column) -> DataFrame:
    """A log over the rows of a table; ``values`` are further columns to carry."""
    return df.select(F.lit(topic).alias("topic"), partition.cast("int").alias("partition"), offset.cast("long").alias("offset"), timestamp.alias("timestamp"), key.cast("string").alias("key"), *values)


def events_log(spark: SparkSession, sf_dir: str, *values: str, partitions: int = 4) -> DataFrame:
    """The ``events`` table as a log: one record an event, keyed by user."""
    return as_log(table(spark, sf_dir, "events"), "events", F.pmod("user_id", F.lit(partitions)), F.col("event_id"), F.col("ts"), F.col("user_id"), *[F.col(v) for v in values])


def orders_log(spark: SparkSession, sf_dir: str, *values: str, partitions: int = 4) -> DataFrame:
    """The ``orders`` table as a second topic, keyed by customer."""
    return as_log(table(spark, sf_dir, "orders"), "orders", F.pmod("o_custkey", F.lit(partitions)), F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_custkey"), *[F.col(v) for v in values])


def read_log(spark: SparkSession, fmt: str, topics: list[str], streaming: bool = False, schema: str = LOG_SCHEMA, **options: str) -> DataFrame:
    """A log from a broker ("kafka", if its connector is installed) or from files of log records (any file format)."""
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        df = reader.format(fmt).options(**(CONSUMER_DEFAULTS | {"subscribe": ",".join(topics), "includeHeaders": "true"} | options)).load()
        return df.select("topic", "partition", "offset", "timestamp", F.when(F.col("timestampType") == 1, "A").otherwise("C").alias("timestamp_type"), "headers", F.decode("key", F.lit("UTF-8")).alias("key"), "value")
    path = options.pop("path")
    return reader.format(fmt).schema(schema).options(**options).load(path).where(F.col("topic").isin(*topics))


def bounded(log: DataFrame, ends: dict[tuple[str, int], int]) -> DataFrame:
    """Records below the end offset that was fixed for each partition before the scan; others are left out."""
    cond = F.lit(False)
    for (topic, partition), end in sorted(ends.items()):
        cond = cond | ((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") < end))
    return log.where(cond)


def high_watermarks(log: DataFrame) -> DataFrame:
    """topic, partition, end: one past the last offset."""
    return log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end"))


def repeat(log: DataFrame, times: int) -> DataFrame:
    """The same records in every of ``times`` polls, with a batch_id; for tests."""
    return log.withColumn("batch_id", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def compacted(log: DataFrame, value: str, is_tombstone: Column | None = None, by: tuple[str, ...] = ("topic", "partition", "key")) -> DataFrame:
    """The last value of each key of a changelog. A null value (or ``is_tombstone``) deletes the key; records without key are ignored.

    ``max_by`` combines on the map side, so a key of any size costs one row a task.
    """
    dead = F.col(value).isNull() if is_tombstone is None else is_tombstone
    last = log.where("key is not null").groupBy(*by).agg(F.max("offset").alias("offset"), F.max_by(F.struct(F.col(value).alias("v"), dead.alias("dead")), "offset").alias("__last"))
    return last.where("not __last.dead").select(*by, "offset", F.col("__last.v").alias(value))
