"""Stores of a user's own making: what ``StoredFold`` asks of them, and one over any file source that Spark appends to."""

from __future__ import annotations

import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfold.sources.tables import Fenced


class SnapshotStore(Protocol):
    """States of keys, with the input offsets that they stand for. Any class with these methods will do; ``tables.Changelog`` is one."""

    def read(self) -> DataFrame:
        """topic, partition, key, offset, value of every key that has a state."""

    def offsets(self) -> dict[str, int]:
        """Next offset to read of each "topic-partition", as committed."""

    def commit(self, writes: DataFrame, generation: int, offsets: dict[str, int]) -> None:
        """Put rows (topic, partition, key, offset, value; a null value deletes) over the store's and advance ``offsets``, both or neither. Repeating it changes nothing. ``Fenced`` if a writer of a younger generation has committed."""


class AppendStore:
    """States in a source that can only be appended to, such as ORC or JSON files.

    A commit appends its rows, marked with its id, and then one row that names
    the id, the writer's generation and the offsets; rows whose commit has no
    such row are never read. Commits are numbered as they find the store; one
    counts only up to the first commit of a younger generation, which decides
    between two writers that take the same number. Nothing is merged: a key
    costs what was ever written of it, so this suits stores that other programs
    read, and ``Changelog`` the long run. ``value`` is the type of states; if
    it is a struct it may get more fields, which older rows have as nulls.
    """

    def __init__(self, spark: SparkSession, path: str, value: str = "string", source: str = "orc"):
        self.spark, self.path, self.source = spark, path.rstrip("/"), source
        self.schemas = {"states": f"commit string, topic string, partition int, key string, offset long, value {value}", "commits": "commit string, number long, generation long, offsets map<string,bigint>"}

    def create(self) -> AppendStore:
        """Does nothing but add empty files if the store is there."""
        for name, schema in self.schemas.items():
            self._append(name, self.spark.createDataFrame([], schema))
        return self

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.format(self.source).mode("append").save(f"{self.path}/{name}")

    def _load(self, name: str) -> DataFrame:
        return self.spark.read.format(self.source).schema(self.schemas[name]).load(f"{self.path}/{name}")

    def _valid(self) -> DataFrame:
        """Commits that count. The window runs over one row a generation, of which each owner has one."""
        commits = self._load("commits")
        starts = commits.groupBy("generation").agg(F.min("number").alias("first"))
        younger = Window.orderBy(F.desc("generation")).rowsBetween(Window.unboundedPreceding, -1)
        ends = starts.select("generation", F.min("first").over(younger).alias("end"))
        return commits.join(ends, "generation").where("end is null or number < end").drop("end")

    def read(self) -> DataFrame:
        rows = self._load("states").join(self._valid().select("commit", "number"), "commit")
        last = rows.groupBy("topic", "partition", "key").agg(F.max_by(F.struct("offset", "value"), F.struct("number", "offset")).alias("row"))
        return last.select("topic", "partition", "key", "row.*").where("value is not null")

    def offsets(self) -> dict[str, int]:
        found = self._valid().select(F.explode("offsets").alias("name", "at")).groupBy("name").agg(F.max("at").alias("at"))
        return {r["name"]: r["at"] for r in found.collect()}  # one row a partition of the input

    def commit(self, writes: DataFrame, generation: int, offsets: dict[str, int]) -> None:
        number, youngest = self._load("commits").agg(F.max("number"), F.max("generation")).first()
        if youngest is not None and youngest > generation:
            raise Fenced(f"generation {generation} after {youngest}")
        name = uuid.uuid4().hex
        self._append("states", writes.select(F.lit(name).alias("commit"), "topic", "partition", "key", "offset", "value"))
        self._append("commits", self.spark.createDataFrame([(name, 0 if number is None else number + 1, generation, offsets)], self.schemas["commits"]).coalesce(1))
        if self._valid().where(F.col("commit") == name).isEmpty():
            raise Fenced(f"generation {generation} was overtaken")
