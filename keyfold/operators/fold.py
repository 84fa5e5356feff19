"""The fold algebra as Column expressions.

A fold is a function (state, record) -> state over Columns. Three ways to run:

* ``run``: ordered, by ``aggregate`` over a key's sorted records. JVM-side; a
  key's records of one run are in one array, so it is for bounded batches.
* ``run_sorted``: ordered, streamed through a Python callable over partitions
  sorted by key and offset; one state is in memory at a time, whatever a key's size.
* a ``Monoid``: for states that merge, by partial aggregation on the map side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

KEY = ("topic", "partition", "key")
Merge = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Fold:
    """A fold with a state that is always there."""

    step: Merge

    def contramap(self, f: Callable[[Column], Column]) -> Fold:
        return Fold(lambda s, a: self.step(s, f(a)))

    def contra_collect(self, cond: Callable[[Column], Column], f: Callable[[Column], Column]) -> Fold:
        """A partial function of the input: what it does not match leaves the state as it is."""
        return Fold(lambda s, a: F.when(cond(a), self.step(s, f(a))).otherwise(s))

    def transform_state(self, get: Callable[[Column], Column], put: Merge) -> Fold:
        """Apply to a part of a wider state: ``get`` reads it, ``put`` (wide, part) writes it back."""
        return Fold(lambda s, a: put(s, self.step(get(s), a)))

    def transform(self, get: Merge, put: Callable[[Column, Column, Column], Column]) -> Fold:
        """As transform_state, with the input at hand on both sides."""
        return Fold(lambda s, a: put(s, self.step(get(s, a), a), a))

    def then(self, other: Fold) -> Fold:
        """The second fold runs on the same input and the new state."""
        return Fold(lambda s, a: other.step(self.step(s, a), a))

    def filter(self, cond: Merge) -> Fold:
        """Where (state, input) fails the condition, the state stays."""
        return Fold(lambda s, a: F.when(cond(s, a), self.step(s, a)).otherwise(s))

    @staticmethod
    def set(value: Column) -> Fold:
        return Fold(lambda s, a: value)

    @staticmethod
    def modify(f: Callable[[Column], Column]) -> Fold:
        return Fold(lambda s, a: f(s))


@dataclass(frozen=True)
class FoldOption:
    """A fold whose state may be absent (null); null out deletes."""

    step: Merge

    @staticmethod
    def empty(state_type: str) -> FoldOption:
        return FoldOption(lambda s, a: F.lit(None).cast(state_type))

    @staticmethod
    def modify(f: Merge) -> FoldOption:
        """Runs only where a state is there."""
        return FoldOption(lambda s, a: F.when(s.isNotNull(), f(s, a)))

    def contramap(self, f: Callable[[Column], Column]) -> FoldOption:
        return FoldOption(lambda s, a: self.step(s, f(a)))

    def contra_collect(self, cond: Callable[[Column], Column], f: Callable[[Column], Column]) -> FoldOption:
        return FoldOption(lambda s, a: F.when(cond(a), self.step(s, f(a))).otherwise(s))

    def transform_state(self, get: Callable[[Column], Column], put: Merge) -> FoldOption:
        """Apply to an optional part of a wider state: ``get`` reads it, ``put`` (wide, part) writes it back."""
        return FoldOption(lambda s, a: put(s, self.step(get(s), a)))

    def transform(self, get: Merge, put: Callable[[Column, Column, Column], Column]) -> FoldOption:
        """As transform_state, with the input at hand on both sides."""
        return FoldOption(lambda s, a: put(s, self.step(get(s, a), a), a))

    @staticmethod
    def set(value: Column) -> FoldOption:
        return FoldOption(lambda s, a: value)

    def then(self, other: FoldOption) -> FoldOption:
        """The second fold is skipped, with null, where the first gave null."""

        def both(s: Column, a: Column) -> Column:
            first = self.step(s, a)
            return F.when(first.isNotNull(), other.step(first, a))

        return FoldOption(both)

    def filter(self, cond: Merge) -> FoldOption:
        """Where no state is there the condition is not asked and the fold runs."""
        return FoldOption(lambda s, a: F.when(s.isNull() | cond(s, a), self.step(s, a)).otherwise(s))

    def newer(self, version_of_state: str, version_of_record: str = "offset") -> FoldOption:
        """Skip records whose version is not above the state's: redelivered ones change nothing."""
        return self.filter(lambda s, a: a[version_of_record] > s[version_of_state])


def newer_sequence(fold: FoldOption, state_seq: str = "seq", first: str = "seq_from") -> FoldOption:
    """Skip records whose sequence range does not start above the state's; once there is a state, records without one are skipped."""
    return fold.filter(lambda s, a: F.coalesce(a[first] > s[state_seq], F.lit(False)))


def run(log: DataFrame, fold: Fold | FoldOption, init: Column, fields: tuple[str, ...], by: tuple[str, ...] = KEY, order: tuple[str, ...] = ("offset",), state: str = "state") -> DataFrame:
    """State of each key after its records in ``order``, starting from ``init`` (a typed null for an absent state)."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in (*order, *[f for f in fields if f not in order])])))
    grouped = log.where("key is not null").groupBy(*by).agg(rows.alias("__rows"))
    return grouped.select(*by, F.aggregate("__rows", init, lambda s, a: fold.step(s, a)).alias(state))


def run_sorted(log: DataFrame, step: Callable, schema: str, fields: tuple[str, ...], by: tuple[str, ...] = KEY, order: tuple[str, ...] = ("offset",), to_row: Callable = dict) -> DataFrame:
    """As ``run``, by a Python callable (state or None, record dict) -> state or None.

    The records of a key arrive in order in the batches of one partition and
    only the running state is held. Keys that end with None give no row.
    ``schema`` describes ``by`` and the fields of ``to_row(state)``.
    """
    names = [*by, *[f for f in (*order, *fields) if f not in by]]
    rows = log.where("key is not null").select(*dict.fromkeys(names)).repartition(*by).sortWithinPartitions(*by, *order)
    out_schema = T._parse_datatype_string(schema)

    def go(batches):
        arrow = to_arrow_schema(out_schema)
        key = state = None
        for batch in batches:
            out = []
            for start in range(0, batch.num_rows, 4096):
                for record in batch.slice(start, 4096).to_pylist():  # nulls stay None and integers exact
                    at = tuple(record[c] for c in by)
                    if at != key:
                        if key is not None and state is not None:
                            out.append(dict(zip(by, key)) | to_row(state))
                        key, state = at, None
                    state = step(state, record)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if key is not None and state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(by, key)) | to_row(state)], schema=arrow)

    return rows.mapInArrow(go, out_schema)


@dataclass(frozen=True)
class Monoid:
    """A fold whose states merge: named aggregates, then a projection; ``alive`` tells which keys have a state."""

    aggregates: dict[str, Column]
    state: dict[str, Column]
    alive: Column | None = None

    def run(self, log: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
        out = log.where("key is not null").groupBy(*by).agg(*[c.alias(n) for n, c in self.aggregates.items()])
        if self.alive is not None:
            out = out.where(self.alive)
        return out.select(*by, *[c.alias(n) for n, c in self.state.items()])


def route_folds(log: DataFrame, folds: dict[str, Monoid], by: tuple[str, ...] = KEY) -> DataFrame:
    """Each topic's records folded by its own Monoid, in one scan and one shuffle; other topics are dropped.

    The folds have states of the same names and aggregates of different ones.
    A group works out the aggregates of all folds and takes those of its topic.
    """
    names = [n for fold in folds.values() for n in fold.aggregates]
    if len(set(names)) < len(names) or len({tuple(sorted(fold.state)) for fold in folds.values()}) > 1:
        raise ValueError("folds need aggregates of different names and states of the same")
    grouped = log.where(F.col("key").isNotNull() & F.col("topic").isin(*folds)).groupBy(*by).agg(*[c.alias(n) for fold in folds.values() for n, c in fold.aggregates.items()])
    alive = F.coalesce(*[F.when(F.col("topic") == t, F.lit(True) if fold.alive is None else fold.alive) for t, fold in folds.items()])
    states = [F.coalesce(*[F.when(F.col("topic") == t, fold.state[n]) for t, fold in folds.items()]).alias(n) for n in next(iter(folds.values())).state]
    return grouped.where(alive).select(*by, *states)


def wait_for(n: int) -> FoldOption:
    """Counts records and gives up the state at the n-th: struct(offset, n)."""

    def step(s: Column, a: Column) -> Column:
        count = F.coalesce(s["n"], F.lit(0)) + 1
        return F.when(count < n, F.struct(a["offset"].cast("long").alias("offset"), count.cast("int").alias("n")))

    return FoldOption(step)


def wait_for_monoid(n: int) -> Monoid:
    """wait_for, as an aggregate: the state depends on the number of records and the last offset only."""
    return Monoid({"__n": F.count(F.lit(1)), "__offset": F.max("offset")}, {"offset": F.col("__offset"), "n": (F.col("__n") % n).cast("int")}, F.col("__n") % n != 0)
