"""Tables of keys, journals and snapshots, as Parquet folders of immutable rows.

A write adds one folder with the rows that changed (a deletion adds tombstones)
and then a numbered pointer file that lists the folders which make up the
table. A pointer is created only if its number is free and none is ever
deleted, so a reader sees the old rows or the new ones, a job that dies leaves
the table as it was, and of two writers the later one notices and goes again.
Folders are merged into one after ``COMPACT`` writes, so a micro-batch costs
what it changes. A deletion by some columns adds those columns' values alone.

A table with ``cluster`` columns lays its rows out in their order, in files of
``FILE_ROWS``, and keeps an index beside each folder: for each file the least
and largest value of each of these columns and, for one column, a Bloom filter.
``scan`` opens only the files that can hold what is asked for.

Schemas grow: a pointer carries the columns of all that was ever written, and
its writers' own are merged into them. A table opened with more columns reads
old rows with nulls there; one opened with fewer sees, and keeps when it merges
folders, what others have added. Fields of structs are merged likewise, and
numbers become wider types of their kind. Other changes are refused.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that a table gathers before they are merged, and tries of a writer that others overtake.
COMPACT, ATTEMPTS = 16, 20
#: What parts a folder of many transactions from the number of the last one that counts.
UPTO = "/txn<="
#: Rows of a file of a clustered table.
FILE_ROWS = 100_000
#: Bits of each of a Bloom filter's two bitmaps (fixed by Spark's bitmap functions).
BLOOM_BITS = 32_768

KEY_COLUMNS = ("application_id", "group_id", "topic", "partition", "key")
SCHEMAS = {
    "keys": "application_id string, group_id string, segment long, topic string, partition int, key string, created timestamp, created_date date, metadata string",
    "records": "application_id string, group_id string, topic string, partition int, key string, offset long, created timestamp, timestamp timestamp, timestamp_type string, headers map<string,string>, metadata string, value binary",
    "snapshots_v2": "application_id string, group_id string, topic string, partition int, key string, offset long, created timestamp, metadata string, value binary",
}


class SchemaConflict(Exception):
    """A writer's columns do not go together with those that a table has."""


#: Types that files of a narrower one can be read as (fixed by Spark's Parquet reader).
WIDER = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3}, {"float": 0, "double": 1}


def merged_type(a: T.DataType, b: T.DataType, at: str = "") -> T.DataType:
    """The type as which values of both can be read; fields of ``a`` come first. SchemaConflict if there is none."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        theirs, own = {f.name: f for f in b}, {f.name for f in a}
        out = [T.StructField(f.name, merged_type(f.dataType, theirs[f.name].dataType, f"{at}.{f.name}") if f.name in theirs else f.dataType) for f in a]
        return T.StructType(out + [T.StructField(f.name, f.dataType) for f in b if f.name not in own])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged_type(a.elementType, b.elementType, f"{at}[]"))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(merged_type(a.keyType, b.keyType, f"{at}.key"), merged_type(a.valueType, b.valueType, f"{at}.value"))
    x, y = a.simpleString(), b.simpleString()
    for kind in WIDER:
        if x in kind and y in kind:
            return a if kind[x] >= kind[y] else b
    if x != y:
        raise SchemaConflict(f"{at[1:]} is {x} and {y}")
    return a


class Table:
    """One table; ``identity`` names the columns that make a row unique, ``cluster`` those in whose order rows lie in files, ``bloom`` the one that has Bloom filters."""

    def __init__(self, spark: SparkSession, path: str, schema: str, identity: tuple[str, ...], cluster: tuple[str, ...] = (), bloom: str | None = None):
        self.spark, self.path, self.schema, self.identity = spark, path.rstrip("/"), schema, identity
        self.cluster, self.bloom, self._held_fs, self._path, self._local = cluster, bloom, None, None, None
        self._own = T._parse_datatype_string(schema)

    def _fs(self, path: str):
        if self._held_fs is None:
            self._path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        p = self._path(path)
        if self._held_fs is None:
            self._held_fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            self._local = self._path(self.path).toUri().getPath() if self._held_fs.getScheme() == "file" else None
        return self._held_fs, p

    def _pointers(self) -> list[int]:
        """Numbers of the pointers, whether they were finished or not."""
        fs, p = self._fs(f"{self.path}/pointers")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []

    def _there(self, number: int) -> bool:
        if self._local:
            return os.path.exists(f"{self._local}/pointers/{number:012d}")
        fs, p = self._fs(f"{self.path}/pointers/{number:012d}")
        return fs.exists(p)

    def _claim(self, number: int):
        """A new file for pointer ``number``, open; None if there is one. On a local disk Python makes it, since Hadoop starts a process for each file's mode."""
        try:
            if not self._local:
                fs, p = self._fs(f"{self.path}/pointers/{number:012d}")
            if self._local is None:
                return fs.create(p, False)
            os.makedirs(f"{self._local}/pointers", exist_ok=True)
            return open(f"{self._local}/pointers/{number:012d}", "xb")
        except FileExistsError:
            return None
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return None
            raise

    def _highest(self) -> int:
        """The highest number in use, -1 if there is none: numbers follow one another and none is freed, so few of them are looked at."""
        low, high = -1, 0
        while self._there(high):
            low, high = high, 2 * high + 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self._there(mid) else (low, mid)
        return low

    def _content(self, number: int) -> dict:
        """Folders and notes of a pointer; empty if its writer died, or has yet to write it."""
        fs, p = self._fs(f"{self.path}/pointers/{number:012d}")
        if not fs.getFileStatus(p).getLen():
            return {}
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _state(self) -> tuple[int, dict]:
        """(highest number in use, content of the newest finished pointer)."""
        highest = self._highest()
        for n in range(highest, -1, -1):
            if content := self._content(n):
                return highest, content
        return highest, {"folders": [], "notes": {}}

    def _point(self, number: int, base: dict, content: dict, sure: bool = False) -> bool:
        """Create pointer ``number``; False if another writer was first, or has changed the table since ``base`` was read. ``sure``: the pointer just before is our own, with ``base``."""
        out = self._claim(number)
        if out is None:
            return False
        try:
            # Another writer may have finished in the meantime, but hardly if the pointer just before ours is ``base``.
            late = not sure and not (number and self._content(number - 1) == base) and self._state()[1] != base
            if not late:
                out.write(json.dumps(content).encode())
        finally:
            out.close()
        return not late and not self._there(number + 1)

    def _commit(self, make: Callable[[dict], dict], known: tuple[int, dict] | None = None) -> tuple[int, dict]:
        """Move to ``make(content)``, starting again if another writer came between; the number and content of the pointer that was made.

        Repeating a write changes nothing. ``known`` is what this method gave last, for a writer that goes on at once.
        """
        for _ in range(ATTEMPTS):
            number, base = known or self._state()
            content = make(base)
            content["schema"] = base["schema"] if known else self._known(base).json()
            ours = self._point(number + 1, base, content) if known is None else self._point(number + 1, base, content, sure=True)
            if ours:
                return number + 1, content
            known = None
        raise OSError(f"{self.path} is written to by too many others")

    def _known(self, content: dict) -> T.StructType:
        """Columns that the table has: its own, and those that others wrote."""
        there = content.get("schema")
        return merged_type(self._own, T.StructType.fromJson(json.loads(there))) if there else self._own

    def _write(self, rows: DataFrame, columns: list[str] | None = None) -> str:
        name = f"v-{uuid.uuid4().hex}"
        rows = rows.select(*(columns or self._columns()), F.lit(False).alias("__gone"))
        if not self.cluster:
            rows.write.parquet(f"{self.path}/{name}")
            return name
        laid = rows.repartitionByRange(*self.cluster).sortWithinPartitions(*self.cluster)
        laid.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.path}/{name}")
        self._index(name)
        return name

    def _index(self, name: str) -> None:
        """One row a file of a folder: its name, ranges of the cluster columns, two bitmaps of hashes of the ``bloom`` column."""
        about = [f(c).alias(f"{n}_{c}") for c in self.cluster for n, f in (("min", F.min), ("max", F.max))]
        if self.bloom:
            about += [F.bitmap_construct_agg(_bloom_place(F.col(self.bloom), seed)).alias(f"bits_{seed}") for seed in (1, 2)]
        rows = self._part(name).select(*dict.fromkeys([*self.cluster, *([self.bloom] if self.bloom else [])]), F.col("_metadata.file_name").alias("__file"))
        rows.groupBy("__file").agg(*about).coalesce(1).write.parquet(f"{self.path}/i-{name[2:]}")

    def files(self, equals: dict[str, object]) -> dict[str, tuple[list[str], int]]:
        """For each indexed folder the files that may hold rows with these values, and how many files it has. The names alone come to the driver."""
        out = {}
        for name in self._state()[1]["folders"]:
            if not self.cluster or not name.startswith("v-") or "/" in name:
                continue
            index, hit = self.spark.read.parquet(f"{self.path}/i-{name[2:]}"), F.lit(True)
            for c, v in equals.items():
                if c in self.cluster:
                    hit = hit & (F.lit(v) >= F.col(f"min_{c}")) & (F.lit(v) <= F.col(f"max_{c}"))
                if c == self.bloom:
                    for seed in (1, 2):
                        place = _bloom_place(F.lit(v), seed)
                        byte = F.conv(F.hex(F.substring(f"bits_{seed}", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
                        hit = hit & (F.getbit(byte, (place % 8).cast("int")) == 1)
            found = index.select("__file", F.coalesce(hit, F.lit(False)).alias("hit"))
            out[name] = [r["__file"] for r in found.where("hit").collect()], index.count()
        return out

    def scan(self, **equals: object) -> DataFrame:
        """Rows with these values (of identity columns), from the files that may hold them."""
        if odd := set(equals) - set(self.identity) - set(self.cluster):
            raise ValueError(f"{sorted(odd)} are no identity columns of the table")
        rows = self._merged(self._state()[1], {name: found for name, (found, _) in self.files(equals).items()})
        for c, v in equals.items():
            rows = rows.where(F.col(c) == F.lit(v))
        return rows

    def _columns(self) -> list[str]:
        return self._own.names

    def _add(self, name: str) -> None:
        self._commit(lambda base: base | {"folders": [*base["folders"], name]})
        self.compact()

    def compact(self, most: int = COMPACT) -> bool:
        """Merge the folders into one if there are ``most``. Left to others if they write in the meantime."""
        number, base = self._state()
        if len(base["folders"]) < most:
            return False
        known = self._known(base)
        return self._point(number + 1, base, {"folders": [self._write(self._merged(base), known.names)], "notes": base["notes"], "schema": known.json()})

    def _part(self, name: str, files: list[str] | None = None, known: T.StructType | None = None, burst: bool = False) -> DataFrame:
        schema = T.StructType([*(known or self._own), T.StructField("__gone", T.BooleanType()), *([T.StructField("__txn", T.LongType())] if burst else [])])
        paths = [f"{self.path}/{name}"] if files is None else [f"{self.path}/{name}/{f}" for f in files]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _merged(self, content: dict, files: dict[str, list[str]] | None = None) -> DataFrame:
        """Rows of a pointer's folders, the last one of each identity, without those that are gone.

        The first folder is the large one. Its rows are not gathered again: those
        that later folders replace or delete are left out by an anti join, for
        which AQE broadcasts the later folders' identities if they are few.
        """
        folders, known = content["folders"], self._known(content)
        if not folders:
            return self.spark.createDataFrame([], known)
        columns, base, newer = known.names, None, None
        rest = [c for c in columns if c not in self.identity]
        for k, name in enumerate(folders):
            if name.startswith("d-"):
                gone = self.spark.read.parquet(f"{self.path}/{name}")
                base, newer = (None if rows is None else without(rows, gone) for rows in (base, newer))
                continue
            name, _, upto = name.partition(UPTO)
            part = self._part(name, (files or {}).get(name), known, burst=bool(upto))
            if not upto and base is None and newer is None:
                base = part.where("not __gone").drop("__gone")
            else:
                part = part.where(F.col("__txn") <= int(upto)) if upto else part.withColumn("__txn", F.lit(0).cast("long"))
                part = part.withColumn("__at", F.struct(F.lit(k).alias("folder"), F.col("__txn").alias("txn"))).drop("__txn")
                newer = part if newer is None else newer.unionByName(part)
        if newer is None:
            return self.spark.createDataFrame([], known) if base is None else base
        last = newer.groupBy(*self.identity).agg(F.max_by(F.struct(*rest, "__gone"), "__at").alias("__row"))
        live = last.where("not __row.__gone").select(*[F.col(c) if c in self.identity else F.col(f"__row.{c}").alias(c) for c in columns])
        return live if base is None else without(base, newer.select(*self.identity)).unionByName(live)

    def create(self) -> Table:
        """Does nothing if the table is there."""
        if not self._state()[1]["folders"]:
            self.replace(self.spark.createDataFrame([], self.schema))
        return self

    def truncate(self) -> None:
        self.replace(self.spark.createDataFrame([], self.schema))

    def read(self) -> DataFrame:
        return self._merged(self._state()[1])

    def replace(self, rows: DataFrame) -> None:
        name = self._write(rows)
        self._commit(lambda base: base | {"folders": [name]})

    def upsert(self, rows: DataFrame, order: Column | None = None) -> None:
        """Last write wins: new rows replace old ones of the same identity; among the new ones the largest ``order`` stays."""
        self._add(self._write(upserted(rows.limit(0), rows, self.identity, order)))

    def delete(self, keys: DataFrame) -> None:
        """Delete all rows that share the columns of ``keys``. The table itself is not read: the keys are added as a folder that deletes from those before it."""
        name = f"d-{uuid.uuid4().hex}"
        keys.distinct().write.parquet(f"{self.path}/{name}")
        self._add(name)

    def vacuum(self) -> int:
        """Remove folders that the newest pointer does not list; how many. Only while nothing reads or writes."""
        fs, p = self._fs(self.path)
        keep, n = {name.split("/")[0][2:] for name in self._state()[1]["folders"]}, 0
        for f in fs.listStatus(p):
            kind, name = f.getPath().getName()[:2], f.getPath().getName()[2:]
            if kind in ("v-", "d-", "i-") and name not in keep:
                fs.delete(f.getPath(), True)
                n += kind != "i-"
        return n

    def live(self, now: Column, ttl_seconds: int | None) -> DataFrame:
        """Rows that have not outlived the table's time to live."""
        rows = self.read()
        return rows if ttl_seconds is None else rows.where(F.col("created") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > now)


class Fenced(Exception):
    """A writer of an older generation tried to commit."""


class Changelog(Table):
    """Snapshots written in transactions, with the input offsets that they stand for.

    A transaction is one folder of rows and one pointer that names it, the
    writer's generation and the next offsets to read: all of it is seen or
    none. Rows of a transaction that never got its pointer are never read. A
    null value is a tombstone. A writer whose generation is older than the last
    committed one is rejected before it changes anything.
    """

    def __init__(self, spark: SparkSession, path: str, value: str = "string"):
        super().__init__(spark, path, f"topic string, partition int, key string, offset long, value {value}", ("topic", "partition", "key"))

    def _fenced(self, base: dict, generation: int, folders: list[str], offsets: dict[str, int]) -> dict:
        """``base`` and a transaction; Fenced if a younger writer has committed."""
        notes, there = base["notes"], base["folders"]
        if notes.get("generation", -1) > generation:
            raise Fenced(f"generation {generation} after {notes['generation']}")
        bursts = [name.partition(UPTO)[0] for name in folders if UPTO in name]
        if there and UPTO in there[-1] and there[-1].partition(UPTO)[0] in bursts:  # it goes on
            there = there[:-1]
        return {"folders": [*there, *folders], "notes": {"generation": generation, "offsets": notes.get("offsets", {}) | offsets}}

    def _last(self, writes: DataFrame, *by: str) -> DataFrame:
        last = writes.groupBy(*by, *self.identity).agg(F.max_by(F.struct("offset", "value"), "offset").alias("__row")).select(*by, *self.identity, "__row.*")
        return last.select(*by, *self._columns(), F.col("value").isNull().alias("__gone"))

    def commit(self, writes: DataFrame, generation: int, offsets: dict[str, int]) -> None:
        """Write rows (topic, partition, key, offset, value) and advance ``offsets`` ("topic-partition": next offset) in one step."""
        name = f"v-{uuid.uuid4().hex}"
        self._last(writes).write.parquet(f"{self.path}/{name}")
        self._commit(lambda base: self._fenced(base, generation, [name], offsets))
        self.compact()

    def commit_all(self, writes: DataFrame, generation: int, txn: str = "txn", offsets: dict[int, dict[str, int]] | None = None) -> int:
        """Commit many transactions, which the column ``txn`` numbers; how many.

        One job writes the rows of all of them to one folder, each transaction's by
        one task. Then their pointers follow in the order of their numbers, each
        with the number up to which the folder counts and the offsets after it:
        those of ``offsets``, or, by one more job, one past the transaction's last
        in each partition. So a reader sees all of the first transactions and
        nothing of the others; a writer that is fenced or dies in between has
        committed those. A pointer's size does not depend on how many there are,
        and the offsets come to the driver a part at a time.
        """
        name = f"v-{uuid.uuid4().hex}"
        rows = writes.select(F.col(txn).cast("long").alias("__txn"), *self._columns())
        if offsets is not None:
            rows = rows.join(self.spark.createDataFrame([(k,) for k in offsets], "__txn long"), "__txn", "left_semi")
        self._last(rows.repartition("__txn"), "__txn").sortWithinPartitions("__txn").write.parquet(f"{self.path}/{name}")
        at, n = None, 0
        for k, nexts in self._nexts(name) if offsets is None else sorted(offsets.items()):
            moved = {"moved": {"txn": k, "offsets": nexts}}
            at, n = self._commit(lambda base, k=k, nexts=nexts, moved=moved: self._fenced(base, generation, [f"{name}{UPTO}{k}"], nexts) | moved, at), n + 1
        self.compact()
        return n

    def _nexts(self, name: str) -> Iterator[tuple[int, dict[str, int]]]:
        """(number, next offsets) of each transaction of a folder, in their order."""
        parts = self._part(name, burst=True).groupBy("__txn", "topic", "partition").agg((F.max("offset") + 1).alias("next"))
        place = F.concat_ws("-", "topic", F.col("partition").cast("string"))
        txns = parts.groupBy("__txn").agg(F.map_from_entries(F.collect_list(F.struct(place, "next"))).alias("offsets"))
        for r in txns.orderBy("__txn").toLocalIterator():
            yield r["__txn"], r["offsets"]

    def history(self) -> DataFrame:
        """txn, topic, partition, committed: what each pointer of ``commit_all`` has moved on. Tasks read the pointers."""
        schema = "moved struct<txn:bigint,offsets:map<string,bigint>>"
        found = self.spark.createDataFrame([], schema) if self._highest() < 0 else self.spark.read.schema(schema).json(f"{self.path}/pointers")
        rows = found.where("moved is not null").select("moved.txn", F.explode("moved.offsets").alias("name", "committed"))
        part = lambda k: F.regexp_extract("name", "(?s)^(.*)-([^-]*)$", k)
        return rows.select("txn", part(1).alias("topic"), part(2).cast("int").alias("partition"), "committed")

    def offsets(self) -> dict[str, int]:
        """Next offset to read of each "topic-partition", as committed."""
        return self._state()[1]["notes"].get("offsets", {})


def work_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, below spark.checkpoint.dir; a temporary one if that is unset and all runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{found.rstrip('/')}/keyfold-{uuid.uuid4().hex}" if found else f"file://{tempfile.mkdtemp(prefix='keyfold-')}"


def _bloom_place(value: Column, seed: int) -> Column:
    """Where a value's hash falls in a bitmap."""
    return F.pmod(F.xxhash64(value, F.lit(seed)), F.lit(BLOOM_BITS))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` that share the columns of ``gone`` with none of its rows; nulls are alike."""
    there = gone.select(*[F.col(c).alias(f"__gone_{c}") for c in gone.columns])
    cond = F.lit(True)
    for c in gone.columns:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__gone_{c}"))
    return rows.join(there, cond, "left_anti")


def upserted(old: DataFrame, new: DataFrame, identity: tuple[str, ...], order: Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put over it. Combines on the map side by ``max_by``; nothing is sorted."""
    columns = old.columns
    rest = [c for c in columns if c not in identity]
    stamp = F.lit(0).cast("long") if order is None else order.cast("long")
    both = old.select(*columns, F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b")).alias("__at")).unionByName(new.select(*columns, F.struct(F.lit(1).alias("a"), stamp.alias("b")).alias("__at")))
    picked = both.groupBy(*identity).agg(F.max_by(F.struct(*rest), "__at").alias("__row"))
    return picked.select(*[F.col(c) if c in identity else F.col(f"__row.{c}").alias(c) for c in columns])


@dataclass
class Stores:
    """The three tables of one application and group. ``value`` names the columns of a snapshot, which may be typed ("n bigint, last string"), and may grow."""

    spark: SparkSession
    root: str
    ttl: dict[str, int] = field(default_factory=dict)
    value: str = "value binary"

    def __post_init__(self):
        place = ("application_id", "group_id", "topic", "partition")
        self.keys = Table(self.spark, f"{self.root}/keys", SCHEMAS["keys"], KEY_COLUMNS, (*place, "segment", "key"))
        self.journals = Table(self.spark, f"{self.root}/records", SCHEMAS["records"], (*KEY_COLUMNS, "offset"), (*KEY_COLUMNS, "offset"), "key")
        self.snapshots = Table(self.spark, f"{self.root}/snapshots_v2", SCHEMAS["snapshots_v2"].replace("value binary", self.value), KEY_COLUMNS, KEY_COLUMNS, "key")

    def create(self) -> Stores:
        for t in (self.keys, self.journals, self.snapshots):
            t.create()
        return self

    def all_keys(self, application: str, group: str, topic: str, partition: int, segment: int | None = None) -> DataFrame:
        """Keys of one partition, or of one of its segments: only the files that hold it are opened."""
        at = {"application_id": application, "group_id": group, "topic": topic, "partition": partition}
        return self.keys.scan(**at | ({} if segment is None else {"segment": segment}))

    def journal(self, **key: object) -> DataFrame:
        """One key's journal, by offset."""
        return self.journals.scan(**key).orderBy("offset")

    def snapshot(self, **key: object) -> DataFrame:
        """One key's snapshot: one row, or none."""
        return self.snapshots.scan(**key)


def journal_of(journals: DataFrame, key: dict[str, object]) -> DataFrame:
    """One key's journal, by offset, of a table that is read whole."""
    out = journals
    for c, v in key.items():
        out = out.where(F.col(c) == F.lit(v))
    return out.orderBy("offset")


def changed_only(new: DataFrame, old: DataFrame, by: tuple[str, ...], *values: str) -> DataFrame:
    """Rows of ``new`` whose ``values`` differ from those of ``old``, or that are new: others need no write."""
    before = old.select(*by, F.struct(*values).alias("__old"), F.lit(True).alias("__was"))
    out = new.join(before, list(by), "left").where(F.col("__was").isNull() | ~F.struct(*values).eqNullSafe(F.col("__old")))
    return out.drop("__old", "__was")


def recover(keys: DataFrame, snapshots: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """All known keys with their snapshots, null where none was stored: eager recovery in one join."""
    return keys.select(*by).distinct().join(snapshots, list(by), "left")


def fenced(changelog: DataFrame, by: tuple[str, ...], generation: str = "generation", offset: str = "offset") -> DataFrame:
    """Last state of each key if writers of a stale generation are rejected: a write counts only if no earlier one, in arrival order, has a larger generation."""
    return changelog.groupBy(*by).agg(F.max_by(F.struct(*[c for c in changelog.columns if c not in by]), F.struct(generation, "arrival")).alias("__row")).select(*by, "__row.*")


def last_write_wins(changelog: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The unprotected store: whatever arrives last stays, however old its offset."""
    return changelog.groupBy(*by).agg(F.max_by(F.struct(*[c for c in changelog.columns if c not in by]), "arrival").alias("__row")).select(*by, "__row.*")


#: What each mode saves: its journal, its snapshots.
SAVES = {"events": (True, False), "snapshots": (True, True), "snapshots_only": (False, True), "empty": (False, False)}


def save(mode: str, stores: Stores, records: DataFrame, snapshots: DataFrame) -> None:
    """Persist what the mode keeps: ``records`` to the journal, ``snapshots`` where they differ from those that are stored."""
    journal, snapshot = SAVES[mode]
    if journal:
        stores.journals.upsert(records)
    if snapshot:
        values = T._parse_datatype_string(stores.value).names
        changed = changed_only(snapshots, stores.snapshots.read(), KEY_COLUMNS, *values)
        stores.snapshots.upsert(changed, F.col("offset"))


def restore(mode: str, journals: DataFrame | None, snapshots: DataFrame | None, replay) -> DataFrame | None:
    """States at start: "events" replays the journal, "snapshots" and "snapshots_only" read snapshots, "empty" has none."""
    if mode == "events":
        return replay(journals)
    if mode in ("snapshots", "snapshots_only"):
        return snapshots
    if mode == "empty":
        return None
    raise ValueError(f"unknown mode {mode}")
