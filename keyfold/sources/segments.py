"""A partitioned log in segment files, and a data source that reads it by offsets.

A log is a folder of Parquet segments, each with the records of one topic and
partition between two offsets, in order. ``append`` writes segments in one
Spark job, each task its own, and then a numbered commit that names them; only
named segments are read, so repeated attempts and dead jobs leave no records.
Offsets of a partition only grow, and of two writers one fails.

``SegmentLog`` ("keyfold_log") reads such a log in batches and streams. Ends
are fixed before a scan: a batch's when it is planned (or given), a micro-batch's
with its offsets, which the checkpoint holds for each partition. A task reads
one segment, or a part of it, as Arrow batches; a hot partition has as many
tasks as segments. With ``repeat`` the same records come in every poll.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Offsets that one segment spans at most.
SEGMENT = 100_000
#: Columns that every log has.
PLACE = ("topic", "partition", "offset")
Offsets = dict[str, dict[str, int]]


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _plain(path: str) -> str:
    """A URI that pyarrow knows: Hadoop's file:/x is file:///x."""
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def append(log: DataFrame, path: str, offsets_in_segment: int = SEGMENT) -> int:
    """Add the records of ``log`` (topic, partition, offset and any further columns) to the log at ``path``; how many segments.

    The first append fixes the columns. Records are dealt to tasks by blocks of
    offsets, so that no task takes a whole partition.
    """
    spark, path = log.sparkSession, path.rstrip("/")
    folder, schema = _plain(path), log.schema
    arrow = to_arrow_schema(schema)
    at = [log.columns.index(c) for c in PLACE]

    def write(batches):
        out = key = writer = None
        state: dict = {}

        def close():
            writer.close()
            out.close()
            return pa.RecordBatch.from_pylist([state], schema=pa.schema([("topic", pa.string()), ("partition", pa.int32()), ("first", pa.int64()), ("end", pa.int64()), ("rows", pa.int64()), ("file", pa.string())]))

        for batch in batches:
            topics, partitions, offsets = (batch.column(k) for k in at)
            blocks = pc.floor(pc.divide(pc.cast(offsets, pa.float64()), float(offsets_in_segment)))
            keys = list(zip(topics.to_pylist(), partitions.to_pylist(), blocks.to_pylist()))
            start = 0
            for k in range(1, len(keys) + 1):
                if k < len(keys) and keys[k] == keys[start]:
                    continue
                part = batch.slice(start, k - start)
                if keys[start] != key:
                    if writer:
                        yield close()
                    key = keys[start]
                    name = f"{folder}/{quote(key[0], safe='')}/{key[1]}/{offsets[start].as_py():020d}-{uuid.uuid4().hex}.parquet"
                    fs, where = pafs.FileSystem.from_uri(name)
                    fs.create_dir(where.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(where)
                    writer = pq.ParquetWriter(out, arrow)
                    state = {"topic": key[0], "partition": key[1], "first": offsets[start].as_py(), "end": 0, "rows": 0, "file": name}
                writer.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, arrow)], schema=arrow))
                state["end"], state["rows"] = offsets[k - 1].as_py() + 1, state["rows"] + len(part)
                start = k
        if writer:
            yield close()

    block = F.floor(F.col("offset") / offsets_in_segment)
    dealt = log.repartition("topic", "partition", block).sortWithinPartitions("topic", "partition", "offset")
    made = [r.asDict() for r in dealt.mapInArrow(write, "topic string, partition int, first long, end long, rows long, file string").collect()]  # one row a segment
    _commit(spark, path, schema, made)
    return len(made)


def _commit(spark: SparkSession, path: str, schema: StructType, made: list[dict]) -> None:
    there = Log(_plain(path))
    number, ends = there.commits(), there.ends()
    if number and there.schema() != schema:
        raise ValueError(f"the log at {path} has other columns")
    for s in made:
        if s["first"] < ends.get(s["topic"], {}).get(str(s["partition"]), 0):
            raise ValueError(f"offset {s['first']} of {s['topic']}-{s['partition']} is not past the log's end")
    fs, p = _hadoop(spark, f"{path}/commits/{number:012d}.json")
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        raise OSError(f"another writer has added to the log at {path}") from e
    try:
        out.write(json.dumps({"schema": json.loads(schema.json()), "segments": made}).encode())
    finally:
        out.close()


class Log:
    """Commits of a log, read without Spark; each is read once, for none ever changes."""

    def __init__(self, path: str):
        self.path, self.read_so_far, self.segments, self._schema = path.rstrip("/"), 0, [], None

    def _refresh(self) -> None:
        fs, base = pafs.FileSystem.from_uri(f"{self.path}/commits")
        names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.base_name[:12].isdigit())
        for name in names[self.read_so_far :]:
            with fs.open_input_stream(f"{base}/{name}") as f:
                raw = f.read()
            if not raw:  # its writer has yet to write it, or died
                break
            content = json.loads(raw)
            self.segments += content["segments"]
            self._schema = content["schema"]
            self.read_so_far += 1

    def commits(self) -> int:
        self._refresh()
        return self.read_so_far

    def schema(self) -> StructType:
        self._refresh()
        if self._schema is None:
            raise FileNotFoundError(f"no log at {self.path}")
        return StructType.fromJson(self._schema)

    def ends(self, topics: tuple[str, ...] = ()) -> Offsets:
        """One past the last offset of each partition, by topic."""
        self._refresh()
        out: Offsets = {}
        for s in self.segments:
            if not topics or s["topic"] in topics:
                of = out.setdefault(s["topic"], {})
                of[str(s["partition"])] = max(of.get(str(s["partition"]), 0), s["end"])
        return out

    def between(self, start: Offsets, end: Offsets) -> list[Piece]:
        """Pieces of segments with the records from ``start`` (0 where it names no offset) to ``end``, which names all partitions to read."""
        self._refresh()
        out = []
        for s in self.segments:
            low = start.get(s["topic"], {}).get(str(s["partition"]), 0)
            high = end.get(s["topic"], {}).get(str(s["partition"]), 0)
            if s["first"] < high and s["end"] > low:
                out.append(Piece(s["file"], low if low > s["first"] else None, high if high < s["end"] else None))
        return out


class Piece(InputPartition):
    """A segment, or its records from ``low`` to below ``high``."""

    def __init__(self, file: str, low: int | None, high: int | None):
        self.file, self.low, self.high = file, low, high


def _read(piece: Piece, schema: StructType):
    arrow = to_arrow_schema(schema)
    fs, where = pafs.FileSystem.from_uri(piece.file)
    with fs.open_input_file(where) as f:
        for batch in pq.ParquetFile(f).iter_batches(10_000):
            offset, keep = batch.column("offset"), None
            if piece.low is not None:
                keep = pc.greater_equal(offset, piece.low)
            if piece.high is not None:
                below = pc.less(offset, piece.high)
                keep = below if keep is None else pc.and_(keep, below)
            batch = batch if keep is None else batch.filter(keep)
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(x.name).cast(x.type) for x in arrow], schema=arrow)


class _Batch(DataSourceReader):
    def __init__(self, log: Log, schema: StructType, topics: tuple[str, ...], options: dict):
        self.schema, repeat = schema, int(options.get("repeat", 1))
        end = json.loads(options["endingoffsets"]) if "endingoffsets" in options else log.ends(topics)
        self.pieces = log.between(json.loads(options.get("startingoffsets", "{}")), {t: of for t, of in end.items() if not topics or t in topics}) * repeat

    def partitions(self):
        return self.pieces

    def read(self, partition):
        return _read(partition, self.schema)


class _Stream(DataSourceStreamReader):
    def __init__(self, log: Log, schema: StructType, topics: tuple[str, ...], options: dict):
        self.log, self.schema, self.topics = log, schema, topics
        self.start = json.loads(options.get("startingoffsets", "{}"))

    def initialOffset(self) -> dict:  # noqa: N802
        return self.start

    def latestOffset(self) -> dict:  # noqa: N802
        return self.log.ends(self.topics)

    def partitions(self, start: dict, end: dict):
        return self.log.between(start, end)

    def read(self, partition):
        return _read(partition, self.schema)


class _Polls(_Stream):
    """Every poll gives all records up to the ends at the start again, ``repeat`` times in all."""

    def __init__(self, log: Log, schema: StructType, topics: tuple[str, ...], options: dict):
        super().__init__(log, schema, topics, options)
        self.most, self.polled, self.end = int(options["repeat"]), 0, log.ends(topics)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"polls": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"polls": min(self.most, self.polled + 1)}

    def partitions(self, start: dict, end: dict):
        self.polled = max(self.polled, end["polls"])
        return self.log.between(self.start, self.end) * (end["polls"] - start["polls"])


class SegmentLog(DataSource):
    """Options: path, topics (names parted by commas; all without it), startingOffsets and endingOffsets ({topic: {partition: offset}} as JSON), repeat."""

    @classmethod
    def name(cls) -> str:
        return "keyfold_log"

    def _parts(self):
        log = Log(_plain(self.options["path"]))
        return log, tuple(t for t in self.options.get("topics", "").split(",") if t), {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> StructType:
        return self._parts()[0].schema()

    def reader(self, schema: StructType):
        log, topics, options = self._parts()
        return _Batch(log, schema, topics, options)

    def streamReader(self, schema: StructType):  # noqa: N802
        log, topics, options = self._parts()
        return (_Polls if "repeat" in options else _Stream)(log, schema, topics, options)


def ends(path: str, *topics: str) -> Offsets:
    """{topic: {partition: one past its last offset}} at this moment."""
    return Log(_plain(path)).ends(topics)


def scan(spark: SparkSession, path: str, *topics: str, start: Offsets | None = None, end: Offsets | None = None, repeat: int | None = None, streaming: bool = False) -> DataFrame:
    """The log at ``path`` from ``start`` to ``end`` (a stream has no end)."""
    spark.dataSource.register(SegmentLog)
    options = {"path": path, "topics": ",".join(topics)}
    options |= {name: json.dumps(of) for name, of in (("startingOffsets", start), ("endingOffsets", end)) if of is not None}
    options |= {} if repeat is None else {"repeat": str(repeat)}
    return (spark.readStream if streaming else spark.read).format("keyfold_log").options(**options).load()
