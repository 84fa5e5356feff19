"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a column of ids is broadcast; a larger one is shuffled.
BROADCAST_IDS = 1_000_000
#: Narrow rows that one file of a table of known size holds.
FILE_ROWS = 50_000
#: Largest share of rows that one key may hold before it counts as heavy.
SUPPORT = 1 / 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and all runs on one machine (tests) a temporary folder is made.
    """
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='keyfold-')}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame, rows: int | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there.

    A lost executor then costs a re-read, never a recomputation, and a plan
    that uses the table twice computes it once. ``rows``, if known about, sizes
    the files and tasks: one for every ``FILE_ROWS`` rows, however many
    partitions a shuffle has. That is for narrow rows of cheap columns.
    """
    path = f"{shared_dir(df.sparkSession)}/keyfold-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has made and nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Meanwhile Spark deletes an action's shuffle files when it ends; each action must have a plan of its own."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def small_enough(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def free_name(name: str, *dfs: DataFrame) -> str:
    """``name``, or that with underscores after it, as no column of ``dfs`` is called."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids``; a null doc_id stays.

    The ids are broadcast after a count shows that they are few; otherwise the
    anti join shuffles both sides.
    """
    name = free_name("gone", docs)
    gone = ids.select(F.col("doc_id").alias(name)).where(F.col(name).isNotNull()).distinct()
    return docs.join(small_enough(cut(gone)), F.col("doc_id") == F.col(name), "left_anti")


def only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (distinct), joined as in drop_ids."""
    name = free_name("wanted", docs)
    want = ids.select(F.col("doc_id").alias(name)).where(F.col(name).isNotNull()).distinct()
    return docs.join(small_enough(cut(want)), F.col("doc_id") == F.col(name), "left_semi")


def group_pick(df: DataFrame, key: str, pick, support: float = SUPPORT) -> DataFrame:
    """Give each row its group's ``pick`` (aggregate Column) as __pick and row count as __size.

    Heavy-hitter split: one pass of the Misra-Gries summary (``freqItems``
    merges counter sets of at most 1/support keys, map-side first) names the
    keys that may hold more than ``support`` of the rows. Their exact count and
    pick follow from one map-side-combined aggregation; at most 1/support
    verified rows result, so broadcasting them is bounded whatever the input.
    Rows of those keys never shuffle. All other keys are light and take the
    usual shuffle; ``df`` should be a table, since it is read three times.
    """
    aggs = [pick.alias("__pick"), F.count(F.lit(1)).alias("__size")]
    named = df.stat.freqItems([key], support).select(F.explode(F.col(f"{key}_freqItems")).alias(key))
    heavy = df.join(F.broadcast(named), key, "left_semi").groupBy(key).agg(*aggs).where("__size > 1")
    tagged = df.join(F.broadcast(cut(heavy.coalesce(1))), key, "left")
    done = tagged.where("__size is not null")
    rest = tagged.where("__size is null").drop("__pick", "__size")
    light = rest.groupBy(key).agg(*aggs)
    return done.unionByName(rest.join(light, key))


def class_sample(df: DataFrame, by: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each value of ``by``, chosen by a hash of doc_id.

    The bound is on rows, so that a model can be fitted on one machine; which
    rows are taken does not depend on their order or partitions.
    """
    counts = {r[0]: r[1] for r in df.where(F.col(by).isNotNull()).groupBy(by).count().collect()}
    if not counts:
        return df.limit(0)
    unit = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for value, n in sorted(counts.items(), key=str):
        keep = keep | ((F.col(by) == F.lit(value)) & (unit < per_class / n))
    return df.where(keep)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): spreads every bit of each value."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda pad: None


def give_back() -> None:
    """Return what this Python worker has freed to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def small_batches(batches, column: int, most: int = 2_000_000):
    """Slices of Arrow batches whose texts in ``column`` have about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        start = size = 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch
        give_back()


def text_blocks(texts: list[str | None], most: int = 2_000_000):
    """(start, end) ranges of ``texts`` with about ``most`` characters each; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
