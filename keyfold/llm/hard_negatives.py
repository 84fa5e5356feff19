"""Hard-negative mining by distributed radix selection.

For every anchor and each of its positives, the negatives are the k best rows
of another label whose score lies in a window below the positive's score.
Scores are exact integer inner products of quantised vectors.

Rows are packed into blocks of bounded size (ids, labels and one matrix), the
anchors likewise, and every block of anchors meets every block of rows once a
pass: the stated query set against all rows. A pass works scores out anew
instead of storing them:

1. positives: each block's best rows of the anchor's label, ranked further on
   the map side, then by anchor;
2. one pass a digit: each window's histogram of the next digit of the distance
   from the window's top, as (window, bucket, count) with partial sums; the
   bucket that holds the k-th row becomes the next range;
3. gather: only rows above the k-th distance, and of those at it as many of
   the smallest ids as are still wanted.

So what is shuffled does not depend on how many rows a window has, and ties,
copies and hot labels cost no more than others.

Edge cases: rows with a null label, null vector or null or non-finite component
take no part, nor do those without an id; of rows of equal id one takes part
(the smallest label, then vector); shorter vectors count as padded with zeros;
an anchor without others of its label, or a window without rows, gives no rows;
a score that might not fit 64 bits is an error; an empty table gives an empty
table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyfold.llm.common import cut

#: Most rows and anchors in a block, and the least rows.
BLOCK_ROWS, BLOCK_ANCHORS, LEAST_ROWS = 4096, 512, 256
#: Bits of a digit: a histogram has 2^RADIX_BITS buckets.
RADIX_BITS = 7
#: Components are multiplied by this and rounded down.
SCALE = 256
BLOCK = "block long, ids array<long>, labels array<long>, matrix binary"
WINDOW = ("anchor_id", "positive_id")
STATE = (*WINDOW, "positive_score", "low", "high", "start", "want", "open")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part, one for each id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.label", "row.embedding")


def pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows, each in ascending order of ids, as a table."""

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                ids, labels = (np.asarray(part.column(c), np.int64) for c in (0, 1))
                lists = part.column(2)
                width = np.diff(np.asarray(lists.offsets))
                flat = np.floor(np.asarray(lists.flatten(), np.float64) * SCALE)
                if len(flat) and np.abs(flat).max() >= 2.0**53:
                    raise ValueError("a component is too large for exact scores")
                matrix = np.zeros((part.num_rows, int(width.max())))
                matrix[np.arange(matrix.shape[1]) < width[:, None]] = flat
                order = np.argsort(ids)
                columns = [pa.array([task << 32 | k], pa.int64()), *[pa.array([x[order]], pa.list_(pa.int64())) for x in (ids, labels)], pa.array([matrix[order].tobytes()], pa.binary())]
                yield pa.record_batch(columns, names=["block", "ids", "labels", "matrix"])
                k += 1

    return cut(rows.select("vec_id", "label", "embedding").mapInArrow(run, BLOCK))


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of all anchors and rows, in the narrowest type whose partial sums are exact."""
    width = min(anchors.shape[1], rows.shape[1])
    anchors, rows = anchors[:, :width], rows[:, :width]
    bound = float(np.sqrt((anchors**2).sum(1).max(initial=0)) * np.sqrt((rows**2).sum(1).max(initial=0))) * 1.001
    if bound >= 2.0**62:
        raise ValueError("a score may not fit 64 bits")
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return anchors.astype(kind) @ rows.astype(kind).T


class Pair:
    """A block of anchors and a block of rows: their ids and scores; ``same`` tells equal labels."""

    def __init__(self, row: pa.RecordBatch):
        self.ids, labels, matrix = self._block(row, "")
        self.anchors, anchor_labels, anchor_matrix = self._block(row, "a_")
        self.scores = scores(anchor_matrix, matrix)
        self.same = anchor_labels[:, None] == labels[None, :]

    @staticmethod
    def _block(row: pa.RecordBatch, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, labels = (row.column(prefix + c).flatten().to_numpy() for c in ("ids", "labels"))
        return ids, labels, np.frombuffer(row.column(prefix + "matrix")[0].as_buffer(), np.float64).reshape(len(ids), -1)

    def masked(self, keep: np.ndarray) -> np.ndarray:
        """Scores where ``keep`` is true, and less than any score elsewhere."""
        lowest = -np.inf if self.scores.dtype.kind == "f" else np.iinfo(np.int64).min
        return np.where(keep, self.scores, lowest)


def meet(blocks: DataFrame, anchors: DataFrame, work: Callable, schema: str) -> DataFrame:
    """The rows of ``work`` over every pair of a block and a block of anchors (its columns with a_ before them, but for windows).

    Each block of rows is a part, for which the anchors' blocks have a copy; the
    two are joined by it and the pairs streamed through the tasks.
    """
    n = max(1, blocks.count())
    parts = F.sequence(F.lit(0), F.lit(n - 1))
    dealt = anchors.select(*[F.col(c).alias(c if c == "windows" else f"a_{c}") for c in anchors.columns if c != "block"], F.explode(parts).alias("part")).repartition(n, "part")
    number = blocks.select("block", (F.row_number().over(Window.orderBy("block")) - 1).alias("part"))  # one narrow row a block
    types = pa.schema([(name, {"long": pa.int64(), "int": pa.int32()}[t]) for name, t in (f.split() for f in schema.split(", "))])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                columns = work(batch.slice(k, 1))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

    placed = blocks.join(F.broadcast(number), "block").drop("block").repartition(n, "part")
    return placed.join(dealt, "part").drop("part").mapInArrow(run, schema)


def best_positives(blocks: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """The first ``k`` other rows of each anchor's label: anchor_id, positive_id, positive_score."""

    def work(row):
        pair = Pair(row)
        keep = pair.same & (pair.anchors[:, None] != pair.ids[None, :])
        masked = pair.masked(keep)
        if masked.shape[1] > k:  # what is below its anchor's k-th score is out
            place = masked.shape[1] - k
            keep &= masked >= np.partition(masked, place, axis=1)[:, place, None]
        at, col = np.nonzero(keep)
        score = pair.scores[at, col].astype(np.int64)
        order = np.lexsort((col, -score, at))
        at, col, score = at[order], col[order], score[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k  # of ties at it, the smallest ids
        return pair.anchors[at[first]], pair.ids[col[first]], score[first]

    found = meet(blocks, anchors, work, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).drop("__k")


def with_windows(anchors: DataFrame, state: DataFrame) -> DataFrame:
    """Blocks of anchors that have windows, with these: an array of each one's anchor's place in the block, and STATE.

    A block has as many as its anchors have positives, so the array is bounded.
    """
    ids = anchors.select("block", F.posexplode("ids").alias("at", "anchor_id"))
    rows = state.join(ids, "anchor_id").groupBy("block").agg(F.collect_list(F.struct("at", *STATE)).alias("windows"))
    return anchors.join(rows, "block")


def _by_anchor(row: pa.RecordBatch):
    """(place of the anchor in its block, its windows as arrays by column) of a pair."""
    flat = row.column("windows").flatten()
    columns = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
    order = np.argsort(columns["at"], kind="stable")
    columns = {name: c[order] for name, c in columns.items()}
    places, starts = np.unique(columns["at"], return_index=True)
    for at, a, b in zip(places.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
        yield at, {name: c[a:b] for name, c in columns.items()}


def histograms(blocks: DataFrame, anchors: DataFrame, state: DataFrame, unit: int) -> DataFrame:
    """Rows of other labels in each bucket, ``unit`` distances wide, of the windows' ranges: anchor_id, positive_id, bucket, rows (none if empty)."""

    def work(row):
        pair, found = Pair(row), []
        ascending = np.sort(pair.masked(~pair.same), axis=1)
        steps = unit * np.arange((1 << RADIX_BITS) + 1)
        for at, w in _by_anchor(row):
            tops = np.maximum((w["high"] - w["start"])[:, None] - steps, w["low"][:, None] - 1)
            below = np.searchsorted(ascending[at], tops.astype(ascending.dtype), side="right")
            n = below[:, :-1] - below[:, 1:]
            which, bucket = np.nonzero(n)
            found.append(np.stack([w["anchor_id"][which], w["positive_id"][which], bucket, n[which, bucket]]))
        return np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)

    made = meet(blocks, with_windows(anchors, state.where("open")), work, "anchor_id long, positive_id long, bucket long, rows long")
    return made.groupBy(*WINDOW, "bucket").agg(F.sum("rows").alias("rows"))


def narrowed(state: DataFrame, counts: DataFrame, unit: int) -> DataFrame:
    """Each window's next range and the rows still wanted from it: the bucket in which the running count reaches what is wanted.

    A window with fewer rows is taken whole: its range is its last distance, and it is open no more.
    """
    running = Window.partitionBy(*WINDOW).orderBy("bucket")
    reached = counts.join(state.select(*WINDOW, "want"), [*WINDOW]).withColumn("upto", F.sum("rows").over(running)).where("upto >= want")
    first = reached.groupBy(*WINDOW).agg(F.min(F.struct("bucket", "rows", "upto")).alias("b"))
    hit = F.col("b").isNotNull()
    start = F.when(hit, F.col("start") + F.col("b.bucket") * unit).otherwise(F.col("high") - F.col("low"))
    want = F.when(hit, F.col("want") - F.col("b.upto") + F.col("b.rows")).otherwise(F.col("want"))
    return state.join(first, [*WINDOW], "left").select(*WINDOW, "positive_score", "low", "high", start.alias("start"), want.alias("want"), hit.alias("open"))


def gather(blocks: DataFrame, anchors: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """The rows nearer to the windows' tops than their last distance, and of those at it the smallest ids, ranked."""

    def work(row):
        pair, found = Pair(row), []
        for at, w in _by_anchor(row):
            score, other = pair.scores[at], ~pair.same[at]
            for i in range(len(w["at"])):
                last = w["high"][i] - w["start"][i]
                nearer = np.flatnonzero(other & (score > last) & (score <= w["high"][i]))
                at_it = np.flatnonzero(other & (score == last))[: w["want"][i]]
                cols = np.concatenate([nearer, at_it])
                one = np.ones(len(cols), np.int64)
                found.append(np.stack([one * w["anchor_id"][i], one * w["positive_id"][i], pair.ids[cols], one * w["positive_score"][i], score[cols].astype(np.int64)]))
        return np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)

    rows = meet(blocks, with_windows(anchors, state), work, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy(*WINDOW).orderBy(F.desc("negative_score"), "negative_id")
    out = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(*WINDOW, "rank", "negative_id", "positive_score", "negative_score")


def windows(positives: DataFrame, low: int, high: int, k: int) -> DataFrame:
    """The state at first: scores from ``low`` to ``high`` hundredths of the positive's, both whole numbers, in parts that cannot overflow. Empty windows are left out."""
    whole, rest = F.expr("(positive_score - pmod(positive_score, 100)) div 100"), F.expr("pmod(positive_score, 100)")
    least = F.lit(low) * whole + F.ceil(F.lit(low) * rest / 100).cast("long")
    most = F.lit(high) * whole + F.floor(F.lit(high) * rest / 100).cast("long")
    out = positives.select("*", least.alias("low"), most.alias("high"), F.lit(0).cast("long").alias("start"), F.lit(k).cast("long").alias("want"), F.lit(True).alias("open"))
    return out.where("low <= high").select(*STATE)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``. A negative's
    score is from ``low`` to ``high`` hundredths of the positive's.
    """
    rows = cut(usable(vectors))
    n, cores = rows.count(), vectors.sparkSession.sparkContext.defaultParallelism
    blocks = pack(rows, min(BLOCK_ROWS, max(LEAST_ROWS, -(-n // (2 * cores)))))
    anchors = pack(rows.where(F.col("vec_id") % every == 0).coalesce(1 + n // every // BLOCK_ANCHORS), BLOCK_ANCHORS)
    state = cut(windows(best_positives(blocks, anchors, positives), low, high, negatives))
    widest = state.agg(F.max(F.col("high") - F.col("low") + 1)).first()[0] or 0
    for digit in reversed(range(-(-int(widest).bit_length() // RADIX_BITS))):
        unit = 1 << (RADIX_BITS * digit)
        state = cut(narrowed(state, histograms(blocks, anchors, state, unit), unit))
    return gather(blocks, anchors, state, negatives)


def shifted(vectors: DataFrame) -> DataFrame:
    """``vectors`` with the next label, modulo 10, where vec_id is divisible by 7."""
    return vectors.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, r.label = a.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
