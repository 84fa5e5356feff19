"""Records put together by the tasks that read them, before they are dealt to processors, and outputs in lists.

A processor pays for each row that it gets or gives. So the records of one key,
or of one segment, that a task has read come as a few rows with an array of
each column, and what a processor tells goes out as arrays too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: Records, or bytes, that a task gathers before it puts together what belongs together.
GATHER, GATHER_BYTES = 100_000, 32 << 20
#: Records in one row at most, and about so many bytes; a longer record stands alone. Spark hands thousands of rows to Python at once.
PIECE, PIECE_BYTES = 256, 8192


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A task's batches in tables of about ``GATHER`` records."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= GATHER or size >= GATHER_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def pieces(table: pa.Table, by: tuple[str, ...], order: str) -> pa.Table:
    """A row for each ``PIECE`` records of equal ``by``: these columns, and an array of each other one by ``order``."""
    n = table.num_rows
    most = max(1, min(PIECE, PIECE_BYTES * n // max(1, table.nbytes)))
    table = table.sort_by([(c, "ascending") for c in (*by, order)]).combine_chunks()
    new = np.zeros(n, bool)
    new[:1] = True
    for c in by:
        of = table.column(c)
        new[1:] |= pc.fill_null(pc.not_equal(of[1:], of[:-1]), True).to_numpy()  # rows that a null parts meet again at the processor
    first = np.flatnonzero(new)
    at = np.flatnonzero((np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))) % most == 0)
    ends = pa.array(np.append(at, n), pa.int32())
    whole = lambda c: table.column(c).chunk(0) if n else pa.array([], table.schema.field(c).type)
    return pa.table({c: table.column(c).take(pa.array(at)) if c in by else pa.ListArray.from_arrays(ends, whole(c)) for c in table.column_names})


def packed(rows: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    """``rows`` with an array of each column beside ``by``; those that a task read of one ``by`` are together."""
    schema = StructType([f if f.name in by else StructField(f.name, ArrayType(f.dataType)) for f in rows.schema])

    def run(batches):
        for table in gathered(batches):
            yield from pieces(table, by, order).to_batches()

    return rows.mapInArrow(run, schema)


def unpacked(outputs: DataFrame, *arrays: str) -> DataFrame:
    """One row for each element of ``arrays``, which are of one length."""
    return outputs.select(*[c for c in outputs.columns if c not in arrays], F.inline(F.arrays_zip(*arrays)))
