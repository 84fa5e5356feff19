"""Token ids in binary shard files of shuffled planes, with a chunk index.

A shard holds a contiguous run of documents in ascending doc_id order:

    magic "KFPL" | u32 version | chunks | footer | u64 footer length | magic

A chunk is a fixed number of ids (the last one shorter). Its unsigned 32-bit
ids are transposed into 4 byte planes or 32 bit planes, each compressed with
zstandard by itself; planes of high zeros shrink to a few bytes. The footer is
zstandard-compressed: the chunk index (offset, ids, length of each plane), the
doc ids with their validity, and the ids per document.

Writing: one range exchange by doc_id, then each task encodes and writes its
own shard and returns a manifest row. A task that is run again writes another
file; only files in the manifest count, so lost executors and repeated
attempts do no harm. Starts are prefix sums over the manifest's rows, of which
there is one a shard. Reading: one task a shard, a chunk at a time.

Edge cases: a null text is empty (its end id alone is stored); null doc_ids
come first; rows of equal doc_id are ordered by their text; an empty table
makes no shard; extra columns do not matter.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyfold.llm import bpe
from keyfold.llm.common import cut, shared_dir, small_batches

MAGIC, VERSION = b"KFPL", 1
CHUNK = 1 << 16
#: Characters that are encoded at once, and chunks that the encoder remembers: more than elsewhere, since encoding is nearly all there is to do here.
BLOCK, REMEMBERED = 4_000_000, 200_000


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte planes (4) or bit planes (32) of u32 ids, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    return [np.packbits(raw[:, k // 8] >> (k % 8) & 1).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if len(planes) == 4:
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        for k, p in enumerate(planes):
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (k % 8)
    return raw.view("<u4").ravel()


class ShardWriter:
    """Streams documents into one shard; at most a chunk and a document are in memory."""

    def __init__(self, out, chunk: int = CHUNK, bits: bool = False, level: int = 3):
        self.out, self.chunk, self.bits = out, chunk, bits
        self.zip = zstandard.ZstdCompressor(level=level)
        self.index: list[list[int]] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.at = out.write(MAGIC + struct.pack("<I", VERSION)) and 8

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.chunk:
            joined = np.concatenate(self.waiting)
            whole = len(joined) // self.chunk * self.chunk
            for k in range(0, whole, self.chunk):
                self._put(joined[k : k + self.chunk])
            self.waiting, self.n_waiting = [joined[whole:]], len(joined) - whole

    def _put(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.bits)]
        self.out.write(b"".join(planes))
        self.index.append([self.at, len(ids), *map(len, planes)])
        self.at += sum(map(len, planes))

    def close(self) -> None:
        if self.n_waiting:
            self._put(np.concatenate(self.waiting))
        valid = np.array([d is not None for d in self.docs], np.uint8)
        head = json.dumps({"chunk": self.chunk, "bits": self.bits, "index": self.index, "docs": len(self.docs)}).encode()
        ids = np.array([d or 0 for d in self.docs], "<i8")
        foot = self.zip.compress(struct.pack("<I", len(head)) + head + valid.tobytes() + ids.tobytes() + np.array(self.lengths, "<u8").tobytes())
        self.out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)


class ShardReader:
    """Random and sequential access to one shard."""

    def __init__(self, file):
        self.file, size = file, file.size()
        self.unzip = zstandard.ZstdDecompressor()
        tail = self._read(size - 12, 12)
        if tail[8:] != MAGIC or self._read(0, 4) != MAGIC:
            raise ValueError("not a shard file, or cut off")
        n = struct.unpack("<Q", tail[:8])[0]
        foot = self.unzip.decompress(self._read(size - 12 - n, n))
        at = 4 + struct.unpack("<I", foot[:4])[0]
        head = json.loads(foot[4:at])
        n = head["docs"]
        self.chunk, self.index = head["chunk"], head["index"]
        valid = np.frombuffer(foot, np.uint8, n, at)
        ids = np.frombuffer(foot, "<i8", n, at + n)
        self.docs = [int(i) if v else None for i, v in zip(ids, valid)]
        self.lengths = np.frombuffer(foot, "<u8", n, at + 9 * n).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids_of_chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k]
        raw, planes = self._read(at, sum(sizes)), []
        for size in sizes:
            planes.append(self.unzip.decompress(raw[:size]))
            raw = raw[size:]
        return from_planes(planes, n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the shard, through the chunk index."""
        if end <= start:
            return np.zeros(0, "<u4")
        parts = [self.ids_of_chunk(k) for k in range(start // self.chunk, (end - 1) // self.chunk + 1)]
        base = start // self.chunk * self.chunk
        return np.concatenate(parts)[start - base : end - base]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the shard, ids) in order; each chunk is read once."""
        k, held = 0, np.zeros(0, "<u4")
        for doc_id, start, n in zip(self.docs, self.starts.tolist(), self.lengths.tolist()):
            if len(held) < n:
                parts, have = [held], len(held)
                while have < n:
                    parts.append(self.ids_of_chunk(k))
                    have += len(parts[-1])
                    k += 1
                held = np.concatenate(parts)
            yield doc_id, start, held[:n]
            held = held[n:]


def write(docs: DataFrame, encode: Callable, folder: str, end_id: int, chunk: int = CHUNK, bits: bool = False) -> DataFrame:
    """Write shards below ``folder`` and return the manifest: file, first and last doc_id, n_docs, n_ids, base (ids in all shards before it)."""

    def run(batches):
        name = f"{folder}/{uuid.uuid4().hex}.kfpl"
        out = writer = None
        end, docs, first = np.array([end_id], "<u4"), 0, None
        last = None
        for batch in small_batches(batches, 1, BLOCK):
            if writer is None:
                fs, path = pafs.FileSystem.from_uri(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, buffer_size=1 << 20)
                writer, first = ShardWriter(out, chunk, bits), batch.column(0)[0].as_py()
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                writer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
                last = doc_id
            docs += batch.num_rows
        if writer:
            writer.close()
            out.close()
            yield pa.record_batch([pa.array([x], t) for x, t in ((name, pa.string()), (first, pa.int64()), (last, pa.int64()), (docs, pa.int64()), (sum(writer.lengths), pa.int64()))], names=["file", "first", "last", "n_docs", "n_ids"])

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    shards = cut(ranged.mapInArrow(run, "file string, first long, last long, n_docs long, n_ids long"))
    before = Window.orderBy(F.asc_nulls_first("first"), F.asc_nulls_first("last")).rowsBetween(Window.unboundedPreceding, -1)
    return cut(shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).coalesce(1))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = pafs.FileSystem.from_uri(name)
                with fs.open_input_file(path) as f:
                    rows: list[tuple] = []
                    for doc_id, start, ids in ShardReader(f).documents():
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    n = max(1, manifest.count())
    return manifest.select("file", "base").repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def store(docs: DataFrame, path: str, end_id: int = 1, bits: bool = False) -> DataFrame:
    """Encode ``docs`` with the vocabulary file, write shards to a fresh shared folder, and read them back."""
    folder = f"{shared_dir(docs.sparkSession)}/keyfold-shards-{uuid.uuid4().hex}"
    classes = bpe.differing_classes()
    return read(write(docs, lambda texts: bpe.load(path, REMEMBERED, classes).encode(texts, BLOCK), folder, end_id, bits=bits))
