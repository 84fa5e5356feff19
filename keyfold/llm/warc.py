"""WARC archives whose repeated payloads are revisits of the first response.

1. ``write``: each task writes its rows as response records, each a gzip
   member of its own, into archives below a shared folder and returns a header
   row a record (file, offset, length, id, digest, size).
2. ``resolve``: headers alone are shuffled, by payload digest; frequent digests
   are settled without a shuffle (heavy-hitter split). Of equal payloads the
   record with the smallest page_id is the response, which the other records'
   headers are joined to.
3. ``rewrite``: one pass over each archive. Responses are copied byte for byte,
   the others become revisit records under fresh headers, without a payload.
4. ``read``: records of the new archives; ``restore`` gives revisits their
   payloads back.

A task that is run again writes another file; only files that header rows or
manifest rows name are ever read, so lost executors and repeated attempts do no
harm. Payloads never shuffle before ``restore``.

Edge cases: a null html is an empty payload; a null url is written as
urn:page:id; control characters of a url are percent-encoded; a null page_id
comes after all others, and of rows without one the first in its file is the
response, which its revisits name by record id only (refers_to is null); of
rows with equal page_id and payload one is the response; an empty table makes
no archive; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import cut, group_pick, shared_dir, small_batches

#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 128 << 20
#: Revisits of one response that are given their payload in one task.
REVISITS = 2_000
LEVEL = 6
VERSION = b"WARC/1.1\r\n"
#: Fixed value: the profile of revisits with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "file string, offset long, length long, record_id string, date string, page_id long, url string, payload_bytes long, payload_digest string"
MANIFEST = "file string, records long, revisits long, bytes long"
RECORDS = "page_id long, url string, record_id string, record_type string, refers_to long, refers_to_record string, payload_bytes long, payload_digest string"
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def digest_of(payload: bytes) -> str:
    """SHA-1 in base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as a gzip member; fields without a value are left out."""
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return b"".join([press.compress(VERSION + f"{lines}Content-Length: {len(block)}\r\n\r\n".encode()), press.compress(block), press.compress(b"\r\n\r\n"), press.flush()])


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(VERSION.rstrip()):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut off")
    return fields, rest[:n]


def members(file) -> Iterator[bytes]:
    """The records of an archive, unpacked one after another; one is in memory, and a piece of the file."""
    held = b""
    while True:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            piece = held or file.read(1 << 20)
            if not piece:
                if parts:
                    raise ValueError("archive is cut off")
                return
            parts.append(inflate.decompress(piece))
            held = inflate.unused_data
        yield b"".join(parts)


class Archives:
    """Records written by one task, into archives of a bounded size."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.out, self.name, self.at = folder, most, None, None, 0

    def add(self, raw: bytes) -> tuple[str, int]:
        """(file, offset) of the record."""
        if self.out is not None and self.at + len(raw) > self.most:
            self.close()
        if self.out is None:
            self.name, self.at = f"{self.folder}/{uuid.uuid4().hex}.warc.gz", 0
            fs, path = pafs.FileSystem.from_uri(self.name)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.out = fs.open_output_stream(path, compression=None, buffer_size=1 << 20)
        place = self.name, self.at
        self.out.write(raw)
        self.at += len(raw)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def write(pages: DataFrame, folder: str, date: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write each row of ``pages`` (page_id, url, html) as a response record; header rows of all records, as a table."""

    def run(batches):
        archives = Archives(folder, most)
        for batch in small_batches(batches, 2):
            rows = []
            for page_id, url, html in zip(*[c.to_pylist() for c in batch.columns]):
                payload = (html or "").encode()
                url = f"urn:page:{'' if page_id is None else page_id}" if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
                digest, record_id = digest_of(payload), f"<urn:uuid:{uuid.uuid4()}>"
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-Id", page_id), ("Content-Type", "application/http;msgtype=response")]
                raw = record(fields, http_head(len(payload)) + payload)
                rows.append((*archives.add(raw), len(raw), record_id, date, page_id, url, len(payload), digest))
            yield _rows(rows, HEADERS)
        archives.close()

    return cut(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, HEADERS))


def resolve(headers: DataFrame, least: int = 0) -> DataFrame:
    """``headers`` (a table) with ``original``: of a record that repeats a payload of at least ``least`` bytes the id, page_id, url and date of the response, else null."""
    order = F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "file", "offset", "record_id", "url", "date")
    picked = group_pick(headers.where(F.col("payload_bytes") >= least), "payload_digest", F.min(order))
    first = F.col("__pick")
    original = F.when(F.col("record_id") != first["record_id"], F.struct(first["record_id"].alias("record_id"), first["page_id"].alias("page_id"), first["url"].alias("url"), first["date"].alias("date")))
    out = picked.select(*headers.columns, original.alias("original"))
    if least <= 0:
        return out
    return out.unionByName(headers.where(F.col("payload_bytes") < least).withColumn("original", F.lit(None).cast(out.schema["original"].dataType)))


def rewrite(resolved: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Deduplicated archives below ``folder``: a manifest row for each, as a table.

    Each archive's headers go to one task in the order of its records; there are
    as many as an archive of bounded size has, and one record is in memory.
    """

    def run(batches):
        archives, opened, source, made = Archives(folder, most), None, None, {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                for row in batch.slice(start, 1000).to_pylist():
                    if row["file"] != opened:
                        if source:
                            source.close()
                        fs, path = pafs.FileSystem.from_uri(row["file"])
                        source, opened = fs.open_input_file(path), row["file"]
                    source.seek(row["offset"])
                    raw = source.read(row["length"])
                    if first := row["original"]:
                        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]), ("WARC-Target-URI", row["url"]), ("WARC-Profile", PROFILE), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}")]
                        fields += [("WARC-Refers-To", first["record_id"]), ("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Date", first["date"]), ("Page-Id", row["page_id"]), ("Refers-To-Page-Id", first["page_id"]), ("Content-Type", "application/http;msgtype=response")]
                        raw = record(fields, http_head(row["payload_bytes"]))
                    name, _ = archives.add(raw)
                    n, again, size = made.get(name, (0, 0, 0))
                    made[name] = n + 1, again + bool(first), size + len(raw)
        if source:
            source.close()
        archives.close()
        yield _rows([(name, *counts) for name, counts in made.items()], MANIFEST)

    files = resolved.select("file").distinct().count()
    dealt = resolved.repartition(max(1, files), "file").sortWithinPartitions("file", "offset")
    return cut(dealt.mapInArrow(run, MANIFEST))


def _scan(manifest: DataFrame, schema: str, row_of) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(name)
                with fs.open_input_stream(path, compression=None) as file:
                    rows, size = [], 0
                    for data in members(file):
                        fields, block = parse(data)
                        rows.append(row_of(fields, block))
                        size += len(block)
                        if len(rows) == 1000 or size > 2_000_000:
                            yield _rows(rows, schema)
                            rows, size = [], 0
                    yield _rows(rows, schema)

    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(run, schema)


def _describe(fields: dict[str, str], block: bytes) -> tuple:
    """What RECORDS names, and the payload (None for a revisit). Size and digest of a response are worked out from its payload and must be those of its headers."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "revisit":
        payload = None
    elif (len(payload), digest_of(payload)) != (size, digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not have the payload of its headers")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("Page-Id"), fields["WARC-Target-URI"], fields["WARC-Record-ID"], kind, number("Refers-To-Page-Id"), fields.get("WARC-Refers-To"), size, digest, payload


def read(manifest: DataFrame) -> DataFrame:
    """The records of the archives, as RECORDS names their columns; sizes and digests are of the full payload, for revisits as well."""
    return _scan(manifest, RECORDS, lambda fields, block: _describe(fields, block)[:-1])


def restore(manifest: DataFrame) -> DataFrame:
    """page_id, url, html of every record. A response that many revisits refer to is dealt to several tasks, REVISITS of them in each."""
    rows = cut(_scan(manifest, RECORDS + ", payload binary", _describe))
    again = rows.where("record_type = 'revisit'")
    parts = again.groupBy("refers_to_record").agg(F.ceil(F.count(F.lit(1)) / REVISITS).cast("int").alias("parts"))
    place: Column = F.pmod(F.xxhash64("record_id"), F.col("parts")).cast("int")
    known = again.select("page_id", "url", "record_id", F.col("refers_to_record").alias("original")).join(parts.withColumnRenamed("refers_to_record", "original"), "original").select("page_id", "url", "original", place.alias("part"))
    payloads = rows.where("record_type = 'response'").select(F.col("record_id").alias("original"), "payload").join(parts.withColumnRenamed("refers_to_record", "original"), "original").select("original", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "payload")
    html = F.decode("payload", "UTF-8").alias("html")
    return rows.where("record_type = 'response'").select("page_id", "url", html).unionByName(known.join(payloads, ["original", "part"]).select("page_id", "url", html))


def archive(pages: DataFrame, folder: str, least: int = 0, date: str | None = None, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as deduplicated archives below ``folder`` (shared); the manifest. The archives of the first step are removed once the new ones are written."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    first = f"{folder}-{uuid.uuid4().hex}"
    made = rewrite(resolve(write(pages, first, date, most), least), folder, most)
    jvm = pages.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(first)
    path.getFileSystem(pages.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return made


def revisits(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in a fresh shared folder and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = f"{shared_dir(pages.sparkSession)}/keyfold-warc-{uuid.uuid4().hex}"
    return read(archive(pages, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1) FOR k IN range(32)], '') AS payload_digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM g
"""
