from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def java_hash(text: Column) -> Column:
    """``String.hashCode`` of a string, as int, in built-in functions. A character outside the basic plane counts as its two surrogates."""
    units = F.split(text, "")
    put = lambda h, unit: F.pmod(h * 31 + unit, F.lit(1 << 32))

    def step(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")  # its code point
        high, low = F.lit(0xD7C0) + F.shiftright(code, 10), F.lit(0xDC00) + code.bitwiseAND(F.lit(0x3FF))
        return F.when(code < 0x10000, put(h, code)).otherwise(put(put(h, high), low))

    h = F.aggregate(F.filter(units, lambda c: c != ""), F.lit(0).cast("long"), step)
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")


def murmur2(data: bytes) -> int:
    """The 32-bit hash by which a broker's clients place keys."""
    m, mask = 0x5BD1E995, 0xFFFFFFFF
    h = 0x9747B28C ^ len(data)
    whole = len(data) & ~3
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        k = k * m & mask
        h = (h * m ^ (k ^ k >> 24) * m) & mask
    if rest := data[whole:]:
        h = (h ^ int.from_bytes(rest, "little")) * m & mask
    h = (h ^ h >> 13) * m & mask
    return h ^ h >> 15


def key_partition(key: Column, partitions: int) -> Column:
    """Partition that a broker's client gives a string key. Distinct keys of a batch are hashed once."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        known = {k: (murmur2(k.encode()) & 0x7FFFFFFF) % partitions for k in keys.dropna().unique()}
        return keys.map(known).astype("Int32")

    return place(key)


@dataclass(frozen=True)
class Compressor:
    """Frames bytes as: header length (int32, big-endian), header, payload. Payloads of at least ``threshold`` bytes are compressed and carry their raw length.

    Bytes that start with "{" were never framed and are read as they are. The
    codec is zlib, from the standard library.
    """

    threshold: int = 10_000
    header: bytes = b"\1"

    def pack(self, data: bytes) -> bytes:
        flag = b"\1" if len(data) >= self.threshold else b"\0"
        body = struct.pack(">i", len(data)) + zlib.compress(data) if flag == b"\1" else data
        return struct.pack(">i", 1) + flag + body

    def unpack(self, data: bytes) -> bytes:
        if data[:1] == b"{":
            return data
        (n,) = struct.unpack(">i", data[:4])
        if n != 1 or data[4:5] not in (b"\0", b"\1"):
            raise ValueError("unknown header")
        if data[4:5] == b"\0":
            return data[5:]
        (size,) = struct.unpack(">i", data[5:9])
        out = zlib.decompress(data[9:])
        if len(out) != size:
            raise ValueError("payload of another length than stated")
        return out

    def column(self, f: Callable[[bytes], bytes], data: Column) -> Column:
        @F.pandas_udf("binary")
        def apply(x: pd.Series) -> pd.Series:
            return x.map(f, na_action="ignore")

        return apply(data)


#: The codes by which record timestamp types are stored.
TIMESTAMP_TYPES = {"Create": "C", "Append": "A"}


def headers_to_map(headers: Column) -> Column:
    """Headers as a map of text; of equal keys the last stays; bytes that are no UTF-8 are an error."""
    text = F.transform(headers, lambda h: F.struct(h["key"].alias("key"), F.validate_utf8(h["value"].cast("string")).alias("value")))
    none = F.expr("cast(map() as map<string,string>)")
    return F.aggregate(text, none, lambda m, h: F.map_concat(F.map_filter(m, lambda k, v: k != h["key"]), F.create_map(h["key"], h["value"])))


def map_to_headers(m: Column) -> Column:
    return F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), F.encode(e["value"], "UTF-8").alias("value")))


JOURNAL = "struct<events:array<struct<seqNr:bigint,tags:array<string>,payload:struct<payload:string>>>>"


def journal_events(value: Column) -> Column:
    """Events of a journal record's JSON value: array of (seqNr, tags, payload). Empty or malformed JSON is an error that names the value."""
    parsed = F.from_json(value, JOURNAL)
    return F.when(parsed["events"].isNull(), F.raise_error(F.concat(F.lit("not a journal record: "), F.coalesce(value, F.lit("null"))))).otherwise(parsed["events"])


def payload_as(payload: Column, schema: str) -> Column:
    """A payload validated to a schema: a field of another type is an error that names the payload."""
    fields = T._parse_datatype_string(schema).fields
    got = F.from_json(payload, schema)
    raw = F.from_json(payload, T.StructType([T.StructField(f.name, T.StringType()) for f in fields]))
    bad = F.json_object_keys(payload).isNull()
    for f in fields:
        text = F.get_json_object(payload, f"$.{f.name}")
        quoted = payload.rlike(f'"{f.name}"\\s*:\\s*"')
        bad = bad | (text.isNotNull() & got[f.name].isNull()) | (quoted & F.lit(not isinstance(f.dataType, T.StringType))) | (raw[f.name].isNull() & F.lit(not f.nullable))
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("payload of another type: "), F.coalesce(payload, F.lit("null"))))).otherwise(got)


def sequence_range(headers: Column, action: str = "append") -> Column:
    """struct(from, to) from the journal header of a record; null for other actions. Reads the headers only."""
    text = F.get(F.filter(headers, lambda h: h["key"] == "journal"), F.lit(0))["value"].cast("string")
    j = F.from_json(text, "action string, range struct<from:bigint,to:bigint>")
    return F.when(F.lower(j["action"]) == action, j["range"])
