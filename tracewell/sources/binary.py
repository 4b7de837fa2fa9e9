"""Length-prefixed binary logs: an 8-byte little-endian length, then the record in the public bincode 2 "standard" encoding.

Numbers are variable-length integers, floats 4 bytes, texts and lists carry their length, optional values a byte, names of
enumerations their position. Records of any schema version may follow each other: the version is their first number, and
records of older versions lack fields. A file is read by one task, record by record; folders of files are read in parallel.
"""

from __future__ import annotations

import datetime as dt
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession

from ..operators.storage import file_system
from ..plans.schema import KINDS, ROLES, SCHEMA_VERSION, TYPES, record_schema

#: Fixed value: a record of more bytes is refused.
MOST_BYTES = 10 * 1024 * 1024
#: Fields in order: name and kind; `?` optional, `*` a list.
FIELDS = (
    ("schema_version", "int"), ("id", "uuid"), ("index", "int"), ("timestamp", "time"), ("session_id", "uuid?"), ("agent_id", "text"),
    ("signing_key_id", "text?"), ("thought_signature", "bytes?"), ("thought_type", "type"), ("role", "role"), ("content", "text"),
    ("confidence", "float?"), ("importance", "float"), ("tags", "text*"), ("concepts", "text*"), ("refs", "int*"), ("relations", "relation*"),
    ("entity_type", "text?"), ("source_episode", "text?"), ("prev_hash", "text"), ("hash", "text"),
)
#: Fields of a relation, and how many of them a version has.
RELATION_FIELDS = (("kind", "kind"), ("target_id", "uuid"), ("chain_key", "text?"), ("valid_at", "time?"), ("invalid_at", "time?"))
RELATION_SIZES = {0: 2, 1: 2, 2: 3}
NAMES = {"type": TYPES, "role": ROLES, "kind": KINDS}
LATER = ("entity_type", "source_episode")


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise ValueError("record ends too early")
        self.at += n
        return part

    def int(self) -> int:
        first = self.take(1)[0]
        if first < 251:
            return first
        if first > 253:
            raise ValueError("number of more than 64 bits")
        return int.from_bytes(self.take({251: 2, 252: 4, 253: 8}[first]), "little")

    def value(self, kind: str, version: int):
        if kind[-1] == "?":
            flag = self.take(1)[0]
            if flag > 1:
                raise ValueError("neither there nor absent")
            return self.value(kind[:-1], version) if flag else None
        if kind[-1] == "*":
            return [self.value(kind[:-1], version) for _ in range(self.int())]
        if kind == "int":
            return self.int()
        if kind == "float":
            return struct.unpack("<f", self.take(4))[0]
        if kind in NAMES:
            return NAMES[kind][self.int()]
        if kind == "relation":
            some = RELATION_FIELDS[: RELATION_SIZES.get(version, len(RELATION_FIELDS))]
            return {name: None for name, _ in RELATION_FIELDS} | {name: self.value(k, version) for name, k in some}
        raw = self.take(self.int())
        if kind == "bytes":
            return raw
        if kind == "uuid":
            return str(uuid.UUID(bytes=raw))
        text = raw.decode()
        return parse_time(text) if kind == "time" else text


def parse_time(text: str) -> dt.datetime:
    """UTC time of RFC 3339 text, to the microsecond."""
    cut = re.sub(r"(\.\d{6})\d+", r"\1", text.replace("Z", "+00:00"))
    return dt.datetime.fromisoformat(cut).astimezone(dt.timezone.utc)


def decode(data: bytes) -> dict:
    """One record, brought to the current version; version as found is in `found_version`. Hashes of versions 0 and 1 are not carried over."""
    version = Cursor(data).int()
    wanted = [FIELDS] if version >= SCHEMA_VERSION else []
    wanted.append(tuple(f for f in FIELDS if f[0] not in LATER))  # as records were before the later fields
    for k, fields in enumerate(wanted):
        cursor = Cursor(data)
        try:
            row = {name: cursor.value(kind, version) for name, kind in fields}
            if cursor.at < len(data) and k + 1 < len(wanted):
                continue
            break
        except (ValueError, IndexError):
            if k + 1 == len(wanted):
                raise ValueError(f"not a record of version {version}") from None
    row |= {name: None for name in LATER if name not in row} | {"found_version": version, "schema_version": SCHEMA_VERSION}
    if version < 2:
        row |= {"prev_hash": "", "hash": ""}
    return row


def encode(row: dict) -> bytes:
    """The record as its payload; the inverse of decode for the current version."""

    def number(n: int) -> bytes:
        if n < 251:
            return bytes([n])
        size, tag = (2, 251) if n < 1 << 16 else (4, 252) if n < 1 << 32 else (8, 253)
        return bytes([tag]) + n.to_bytes(size, "little")

    def value(kind: str, v) -> bytes:
        if kind[-1] == "?":
            return b"\0" if v is None else b"\1" + value(kind[:-1], v)
        if kind[-1] == "*":
            return number(len(v)) + b"".join(value(kind[:-1], x) for x in v)
        if kind == "int":
            return number(v)
        if kind == "float":
            return struct.pack("<f", v)
        if kind in NAMES:
            return number(NAMES[kind].index(v))
        if kind == "relation":
            return b"".join(value(k, v[name]) for name, k in RELATION_FIELDS)
        raw = v if kind == "bytes" else uuid.UUID(v).bytes if kind == "uuid" else v.isoformat().replace("+00:00", "Z").encode() if kind == "time" else v.encode()
        return number(len(raw)) + raw

    return b"".join(value(kind, row[name]) for name, kind in FIELDS)


def frames(source: BinaryIO) -> Iterator[bytes]:
    """Payloads of a file; what follows the last whole length is ignored, a payload that is cut off is an error."""
    while len(head := source.read(8)) == 8:
        n = int.from_bytes(head, "little")
        if n > MOST_BYTES:
            raise ValueError(f"a record of {n} bytes is over {MOST_BYTES}")
        payload = source.read(n)
        if len(payload) < n:
            raise ValueError("the last record is cut off")
        yield payload


def read_binary(spark: SparkSession, path: str, chain_key: str | None = None) -> DataFrame:
    """Records of the binary log files below a path, with found_version. The chain is `chain_key`, or the file's name without its ending."""
    files = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()]  # names of files only

    def run(batches):
        import io

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                fs, name = file_system(files[k])
                chain = chain_key or name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows = []
                with fs.open_input_stream(name) as source:
                    for payload in frames(io.BufferedReader(source)):
                        rows.append({"chain_key": chain} | decode(payload))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    from pyspark.sql.types import IntegerType, StructField, StructType

    out = StructType([*record_schema().fields, StructField("found_version", IntegerType())])
    if not files:
        return spark.createDataFrame([], out)
    return spark.range(0, len(files), 1, len(files)).mapInArrow(run, out)

