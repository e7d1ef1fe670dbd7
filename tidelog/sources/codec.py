"""The binary form of commands and stored entities, for reading old logs: little-endian, lengths before contents."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import BLOB, INT, LOG_SCHEMA, STR, BatchInsert, Command, Delete, Insert, InsertFast

_ORDER = (STR, INT, BLOB)


class Malformed(ValueError):
    """Bytes that aren't a whole record."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Malformed("too short")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def sized(self) -> bytes:
        return self.take(self.number(4))

    def text(self) -> str:
        try:
            return self.sized().decode()
        except UnicodeDecodeError as e:
            raise Malformed("not UTF-8") from e

    def attrs(self) -> dict[str, object]:
        """Three sections: strings, integers, blobs."""
        value = {STR: self.text, INT: lambda: self.number(4), BLOB: self.sized}
        out: dict[str, object] = {}
        for family in _ORDER:
            for _ in range(self.number(4)):
                name = self.text()
                out[name] = value[family]()
        return out


def _sized(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data


def _attrs(insert: Insert) -> bytes:
    value = {STR: lambda v: _sized(v.encode()), INT: lambda v: struct.pack("<I", v), BLOB: _sized}
    own = insert.by_family()
    return b"".join(struct.pack("<I", len(own[f])) + b"".join(_sized(name.encode()) + value[f](v) for name, v in own[f].items()) for f in _ORDER)


def encode_entity(entity: Insert) -> bytes:
    return struct.pack("<Q", entity.entity_id) + _attrs(entity)


def decode_entity(data: bytes) -> Insert | None:
    """An entity, or None for malformed bytes."""
    try:
        r = _Reader(data)
        return Insert(r.number(8), r.attrs())
    except Malformed:
        return None


def encode(command: Command) -> bytes:
    match command:
        case Insert():
            return b"\x00" + encode_entity(command)
        case BatchInsert(items):
            return b"\x01" + struct.pack("<I", len(items)) + b"".join(map(encode_entity, items))
        case Delete(entity_id):
            return b"\x02" + struct.pack("<Q", entity_id)
        case InsertFast(entity_id, epoch, kind, payload):
            return b"\x03" + struct.pack("<QII", entity_id, epoch, kind) + _sized(payload)
    raise TypeError(type(command))


def decode(data: bytes) -> Command | None:
    """A command, or None for malformed bytes."""
    try:
        return _decoded(_Reader(data))
    except Malformed:
        return None


def _decoded(r: _Reader) -> Command | None:
    kind = r.number(1)
    if kind == 0:
        return Insert(r.number(8), r.attrs())
    if kind == 1:
        return BatchInsert(tuple(Insert(r.number(8), r.attrs()) for _ in range(r.number(4))))
    if kind == 2:
        return Delete(r.number(8))
    if kind == 3:
        return InsertFast(r.number(8), r.number(4), r.number(4), r.sized())
    return None


def framed(records: Iterator[bytes]) -> bytes:
    """Records with their lengths before them, as a log file has them."""
    return b"".join(map(_sized, records))


def unframed(data: bytes) -> Iterator[bytes]:
    """The records of a log or entity file. It ends at a truncated one; lengths of 0 are padding."""
    at = 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        at += 4
        if n == 0:
            continue
        if at + n > len(data):
            return
        yield data[at : at + n]
        at += n


def read_log_files(files: DataFrame) -> DataFrame:
    """Old log files, as the ``binaryFile`` source gives them, as log rows.

    Undecodable records are skipped. Files are ordered by path and each has 2^40 sequence numbers. A file, which a
    single writer made, is one task's work.
    """
    ordered = files.select("path", "content")
    numbers = ordered.select("path").distinct()
    rank = numbers.select("path", F.row_number().over(Window.orderBy("path")).alias("file"))  # paths only, one row a file
    rows = ordered.join(rank, "path").select("file", "content")

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                for record in unframed(content):
                    command = decode(record)
                    if command is not None:
                        out += [((file << 40) + len(out) + i, *row) for i, row in enumerate(command.rows())]
                for at in range(0, len(out), 10_000):
                    seq, op, entity, strs, ints, blobs = zip(*out[at : at + 10_000])
                    maps = [pa.array([list(m.items()) for m in col], pa.map_(pa.string(), t)) for col, t in ((strs, pa.string()), (ints, pa.int64()), (blobs, pa.binary()))]
                    yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(op, pa.string()), pa.array(entity, pa.int64()), *maps], names=LOG_SCHEMA.names)

    return rows.mapInArrow(run, LOG_SCHEMA)

