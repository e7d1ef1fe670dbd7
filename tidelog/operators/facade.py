"""Facades over the log: a partition's typed reads and writes, key-value stores and typed caches.

Writes are buffered commands, appended as log rows; reads derive the state. A facade is for applications and tests;
bulk work goes to the log itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Generic, Protocol, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.scalars import key_id
from tidelog.model import BLOB, DELETE, INT, LOG_SCHEMA, STR, Command, Delete, Insert, InsertFast
from tidelog.operators.state import get
from tidelog.sources.log import Log, commands_frame, from_commands
from tidelog.sources.tables import scratch

V = TypeVar("V")


class CommandLog:
    """An append-only log of commands below a folder. One writer; seq goes on from what is there. With ``batch``, so many
    commands are written at once without being asked."""

    def __init__(self, spark: SparkSession, path: str | None = None, batch: int | None = None):
        self.spark, self.path, self.batch = spark, path or scratch(spark, "log"), batch
        self._pending: list[Command] = []
        self._next: int | None = None

    def _start(self) -> int:
        if self._next is None:
            last = self.frame().agg(F.max("seq")).first()[0]
            self._next = 0 if last is None else last + 1
        return self._next

    def send(self, *commands: Command) -> None:
        self._pending += commands
        if self.batch and len(self._pending) >= self.batch:
            self.flush()

    def try_send(self, command: Command, capacity: int = 262_144) -> bool:
        """False, and the command is dropped, if the buffer is full."""
        if len(self._pending) >= capacity:
            return False
        self._pending.append(command)
        return True

    def flush(self) -> None:
        """Appends what was sent, as one group commit."""
        if self._pending:
            rows = commands_frame(self.spark, self._pending, self._start())
            rows.write.mode("append").parquet(self.path)
            self._next = self._start() + sum(len(c.rows()) for c in self._pending)
            self._pending = []

    def append(self, log: DataFrame) -> None:
        """Appends log rows in bulk; their seq must be larger than all before."""
        self.flush()
        log.select(*LOG_SCHEMA.names).write.mode("append").parquet(self.path)
        self._next = None

    def frame(self) -> DataFrame:
        from tidelog.sources.storage import Files

        if not Files(self.spark, self.path).exists():
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.path)

    def log(self) -> Log:
        """The log with all that was sent."""
        self.flush()
        return from_commands(self.frame())

    def frame_of_writes(self) -> DataFrame:
        """All commands that write values, as they are stored: attributes as maps, whatever their names."""
        self.flush()
        return self.frame().where(F.col("op") != DELETE)

    def of_entity(self, entity_id: int, families: dict[str, str]) -> Log:
        """One entity's commands with some attributes; the filter goes down to the files."""
        self.flush()
        return from_commands(self.frame().where(F.col("entity_id") == entity_id), families)


class MemoryLog(CommandLog):
    """The same without files: frames held in memory, gone with the session."""

    def __init__(self, spark: SparkSession, batch: int | None = None):
        self.spark, self._pending, self._next, self.batch = spark, [], 0, batch
        self._frames: list[DataFrame] = []

    def flush(self) -> None:
        if self._pending:
            self._frames.append(commands_frame(self.spark, self._pending, self._start()).persist())
            self._next = self._start() + sum(len(c.rows()) for c in self._pending)
            self._pending = []

    def append(self, log: DataFrame) -> None:
        self.flush()
        self._frames.append(log.select(*LOG_SCHEMA.names).persist())
        self._next = None

    def frame(self) -> DataFrame:
        out = self.spark.createDataFrame([], LOG_SCHEMA)
        for f in self._frames:
            out = out.unionByName(f)
        return out


class PartitionReader:
    """Typed point reads."""

    def __init__(self, log: CommandLog):
        self.log_ = log

    def _get(self, entity_id: int, attr: str, family: str) -> Any:
        # One scan of the entity's rows: the asked family's map says whether the attribute is there, so no names are looked up.
        row = get(self.log_.of_entity(entity_id, {attr: family}), attr, family).select(F.col(f"`{attr}`")).first()
        return None if row is None else bytes(row[0]) if family == BLOB else row[0]

    def get_int(self, entity_id: int, attr: str) -> int | None:
        return self._get(entity_id, attr, INT)

    def get_str(self, entity_id: int, attr: str) -> str | None:
        return self._get(entity_id, attr, STR)

    def get_blob(self, entity_id: int, attr: str) -> bytes | None:
        return self._get(entity_id, attr, BLOB)

    def with_value(self, entity_id: int, attr: str, family: str, f: Callable[[Any], V]) -> V | None:
        """``f`` of the value, or None."""
        value = self._get(entity_id, attr, family)
        return None if value is None else f(value)


class Partition(PartitionReader):
    """Reads and writes of one partition. A write replaces the whole entity."""

    def write_str(self, entity_id: int, attr: str, value: str) -> None:
        self.log_.send(Insert(entity_id, {attr: value}))

    def write_int(self, entity_id: int, attr: str, value: int) -> None:
        self.log_.send(Insert(entity_id, {attr: value}))

    def write_blob(self, entity_id: int, attr: str, value: bytes) -> None:
        self.log_.send(Insert(entity_id, {attr: value}))

    def write_epoch_snapshot(self, entity_id: int, epoch: int, kind: int, payload: bytes) -> None:
        self.log_.send(InsertFast(entity_id, epoch, kind, payload))

    read_str = PartitionReader.get_str
    read_int = PartitionReader.get_int
    read_blob = PartitionReader.get_blob

    def delete(self, entity_id: int) -> None:
        self.log_.send(Delete(entity_id))


class EntityStore(Protocol[V]):
    def put(self, entity_id: int, value: V) -> None: ...
    def get(self, entity_id: int) -> V | None: ...
    def delete(self, entity_id: int) -> None: ...


@dataclass
class StrStore:
    """Strings under one attribute."""

    partition: Partition
    attr: str

    def put(self, entity_id: int, value: str) -> None:
        self.partition.write_str(entity_id, self.attr, value)

    def get(self, entity_id: int) -> str | None:
        return self.partition.read_str(entity_id, self.attr)

    def delete(self, entity_id: int) -> None:
        self.partition.delete(entity_id)


@dataclass
class BlobStore:
    """Blobs under one attribute."""

    partition: Partition
    attr: str

    def put(self, entity_id: int, value: bytes) -> None:
        self.partition.write_blob(entity_id, self.attr, value)

    def get(self, entity_id: int) -> bytes | None:
        return self.partition.read_blob(entity_id, self.attr)

    def delete(self, entity_id: int) -> None:
        self.partition.delete(entity_id)


class SimpleKvStore(BlobStore):
    """A key-value store of blobs, durable in its folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        super().__init__(Partition(CommandLog(spark, path)), "data")


class TypedCache(Generic[V]):
    """Values by key: entity ids are key hashes, and the key is kept with the value, so ids may collide."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.log = spark, CommandLog(spark, path)

    def insert(self, key: object, value: V) -> None:
        name = json.dumps(key, sort_keys=True)
        row = self.spark.range(1).select(key_id(F.lit(name))).first()[0]
        self.log.send(Insert(row, {"key": name, "value": json.dumps(value)}))

    def get(self, key: object) -> V | None:
        name = json.dumps(key, sort_keys=True)
        from tidelog.operators.state import live

        entity_id = self.spark.range(1).select(key_id(F.lit(name))).first()[0]
        row = live(self.log.of_entity(entity_id, {"key": STR, "value": STR}), ["key", "value"]).where(F.col("key") == name).first()
        return None if row is None else json.loads(row["value"])


def bulk_kv(df: DataFrame, seq: str, key: str, value: str, deleted: str | None = None) -> DataFrame:
    """Last value of each key of a table of puts (and deletes): ``key`` and ``data``."""
    gone = F.col(deleted) if deleted else F.lit(False)
    last = df.groupBy(F.col(key).alias("key")).agg(F.max_by(F.struct(F.col(value).alias("data"), gone.alias("gone")), F.col(seq)).alias("l"))
    return last.where(~F.col("l.gone") & F.col("l.data").isNotNull()).select("key", F.col("l.data").alias("data"))


def typed_values(df: DataFrame, key: str, schema: T.StructType, json_col: str) -> DataFrame:
    """A cache's values as typed structs."""
    return df.select(F.col(key), F.from_json(json_col, schema).alias("value"))
