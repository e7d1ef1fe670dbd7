"""Streaming ingestion of the command log into current state.

A micro-batch is reduced to the last command of each entity and written as one delta, named by its source and batch, so
a replayed batch is known. Every folder is written under a name of its own and counts once it's complete; none is ever
written again, and deltas of several sources don't meet. Reading merges base and deltas by seq; tombstones stay, so an
older insert that is replayed can't bring an entity back. Compaction folds deltas into a new base.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.sources.storage import Files


def last_commands(log: DataFrame) -> DataFrame:
    """The row with the largest seq of each entity."""
    rest = [c for c in log.columns if c != "entity_id"]
    return log.groupBy("entity_id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), "seq").alias("r")).select("entity_id", "r.*")


class StateTable:
    """Current state below ``path``: a base and deltas. The manifest names the base and the deltas folded into it; every
    other complete delta counts as well, so writers don't need each other's leave."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, fold_after: int = 16):
        self.spark, self.path, self.schema, self.fold_after = spark, path, schema, fold_after
        self.files = Files(spark, path)
        if not self.files.exists("PARTS"):
            self.files.make_dir()
            self.files.write("PARTS", b"")

    def _folded(self) -> list[str]:
        """The base, if there is one, and the deltas in it."""
        return self.files.read("PARTS").decode().split()

    def _deltas(self) -> list[str]:
        return [n for n in self.files.names() if n.startswith("delta-") and self.files.exists(f"{n}/_SUCCESS")]

    @property
    def parts(self) -> list[str]:
        folded = self._folded()
        return [*folded[:1], *sorted(set(self._deltas()) - set(folded))]

    def merge(self, batch: DataFrame, batch_id: int, source: str = "") -> None:
        """For ``foreachBatch``: idempotent by ``source`` and ``batch_id``, until its delta is vacuumed; after that the
        same rows again, which change nothing."""
        name = f"delta-{hashlib.sha256(source.encode()).hexdigest()[:16]}-{batch_id:012d}-"
        if any(n.startswith(name) for n in self._deltas()):
            return
        last_commands(batch).select(*self.schema.names).write.parquet(f"{self.path}/{name}{uuid.uuid4().hex}")
        if len(self.parts) > self.fold_after:
            self.fold()

    def fold(self) -> None:
        """One new base for all parts. What it replaces stays until ``vacuum``, for readers that began before."""
        folded, parts = self._folded(), self.parts
        base = f"base-{uuid.uuid4().hex}"
        self._read(parts).write.parquet(f"{self.path}/{base}")
        self.files.write("PARTS", "\n".join([base, *sorted({*folded[1:], *parts} - {*folded[:1]})]).encode())

    def vacuum(self) -> list[str]:
        """Deletes bases and deltas that the manifest replaced, when no reader uses them any more; returns their names."""
        folded = self._folded()
        gone = [n for n in self.files.names() if n in folded[1:] or (n.startswith("base-") and n not in folded[:1])]
        for name in gone:
            self.files.delete(name)
        return gone

    def _read(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return last_commands(self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts])).select(*self.schema.names)

    def current(self) -> DataFrame:
        """Last command of each entity, tombstones too."""
        return self._read(self.parts)


def _started(stream: DataFrame, table: StateTable, checkpoint: str, mode: str, trigger: dict):
    return stream.writeStream.outputMode(mode).foreachBatch(partial(table.merge, source=checkpoint)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _landed(landing: str, table: StateTable, files_per_batch: int) -> DataFrame:
    return table.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)


def ingest(landing: str, table: StateTable, checkpoint: str, files_per_batch: int = 8):
    """Applies the log files of a folder to a state table, those that are there now; returns the ended query."""
    query = _started(_landed(landing, table, files_per_batch), table, checkpoint, "append", {"availableNow": True})
    query.awaitTermination()
    return query


def follow(landing: str, table: StateTable, checkpoint: str, trigger: dict, files_per_batch: int = 8):
    """The same without end, a micro-batch at each ``trigger`` (see ``LogOptions.trigger``); returns the running query."""
    return _started(_landed(landing, table, files_per_batch), table, checkpoint, "append", trigger)


def latest_by_state(stream: DataFrame, schema: StructType) -> DataFrame:
    """The same by a stateful operator: a row for an entity whenever its last command changes.

    A streaming aggregation: a micro-batch is reduced before the shuffle, and the state is each entity's last command with
    the time of its micro-batch, which tells whether it is a new one. Of equal seqs the one that came first stays.
    """
    now = F.current_timestamp()  # one value in a micro-batch, the same when it is replayed
    rest = [F.col(f"`{c}`") for c in schema.names if c != "entity_id"]
    order = F.struct(F.col("seq"), (-F.unix_micros("__at")).alias("earlier"))
    last = F.max_by(F.struct(F.struct(*rest).alias("row"), F.col("__at").alias("at")), order)
    changed = stream.withColumn("__at", now).groupBy("entity_id").agg(last.alias("last")).where(F.col("last.at") == now)
    return changed.select("entity_id", "last.row.*").select(*schema.names)


def run_stateful(landing: str, table: StateTable, checkpoint: str, files_per_batch: int = 8):
    """Feeds ``latest_by_state`` into a state table."""
    query = _started(latest_by_state(_landed(landing, table, files_per_batch), table.schema), table, checkpoint, "update", {"availableNow": True})
    query.awaitTermination()
    return query
