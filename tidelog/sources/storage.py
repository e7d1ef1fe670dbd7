"""Stored entities: appended Parquet segments, published in versions.

A store is a folder of versions and a pointer file. Appending adds a segment to the current version; compaction
writes a new version and then moves the pointer, so a path is never overwritten while it's read. Deletes don't reach
the store: a read gives the latest record, deleted or not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 32


class Files:
    """The file system of a path, by Spark's own Hadoop client."""

    def __init__(self, spark: SparkSession, base: str):
        jvm = spark._jvm
        hadoop, conf = jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self._path = hadoop.Path
        self._fs = self._path(base).getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        self._overwrite = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
        self._overwrite[0] = hadoop.Options.Rename.OVERWRITE
        self.base = base

    def at(self, name: str):
        return self._path(f"{self.base}/{name}" if name else self.base)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.at(name))

    def make_dir(self, name: str = "") -> None:
        self._fs.mkdirs(self.at(name))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def read_range(self, name: str, start: int, length: int) -> bytes:
        stream = self._fs.open(self.at(name))
        try:
            stream.seek(start)
            return bytes(stream.readNBytes(length))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """Whole or not at all: to a temporary name, then renamed over the old file."""
        temporary = self.at(f".{name}.tmp")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(data))
        stream.close()
        self._context.rename(temporary, self.at(name), self._overwrite)

    def append(self, name: str, data: bytes) -> None:
        self.write(name, (self.read(name) if self.exists(name) else b"") + data)

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def size(self, name: str) -> int:
        return self._fs.getFileStatus(self.at(name)).getLen()

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(name)))


@dataclass
class Store:
    """Records (seq, entity_id, ...) below ``path``."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        self.files = Files(self.spark, self.path)
        if not self.files.exists("CURRENT"):
            self.files.make_dir()
            self.files.write("CURRENT", b"0")

    @property
    def version(self) -> int:
        return int(self.files.read("CURRENT"))

    def _dir(self, version: int) -> str:
        return f"{self.path}/v{version:06d}"

    def append(self, records: DataFrame) -> None:
        """Adds records, clustered by entity so that reads of some ids skip row groups; a Parquet bloom filter helps."""
        records.sortWithinPartitions("entity_id").write.mode("append").option("parquet.bloom.filter.enabled#entity_id", "true").parquet(self._dir(self.version))

    def records(self) -> DataFrame:
        return self.spark.read.parquet(self._dir(self.version))

    def latest(self) -> DataFrame:
        return latest(self.records())

    def read_entity(self, entity_id: int) -> DataFrame:
        """The latest record; an error if there is none."""
        found = latest(self.records().where(F.col("entity_id") == entity_id))
        if found.isEmpty():
            raise KeyError(entity_id)
        return found

    def read_block(self, entity_id: int, block: int = BLOCK) -> DataFrame:
        return latest(in_block(self.records(), entity_id, block))

    def contains(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.records().select("entity_id").distinct(), "entity_id", "left_semi")

    def disk_index(self) -> DataFrame:
        return disk_index(self.records())

    def compact(self) -> int:
        """Keeps each entity's latest record, in a new version; returns it."""
        new = self.version + 1
        self.latest().repartitionByRange("entity_id").sortWithinPartitions("entity_id").write.mode("overwrite").option("parquet.bloom.filter.enabled#entity_id", "true").parquet(self._dir(new))
        self.files.write("CURRENT", str(new).encode())
        return new

    def vacuum(self) -> list[str]:
        """Deletes versions before the current one, when no reader uses them any more; returns their names."""
        gone = [n for n in self.files.names() if n.startswith("v") and n < f"v{self.version:06d}"]
        for name in gone:
            self.files.delete(name)
        return gone

    def promote(self, ids: DataFrame) -> DataFrame:
        """Some entities' latest records, held in memory; answers don't change."""
        return prewarm(self.latest(), ids)

    def sign(self) -> None:
        """Writes the manifest that ``verify_integrity`` compares with."""
        row = checksum(self.records()).first()
        self.files.write("MANIFEST", f"{self.version} {row['n']} {row['sum']}".encode())

    def verify_integrity(self) -> bool:
        if not self.files.exists("MANIFEST"):
            return False
        row = checksum(self.records()).first()
        return self.files.read("MANIFEST").decode() == f"{self.version} {row['n']} {row['sum']}"


def latest(records: DataFrame) -> DataFrame:
    """The record of each entity with the largest seq."""
    return records.groupBy("entity_id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in records.columns if c != "entity_id"]), "seq").alias("r")).select("entity_id", "r.*")


def in_block(records: DataFrame, entity_id: int, block: int = BLOCK) -> DataFrame:
    """Records with ids from the start of the entity's block on, two blocks of them; a range that is pushed down."""
    start = entity_id // block * block
    return records.where((F.col("entity_id") >= start) & (F.col("entity_id") < start + 2 * block))


def disk_index(records: DataFrame) -> DataFrame:
    """Where the latest record of each entity is: its seq, and how many records it has."""
    return records.groupBy("entity_id").agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("records"))


def checksum(records: DataFrame) -> DataFrame:
    """Row count and an order-free sum of row hashes; maps are hashed by their sorted entries."""
    cols = [F.array_sort(F.map_entries(f"`{f.name}`")) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in records.schema.fields]
    return records.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*cols)), F.lit(0)).alias("sum"))


def metadata(logs: dict[str, DataFrame]) -> DataFrame | None:
    """For each partition: its name, entities and commands."""
    out = None
    for name, log in sorted(logs.items()):
        one = log.agg(F.lit(name).alias("name"), F.countDistinct("entity_id").alias("entities"), F.count(F.lit(1)).alias("commands"))
        out = one if out is None else out.unionByName(one)
    return out


def reverse_search(records: DataFrame, blob: Column, pattern: bytes) -> DataFrame:
    """Ids of the entities whose blob contains ``pattern``."""
    return records.where(F.contains(blob, F.lit(pattern))).select("entity_id")


def prewarm(current: DataFrame, ids: DataFrame) -> DataFrame:
    return current.join(ids, "entity_id", "left_semi").persist()
