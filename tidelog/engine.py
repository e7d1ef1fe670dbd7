"""The engine: named partitions, each a command log with its own settings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import Node
from tidelog.operators.facade import CommandLog, MemoryLog, Partition
from tidelog.operators.state import state
from tidelog.plans.batch import execute, for_each_result
from tidelog.sources.storage import Store, latest, metadata, prewarm
from tidelog.sources.tables import scratch


@dataclass(frozen=True)
class LogOptions:
    """How a partition's log is kept: in files, or in memory only; written at ``batch`` commands, or when it's read or
    flushed. ``flush_micros`` is how often ``streaming.ingest.follow`` applies what has landed; under 1,000 needs
    ``expert``."""

    durable: bool = True
    flush_micros: int = 1_000
    batch: int = 4_096
    expert: bool = False

    def __post_init__(self):
        if self.flush_micros < 1_000 and not self.expert:
            raise ValueError("flushing more often than every 1,000 microseconds needs expert=True")
        if self.batch < 1:
            raise ValueError("batch must be positive")

    @property
    def trigger(self) -> dict[str, str]:
        """For ``writeStream.trigger``."""
        return {"processingTime": f"{max(1, self.flush_micros // 1_000)} milliseconds"}


@dataclass
class _Route:
    log: CommandLog
    store: Store | None
    options: LogOptions
    sleeping: bool = False
    warm: list[DataFrame] = field(default_factory=list)


class Engine:
    """Partitions by name; a dot in a name is a folder."""

    def __init__(self, spark: SparkSession, base: str | None = None):
        self.spark, self.base = spark, (base or scratch(spark, "engine")).rstrip("/")
        self._routes: dict[str, _Route] = {}

    def path(self, name: str) -> str:
        return f"{self.base}/{name.replace('.', '/')}.data"

    def register_partition(self, name: str, options: LogOptions = LogOptions()) -> Partition:
        """Opens a partition, with what its folder has; once more gives the same one."""
        if name not in self._routes:
            at = self.path(name)
            log = CommandLog(self.spark, f"{at}/log", options.batch) if options.durable else MemoryLog(self.spark, options.batch)
            self._routes[name] = _Route(log, Store(self.spark, f"{at}/entities") if options.durable else None, options)
        return Partition(self._routes[name].log)

    def get_partition(self, name: str) -> Partition | None:
        return Partition(self._routes[name].log) if name in self._routes else None

    def execute_batch(self, name: str, nodes: Sequence[Node], callback: Callable) -> object:
        """The nodes' results, one callback each row; nothing is called for an unknown partition."""
        if name not in self._routes:
            return None
        return for_each_result(execute(self._routes[name].log.log(), nodes), callback)

    def prewarm_partition(self, name: str, ids: Sequence[int]) -> DataFrame:
        """Holds some entities' state in memory; an error for an unknown partition."""
        if name not in self._routes:
            raise KeyError(name)
        route = self._routes[name]
        wanted = self.spark.createDataFrame([(i,) for i in ids], "entity_id bigint")
        route.warm.append(prewarm(state(route.log.log()), wanted))
        return route.warm[-1]

    def cool(self, name: str) -> None:
        for df in self._routes[name].warm:
            df.unpersist()
        self._routes[name].warm = []

    def store(self, name: str) -> DataFrame:
        """Adds what was written since the last time to the partition's store and gives its latest records. A partition
        in memory has no store: then its log's."""
        route = self._routes[name]
        if route.store is None:
            return latest(route.log.frame_of_writes())
        new = route.log.frame_of_writes()
        if route.store.files.exists(f"v{route.store.version:06d}"):
            last = route.store.records().agg(F.max("seq")).first()[0]
            new = new if last is None else new.where(F.col("seq") > last)
        route.store.append(new)
        return route.store.latest()

    def compact(self, name: str) -> int | None:
        store = self._routes[name].store
        return None if store is None else store.compact()

    def vacuum(self, name: str) -> list[str]:
        store = self._routes[name].store
        return [] if store is None else store.vacuum()

    def metrics(self) -> DataFrame:
        """name, partition_id and memory_entities of each partition."""
        out = None
        for i, (name, route) in enumerate(sorted(self._routes.items())):
            one = metrics(route.log.log().df, name, i)
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "name string, partition_id int, memory_entities bigint")

    def inspect_metadata(self) -> DataFrame | None:
        return metadata({n: r.log.log().df for n, r in self._routes.items()})

    def sleep(self, name: str) -> None:
        self._routes[name].sleeping = True

    def wake(self, name: str) -> None:
        self._routes[name].sleeping = False

    def is_sleeping(self, name: str) -> bool:
        return self._routes[name].sleeping

    def sync_cache(self) -> None:
        """Nothing: reads see what was written."""

    def flush_wal(self, name: str) -> None:
        self._routes[name].log.flush()


def metrics(log: DataFrame, name: str, partition_id: int) -> DataFrame:
    return log.agg(F.lit(name).alias("name"), F.lit(partition_id).alias("partition_id"), F.countDistinct("entity_id").alias("memory_entities"))
