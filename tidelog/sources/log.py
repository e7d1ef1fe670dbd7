"""The command log, and its two bindings.

A ``Log`` is a DataFrame with ``seq``, ``op``, ``entity_id`` and one typed column for each attribute. It comes from
stored commands, whose attributes are maps, or straight from a wide table; the latter keeps column pruning and predicate
pushdown. ``seq`` is the write order: unique, and data, not the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import BLOB, DELETE, FAMILIES, INSERT, INT, LOG_SCHEMA, SPARK_TYPE, STR, Command, merged_families

META = ("seq", "op", "entity_id")


@dataclass(frozen=True)
class Log:
    df: DataFrame
    families: Mapping[str, str]

    def attrs(self, family: str) -> list[str]:
        return [a for a, f in self.families.items() if f == family]

    def column(self, attr: str) -> Column:
        return F.col(f"`{attr}`")

    def writes(self) -> DataFrame:
        """All commands that write values."""
        return self.df.where(F.col("op") != DELETE)

    def checked(self) -> Log:
        """Itself, if every seq is there once and every integer is unsigned 32-bit; else an error."""
        twice = self.df.groupBy("seq").count().where("count > 1 or seq is null").limit(1).count()
        if twice:
            raise ValueError("seq repeats or is null")
        bounds = [(self.column(a) < 0) | (self.column(a) > 4294967295) for a in self.attrs(INT)]
        if bounds:
            bad = bounds[0]
            for b in bounds[1:]:
                bad = bad | b
            if self.df.where(bad).limit(1).count():
                raise ValueError("an integer isn't unsigned 32-bit")
        return self


def commands_frame(spark: SparkSession, commands: Iterable[Command], start: int = 0) -> DataFrame:
    """Commands as log rows, batches taken apart, numbered from ``start``."""
    rows = [row for c in commands for row in c.rows()]
    return spark.createDataFrame([(start + i, *row) for i, row in enumerate(rows)], LOG_SCHEMA)


def discovered_families(log: DataFrame) -> dict[str, str]:
    """The attribute names in the maps of a log. A name in two families is refused."""
    parts = []
    for family in FAMILIES:
        names = log.select(F.explode(F.map_keys(f"attrs_{family}")).alias("a")).distinct().collect()
        parts.append({r["a"]: family for r in sorted(names)})
    return merged_families(parts)


def from_commands(log: DataFrame, families: Mapping[str, str] | None = None) -> Log:
    """The log binding: maps to columns. Families are looked up in the log if they aren't given."""
    families = dict(families) if families is not None else discovered_families(log)
    return Log(log.select(*META, *[F.col(f"attrs_{f}")[a].cast(SPARK_TYPE[f]).alias(a) for a, f in families.items()]), families)


def from_table(df: DataFrame, entity: str, families: Mapping[str, str], seq: str | None = None, op: Column | None = None) -> Log:
    """The table binding: each row is one command, an insert unless ``op`` says otherwise."""
    return Log(
        df.select(
            F.col(seq or entity).cast("bigint").alias("seq"),
            (F.lit(INSERT) if op is None else op).alias("op"),
            F.col(entity).cast("bigint").alias("entity_id"),
            *[F.col(f"`{a}`").cast(SPARK_TYPE[f]).alias(a) for a, f in families.items()],
        ),
        dict(families),
    )


def to_commands(log: Log) -> DataFrame:
    """A log with its attributes as maps, as it is stored; a null is no attribute."""

    def as_map(family: str) -> Column:
        names = log.attrs(family)
        if not names:
            return F.create_map().cast(LOG_SCHEMA[f"attrs_{family}"].dataType)
        pairs = F.create_map(*[x for a in names for x in (F.lit(a), log.column(a))])
        return F.map_filter(pairs, lambda _, v: v.isNotNull())

    return log.df.select(*META, *[as_map(f).alias(f"attrs_{f}") for f in (STR, INT, BLOB)])


def batches(log: DataFrame, size: int) -> DataFrame:
    """Log rows gathered into batches of ``size`` consecutive commands (by ``seq`` div size): batch and its items."""
    item = F.struct("seq", "op", "entity_id", "attrs_str", "attrs_int", "attrs_blob")
    return log.groupBy(F.floor(F.col("seq") / size).alias("batch")).agg(F.sort_array(F.collect_list(F.col("seq"))).alias("order"), F.collect_list(item).alias("items"))


def exploded(batched: DataFrame, width: int) -> DataFrame:
    """Batch inserts as log rows: seq is batch * width + place in the batch."""
    rows = batched.select("batch", F.posexplode(F.array_sort("items", lambda a, b: (a["seq"] > b["seq"]).cast("int") - (a["seq"] < b["seq"]).cast("int"))).alias("place", "item"))
    return rows.select((F.col("batch") * width + F.col("place")).alias("seq"), "item.op", "item.entity_id", "item.attrs_str", "item.attrs_int", "item.attrs_blob")
