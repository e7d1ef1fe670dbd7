"""Current state: the last command of each entity wins, and reads of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import BLOB, DELETE, FAMILIES, INT, STR
from tidelog.sources.log import Log

TAG = {INT: "Int", STR: "Str", BLOB: "Blob"}


def state(log: Log, attrs: Sequence[str] | None = None) -> DataFrame:
    """One row per entity: ``entity_id``, the ``seq`` and ``op`` of its last command, and attributes.

    An aggregation with map-side combine, not a window: a hot entity is reduced before the shuffle.
    """
    names = list(log.families if attrs is None else attrs)
    last = F.max_by(F.struct("seq", "op", *[log.column(a) for a in names]), "seq").alias("last")
    return log.df.groupBy("entity_id").agg(last).select("entity_id", "last.*")


def live(log: Log, attrs: Sequence[str] | None = None) -> DataFrame:
    """State without tombstones."""
    return state(log, attrs).where(F.col("op") != DELETE)


def get(log: Log, attr: str, family: str) -> DataFrame:
    """``entity_id`` and the attribute, for live entities that have it; nothing if it is of another family."""
    if log.families.get(attr) != family:
        return log.df.sparkSession.createDataFrame([], f"entity_id bigint, `{attr}` string").where("false")
    return live(log, [attr]).where(log.column(attr).isNotNull()).select("entity_id", log.column(attr))


def with_value(log: Log, attr: str, family: str, f: Callable[[Column], Column]) -> DataFrame:
    """``entity_id`` and ``result``: ``f`` of the attribute of each live entity that has it.

    ``f`` is an expression, or a pandas UDF where there is none.
    """
    return get(log, attr, family).select("entity_id", f(log.column(attr)).alias("result"))


def tagged(log: Log, attr: str) -> list[Column]:
    """tag, v_int, v_str and v_blob of an attribute by its family; tag None where it is missing."""
    family = log.families.get(attr)
    value = log.column(attr) if family else F.lit(None)
    tag = F.when(value.isNotNull(), F.lit(TAG[family])).otherwise(F.lit("None")) if family else F.lit("None")
    kinds = {INT: "bigint", STR: "string", BLOB: "binary"}
    return [tag.alias("tag"), *[(value if f == family else F.lit(None)).cast(kinds[f]).alias(f"v_{f}") for f in FAMILIES]]


def dynamic_get(log: Log, attr: str, ids: DataFrame | None = None) -> DataFrame:
    """Get of all entities, or of those in ``ids`` (column entity_id): one tagged row each, missing ones too."""
    found = live(log, [attr] if attr in log.families else [])
    wanted = log.df.select("entity_id").distinct() if ids is None else ids
    return wanted.join(found, "entity_id", "left").select("entity_id", *tagged(log, attr))


def link(log: Log, link_attr: str, target_attr: str) -> DataFrame:
    """For all live entities: ``entity_id`` and the tagged target attribute of the entity they point to."""
    if log.families.get(link_attr) != INT:
        return live(log, []).select("entity_id", F.lit("None").alias("tag"), F.lit(None).cast("bigint").alias("v_int"), F.lit(None).cast("string").alias("v_str"), F.lit(None).cast("binary").alias("v_blob"))
    current = live(log, list(dict.fromkeys([link_attr, *[a for a in [target_attr] if a in log.families]])))
    sources = current.select("entity_id", log.column(link_attr).alias("__to"))
    targets = current.select(F.col("entity_id").alias("__at"), *([log.column(target_attr)] if target_attr in log.families else []))
    return sources.join(targets, F.col("__to") == F.col("__at"), "left").select("entity_id", *tagged(log, target_attr))


def signed_records(log: Log) -> DataFrame:
    """Entities with payload, epoch and type, all three."""
    names = ["payload", "epoch", "type"]
    return live(log, names).dropna(how="any", subset=names).select("entity_id", *names)


def entities(log: Log) -> DataFrame:
    """Ids of entities with an attribute: no tombstones, no empty inserts."""
    some = F.coalesce(*[log.column(a).isNotNull().cast("int") * F.when(log.column(a).isNotNull(), 1) for a in log.families], F.lit(0)) if log.families else F.lit(0)
    return live(log).where(some > 0).select("entity_id")


def size(log: Log) -> DataFrame:
    """How many entities were ever written or deleted."""
    return log.df.agg(F.countDistinct("entity_id").alias("entities"))
