"""Operations records: monitoring rows mapped to attributes and log commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.scalars import level_name, milli, wrapped_timestamp
from tidelog.model import INSERT, INT, LOG_SCHEMA, STR

FAMILIES = {"service": STR, "node": STR, "level": STR, "message": STR, "timestamp": INT, "cpu_milli": INT, "mem_milli": INT, "response_time": INT}


def attributes(records: DataFrame) -> DataFrame:
    """Records (timestamp, service, node, level, message, cpu_usage, mem_usage, response_time_ms) as attribute columns."""
    others = [c for c in records.columns if c not in {"timestamp", "service", "node", "level", "message", "cpu_usage", "mem_usage", "response_time_ms"}]
    return records.select(
        *others,
        "service",
        "node",
        level_name(F.col("level")).alias("level"),
        "message",
        wrapped_timestamp(F.col("timestamp")).alias("timestamp"),
        milli(F.col("cpu_usage")).alias("cpu_milli"),
        milli(F.col("mem_usage")).alias("mem_milli"),
        F.col("response_time_ms").cast("bigint").alias("response_time"),
    )


def inserts(records: DataFrame, seq: str = "seq", entity: str = "entity_id") -> DataFrame:
    """Records as insert commands of the log; no blobs."""
    rows = attributes(records)

    def as_map(family: str):
        names = [a for a, f in FAMILIES.items() if f == family]
        return F.map_filter(F.create_map(*[x for a in names for x in (F.lit(a), F.col(a))]), lambda _, v: v.isNotNull())

    return rows.select(F.col(seq).alias("seq"), F.lit(INSERT).alias("op"), F.col(entity).alias("entity_id"), as_map(STR).alias("attrs_str"), as_map(INT).alias("attrs_int"), F.create_map().cast(LOG_SCHEMA["attrs_blob"].dataType).alias("attrs_blob"))
