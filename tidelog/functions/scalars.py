"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.model import U32_MAX

LEVELS = ("Info", "Warn", "Error", "Fatal", "Debug")


def u64_le(value: Column) -> Column:
    """A number's eight little-endian bytes."""
    return _le(value, 8)


def u32_le(value: Column) -> Column:
    return _le(value, 4)


def _le(value: Column, size: int) -> Column:
    digits = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]))


def saturated_u32(value: Column) -> Column:
    """A float as an unsigned 32-bit integer: truncated, NaN and negatives to 0, too large ones to the maximum."""
    return F.when(F.isnan(value) | (value < 0), F.lit(0)).when(value >= float(U32_MAX), F.lit(U32_MAX)).otherwise(value.cast("bigint")).cast("bigint")


def milli(value: Column) -> Column:
    """A float32 ratio in thousandths, multiplied in float32."""
    return saturated_u32(value.cast("float") * F.lit(1000).cast("float"))


def wrapped_timestamp(value: Column) -> Column:
    """Seconds modulo 2^32 - 1."""
    return F.pmod(value.cast("bigint"), F.lit(U32_MAX).cast("bigint"))


def level_name(value: Column) -> Column:
    """A log level by its name, in any case; null for others."""
    names = F.create_map(*[x for level in LEVELS for x in (F.lit(level.lower()), F.lit(level))])
    return F.element_at(names, F.lower(value))


def key_id(key: Column) -> Column:
    """An entity id from a key's hash. Compare keys as well: ids may collide."""
    return F.xxhash64(key)
