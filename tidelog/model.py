"""The data model: typed attributes, commands, query nodes and the schemas of their tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

INT, STR, BLOB = "int", "str", "blob"
FAMILIES = (INT, STR, BLOB)
#: Where a name is looked up first.
PRECEDENCE = {f: i for i, f in enumerate(FAMILIES)}
SPARK_TYPE = {INT: T.LongType(), STR: T.StringType(), BLOB: T.BinaryType()}
U32_MAX = (1 << 32) - 1

INSERT, FAST, DELETE = "insert", "insert_fast", "delete"



def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _L = T.StringType(), T.LongType()
LOG_SCHEMA = _schema(("seq", _L), ("op", _S), ("entity_id", _L), ("attrs_str", T.MapType(_S, _S)), ("attrs_int", T.MapType(_S, _L)), ("attrs_blob", T.MapType(_S, T.BinaryType())))
RESULT_SCHEMA = _schema(("node_idx", T.IntegerType()), ("tag", _S), ("pos", _L), ("v_int", _L), ("v_dbl", T.DoubleType()), ("v_str", _S), ("v_blob", T.BinaryType()))


def check_u32(value: int) -> int:
    """Integers of the model are unsigned 32-bit numbers."""
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= U32_MAX:
        raise ValueError(f"not an unsigned 32-bit integer: {value!r}")
    return value


def family_of(value: object) -> str:
    if isinstance(value, str):
        return STR
    if isinstance(value, (bytes, bytearray)):
        return BLOB
    check_u32(value)  # type: ignore[arg-type]
    return INT


def merged_families(parts: Iterable[Mapping[str, str]]) -> dict[str, str]:
    """One family for each name; a name in two families is refused."""
    out: dict[str, str] = {}
    for part in parts:
        for name, family in part.items():
            if out.setdefault(name, family) != family:
                raise ValueError(f"attribute {name!r} is both {out[name]} and {family}")
    return out


@dataclass(frozen=True)
class Insert:
    """Replaces the entity: attributes that aren't named are gone."""

    entity_id: int
    attrs: Mapping[str, object] = field(default_factory=dict)

    def by_family(self) -> dict[str, dict]:
        out: dict[str, dict] = {f: {} for f in FAMILIES}
        for name, value in self.attrs.items():
            out[family_of(value)][name] = bytes(value) if isinstance(value, bytearray) else value
        return out

    def rows(self) -> list[tuple]:
        own = self.by_family()
        return [(INSERT, self.entity_id, own[STR], own[INT], own[BLOB])]


@dataclass(frozen=True)
class InsertFast:
    """A signed record: epoch, type and payload."""

    entity_id: int
    epoch: int
    kind: int
    payload: bytes

    def rows(self) -> list[tuple]:
        return [(FAST, self.entity_id, {}, {"epoch": check_u32(self.epoch), "type": check_u32(self.kind)}, {"payload": self.payload})]


@dataclass(frozen=True)
class BatchInsert:
    """Its items in their order."""

    items: tuple[Insert, ...]

    def rows(self) -> list[tuple]:
        return [row for item in self.items for row in item.rows()]


@dataclass(frozen=True)
class Delete:
    """Leaves a tombstone; what was written stays in the columns."""

    entity_id: int

    def rows(self) -> list[tuple]:
        return [(DELETE, self.entity_id, {}, {}, {})]


Command = Insert | InsertFast | BatchInsert | Delete


@dataclass(frozen=True)
class Get:
    entity_id: int
    attr: str


@dataclass(frozen=True)
class Link:
    """The target attribute of the entity that an integer attribute names."""

    from_entity_id: int
    link_attr: str
    target_attr: str


@dataclass(frozen=True)
class Range:
    """``length`` slots of an integer column from the entity's current value on, in write order."""

    entity_id: int
    attr: str
    length: int


@dataclass(frozen=True)
class Scan:
    attr: str


AGGREGATES = ("sum", "count", "min", "max", "avg")


@dataclass(frozen=True)
class Aggregate:
    attr: str
    function: str

    def __post_init__(self):
        if self.function not in AGGREGATES:
            raise ValueError(f"no aggregate {self.function!r}")


Node = Get | Link | Range | Scan | Aggregate


@dataclass(frozen=True)
class Query:
    """A list of nodes with a name."""

    name: str
    nodes: tuple[Node, ...]
