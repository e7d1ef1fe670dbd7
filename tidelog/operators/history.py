"""Column history: every value ever written to an attribute, in write order, deleted and overwritten ones too."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import BLOB, FAMILIES, INT, STR
from tidelog.operators.state import live
from tidelog.plans.positions import with_running
from tidelog.sources.log import Log

LIST_TAG = {INT: "IntList", STR: "StrList", BLOB: "BlobList"}


def column(log: Log, attr: str) -> DataFrame:
    """``pos``, ``seq``, ``entity_id`` and ``v`` of one attribute; pos counts its writes from 0."""
    written = log.writes().where(log.column(attr).isNotNull()).select("seq", "entity_id", log.column(attr).alias("v"))
    return with_running(written, "seq", name="pos").select("pos", "seq", "entity_id", "v")


def history(log: Log) -> DataFrame:
    """All columns: ``attr``, ``family``, ``pos``, ``seq``, ``entity_id`` and ``v_int``, ``v_str`` or ``v_blob``."""

    def cell(attr: str, family: str) -> Column:
        kinds = {INT: "bigint", STR: "string", BLOB: "binary"}
        values = [(log.column(attr) if f == family else F.lit(None)).cast(kinds[f]).alias(f"v_{f}") for f in FAMILIES]
        return F.struct(F.lit(attr).alias("attr"), F.lit(family).alias("family"), log.column(attr).isNotNull().alias("there"), *values)

    cells = F.filter(F.array(*[cell(a, f) for a, f in log.families.items()]), lambda c: c["there"])
    rows = log.writes().select("seq", "entity_id", F.explode(cells).alias("c")).select("seq", "entity_id", "c.attr", "c.family", "c.v_int", "c.v_str", "c.v_blob")
    return with_running(rows, "seq", ["attr", "family"], name="pos").select("attr", "family", "pos", "seq", "entity_id", "v_int", "v_str", "v_blob")


def snapshot(log: Log) -> DataFrame:
    """The live entities' pointers: ``entity_id``, ``attr`` and the ``pos`` of its current value."""
    heads = live(log, []).select("seq")
    return history(log).join(heads, "seq", "left_semi").select("entity_id", "attr", "pos")


def scan(log: Log, attr: str, live_only: bool = False) -> DataFrame:
    """``tag``, ``pos`` and the values of a column, or one None row if there is no such column.

    ``live_only`` leaves out what was overwritten or deleted; positions stay.
    """
    family = log.families.get(attr)
    kinds = {INT: "bigint", STR: "string", BLOB: "binary"}
    if family is None:
        return log.df.sparkSession.range(1).select(F.lit("None").alias("tag"), F.lit(None).cast("bigint").alias("pos"), *[F.lit(None).cast(kinds[f]).alias(f"v_{f}") for f in FAMILIES])
    found = column(log, attr)
    if live_only:
        found = found.join(live(log, []).select("seq"), "seq", "left_semi")
    return found.select(F.lit(LIST_TAG[family]).alias("tag"), "pos", *[(F.col("v") if f == family else F.lit(None)).cast(kinds[f]).alias(f"v_{f}") for f in FAMILIES])


def ranges(log: Log, requests: DataFrame, attr: str) -> DataFrame:
    """For requests (req, entity_id, length): ``req``, ``pos`` and ``v``, ``length`` slots from each entity's current value.

    Lengths are taken up to the next power of two; a request touches two stretches of so many positions, so the join is
    on the stretch, whatever the length, and cells come once for each of at most 63 powers.
    """
    cells = column(log, attr)
    heads = live(log, [attr]).where(log.column(attr).isNotNull()).select("seq", F.col("entity_id").alias("__e"))
    starts = cells.join(heads, "seq", "left_semi").select(F.col("entity_id").alias("__e"), F.col("pos").alias("start"))
    # The bits of length - 1. Longer than 2^62 is longer than any column.
    power = F.length(F.bin(F.least(F.col("length"), F.lit(1 << 62)).cast("bigint") - 1)) - F.when(F.col("length") == 1, 1).otherwise(0)
    asked = requests.join(starts, requests["entity_id"] == starts["__e"]).where("length > 0").select("req", F.col("length").cast("bigint").alias("length"), "start", power.alias("power"))
    powers = [r["power"] for r in requests.where("length > 0").select(power.alias("power")).distinct().collect()]
    out = None
    for p in sorted(powers):
        stretch = F.shiftright(F.col("start"), p)
        keyed = asked.where(F.col("power") == p).select("*", F.explode(F.array(stretch, stretch + 1)).alias("stretch"))
        part = keyed.join(cells.select("pos", "v", F.shiftright(F.col("pos"), p).alias("stretch")), "stretch").where("pos >= start and pos - start < length").select("req", "pos", "v")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else asked.select("req", F.col("start").alias("pos"), F.lit(None).cast("bigint").alias("v")).where("false")


def range_from(log: Log, attr: str, length: int) -> DataFrame:
    """The range of every entity that holds ``attr``: ``entity_id``, ``pos``, ``v``."""
    asked = live(log, [attr]).where(log.column(attr).isNotNull()).select(F.col("entity_id").alias("req"), "entity_id", F.lit(length).cast("bigint").alias("length"))
    return ranges(log, asked, attr).withColumnRenamed("req", "entity_id")


def sums(log: Log, attr: str) -> dict[str, Column]:
    """The aggregates of an integer column; of an empty one sum, min and max are 0 and avg is null."""
    v = log.column(attr)
    return {"sum": F.coalesce(F.sum(v), F.lit(0)), "count": F.count(v), "min": F.coalesce(F.min(v), F.lit(0)), "max": F.coalesce(F.max(v), F.lit(0)), "avg": F.avg(v)}


def aggregate(log: Log, attr: str, functions: Sequence[str]) -> DataFrame:
    """One row with a column for each function, straight from the log, without positions.

    All are null if the column doesn't exist or isn't of integers. A sum past 2^63 is an error; ``exact_sum`` isn't.
    """
    if log.families.get(attr) != INT:
        kinds = {"avg": "double"}
        return log.df.sparkSession.range(1).select(*[F.lit(None).cast(kinds.get(f, "bigint")).alias(f) for f in functions])
    every = sums(log, attr)
    return log.writes().agg(*[every[f].alias(f) for f in functions])


def with_data(log: Log, attr: str, f: Callable[[Column], Column]) -> DataFrame:
    """``result``: ``f``, an aggregate expression or a grouped pandas UDF, of a whole column."""
    return log.writes().agg(f(log.column(attr)).alias("result"))


def exact_sum(log: Log, attr: str) -> DataFrame:
    return log.writes().agg(F.coalesce(F.sum(log.column(attr).cast("decimal(20,0)")), F.lit(0)).alias("sum"))


def sum_range(log: Log, attr: str, start: int, length: int) -> DataFrame:
    """The sum of the positions [start, start + length); null if there is no such integer column."""
    if log.families.get(attr) != INT:
        return log.df.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("sum"))
    return column(log, attr).where((F.col("pos") >= start) & (F.col("pos") < start + length)).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("sum"))


# Columns as slots with a validity mask: pos, v, valid.


def slots(cells: DataFrame) -> DataFrame:
    return cells.select("pos", "v", F.lit(True).alias("valid"))


def set_valid(column_: DataFrame, hit: Column, valid: bool) -> DataFrame:
    """Marks slots; the value stays underneath."""
    return column_.withColumn("valid", F.when(hit, F.lit(valid)).otherwise(F.col("valid")))


def set_values(column_: DataFrame, values: DataFrame) -> DataFrame:
    """Sets ``values`` (pos, v); new slots up to the largest pos come as invalid ones."""
    top = column_.select("pos").unionByName(values.select("pos")).agg(F.max("pos").alias("top"))
    # A few starts, each filled in on the executors.
    stretch = 1 << 16
    starts = top.where("top is not null").select("top", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("top") / stretch))).alias("k")).repartition("k")
    places = starts.select(F.explode(F.sequence(F.col("k") * stretch, F.least(F.col("top"), (F.col("k") + 1) * stretch - 1))).alias("pos"))
    old = column_.select("pos", F.col("v").alias("v0"), F.col("valid").alias("valid0"))
    new = values.select("pos", F.col("v").alias("v1"), F.lit(True).alias("valid1"))
    return places.join(old, "pos", "left").join(new, "pos", "left").select("pos", F.when(F.col("valid1"), F.col("v1")).otherwise(F.col("v0")).alias("v"), F.coalesce("valid1", "valid0", F.lit(False)).alias("valid"))


def iterate(column_: DataFrame) -> DataFrame:
    """pos and value, null where a slot is invalid."""
    return column_.select("pos", F.when(F.col("valid"), F.col("v")).alias("v"))


def lengths(column_: DataFrame) -> DataFrame:
    """Slots, and valid slots."""
    return column_.agg(F.count(F.lit(1)).alias("slots"), F.count(F.when(F.col("valid"), 1)).alias("valid"))


def elements(column_: DataFrame, positions: DataFrame) -> DataFrame:
    """The slots at some positions (column pos): pos and v, one row each; v is null in an invalid slot or beyond the end."""
    return positions.join(iterate(column_), "pos", "left")
