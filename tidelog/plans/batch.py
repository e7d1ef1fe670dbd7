"""Batched query nodes, fused: nodes of one kind share a plan, whatever their number."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.model import BLOB, INT, RESULT_SCHEMA, STR, Aggregate, Get, Link, Node, Range, Scan
from tidelog.operators import history
from tidelog.operators.state import TAG, live
from tidelog.sources.log import Log

_AGG_TAG = {"sum": "IntSum", "count": "Count", "min": "IntMin", "max": "IntMax", "avg": "IntAvg"}


def _shaped(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA.fields])


def _values(log: Log, current: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """entity_id, attr, tag and values of some attributes of live entities, one row each that has one."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("attr"), F.lit(TAG[log.families[a]]).alias("tag"), *[(log.column(a) if f == log.families[a] else F.lit(None)).cast(t).alias(f"v_{f}") for f, t in ((INT, "bigint"), (STR, "string"), (BLOB, "binary"))], log.column(a).isNotNull().alias("there"))
            for a in attrs
        ]
    )
    return current.select("entity_id", F.explode(F.filter(cells, lambda c: c["there"])).alias("c")).select("entity_id", "c.attr", "c.tag", "c.v_int", "c.v_str", "c.v_blob")


def _gets(log: Log, nodes: list[tuple[int, Get]]) -> DataFrame:
    spark = log.df.sparkSession
    asked = spark.createDataFrame([(i, n.entity_id, n.attr) for i, n in nodes], "node_idx int, entity_id bigint, attr string")
    known = sorted({n.attr for _, n in nodes} & set(log.families))
    if not known:
        return _shaped(asked.withColumn("tag", F.lit("None")))
    # Only the asked entities are reduced to their last command.
    few = Log(log.df.join(asked.select("entity_id").distinct(), "entity_id", "left_semi"), log.families)
    found = _values(log, live(few, known), known)
    return _shaped(asked.join(found, ["entity_id", "attr"], "left").withColumn("tag", F.coalesce("tag", F.lit("None"))))


def _links(log: Log, nodes: list[tuple[int, Link]]) -> DataFrame:
    spark = log.df.sparkSession
    asked = spark.createDataFrame([(i, n.from_entity_id, n.link_attr, n.target_attr) for i, n in nodes], "node_idx int, entity_id bigint, link_attr string, attr string")
    via = sorted({n.link_attr for _, n in nodes if log.families.get(n.link_attr) == INT})
    known = sorted({n.target_attr for _, n in nodes} & set(log.families))
    if not via or not known:
        return _shaped(asked.withColumn("tag", F.lit("None")))
    few = Log(log.df.join(asked.select("entity_id").distinct(), "entity_id", "left_semi"), log.families)
    steps = _values(log, live(few, via), via).select("entity_id", F.col("attr").alias("link_attr"), F.col("v_int").alias("to"))
    hops = asked.join(steps, ["entity_id", "link_attr"], "left").select("node_idx", F.col("to").alias("entity_id"), "attr")
    ends = Log(log.df.join(hops.select("entity_id").distinct(), "entity_id", "left_semi"), log.families)
    found = _values(log, live(ends, known), known)
    return _shaped(hops.join(found, ["entity_id", "attr"], "left").withColumn("tag", F.coalesce("tag", F.lit("None"))))


def _aggregates(log: Log, nodes: list[tuple[int, Aggregate]]) -> DataFrame:
    spark = log.df.sparkSession
    known = [(i, n) for i, n in nodes if log.families.get(n.attr) == INT]
    out = []
    if len(known) < len(nodes):
        out.append(_shaped(spark.createDataFrame([(i, "None") for i, n in nodes if log.families.get(n.attr) != INT], "node_idx int, tag string")))
    if known:
        one = log.writes().agg(*[history.sums(log, n.attr)[n.function].alias(f"n{i}") for i, n in known])
        cells = [
            F.struct(
                F.lit(i).alias("node_idx"),
                (F.when(F.col(f"n{i}").isNull(), F.lit("None")).otherwise(F.lit(_AGG_TAG[n.function]))).alias("tag"),
                (F.lit(None) if n.function == "avg" else F.col(f"n{i}")).cast("bigint").alias("v_int"),
                (F.col(f"n{i}") if n.function == "avg" else F.lit(None)).cast("double").alias("v_dbl"),
            )
            for i, n in known
        ]
        out.append(_shaped(one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")))
    return reduce(DataFrame.unionByName, out)


def _ranges(log: Log, nodes: list[tuple[int, Range]]) -> DataFrame:
    spark = log.df.sparkSession
    out = []
    for attr in sorted({n.attr for _, n in nodes}):
        own = [(i, n.entity_id, n.length) for i, n in nodes if n.attr == attr]
        asked = spark.createDataFrame(own, "req int, entity_id bigint, length bigint")
        if log.families.get(attr) != INT:
            out.append(_shaped(asked.select(F.col("req").alias("node_idx"), F.lit("None").alias("tag"))))
            continue
        holders = live(log, [attr]).where(log.column(attr).isNotNull()).select("entity_id", F.lit(True).alias("holds"))
        found = history.ranges(log, asked, attr)
        rows = asked.join(holders, "entity_id", "left").join(found, "req", "left")
        out.append(_shaped(rows.select(F.col("req").alias("node_idx"), F.when(F.col("holds"), F.lit("IntRange")).otherwise(F.lit("None")).alias("tag"), "pos", F.col("v").alias("v_int"))))
    return reduce(DataFrame.unionByName, out)


def _scans(log: Log, nodes: list[tuple[int, Scan]]) -> DataFrame:
    spark = log.df.sparkSession
    out = []
    for attr in sorted({n.attr for _, n in nodes}):
        found = history.scan(log, attr)
        if attr in log.families:  # a column without values is a result too: its tag, without a position
            tag = spark.createDataFrame([(history.LIST_TAG[log.families[attr]],)], "of string")
            found = tag.join(found, F.col("of") == F.col("tag"), "left").drop("tag").withColumnRenamed("of", "tag")
        ids = [i for i, n in nodes if n.attr == attr]
        out.append(_shaped(found.withColumn("node_idx", F.explode(F.array(*[F.lit(i) for i in ids])))))
    return reduce(DataFrame.unionByName, out)


def execute(log: Log, nodes: Sequence[Node]) -> DataFrame:
    """All results as rows (node_idx, tag, pos, v_int, v_dbl, v_str, v_blob): a row per element of a list result, one
    row for any other, tag None for a missing one. A list without elements is one row without a position."""
    makers: dict[type, Callable] = {Get: _gets, Link: _links, Aggregate: _aggregates, Range: _ranges, Scan: _scans}
    parts = []
    for kind, make in makers.items():
        own = [(i, n) for i, n in enumerate(nodes) if isinstance(n, kind)]
        if own:
            parts.append(make(log, own))
    if not parts:
        return log.df.sparkSession.createDataFrame([], RESULT_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def for_each_result(results: DataFrame, callback: Callable) -> object:
    """Calls ``callback`` with each row in node order, streaming them to the driver; returns its last value."""
    last = None
    for row in results.orderBy("node_idx", "pos").toLocalIterator(prefetchPartitions=True):
        last = callback(row)
    return last


_POOL = ThreadPoolExecutor(max_workers=4, thread_name_prefix="tidelog")


def execute_async(log: Log, nodes: Sequence[Node], callback: Callable) -> Future:
    """The batch on another thread; the future has the callback's last value."""
    return _POOL.submit(lambda: for_each_result(execute(log, nodes), callback))
