"""Mixing sources to target weights by Pfair scheduling.

Time is cut into slots, each for one block of documents. A source of weight w releases its i-th block (from 0) at slot
floor(i / w) and wants it placed before slot ceil((i + 1) / w); of the released blocks the one with the earliest
deadline is placed. With weights that add up to 1 every block meets its deadline, so at every point of the mix a source
is less than one block from its share.

Weights are taken as they are, as exact fractions; only if a number of slots is given they're first rounded to quotas of
a round of so many. The driver works the schedule out for all blocks, knowing sources by number; a document finds its
block's slots by a join.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from itertools import islice
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.plans.positions import with_running
from tidelog.sources.tables import written

#: Documents in a block; slots in a round that weights are rounded to (None: they aren't); the weight of a source by
#: default is its part of the documents to this power, so that small sources gain.
BLOCK, ROUND, FLATTEN = 16, None, 0.8
MAX_ROUND = 1_000_000
#: Sources up to which ``repeat`` broadcasts their turns; beyond, texts are shuffled.
MAX_BROADCAST = 100_000


def quotas(weights: Mapping, slots: int | None = ROUND) -> dict:
    """Whole numbers in the ratio of the positive weights, in order of names.

    With ``slots`` they are a round's slots instead, at least one each, by largest remainders; ties by name. The round is
    made longer, up to MAX_ROUND, for a source whose share is under 4 slots, and by the slots that small shares lack.
    """
    names = sorted((s for s, w in weights.items() if w > 0), key=lambda s: (s is not None, s))
    if not names:
        return {}
    parts = {s: Fraction(weights[s]) for s in names}
    if slots is None:
        unit = lcm(*[x.denominator for x in parts.values()])
        whole = {s: int(x * unit) for s, x in parts.items()}
        common = gcd(*whole.values())
        return {s: x // common for s, x in whole.items()}
    total = sum(parts.values())
    slots = max(slots, 4 * len(names), min(MAX_ROUND, int(4 * total / min(parts.values()))))
    exact = {s: parts[s] / total * slots for s in names}
    out = {s: max(1, int(exact[s])) for s in names}
    left = max(0, slots - sum(out.values()))
    for s in sorted((s for s in names if exact[s] >= 1), key=lambda s: (int(exact[s]) - exact[s], s is not None, s))[:left]:
        out[s] += 1
    return out


def _earliest(quota: Sequence[int]) -> Iterator[int]:
    """The source (by number) of each slot without end, earliest deadline first among the released; ties by number."""
    total = sum(quota)
    waiting = [(0, k) for k in range(len(quota))]  # (release, source)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    placed = [0] * len(quota)
    t = 0
    while quota:
        while waiting and waiting[0][0] <= t:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(placed[k] + 1) * total // quota[k]), k))
        deadline, k = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        yield k
        placed[k] += 1
        heapq.heappush(waiting, (placed[k] * total // quota[k], k))
        t += 1


def schedule(quota: Mapping) -> list:
    """The source of each slot of one round."""
    names = list(quota)
    return [names[k] for k in islice(_earliest(list(quota.values())), sum(quota.values()))]


def _order(quota: Sequence[int], blocks: Sequence[int]) -> np.ndarray:
    """The source of each slot up to the one in which the last source has placed all its blocks once."""
    out, left, behind = array("i"), list(blocks), len(blocks)
    for k in _earliest(quota):
        out.append(k)
        left[k] -= 1
        behind -= left[k] == 0
        if not behind:
            break
    return np.array(out, np.int64)


def _sources(docs: DataFrame, source: str, weights: Mapping | None) -> DataFrame:
    """``id`` in order of names, the source ``s``, its ``n`` documents and ``w`` (null: by n) of what is mixed. Sources
    without a positive weight aren't there."""
    found = docs.groupBy(F.col(source).cast("string").alias("s")).agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.lit(None).cast("double"))
    if weights is not None:
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0], "g string, given double")
        found = found.join(given, F.col("s").eqNullSafe(F.col("g"))).select("s", "n", F.col("given").alias("w"))
    return written(found.orderBy(F.asc_nulls_first("s")).withColumn("id", F.monotonically_increasing_id()), "mix-sources")


def _plan(docs: DataFrame, source: str, weights: Mapping | None, block: int, slots: int | None) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """(names, ids, blocks, order): ``s`` and ``id``; of each source its id and blocks; the source, by its place in
    ids, of each slot. The driver holds some 24 bytes a source beside the heap, and 4 to 40 a slot: no names."""
    names = _sources(docs, source, weights)
    held = names.select("id", "n", "w").orderBy("id").toArrow()
    n = held.column("n").to_pylist()
    given = {k: float(n[k]) ** FLATTEN if w is None else w for k, w in enumerate(held.column("w").to_pylist())}
    blocks = [-(-x // block) for x in n]
    quota = quotas(given, slots)
    return names.select("s", "id"), held.column("id").to_numpy(), np.array(blocks, np.int64), _order(list(quota.values()), blocks)


def _ranked(docs: DataFrame, names: DataFrame, source: str, key: str) -> DataFrame:
    """Key ``k``, ``s`` and ``id`` of each document's source, and its ``rank`` in it."""
    rows = docs.select(F.col(key).alias("k"), F.col(source).cast("string").alias("__s"))
    named = rows.join(names, F.col("__s").eqNullSafe(F.col("s"))).select("k", "s", "id")
    # The second order is written, so that it's the same whenever it's read.
    kept = written(named.withColumn("u", F.rand(11)), "mix")
    return with_running(kept, "k", ["id"], second=F.col("u"), name="rank").drop("u")


def mix(docs: DataFrame, weights: Mapping | None = None, source: str = "source", key: str = "doc_id", block: int = BLOCK, slots: int | None = ROUND) -> DataFrame:
    """The mix: ``key``, ``source``, ``block`` (of its source, by key), ``epoch``, ``slot`` and ``place`` in the slot.

    ``weights`` maps sources to positive numbers; sources without one are left out. By default every source has the
    weight n ** FLATTEN of its n documents. The mix ends with the slot in which the last source has placed all its
    blocks once; until then a source that has run out starts over (``epoch``), so nothing is lost and shares hold to
    the end. Null is a source like any other. Documents of one key are neighbours in an arbitrary order; null keys
    are last. An empty table gives an empty mix. Only keys and sources are shuffled. Every source has its own
    quota, however many there are, in the ratio of the weights themselves; only with ``slots`` is a weight below one slot
    of MAX_ROUND given one slot. Rows: about n times the largest n ** (1 - FLATTEN) over the mean; with given weights a
    large source of a tiny weight makes all others come again until it is through.
    """
    names, ids, blocks, order = _plan(docs, source, weights, block, slots)
    by = np.argsort(order, kind="stable")
    times = np.bincount(order, minlength=len(ids))
    number = np.empty(len(order), np.int64)
    number[by] = np.arange(len(order)) - np.repeat(np.cumsum(times) - times, times)
    turn = pa.table({"i": ids[order], "b": number % blocks[order], "epoch": number // blocks[order], "slot": np.arange(len(order))})
    # One row a slot; as a table, since it has as many rows as the mix has blocks.
    plan = written(docs.sparkSession.createDataFrame(turn, "i bigint, b bigint, epoch bigint, slot bigint"), "mix-plan")
    placed = _ranked(docs, names, source, key).withColumn("block", F.floor(F.col("rank") / block).cast("bigint"))
    turns = placed.join(plan, (F.col("id") == F.col("i")) & (F.col("block") == F.col("b")))
    return turns.select(F.col("k").alias(key), F.col("s").alias("source"), "block", "epoch", "slot", (F.col("rank") % block).cast("int").alias("place"))


def repeat(docs: DataFrame, weights: Mapping | None = None, source: str = "source", key: str = "doc_id", block: int = BLOCK, slots: int | None = ROUND) -> DataFrame:
    """``docs``, each row as often as the mix has it, columns as they are. Texts aren't shuffled.

    A source's documents differ by one turn at most: those up to a certain key have one more. So the mix is first
    reduced to that key for each source. Rows that share it are told apart by nothing and get the same number of turns.
    """
    names, ids, blocks, order = _plan(docs, source, weights, block, slots)
    times = np.bincount(order, minlength=len(ids))
    table = pa.table({"i": ids, "turns": times // blocks, "more": times % blocks * block})
    turns = docs.sparkSession.createDataFrame(table, "i bigint, turns bigint, more bigint")
    ranked = _ranked(docs, names, source, key)
    edge = ranked.join(turns, F.col("id") == F.col("i")).where("rank < more").groupBy(F.col("id").alias("e")).agg(F.max("k").alias("edge"), F.count(F.lit(1)).alias("some"), F.max(F.col("k").isNull()).alias("all"))
    # One row a source.
    known = names.join(turns, F.col("id") == F.col("i")).join(edge, F.col("id") == F.col("e"), "left").select("s", "turns", "edge", F.coalesce("all", F.lit(False)).alias("all"), F.coalesce("some", F.lit(0)).alias("some"))
    mark, turn = "mix", "turn"
    while {mark, turn} & set(docs.columns):
        mark, turn = mark + "_", turn + "_"
    known = known.select(F.struct("s", "turns", "edge", "all", "some").alias(mark))
    joined = docs.join(F.broadcast(known) if len(ids) <= MAX_BROADCAST else known, F.col(source).cast("string").eqNullSafe(F.col(f"{mark}.s")))
    more = F.when(F.col(f"{mark}.some") == 0, 0).when(F.col(f"{mark}.all"), 1).otherwise(F.coalesce((F.col(key) <= F.col(f"{mark}.edge")).cast("int"), F.lit(0)))
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(f"{mark}.turns") + more))).select(*[F.col(f"`{c}`") for c in docs.columns])
