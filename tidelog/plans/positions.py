"""Gapless positions and running sums over an order, without a single-task window.

``row_number`` over a whole attribute, shard or source would send it to one task. Here the order key is
cut at quantiles into buckets; a window ranks rows inside a (group, bucket) cell, and the cell totals,
a few per bucket, give each cell its base. A key, or null, that many rows have gets buckets of its own, cut by a second
order. The result doesn't depend on where the cuts fall.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one bucket is meant to hold; quantiles that are taken; the most buckets (a literal of 256 KB).
ROWS_PER_BUCKET = 50_000
QUANTILES = 1_024
MAX_BUCKETS = 32_768
LONG_MAX = (1 << 63) - 1


@dataclass(frozen=True)
class Cuts:
    """``bounds`` between buckets of keys, nulls in one more; ``split``: buckets that are cut again, into how many."""

    bounds: list[int]
    split: dict[int, int] = field(default_factory=dict)

    @property
    def of_keys(self) -> int:
        """Buckets below those of null."""
        return len(self.bounds) + 1 + sum(n - 1 for b, n in self.split.items() if b <= len(self.bounds))

    @property
    def count(self) -> int:
        return self.of_keys + self.split.get(len(self.bounds) + 1, 1)


def quantile_cuts(df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> Cuts:
    """Cuts of the integer column ``key`` so that buckets have about equal row counts, at most MAX_BUCKETS.

    Beyond QUANTILES buckets, the stretches between quantiles are cut evenly. A key that several quantiles name is a
    bucket by itself, which is split, as is null.
    """
    probs = [i / QUANTILES for i in range(QUANTILES + 1)]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("m"), F.percentile_approx(key, probs, 10_000).alias("q")).first()
    buckets = min(MAX_BUCKETS, max(1, -(-row["m"] // rows_per_bucket)))
    q, cuts, often = [int(x) for x in row["q"] or ()], set(), {}
    if buckets > 1 and q:
        for i in range(1, buckets):
            k, rest = divmod(i * QUANTILES, buckets)
            cuts.add(q[k] + (q[k + 1] - q[k]) * rest // buckets)
        often = {v: min(buckets, n * buckets // QUANTILES + 1) for v, n in Counter(q).items() if n > 1 and n * buckets > QUANTILES}
        cuts |= {x for v in often for x in (v - 1, v)}
    bounds = sorted(cuts)
    split = {bisect_left(bounds, v): n for v, n in often.items() if n > 1}
    nulls = min(MAX_BUCKETS, -(-(row["n"] - row["m"]) // rows_per_bucket))
    if nulls > 1:
        split[len(bounds) + 1] = nulls
    return Cuts(bounds, split)


def _below(key: Column, bounds: Sequence[int]) -> Column:
    """How many bounds lie below ``key`` (a binary search inside one expression)."""
    if not bounds:
        return F.lit(0)
    depth = len(bounds).bit_length()
    padded = F.array(*[F.lit(b).cast("bigint") for b in bounds], *[F.lit(LONG_MAX).cast("bigint")] * ((1 << depth) - 1 - len(bounds)))
    steps = F.array(*[F.lit(1 << d) for d in reversed(range(depth))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.element_at(padded, at + step) < key, step).otherwise(F.lit(0)))


def bucket_of(key: Column, cuts: Cuts, second: Column | None = None) -> Column:
    """The bucket of a key, ascending with it, nulls last. ``second``, from 0 to below 1, orders rows of one key; without
    it no bucket is split."""
    base = _below(key, cuts.bounds)
    if second is None or not cuts.split:
        return F.when(key.isNull(), F.lit(len(cuts.bounds) + 1)).otherwise(base) if cuts.bounds else F.when(key.isNull(), F.lit(1)).otherwise(F.lit(0))
    null = len(cuts.bounds) + 1
    place = lambda n: F.least(F.floor(second * n).cast("int"), F.lit(n - 1))
    heavy = sorted(b for b in cuts.split if b != null)
    found = base
    if heavy:
        more = [0]
        for b in heavy:
            more.append(more[-1] + cuts.split[b] - 1)
        before = _below(base.cast("bigint"), heavy)
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for b in heavy for x in (b, cuts.split[b])]), base), F.lit(1))
        found = base + F.element_at(F.array(*map(F.lit, more)), before + 1) + F.least(F.floor(second * parts).cast("int"), parts - 1)
    return F.when(key.isNull(), F.lit(cuts.of_keys) + place(cuts.split.get(null, 1))).otherwise(found)


def unit(hashed: Column) -> Column:
    """A 64-bit number as one from 0 to below 1, ascending."""
    return hashed.cast("double") / float(1 << 64) + 0.5


def with_running(
    df: DataFrame,
    order: str,
    groups: Sequence[str] = (),
    ties: Sequence[str] = (),
    second: Column | None = None,
    value: Column | None = None,
    name: str = "pos",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` (default 1, so a position from 0) over all earlier rows of the group.

    ``order`` is an integer column; nulls come last, ``second`` (from 0 to below 1) orders rows of one key, then ``ties``
    do. Rows equal in all of these get distinct positions in an arbitrary order. Without ``second``, rows of one key and
    group go to one task. ``df`` is read three times, so it should be a scan
    or a written table, with no column named like ``__bucket``.
    """
    value = F.lit(1) if value is None else value
    keyed = df.withColumn("__value", value.cast("bigint")).withColumn("__second", F.lit(0.0) if second is None else second)
    keyed = keyed.withColumn("__bucket", bucket_of(F.col(order), quantile_cuts(df, order, rows_per_bucket), None if second is None else F.col("__second")))
    cells = keyed.groupBy(*groups, "__bucket").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*groups, "__bucket").orderBy(F.col(order).asc_nulls_last(), "__second", *[F.col(t).asc_nulls_last() for t in ties]).rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumn("__local", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    on = F.col("__bucket") == F.col("__b")
    for i, g in enumerate(groups):
        on = on & ranked[g].eqNullSafe(bases[f"__g{i}"])
    return ranked.join(bases, on).select(*df.columns, (F.col("__base") + F.col("__local")).cast("bigint").alias(name))
