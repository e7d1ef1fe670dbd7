"""Sharding: a weighted hash tree of regions, racks and shards, descended by weighted hash draws.

At each level every child draws ``ln(u) / weight`` for the key, ``u`` from a hash of key and child, and the
largest draw wins; so a child is chosen in proportion to its weight, the sum of what lies below it. A changed
weight moves keys only into or out of the subtrees whose weights changed. A new shard comes in a region of its
own, so it takes keys only into itself. Everything is JVM-side; a key never sees another key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.plans.positions import with_running
from tidelog.sources.tables import written

#: The registered query's tree: 40 shards, 5 in a rack and 2 racks in a region.
SHARDS, PER_RACK, PER_REGION = 40, 5, 2
SEED = "tidelog"


@dataclass(frozen=True)
class Tree:
    """regions: each a tuple of racks, each a tuple of (shard number, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @classmethod
    def regular(cls, shards: int, per_rack: int = PER_RACK, per_region: int = PER_REGION) -> Tree:
        racks = [tuple((s, 1.0) for s in range(i, min(i + per_rack, shards))) for i in range(0, shards, per_rack)]
        return cls(tuple(tuple(racks[i : i + per_region]) for i in range(0, len(racks), per_region)))

    @property
    def shards(self) -> list[int]:
        return sorted(s for region in self.regions for rack in region for s, _ in rack)

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region of its own."""
        return Tree((*self.regions, (((max(self.shards, default=-1) + 1, weight),),)))

    def reweighted(self, shard: int, weight: float) -> Tree:
        return Tree(tuple(tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region) for region in self.regions))


def _weight(node) -> float:
    return node[1] if isinstance(node[0], int) else sum(map(_weight, node))


def _literal(node, name: str) -> Column:
    """A node as a literal struct (name, weight, below): below are the child nodes, or the shard's number."""
    if isinstance(node[0], int):  # a shard draws under its own number, so its place in a list doesn't matter
        return F.struct(F.lit(f"s{node[0]}").alias("name"), F.lit(float(node[1])).alias("weight"), F.lit(node[0]).alias("below"))
    return F.struct(F.lit(name).alias("name"), F.lit(float(_weight(node))).alias("weight"), _literals(node, name).alias("below"))


def _literals(nodes, name: str) -> Column:
    return F.array(*[_literal(n, f"{name}/{i}") for i, n in enumerate(nodes) if _weight(n) > 0])


def _chosen(key: Column, nodes: Column) -> Column:
    """What lies below the node with the largest draw ln(u) / weight; u, in (0, 1), is 48 bits of an MD5."""

    def drawn(node: Column, at: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{SEED}|"), node["name"])), 1, 12), 16, 10).cast("double")
        return F.struct((F.log((bits + 1.0) / F.lit(float((1 << 48) + 2))) / node["weight"]).alias("draw"), (-at).alias("first"), node["below"].alias("below"))

    return F.array_max(F.transform(nodes, drawn))["below"]


def shard_of(key: Column, tree: Tree = Tree.regular(SHARDS)) -> Column:
    """The shard of a key. A null key counts as the text ``null``."""
    if not any(_weight(r) > 0 for r in tree.regions):
        raise ValueError("no shard has a weight")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    return _chosen(key, _chosen(key, _chosen(key, _literals(tree.regions, "r")))).cast("int")


def assign(docs: DataFrame, tree: Tree = Tree.regular(SHARDS), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``size`` (UTF-8 bytes + 16), ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    Law ``key``: the key and the tree decide alone, so copies of a text go where their own keys lead, and rows
    with one key stay together. ``slot`` numbers a shard's rows from 0 by (key, CRC), nulls last; rows
    alike in both take their slots in any order. A null text has size 16 and the CRC of no bytes.
    Texts are read once and aren't moved: only these few numbers are written and shuffled.
    """
    rows = docs.select(
        F.col(key),
        F.coalesce(F.octet_length(F.col(text)).cast("bigint"), F.lit(0)).alias("__bytes"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
    ).select(key, (F.col("__bytes") + 16).alias("size"), "text_crc32", shard_of(F.col(key), tree).alias("shard"), shard_of(F.col(key), tree.grown()).alias("grown_shard"))
    # CRC and a random part, written so that it's the same whenever it's read.
    rows = written(rows.withColumn("__u", (F.col("text_crc32") + F.rand(7)) / float(1 << 32)), "sharding")
    placed = with_running(rows, key, ["shard"], second=F.col("__u"), name="slot")
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
