"""Near-duplicate detection by ProbMinHash over weighted word shingles.

A text's shingles, weighted by how often they occur, send points at exponential intervals (a Poisson process each, of
the shingle's weight) to random registers; a register keeps the shingle of its earliest point. A shingle stops when its
next point would come after the last register's. Two texts agree in a register with probability equal to their
probability Jaccard similarity. Bands of registers give candidates, all registers verify them.

Equal texts are one class from the start, and texts with equal signatures one node, so copies never pair up. The number
of registers in which two signatures differ is a metric, so most links follow from others and aren't looked for: nodes
gather round leaders at less than half the distance of a link, each with each other linked by the triangle inequality;
of two gatherings the leaders' distance and the radii tell that all pairs are links, or none. Only where neither holds
are members compared, in blocks of a bounded size, and only their counts leave a task. So a group of any number of near
copies costs work in proportion to it, no pairs of its members are written, and no bucket is cut off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import text as tx
from tidelog.sources.tables import discard, written

#: Words in a shingle; registers; registers in a band and bands; similarity from which texts are linked.
SHINGLE, REGISTERS, BAND, BANDS, THRESHOLD = 3, 256, 4, 48, 0.5
#: Leaders, or members, that are compared with each other at once.
BLOCK = 256
#: Rounds in which nodes look for a leader; who has none by then leads itself, which only costs comparisons.
ROUNDS = 3

_BREAK = tx.SPACE.copy()
_BREAK[[b for b in range(33, 128) if not chr(b).isalnum()]] = True


def shingles(a: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, hashes, weights) of the different shingles, ordered by document.

    Words are cut at white space and ASCII punctuation and compared without ASCII case. A text of fewer words is one
    shingle; one without words has none.
    """
    start, end, doc = tx.word_bounds(a, off, _BREAK)
    h = tx.word_hashes(a, start, end, fold=True)
    n = len(off) - 1
    grams = tx.gram_hashes(h, size)
    inside = doc[size - 1 :] == doc[: len(grams)]
    counts = np.bincount(doc, minlength=n)
    few = np.flatnonzero((counts > 0) & (counts < size))
    firsts = np.searchsorted(doc, few)
    short = [tx.gram_hashes(h[f : f + counts[d]], int(counts[d]))[0] for d, f in zip(few, firsts)]
    all_h = np.concatenate([grams[inside], np.array(short, np.uint64)])
    all_d = np.concatenate([doc[: len(grams)][inside], few])
    _, index, weight = np.unique(tx.mix(all_h) ^ tx.mix(all_d.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    order = np.argsort(all_d[index], kind="stable")
    return all_d[index][order], all_h[index][order], weight[order].astype(np.float64)


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """The shingle hash in each register, n x registers; a text without shingles has zeros."""
    best = np.full(n * registers, np.inf)
    held = np.zeros(n * registers, np.uint64)
    if not len(h):
        return held.reshape(n, registers)
    live = np.arange(len(h))
    time = np.zeros(len(h))
    turn = 0
    while len(live):
        turn += 1
        r = tx.mix(h[live] + np.uint64((turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        # 44 bits for the interval, 20 for the register.
        gap = -np.log(((r >> np.uint64(20)).astype(np.float64) + 0.5) / (1 << 44))
        time[live] += gap / weight[live]
        at = doc[live] * registers + ((r & np.uint64(0xFFFFF)) * np.uint64(registers) >> np.uint64(20)).astype(np.int64)
        now = time[live]
        np.minimum.at(best, at, now)
        won = best[at] == now
        held[at[won]] = h[live[won]]
        docs = np.unique(doc[live])
        limit = np.zeros(n)
        limit[docs] = best.reshape(n, registers)[docs].max(1)
        live = live[now < limit[doc[live]]]
    return held.reshape(n, registers)


def band_hashes(held: np.ndarray, band: int = BAND, bands: int = BANDS) -> np.ndarray:
    """One number for each band of each signature."""
    x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), (len(held), bands)).copy()
    parts = held[:, : band * bands].reshape(len(held), bands, band)
    for k in range(band):
        x = tx.mix(x ^ parts[:, :, k]) * np.uint64(0x9FB21C651E98DF25)
    return tx.mix(x)


def small(held: np.ndarray) -> np.ndarray:
    """8 bits a register, for comparing."""
    return (tx.mix(held) >> np.uint64(56)).astype(np.uint8)


def similarity(equal: np.ndarray) -> np.ndarray:
    """Estimate from the part of equal 8-bit registers, less what agrees by chance."""
    return np.clip((equal - 1 / 256) / (1 - 1 / 256), 0, 1)


def _signed_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """node (of the signature), t1 and t2 (of the text), key, small signature and bands: null for wordless texts."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("key", *_identity("text"), "text")

    def run(batches):
        for part, a, off in tx.steps(batches):
            doc, h, weight = shingles(a, off)
            held = signatures(doc, h, weight, part.num_rows)
            some = np.bincount(doc, minlength=part.num_rows) > 0
            marks = small(held)
            whole = tx.signed(np.bitwise_xor.reduce(tx.mix(held ^ np.arange(1, held.shape[1] + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), axis=1))
            bands = tx.signed(band_hashes(held))
            offsets = np.concatenate(([0], np.cumsum(np.where(some, bands.shape[1], 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(whole, mask=~some), pa.array([m.tobytes() if s else None for m, s in zip(marks, some)], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[some].ravel()))],
                names=["key", "t1", "t2", "node", "marks", "bands"],
            )

    return rows.mapInArrow(run, "key bigint, t1 bigint, t2 bigint, node bigint, marks binary, bands array<bigint>")


def reach(threshold: float, registers: int = REGISTERS) -> int:
    """In how many registers two signatures may differ and be similar; -1: in none."""
    return int((similarity(1 - np.arange(registers + 1) / registers) >= threshold).sum()) - 1


def _distance(marks: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (marks[x] != marks[y]).sum(1)


def _marks(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _by_group(batches, keys: tuple[str, ...], handle):
    """``handle`` of tables of whole groups, from rows sorted by the keys."""
    waiting: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        waiting = pa.concat_tables([waiting, table]).combine_chunks() if waiting is not None else table
        if not len(waiting):
            continue
        same = np.ones(len(waiting), bool)
        for c in keys:
            column = waiting.column(c).to_numpy()
            same &= column == column[-1]
        cut = int(np.argmax(same))
        if cut:
            yield handle(waiting.slice(0, cut))
            waiting = waiting.slice(cut)
    if waiting is not None and len(waiting):
        yield handle(waiting)


def _groups(table: pa.Table, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of each row, and the starts and sizes of the groups."""
    group = np.stack([table.column(c).to_numpy() for c in keys], 1)
    head = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(1))))
    return group, head, np.diff(np.append(head, len(group)))


def _pairs(left: np.ndarray, right: np.ndarray, within: bool):
    """All pairs of the two (p before q, if they're the same), some thousands at a time."""
    for at in range(0, len(left), 16):
        part = left[at : at + 16]
        p, q = np.repeat(part, len(right)), np.tile(right, len(part))
        yield (p[p < q], q[p < q]) if within else (p, q)


_IN_BUCKET, _IN_CROSS = ("bucket", "i", "j"), ("lead", "i", "j")


def _near_leaders(batches, most: int):
    """Rows (bucket, i, j, block, node, radius, marks) sorted by the first three: pairs of leaders of which members may
    be linked, and whether all of them must be."""

    def links(table: pa.Table):
        group, head, size = _groups(table, _IN_BUCKET)
        node, block, radius = (table.column(c).to_numpy() for c in ("node", "block", "radius"))
        marks = _marks(table.column("marks"))
        found: set[tuple[int, int, bool]] = set()

        def keep(x, y):
            d, slack = _distance(marks, x, y), radius[x] + radius[y]
            ok = np.flatnonzero((d <= most + slack) & (node[x] != node[y]))
            x, y = x[ok], y[ok]
            found.update(zip(np.minimum(node[x], node[y]).tolist(), np.maximum(node[x], node[y]).tolist(), (d[ok] + slack[ok] <= most).tolist()))

        two = head[size == 2]
        for at in range(0, len(two), 4096):
            keep(two[at : at + 4096], two[at : at + 4096] + 1)
        for x, n in zip(head[size > 2].tolist(), size[size > 2].tolist()):
            i, j = group[x, 1:]
            rows = np.arange(x, x + n)
            left, right = (rows, rows) if i == j else (rows[block[x : x + n] == i], rows[block[x : x + n] == j])
            for p, q in _pairs(left, right, i == j):
                keep(p, q)
        a, b, sure = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], names=["a", "b", "sure"])

    yield from _by_group(batches, _IN_BUCKET, links)


def _cross(batches, most: int):
    """Rows (lead, i, j, side, node, leader, texts, marks) sorted by the first three: for each node the texts on the
    other side that it's linked with, and pairs (a, b) of leaders with a link between their members."""

    def count(table: pa.Table):
        _, head, size = _groups(table, _IN_CROSS)
        node, side, leader, texts = (table.column(c).to_numpy() for c in ("node", "side", "leader", "texts"))
        marks = _marks(table.column("marks"))
        linked = np.zeros(len(node), np.int64)
        edges: set[tuple[int, int]] = set()
        for x, n in zip(head.tolist(), size.tolist()):
            rows = np.arange(x, x + n)
            for p, q in _pairs(rows[side[x : x + n] == 0], rows[side[x : x + n] == 1], False):
                ok = np.flatnonzero(_distance(marks, p, q) <= most)
                p, q = p[ok], q[ok]
                np.add.at(linked, p, texts[q])
                np.add.at(linked, q, texts[p])
                edges.update(zip(leader[p].tolist(), leader[q].tolist()))
        some = np.flatnonzero(linked)
        a, b = zip(*edges) if edges else ((), ())
        none = [None] * len(a)
        return pa.RecordBatch.from_arrays([pa.array([*node[some].tolist(), *none], pa.int64()), pa.array([*linked[some].tolist(), *none], pa.int64()), pa.array([None] * len(some) + list(a), pa.int64()), pa.array([None] * len(some) + list(b), pa.int64())], names=["node", "linked", "a", "b"])

    yield from _by_group(batches, _IN_CROSS, count)


def _gathered(nodes: DataFrame, full: DataFrame, most: int) -> DataFrame:
    """node, ``leader`` and the distance to it, for all nodes in buckets with others.

    A node may follow the smallest node of any of its buckets; of those at half a link's distance or less that lead, the
    nearest is its leader. Who can't follow leads.
    """
    radius = most // 2
    marks = nodes.select("node", "marks")
    asked = full.where("node <> head").select("node", "head").distinct()
    both = asked.join(marks, "node").join(marks.select(F.col("node").alias("head"), F.col("marks").alias("of_head")), "head").select("node", "head", "marks", "of_head")

    def near(batches):
        for batch in batches:
            d = (_marks(pa.chunked_array([batch.column(2)])) != _marks(pa.chunked_array([batch.column(3)]))).sum(1) if batch.num_rows else np.zeros(0, np.int64)
            hit = pa.array(np.flatnonzero(d <= radius))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(hit), batch.column(1).take(hit), pa.array(d.astype(np.int32)).take(hit)], names=["node", "head", "d"])

    left = written(both.mapInArrow(near, "node bigint, head bigint, d int"), "near")
    found = None
    for _ in range(ROUNDS):
        # Heads that could still follow don't lead yet; edges to those that do follow are gone.
        leading = left.join(left.select(F.col("node").alias("head")).distinct(), "head", "left_anti")
        got = written(leading.groupBy("node").agg(F.min(F.struct("d", "head")).alias("best")).select("node", F.col("best.head").alias("leader"), "best.d"), "followers")
        found = got if found is None else found.unionByName(got)
        left = written(left.join(got.select("node"), "node", "left_anti").join(got.select(F.col("node").alias("head")), "head", "left_anti"), "near")
        if left.isEmpty():
            break
    return full.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("leader", "node").alias("leader"), F.coalesce("d", F.lit(0)).alias("d"))


def _connected(nodes: DataFrame, threshold: float) -> DataFrame:
    """``node``, ``linked`` (texts of other nodes that are linked with it) and ``root``, equal for connected nodes.

    ``nodes`` has node, marks, bands and texts. Nodes that share no bucket aren't there.
    """
    most = reach(threshold)
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    full = written(buckets.join(heads, "bucket").select("bucket", "node", "head"), "buckets")
    gathered = written(_gathered(nodes, full, most).join(nodes.select("node", "texts"), "node"), "gathered")
    clusters = written(gathered.groupBy("leader").agg(F.max("d").alias("radius"), F.count(F.lit(1)).alias("n"), F.sum("texts").alias("texts")), "clusters")

    # Leaders whose followers share a bucket.
    meeting = full.select("bucket", "node").join(gathered.select("node", "leader"), "node").select("bucket", "leader").distinct()
    crowded = meeting.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    placed = meeting.join(crowded, "bucket").withColumn("block", F.pmod(F.xxhash64("leader", "bucket"), F.col("blocks")).cast("int"))
    laid = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("leader").alias("node"))
    known = nodes.select("node", "marks").join(clusters.select(F.col("leader").alias("node"), "radius"), "node")
    # Groups hold at most about 2 x BLOCK rows, so a sort within hash partitions is enough to stream them.
    parts = laid.join(known, "node").select(*_IN_BUCKET, "block", "node", "radius", "marks").repartition(*_IN_BUCKET).sortWithinPartitions(*_IN_BUCKET)
    pairs = written(parts.mapInArrow(lambda batches: _near_leaders(batches, most), "a bigint, b bigint, sure boolean").distinct(), "pairs")

    # Where the leaders don't tell, the members of the larger gathering meet those of all smaller ones in question.
    sizes = clusters.select(F.col("leader").alias("of"), "n")
    doubt = pairs.where("not sure").join(sizes.select(F.col("of").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("of").alias("b"), F.col("n").alias("nb")), "b")
    larger = F.col("na") >= F.col("nb")
    doubt = written(doubt.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("small"), F.greatest("na", "nb").alias("n0"), F.least("na", "nb").alias("n1")), "doubt")
    shape = doubt.groupBy("lead").agg(F.ceil(F.max("n0") / BLOCK).cast("int").alias("b0"), F.ceil(F.sum("n1") / BLOCK).cast("int").alias("b1"))
    member = gathered.select("node", "leader", "texts")
    own = shape.join(member, F.col("lead") == F.col("leader")).select("lead", "b0", "b1", F.lit(0).alias("side"), "node", "leader", "texts")
    others = doubt.select("lead", "small").join(shape, "lead").join(member, F.col("small") == F.col("leader")).select("lead", "b0", "b1", F.lit(1).alias("side"), "node", "leader", "texts")
    block = lambda n: F.pmod(F.xxhash64("node", "lead"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ["side", "node", "leader", "texts"]
    crossed = own.select("lead", block("b0").alias("i"), every("b1").alias("j"), *rest).unionByName(others.select("lead", every("b0").alias("i"), block("b1").alias("j"), *rest))
    parts = crossed.join(nodes.select("node", "marks"), "node").select(*_IN_CROSS, *rest, "marks").repartition(*_IN_CROSS).sortWithinPartitions(*_IN_CROSS)
    crossing = written(parts.mapInArrow(lambda batches: _cross(batches, most), "node bigint, linked bigint, a bigint, b bigint"), "crossing")

    sure = pairs.where("sure").select("a", "b")
    roots = components(sure.unionByName(crossing.where("a is not null").select("a", "b"))).withColumnRenamed("node", "leader")
    weight = clusters.select(F.col("leader").alias("other"), "texts")
    ends = sure.select(F.col("a").alias("leader"), F.col("b").alias("other")).unionByName(sure.select(F.col("b").alias("leader"), F.col("a").alias("other")))
    beside = ends.join(weight, "other").groupBy("leader").agg(F.sum("texts").alias("beside"))
    each = crossing.where("node is not null").groupBy("node").agg(F.sum("linked").alias("one_by_one"))
    of_cluster = clusters.select("leader", F.col("texts").alias("inside")).join(beside, "leader", "left").join(roots, "leader", "left").select("leader", (F.col("inside") + F.coalesce("beside", F.lit(0))).alias("shared"), F.coalesce("root", "leader").alias("root"))
    return gathered.join(of_cluster, "leader").join(each, "node", "left").select("node", (F.col("shared") - F.col("texts") + F.coalesce("one_by_one", F.lit(0))).alias("linked"), "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the smallest node that a node is connected with.

    Large and small stars in turn: each round joins neighbours to the smallest one, and written tables cut the
    lineage. Rounds grow with the logarithm of the longest chain.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "edges")
    before = None
    while True:
        # Large star: a node's larger neighbours move to the smallest of its neighbours and itself.
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(lowest, "v")
        small_star = moved.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(lowest.select("v", F.col("m").alias("u"))).where("u < v").distinct()
        replaced, edges = edges, written(small_star, "edges")
        discard(replaced)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _identity(text: str) -> list[Column]:
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.xxhash64(value).alias("t1"), F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint").alias("t2")]


def text_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a different text: t1 and t2, which stand for it, ``text_id``, ``n_copies``, ``n_links``, ``class_id``
    and ``head``, true for one text of each class, which has the class's id."""
    signed = _signed_texts(docs, key, text)
    # Copies are counted before the shuffle.
    texts = written(signed.groupBy("t1", "t2").agg(F.min("key").alias("text_id"), F.count(F.lit(1)).alias("n_copies"), F.first("node").alias("node"), F.first("marks").alias("marks"), F.first("bands").alias("bands")), "texts")
    nodes = written(texts.where("node is not null").groupBy("node").agg(F.first("marks").alias("marks"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("texts")), "nodes")
    found = _connected(nodes, threshold)
    known = (
        texts.select("t1", "t2", "text_id", "n_copies", "node")
        .join(nodes.select("node", "texts"), "node", "left")
        .join(found, "node", "left")
        .select("t1", "t2", "text_id", "n_copies", (F.coalesce("texts", F.lit(1)) - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    known = written(known, "known")
    # A null id comes after all others.
    order = F.struct(F.col("text_id").isNull().alias("none"), F.col("text_id").alias("id"), "t1", "t2")
    groups = known.where("root is not null").groupBy("root").agg(F.min(order).alias("least"))
    named = known.join(groups, "root", "left")
    alone = F.col("root").isNull()
    return named.select("t1", "t2", "text_id", "n_copies", "n_links", F.when(alone, F.col("text_id")).otherwise(F.col("least.id")).alias("class_id"), (alone | ((F.col("t1") == F.col("least.t1")) & (F.col("t2") == F.col("least.t2")))).alias("head"))


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, ``class_id``, ``text_id``, ``n_copies``, ``n_links``: one row per input row.

    ``class_id`` is the smallest key in the group of near duplicates (texts connected by links), ``text_id`` the
    smallest key with the same text, ``n_copies`` the rows with it, and ``n_links`` how many different other texts
    have a similarity of ``threshold`` or more. A null text is an empty one. Texts without words are alike only if
    equal. Keys may repeat or be null; a group of null keys only has a null id.
    """
    classes = text_classes(docs, key, text, threshold).drop("head")
    return docs.select(F.col(key), *_identity(text)).join(classes, ["t1", "t2"]).select(key, "class_id", "text_id", "n_copies", "n_links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: one with the class's id."""
    heads = text_classes(docs, key, text, threshold).where("head").select("t1", "t2", "text_id")
    rows = docs.select(*_identity(text), F.col(key).alias("k"), F.struct("*").alias("row")).join(heads, ["t1", "t2"]).where(F.col("k").eqNullSafe(F.col("text_id")))
    return rows.groupBy("t1", "t2").agg(F.first("row").alias("row")).select("row.*")
