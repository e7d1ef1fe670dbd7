"""Document fingerprints: content-defined chunks, whose digests weighted by length measure containment.

A gear hash over the last 16 bytes cuts a text's UTF-8 bytes; before the normal size a mask with more bits must
match, after it one with fewer, so chunk sizes gather round the normal one. A cut depends on nearby bytes only:
an edit changes the chunks it touches, and the cuts fall into step again after it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.plans.positions import bucket_of, quantile_cuts, unit

#: Chunk sizes in bytes. The hash looks at 16 bytes, which fit into the smallest chunk.
MIN_SIZE, NORMAL_SIZE, MAX_SIZE = 16, 32, 128
#: Documents that one task takes.
ROWS_PER_TASK = 5_000

_GEAR = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)), np.uint32)
_HARD, _EASY = np.uint32(0x7F << 9), np.uint32(0x07 << 9)


def _candidates(a: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends of possible chunks under the hard and the easy mask. Only those from the 16th byte on mean anything."""
    h = _GEAR[a]
    for size in (1, 2, 4, 8):
        h[size:] += h[:-size] << np.uint32(size)
    hits = np.flatnonzero((h & _EASY) == 0)
    hard = hits[(h[hits] & _HARD) == 0]
    return (hard + 1).tolist(), (hits + 1).tolist()


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks of ``data``."""
    n, at, ends = len(data), 0, []
    if n > MIN_SIZE:
        hard, easy = _candidates(np.frombuffer(data, np.uint8))
        while n - at > MIN_SIZE:
            middle, far = at + NORMAL_SIZE, min(at + MAX_SIZE, n)
            i = bisect_left(hard, at + MIN_SIZE)
            if i < len(hard) and hard[i] <= middle:
                at = hard[i]
            else:
                i = bisect_left(easy, middle + 1)
                at = easy[i] if i < len(easy) and easy[i] <= far else far
            ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks(data: bytes, ends: list[int]) -> dict[int, int]:
    """Digest to length, a set: a chunk that repeats counts once."""
    out, at = {}, 0
    digest = xxhash.xxh3_64_intdigest
    for end in ends:
        out[digest(data[at:end]) >> 24] = end - at
        at = end
    return out


def fingerprint(found: dict[int, int]) -> str:
    """12 hex digits a chunk: 40 bits of its digest and its length; sorted."""
    return "".join([f"{d:010x}{n:02x}" for d, n in sorted(found.items())])


def parse(text: str) -> dict[int, int]:
    return {int(text[i : i + 10], 16): int(text[i + 10 : i + 12], 16) for i in range(0, len(text), 12)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The part of the weight of ``a`` whose chunks ``b`` has too; of nothing in nothing 1, in something 0."""
    if not a:
        return 0.0 if b else 1.0
    return sum(map(a.__getitem__, a.keys() & b.keys())) / sum(a.values())


def _edited(data: bytes, ends: list[int], found: dict[int, int], text: str, following: str) -> tuple[bytes, dict[int, int]]:
    """The edited text and its chunks; those before the edit are taken over."""
    third = len(text) // 3
    if not third:
        return data, found
    head = text[: len(text) - third].encode()
    whole = head + following[:third].encode()
    kept = ends[: bisect_left(ends, len(head) + 1)]
    base = kept[-1] if kept else 0
    tail = whole[base:]
    return whole, chunks(data[:base], kept) | chunks(tail, cuts(tail))


def compare(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """For each row: key, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``
    and ``near_next``, both the containment of its own chunks.

    The next document is the one before it in key order (after the smallest key: the largest); null keys come
    after all others, rows with one key go by a hash of their text. One row alone is its own next. A null text is
    empty. The edit replaces the last third of the code points by the first as many of the next document.
    Texts are shuffled once, by ranges of the key, and of the hash where many rows have one key or none; the first text
    of each range goes to the range before, too.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ranges = quantile_cuts(rows, "id", rows_per_task)
    parts = ranges.count
    # Keys fall, nulls come last, and the hashes of either fall.
    ascending = bucket_of(F.col("id"), ranges, unit(F.col("tie")))
    rows = rows.withColumn("part", F.when(F.col("id").isNull(), F.lit(ranges.of_keys + parts - 1) - ascending).otherwise(F.lit(ranges.of_keys - 1) - ascending))
    # One row a part, at most MAX_BUCKETS + 1 in all, so it may be broadcast.
    firsts = rows.groupBy("part").agg(F.max(F.struct("id", "tie")).alias("first"))
    across = Window.orderBy("part")
    firsts = firsts.select(F.coalesce(F.lag("part").over(across), F.max("part").over(Window.partitionBy())).alias("before"), "part", F.col("first.id").alias("first_id"), F.col("first.tie").alias("first_tie"))
    halo = rows.join(F.broadcast(firsts), "part").where(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")))
    both = rows.select("part", F.lit(0).alias("halo"), "id", "tie", "text").unionByName(halo.select(F.col("before").alias("part"), F.lit(1).alias("halo"), "id", "tie", "text"))
    laid = both.repartitionById(parts, F.col("part")).sortWithinPartitions("halo", F.col("id").desc_nulls_last(), F.col("tie").desc())
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        last = None  # (id, text, bytes, ends, chunks) of the row that waits for its next one

        def rows_of(ids, texts, halos):
            nonlocal last
            out: list[list] = [[] for _ in names]
            for i, x, halo in zip(ids, texts, halos):
                data = x.encode()
                ends = cuts(data)
                now = (i, x, data, ends, chunks(data, ends))
                if last is not None:
                    whole, found = _edited(last[2], last[3], last[4], last[1], x)
                    print_, own = fingerprint(last[4]), last[4]
                    row = (last[0], len(last[1]), hashlib.sha256(whole).hexdigest(), print_, print_ if found is own else fingerprint(found), containment(own, found), containment(own, now[4]))
                    for col, v in zip(out, row):
                        col.append(v)
                last = None if halo else now
                if halo:
                    break  # rows alike in key and text give more than one; any serves
            return out

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        ended = False
        for batch in batches:
            for at in range(0, 0 if ended else batch.num_rows, 256):
                part = batch.slice(at, 256)
                halos = part.column(0).to_pylist()
                cols = rows_of(part.column(1).to_pylist(), part.column(2).to_pylist(), halos)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
                if any(halos):
                    ended = True
                    break

    return laid.select("halo", "id", "text").mapInArrow(run, f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
