"""Substring dedup by relative Lempel-Ziv parsing against every block of the corpus.

A text is cut into reference blocks at anchors: of the 8-word runs in a window of 35 words the one with the smallest
hash, the first of equals, is its anchor, and the windows with one anchor make a block. So equal windows have equal
anchors, wherever they stand, and blocks line up without being compared. All blocks are indexed by anchor and by a hash
of their windows, with the place of a block that has the same:

* a block that occurs again is matched as a whole;
* a block whose anchor occurs again, but not the block, lies at a factor's boundary: there single windows are
  compared, once for each different block of that anchor, and matched with the place of an equal one.

Each document is then parsed from left to right: from the first match on a factor is extended, block by block and window
by window, as long as the next match lies next in the same reference document; then the next factor begins. A factor is
(first word, words, reference document, first word there) and has a window's words at least; words that no factor covers
stand for themselves. Factors are the duplicate spans. Counting is pre-aggregated, occurrences meet their counts in
skew-split joins, and nothing is paired.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import text as tx
from tidelog.sources.tables import written

#: Words in a window, and in the runs of which one is its anchor.
WINDOW, ANCHOR = 35, 8
_PLACE = np.uint64((1 << 30) - 1)
_NO_KEY = -(1 << 63)


def blocks(h: np.ndarray, doc: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """The blocks of documents given as word hashes ``h`` with document numbers ``doc``.

    ``anchor`` and ``content`` are hashes; ``doc``; windows
    ``first`` to ``first + count - 1`` (numbers of their first words) belong to it. ``window``: all windows' hashes.
    """
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return {"anchor": none.view(np.uint64), "content": none.view(np.uint64), "doc": none, "first": none, "count": none, "window": none.view(np.uint64)}
    runs, windows = tx.gram_hashes(h, anchor), tx.gram_hashes(h, window)
    ranked = (runs & ~_PLACE) | np.arange(len(runs), dtype=np.uint64)
    place = (tx.sliding_min(ranked, window - anchor + 1) & _PLACE).astype(np.int64)
    inside = np.flatnonzero(doc[window - 1 :] == doc[: len(windows)])
    at = place[inside]
    head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else none
    tail = np.append(head[1:], len(at))
    first = inside[head]
    up, down = tx._POWERS.to(len(inside) + 1)
    sums = np.zeros(len(inside) + 1, np.uint64)
    np.cumsum(windows[inside] * up[: len(inside)], out=sums[1:])
    content = tx.mix((sums[tail] - sums[head]) * down[head] + (tail - head).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (at[head] - first).astype(np.uint64))
    owner = doc[first]
    return {"anchor": runs[at[head]], "content": content, "doc": owner, "first": first, "count": tail - head, "window": windows}


def _cut(a: np.ndarray, off: np.ndarray, window: int, anchor: int):
    start, end, doc = tx.word_bounds(a, off)
    h = tx.word_hashes(a, start, end)
    return start, end, doc, blocks(h, doc, window, anchor)


def _keyed(docs: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    """Rows with a key of two numbers. Rows alike in it have the same text, so they may share an answer."""
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(_NO_KEY)).alias("k1"), F.xxhash64(F.col(text)).alias("k2"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.lit(0).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows


_FOUND = "array<struct<at:int,whole:boolean,r1:bigint,r2:bigint,r_at:int>>"


def _answers(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """By key (k1, k2) what repeats: the window ``at`` which (by its first word in the document) a block begins that is
    matched as a ``whole``, or a single window, and the place (r1, r2, r_at) of another one that is equal: the first of
    all, for the first itself the last."""
    place = F.struct("k1", "k2", "at")

    def index(batches):
        for part, a, off in tx.steps(batches):
            _, _, doc, b = _cut(a, off, window, anchor)
            rows = pa.array(b["doc"])
            at = b["first"] - np.searchsorted(doc, np.arange(part.num_rows))[b["doc"]]
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(b["anchor"])), pa.array(tx.signed(b["content"])), part.column(0).take(rows), part.column(1).take(rows), pa.array(at.astype(np.int32))], names=["anchor", "content", "k1", "k2", "at"])

    indexed = texts.select("k1", "k2", "text").mapInArrow(index, "anchor bigint, content bigint, k1 bigint, k2 bigint, at int")
    again = indexed.groupBy("anchor").count().where("count > 1").select("anchor")
    shared = written(indexed.join(again, "anchor", "left_semi"), "blocks")
    kinds = shared.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    mixed = kinds.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("mixed"))
    known = kinds.join(mixed, "anchor").where("n > 1 or mixed")
    is_first = place == F.col("first")
    told = shared.join(known, ["anchor", "content"]).select("k1", "k2", "at", (F.col("n") > 1).alias("whole"), (F.col("mixed") & is_first).alias("ask"), F.when(is_first, F.col("last")).otherwise(F.col("first")).alias("ref"))
    told = written(told.where("whole or ask"), "matches")

    def compare(batches):
        for part, a, off in tx.steps(batches):
            _, _, doc, b = _cut(a, off, window, anchor)
            zero = np.searchsorted(doc, np.arange(part.num_rows))
            asked = part.column(4)
            owner = np.repeat(np.arange(part.num_rows), np.diff(asked.offsets.to_numpy()))
            first, needed = (x.to_numpy(zero_copy_only=False) for x in asked.flatten().flatten())
            # Rows that are equal ask the same twice.
            block, once = np.unique(np.searchsorted(b["first"], zero[owner] + first), return_index=True)
            count = b["count"][block]
            which = np.repeat(b["first"][block], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            of = np.repeat(owner[once], count)
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(b["window"][which])), part.column(0).take(rows), part.column(1).take(rows), pa.array((which - zero[of]).astype(np.int32)), pa.array(np.repeat(needed[once], count))], names=["window", "k1", "k2", "at", "own"])

    asks = told.where("ask").groupBy("k1", "k2").agg(F.collect_list(F.struct("at", (~F.col("whole")).alias("needed"))).alias("asked"))
    single = texts.join(asks, ["k1", "k2"]).select("k1", "k2", "row", "text", "asked").mapInArrow(compare, "window bigint, k1 bigint, k2 bigint, at int, own boolean")
    twice = single.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last")).where("n > 1")
    hits = single.where("own").join(twice, "window").select("k1", "k2", "at", F.lit(False).alias("whole"), F.when(is_first, F.col("last")).otherwise(F.col("first")).alias("ref"))
    # A document's blocks and windows are no more than its words; equal rows answer alike, so a set will do.
    both = told.where("whole").select("k1", "k2", "at", "whole", "ref").unionByName(hits)
    return both.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "whole", F.col("ref.k1").alias("r1"), F.col("ref.k2").alias("r2"), F.col("ref.at").alias("r_at"))).alias("found"))


@dataclass
class Parse:
    """The words of one step of documents (``start``, ``end``, ``doc``) and their factors, in order: ``of`` (document),
    ``first`` (number of the first word in the step), ``words``, and the place in the reference: ``r1``, ``r2``, ``r_at``."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    of: np.ndarray
    first: np.ndarray
    words: np.ndarray
    r1: np.ndarray
    r2: np.ndarray
    r_at: np.ndarray

    def gone(self) -> np.ndarray:
        """Which words a factor covers."""
        return tx.cover(self.first, self.words, len(self.doc))


def parse(a: np.ndarray, off: np.ndarray, found: pa.ListArray, window: int = WINDOW, anchor: int = ANCHOR) -> Parse:
    """Greedy factors of documents from what was found of each."""
    start, end, doc, b = _cut(a, off, window, anchor)
    n = len(off) - 1
    zero = np.searchsorted(doc, np.arange(n))
    offsets = found.offsets.to_numpy()
    sizes = np.where(found.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets)) if found.null_count else np.diff(offsets)
    at, whole, r1, r2, r_at = (x.to_numpy(zero_copy_only=False) for x in found.flatten().flatten())
    of = np.repeat(np.arange(n), sizes)
    first = zero[of] + at
    count = np.ones(len(first), np.int64)
    if whole.any():
        count[whole] = b["count"][np.searchsorted(b["first"], first[whole])]
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    match, index = np.unique(np.repeat(first, count) + inside, return_index=True)
    of, r1, r2 = (np.repeat(x, count)[index] for x in (of, r1, r2))
    r_at = (np.repeat(r_at.astype(np.int64), count) + inside)[index]
    # The next match carries a factor on if it's the next window here and there.
    on = (np.diff(match) == 1) & (np.diff(of) == 0) & (np.diff(r_at) == 1) & (r1[1:] == r1[:-1]) & (r2[1:] == r2[:-1])
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(match)), bool), ~on)))
    words = np.diff(np.append(head, len(match))) + window - 1
    return Parse(start, end, doc, of[head], match[head], words, r1[head], r2[head], r_at[head])


def _applied(docs: DataFrame, keep: list[str], key: str, text: str, window: int, anchor: int, ddl: str, make) -> DataFrame:
    texts = _keyed(docs, key, text, keep)
    answers = _answers(texts, window, anchor)
    joined = texts.join(answers, ["k1", "k2"], "left").select("k1", "k2", "row", "text", F.coalesce("found", F.array().cast(_FOUND)).alias("found"))
    fields = T.StructType(texts.schema["row"].dataType.fields + T.StructType.fromDDL(ddl).fields)

    def run(batches):
        for part, a, off in tx.steps(batches):
            parsed = parse(a, off, part.column(4), window, anchor)
            bounds = np.searchsorted(parsed.doc, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*part.column(2).flatten(), *make(part, a, off, parsed, bounds)], names=fields.names)

    return joined.mapInArrow(run, fields)


def factors(docs: DataFrame, keep: list[str] | tuple[str, ...] = ("doc_id",), key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The kept columns with ``n_words``, the ``place`` (k1, k2) by which references name the row, and its ``factors``:
    (first, words, ref1, ref2, ref_first). Words of a factor equal those of the row with that place from ref_first on;
    a factor may begin in the last window's words of the one before. Rows with one key and text share a place."""

    def make(part, a, off, parsed, bounds):
        zero = bounds[:-1]
        cols = [parsed.first - zero[parsed.of], parsed.words, parsed.r1, parsed.r2, parsed.r_at]
        names = ["first", "words", "ref1", "ref2", "ref_first"]
        flat = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names)
        offsets = pa.array(np.searchsorted(parsed.of, np.arange(len(off))).astype(np.int32))
        place = pa.StructArray.from_arrays([part.column(0), part.column(1)], ["k1", "k2"])
        return pa.array(np.diff(bounds)), place, pa.ListArray.from_arrays(offsets, flat)

    return _applied(docs, list(keep), key, text, window, anchor, "n_words bigint, place struct<k1:bigint,k2:bigint>, factors array<struct<first:bigint,words:bigint,ref1:bigint,ref2:bigint,ref_first:bigint>>", make)


def spans(docs: DataFrame, keep: list[str] | tuple[str, ...] = ("doc_id",), key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The kept columns with ``spans``, an array of (first word, words) of the duplicate spans, and ``n_words``."""

    def make(part, a, off, parsed, bounds):
        gone, out = parsed.gone(), []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            edge = np.diff(np.concatenate(([0], gone[lo:hi].astype(np.int8), [0])))
            out.append([{"first": int(s), "words": int(e - s)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
        return pa.array(out, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))), pa.array(np.diff(bounds))

    return _applied(docs, list(keep), key, text, window, anchor, "spans array<struct<first:bigint,words:bigint>>, n_words bigint", make)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """key, ``n_words``, ``n_removed`` and ``kept_sha256`` (of the kept words joined by one space), a row per input row.

    A null text has no words. Rows that repeat whole are copies of each other, so their windows go.
    """

    def make(part, a, off, parsed, bounds):
        gone = parsed.gone()
        sums = np.concatenate(([0], np.cumsum(gone)))
        lost = sums[bounds[1:]] - sums[bounds[:-1]]
        data, out = a.tobytes(), []
        for i in range(len(off) - 1):
            words = data[off[i] : off[i + 1]].split()
            if lost[i]:
                words = compress(words, (~gone[bounds[i] : bounds[i + 1]]).tolist())
            out.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.array(np.diff(bounds)), pa.array(lost), pa.array(out, pa.string())

    return _applied(docs, [key], key, text, window, anchor, "n_words bigint, n_removed bigint, kept_sha256 string", make)


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The columns of ``docs``, ``text`` without the removed words and the white space before each.

    A text that loses nothing stays as it is, null too; one that loses all becomes empty. No row goes.
    """
    keep = [c for c in docs.columns if c != text]
    was_null = "null"
    while was_null in keep:
        was_null += "_"

    def make(part, a, off, parsed, bounds):
        gone, end = parsed.gone(), parsed.end
        sums = np.concatenate(([0], np.cumsum(gone)))
        lost = sums[bounds[1:]] - sums[bounds[:-1]]
        # From the end of the word before (or the text's start) to the word's end.
        prior = np.concatenate(([0], end[:-1])) if len(end) else end
        if len(end):
            heads = bounds[:-1][np.diff(bounds) > 0]
            prior[heads] = off[:-1][np.diff(bounds) > 0]
        at = np.flatnonzero(gone)
        drop = tx.cover(prior[at], end[at] - prior[at], len(a))
        plain, out = part.column(3).to_pylist(), []
        for i in range(len(off) - 1):
            piece = slice(off[i], off[i + 1])
            out.append(a[piece][~drop[piece]].tobytes().decode() if lost[i] else plain[i])
        return (pa.array(out, pa.string()),)

    stripped = _applied(docs.withColumn(was_null, F.col(text).isNull()), [*keep, was_null], key, text, window, anchor, f"`{text}` string", make)
    return stripped.select(*[F.when(F.col(was_null), F.lit(None)).otherwise(F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
