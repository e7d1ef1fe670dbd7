"""Vectorised text helpers: slices of Arrow batches as byte arrays, words, and hashes of words and n-grams."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step handles, so that a worker's arrays stay small whatever a batch holds.
STEP_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def steps(batches, column: str | int = "text", limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): rows whose texts have about ``limit`` bytes in all, at least one row.

    ``bytes`` are the texts end to end, ``offsets`` their bounds. A null text is empty. No text is split.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        if col.null_count:
            col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at), data[off[at] : off[end]], off[at : end + 1] - off[at]
            at = end
    trim()


def trim() -> None:
    """Gives freed memory back, since a worker waits for its next task with what it has."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def word_bounds(a: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words; a document's edge ends a word."""
    if not len(a):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~space[a]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = off[(off > 0) & (off < len(a))]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums by document number."""
    return np.bincount(doc, weights=weights, minlength=n).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, made longer as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            up, down = np.full(n, self.base, np.uint64), np.full(n, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_POWERS = Powers(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
#: The same with A-Z as a-z.
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_PIECE = 1 << 19


def word_hashes(a: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of the slices [start, end), which are in order and don't overlap.

    A polynomial over random byte values modulo 2^64, from prefix sums, with the length mixed in.
    Long arrays are handled in pieces at slice bounds, so the tables of powers stay small.
    """
    out = np.empty(len(start), np.uint64)
    table, at = _FOLDED if fold else _BYTES, 0
    while at < len(start):
        base = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, base + _PIECE, side="right")))
        stop = int(end[to - 1])
        up, down = _POWERS.to(stop - base + 1)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(table[a[base:stop]] * up[: stop - base], out=sums[1:])
        s, e = start[at:to] - base, end[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` hashes; run i starts at i. Runs may cross documents."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.to(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: len(h) - k + 1] + np.uint64(k))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def cover(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a run [start, start + length)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def kept_columns(wanted: list[str], schema_names: list[str]) -> list[str]:
    """Those of ``wanted`` that a table has."""
    return [c for c in wanted if c in schema_names]
