"""Byte-level BPE by ranks, encoding and decoding.

Two tiers: a minimal perfect hash finds pre-tokens that are whole entries of the vocabulary; any other is merged
with a heap of ranked pairs over a doubly linked list of its bytes. Results for pre-tokens are remembered per worker,
within a bound.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import text as tx
from tidelog.llm.pretoken import Memo, split
from tidelog.sources.tables import file_to_send

#: Pre-tokens that a worker remembers in a generation; two generations are some 100 MB.
MEMO_SIZE = 220_000
_M = (1 << 64) - 1


def _level_hash(h: int, level: int) -> int:
    h = (h + level * 0x9E3779B97F4A7C15) & _M
    h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & _M
    return h ^ (h >> 32)


class PerfectHash:
    """A minimal perfect hash: each of n distinct keys gets its own number below n.

    Levels of bit arrays: a key sits in the first level where no other key still looking has its place; its
    number is the count of set bits before it. Keys are bytes; others get any number or None.
    """

    GAMMA = 1.5

    def __init__(self, keys: list[bytes]):
        left = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("keys repeat")
        self.levels: list[tuple[int, bytes, list[int]]] = []
        before = 0
        while len(left):
            size = max(64, int(self.GAMMA * len(left)))
            at = self._places(left, len(self.levels), size)
            single = np.bincount(at, minlength=size) == 1
            ranks = (before + np.concatenate(([0], np.cumsum(single)[:-1]))).tolist()
            self.levels.append((size, single.tobytes(), ranks))
            before += int(single.sum())
            left = left[~single[at]]

    @staticmethod
    def _places(h: np.ndarray, level: int, size: int) -> np.ndarray:
        x = h + np.uint64((level * 0x9E3779B97F4A7C15) & _M)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def __call__(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        for level, (size, bits, ranks) in enumerate(self.levels):
            at = _level_hash(h, level) % size
            if bits[at]:
                return ranks[at]
        return None


class Codec:
    """Encodes and decodes by a vocabulary of (bytes, rank) entries; the rank is the id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        entries = list(ranks)
        self.hash = PerfectHash(entries)
        self.slots: list = [None] * len(entries)
        for b in entries:
            self.slots[self.hash(b)] = (b, ranks[b])
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without an entry: {missing[:5]}")
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.shift = max(ranks.values()).bit_length()
        #: (left id, right id) to the id of both together
        self.pairs = {ranks[b[:i]] << self.shift | ranks[b[i:]]: r for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks}
        self.pieces: Memo = Memo(lambda piece: np.array(self.encode_piece(piece.encode()), np.uint32).tobytes(), MEMO_SIZE)

    @classmethod
    def parse(cls, content: bytes) -> Codec:
        """From a rank file: lines of a base64 entry and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())})

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        slot = self.hash(piece)
        if slot is not None and self.slots[slot][0] == piece:
            return [self.slots[slot][1]]
        return self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the best-ranked adjacent pair, the first of equals, until none is left."""
        n, shift, pairs = len(piece), self.shift, self.pairs
        ids = [self.byte_ids[b] for b in piece]
        place = n.bit_length()
        mask = (1 << place) - 1
        heap = [r << place | i for i in range(n - 1) if (r := pairs.get(ids[i] << shift | ids[i + 1])) is not None]
        if not heap:
            return ids
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i, rank = top & mask, top >> place
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << shift | ids[j]) != rank:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = pairs.get(rank << shift | ids[k])
                if r is not None:
                    heappush(heap, r << place | i)
            h = before[i]
            if h >= 0:
                r = pairs.get(ids[h] << shift | rank)
                if r is not None:
                    heappush(heap, r << place | h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, split(text))), np.uint32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[bytes, Codec] = {}


def codec_of(content: bytes) -> Codec:
    """One codec a worker and vocabulary, kept between tasks."""
    name = hashlib.sha256(content).digest()
    if name not in _CODECS:
        _CODECS[name] = Codec.parse(content)
    return _CODECS[name]


def _mapped(docs: DataFrame, key: list[str], text: str, ranks_path: str, ddl: str, make: Callable) -> DataFrame:
    """key columns and those of ``ddl``, which ``make(codec, texts)`` gives for some texts."""
    shared = docs.sparkSession.sparkContext.broadcast(file_to_send(ranks_path))
    rows = docs.select(F.col(text).cast("string").alias("__text"), *[F.col(k) for k in key])
    schema = T.StructType(rows.select(*key).schema.fields + T.StructType.fromDDL(ddl).fields)

    def run(batches):
        codec = codec_of(shared.value)
        for part, _, _ in tx.steps(batches, "__text"):
            texts = [x or "" for x in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *make(codec, texts)], names=schema.names)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, key: list[str] | tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The key columns, ``n_tokens`` and ``ids``, one row per input row.

    A null or empty text has no ids. Special tokens are ordinary text. Nothing is shuffled.
    """

    def make(codec, texts):
        ids = [codec.encode(x) for x in texts]
        counts = np.array([len(x) for x in ids], np.int64)
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        return pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)))

    return _mapped(docs, list(key), text, ranks_path, "n_tokens bigint, ids array<int>", make)


def decode(encoded: DataFrame, ranks_path: str, key: list[str] | tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The key columns and ``decoded``, the bytes of the ids; null ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(file_to_send(ranks_path))
    rows = encoded.select(F.col(ids).alias("__ids"), *key)
    schema = T.StructType(rows.select(*key).schema.fields + [T.StructField("decoded", T.BinaryType())])

    def run(batches):
        codec = codec_of(shared.value)
        for batch in batches:
            out = [codec.decode(x or ()) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``n_tokens``, ``ids_sha256`` of the decimal ids joined by spaces, ``decoded_sha256`` of the bytes they decode to."""

    def make(codec, texts):
        decimal = [str(i) for i in range(max(codec.bytes_of) + 1)]
        counts, ids_sha, text_sha = [], [], []
        for x in texts:
            ids = codec.encode(x).tolist()
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())

    return _mapped(docs, [key], text, ranks_path, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
