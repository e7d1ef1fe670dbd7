"""Token files: token ids end to end in one array, and the documents' bounds in it as an Elias-Fano sequence.

A data set is a folder of files, each with the documents of one range of keys in ascending order, and a manifest.
A file's bounds and keys take about 2 + log2(mean gap) bits a document; ``select`` finds one bound from a sampled
bit position and a short scan, without a table of 64-bit offsets.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import text as tx
from tidelog.llm.pretoken import split_sure, sure
from tidelog.plans.positions import bucket_of, quantile_cuts, unit, with_running
from tidelog.sources.tables import file_to_send, scratch

END_ID = 2
#: Documents that one writing task takes, and ids that one file may hold (a longer document has its own file).
ROWS_PER_TASK, IDS_PER_FILE = 5_000, 1 << 25
_SAMPLE = 512
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_HEAD = struct.Struct("<4sHHQQQq")
_EF_HEAD = struct.Struct("<QQQQ")
MAGIC, VERSION = b"TLTK", 1


class EliasFano:
    """A non-decreasing sequence of numbers from 0: low bits packed, high bits as gaps in unary."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("values fall")
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        bits = np.arange(width, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> bits) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, width, low.tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::_SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th number."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        bit = int(self.samples[i // _SAMPLE])
        left, byte = i % _SAMPLE, bit >> 3
        block = self.high[byte] & (0xFF << (bit & 7)) & 0xFF
        while (here := int(_POPCOUNT[block])) <= left:
            left -= here
            byte += 1
            block = self.high[byte]
        for _ in range(left):
            block &= block - 1
        bit = byte * 8 + (block & -block).bit_length() - 1
        at = i * self.width
        low = int.from_bytes(self.low[at >> 3 : (at + self.width + 7) >> 3], "little") >> (at & 7) & ((1 << self.width) - 1)
        return (bit - i) << self.width | low

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.width].reshape(self.n, self.width)
            out |= (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out.astype(np.int64)

    def dump(self) -> bytes:
        return _EF_HEAD.pack(self.n, self.width, len(self.low), len(self.high)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def load(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the start of ``data`` and its size there."""
        n, width, low, high = _EF_HEAD.unpack_from(data)
        at = _EF_HEAD.size
        samples = -(-n // _SAMPLE)
        end = at + low + high
        return cls(n, width, bytes(data[at : at + low]), bytes(data[at + low : end]), np.frombuffer(data[end : end + 4 * samples], np.uint32)), end + 4 * samples


def dump(keys: Sequence[int | None], ids: Sequence[bytes], width: int) -> bytes:
    """One file: ``keys`` ascending with nulls last, ``ids`` little-endian arrays of ``width`` bytes an id."""
    known = [k for k in keys if k is not None]
    base = known[0] if known else 0
    bounds = np.concatenate(([0], np.cumsum([len(x) // width for x in ids], dtype=np.int64)))
    head = _HEAD.pack(MAGIC, VERSION, width, len(keys), len(keys) - len(known), int(bounds[-1]), base)
    gaps = np.array([k - base for k in known], np.uint64)
    return b"".join([head, EliasFano.of(bounds).dump(), EliasFano.of(gaps).dump(), *ids])


class TokenFile:
    """A file's content: keys, bounds and ids."""

    def __init__(self, data: bytes):
        magic, version, self.width, self.n_docs, nulls, self.n_ids, base = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        view = memoryview(data)
        at = _HEAD.size
        self.bounds, size = EliasFano.load(view[at:])
        at += size
        gaps, size = EliasFano.load(view[at:])
        at += size
        self.keys = [base + int(g) for g in gaps.all().view(np.uint64)] + [None] * nulls
        self.ids = np.frombuffer(view[at:], np.uint16 if self.width == 2 else np.uint32)
        if len(self.ids) != self.n_ids:
            raise ValueError(f"{len(self.ids)} ids, not {self.n_ids}")

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


class Pieces(dict):
    """Pre-token to a place in ``parts``, the id bytes, which the tokenizers library makes in batches.

    Two generations of ``size`` pre-tokens are kept.
    """

    #: Words joined by line feeds are pre-tokens of their own in one text, which is quicker than as many texts.
    JOINED = 100

    def __init__(self, content: bytes, size: int = 450_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts with one of these go whole to the library, which finds them before anything else.
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or "(?!)")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.type = np.uint16 if self.width == 2 else np.uint32
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.size = size
        self.old: dict[str, bytes] = {}
        self.parts: list = []
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        at = self[piece] = len(self.parts)
        known = self.old.get(piece)
        self.parts.append(known)
        if known is None:
            self.fresh.append(piece)
        return at

    def _learn(self) -> None:
        words = [p for p in self.fresh if self.feed is not None and p.removeprefix(" ").isalpha()]
        if words:
            joined = ["\n".join(words[i : i + self.JOINED]) + "\n" for i in range(0, len(words), self.JOINED)]
            ids = np.concatenate([np.array(e.ids, self.type) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.feed)
            if len(ends) != len(words):
                raise ValueError("words and line feeds don't alternate")
            data, at = ids.tobytes(), 0
            for piece, end in zip(words, (ends * self.width).tolist()):
                self.parts[self[piece]] = data[at:end]
                at = end + self.width
        others = [p for p in self.fresh if self.parts[self[p]] is None]
        if others:
            for piece, found in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
                self.parts[self[piece]] = np.array(found.ids, self.type).tobytes()
        self.fresh = []

    def encode(self, texts: list[str]) -> list[bytes]:
        """The id bytes of each text, those that the library gives for the whole of it. Texts with added tokens, or with
        characters on which the engines might differ, are given to it whole."""
        place = self.__getitem__
        cut = [list(map(place, split_sure(x))) if sure(x) and not self.added.search(x) else None for x in texts]
        self._learn()
        part = self.parts.__getitem__
        out = [b"".join(map(part, c)) if c is not None else np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, self.type).tobytes() for x, c in zip(texts, cut)]
        if len(self) > self.size:
            self.old = {p: self.parts[at] for p, at in self.items()}
            self.clear()
            self.parts = []
        return out


_PIECES: dict[int, Pieces] = {}


def _pieces(content: bytes) -> Pieces:
    key = zlib.crc32(content)
    if key not in _PIECES:
        _PIECES[key] = Pieces(content)
    return _PIECES[key]


def _store(folder: str, name: str, data: bytes) -> None:
    """Whole or not at all; a task that runs again writes the same file."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        f.write(data)
    final = f"{path}/{name}"
    if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(final).type != pafs.FileType.NotFound:
        fs.delete_file(final)
    fs.move(temporary, final)


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID, rows_per_task: int = ROWS_PER_TASK, ids_per_file: int = IDS_PER_FILE) -> str:
    """Encode every text, end each with ``end_id``, and write token files in key order; returns the folder.

    Ids are those of the library for the whole text; added tokens that stand in a text are found as it finds them.
    A null text is empty: only the end id. Null keys come last; rows with one key follow each other in an order
    given by a hash of their text, by which they are split among tasks if they are many. An empty table gives no file. Only ids are shuffled, not texts.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    shared = spark.sparkContext.broadcast(file_to_send(tokenizer_path))
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).cast("string").alias("text"))

    def encode(batches):
        pieces = _pieces(shared.value)
        end = np.array([end_id], pieces.type).tobytes()
        for part, _, _ in tx.steps(batches, "text", 2 << 20):
            ids = [x + end for x in pieces.encode([x or "" for x in part.column(2).to_pylist()])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())], names=["key", "tie", "ids"])

    def store(batches):
        width = _pieces(shared.value).width
        most = ids_per_file * width
        bucket, number, keys, ids, size, told = None, 0, [], [], 0, []

        def flush():
            nonlocal number, keys, ids, size
            if keys:
                name = f"part-{bucket:06d}-{number:06d}.tok"
                _store(folder, name, dump(keys, ids, width))
                told.append((bucket << 32 | number, name, len(keys), size // width))
                number, keys, ids, size = number + 1, [], [], 0

        for batch in batches:
            for b, k, x in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket or size + len(x) > most:
                    flush()
                    bucket, number = b, number if b == bucket else 0
                keys.append(k)
                ids.append(x)
                size += len(x)
        flush()
        place, names, counts, totals = zip(*told) if told else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(totals, pa.int64())], names=["place", "name", "n_docs", "n_ids"])

    cuts = quantile_cuts(rows, "key", rows_per_task)
    encoded = rows.mapInArrow(encode, "key bigint, tie bigint, ids binary").withColumn("bucket", bucket_of(F.col("key"), cuts, unit(F.col("tie"))))
    laid = encoded.select("bucket", "key", "tie", "ids").repartitionById(cuts.count, F.col("bucket")).sortWithinPartitions("bucket", F.col("key").asc_nulls_last(), "tie", "ids")
    laid.select("bucket", "key", "ids").mapInArrow(store, "place bigint, name string, n_docs bigint, n_ids bigint").write.parquet(f"{folder}/manifest")
    return folder


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``key``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32`` (of the ids as little-endian
    32-bit numbers) and, if asked for, ``ids``; all from the files, offsets by ``select``."""
    manifest = spark.read.schema("place bigint, name string, n_docs bigint, n_ids bigint").parquet(f"{folder}/manifest")
    files = with_running(manifest, "place", value=F.col("n_ids"), name="base").select("base", "name")
    names = ["key", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def load(batches):
        for batch in batches:
            for base, name in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = pafs.FileSystem.from_uri(folder)
                with fs.open_input_file(f"{path}/{name}") as f:
                    file = TokenFile(f.read())
                for at in range(0, file.n_docs, 1000):
                    to = min(file.n_docs, at + 1000)
                    bounds = np.fromiter(map(file.bounds.select, range(at, to + 1)), np.int64, to + 1 - at)
                    ids = [file.ids[i:j].astype("<u4") for i, j in zip(bounds[:-1], bounds[1:])]
                    cols = [pa.array(file.keys[at:to], pa.int64()), pa.array(base + bounds[:-1]), pa.array(np.diff(bounds)), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    count = max(1, min(10_000, manifest.count()))
    return files.repartition(count).mapInArrow(load, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
