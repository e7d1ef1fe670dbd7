"""Toxicity by compression distance: how much shorter a window gets with a dictionary of toxic text.

Two zstandard dictionaries are trained, one on windows of ordinary labelled documents, one on the whole text of toxic
ones. The trainer of the second covers the text as zstandard's own does (segments with the most frequent byte runs), but
a run's frequency is net of ordinary text: only runs many times as frequent in toxic documents count, or it would mostly
hold what both kinds have. Every window of eight
words of a text is compressed under the ordinary dictionary alone and under both; ordinary content sits at the same
distance in either, so the difference in length is due to toxic content. A logistic calibration, fitted on labelled
documents that the dictionaries haven't seen, turns a document's differences into a score.
"""

from __future__ import annotations

import pickle
import random
import zlib
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import text as tx
from tidelog.sources.tables import written

#: Words in a window; bytes of the dictionaries; compression level.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 8, 65_536, 4_096, 12
#: The bounded training sample: documents of each label, those with the smallest hashes of their ids, and bytes of
#: text in all, half of them for each label. Whole texts are taken, in hash order; those that don't fit in what is left
#: are passed over.
MAX_TOXIC, MAX_ORDINARY, MAX_SAMPLE_BYTES = 5_000, 10_000, 64_000_000
#: Windows that the ordinary dictionary is trained on, drawn from all those of its documents.
MAX_SAMPLES = 40_000
#: The parts of the sample's ordinary and toxic documents that train dictionaries; the rest calibrates.
DICTIONARY_PART = {0: 0.75, 1: 0.6}
#: Bytes in a run whose frequency counts, and in a segment of the toxic dictionary.
RUN, SEGMENT = 6, 16
#: A run is toxic if it is so many times as frequent in toxic text as in ordinary text, which counts as having it in
#: SMOOTHING more places than it does. A place is a run with the six bytes before and after it, so near copies of one
#: document show a run in one place only.
RATIO, SMOOTHING = 10, 5
#: Parts, by run, in which places are counted, so that a part's places fit in the driver's memory.
COUNT_PARTS = 6


def held_out(key: Column) -> Column:
    """Whether a row's label must not be learnt: crc32 of the key as text, modulo 5, is 0. A null key is held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def dump(self) -> bytes:
        return pickle.dumps(self)


def _windows(a: np.ndarray, off: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of the windows: ``size`` words with the space after them, end to end; a document's
    last may have fewer."""
    start, end, doc = tx.word_bounds(a, off)
    if not len(start):
        return start, end, doc
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    heads = np.flatnonzero(rank % size == 0)
    until = np.minimum(np.append(start[heads[1:]], len(a)), off[doc[heads] + 1])
    return start[heads], until - start[heads], doc[heads]


class Scorer:
    """Compresses windows under both dictionaries."""

    def __init__(self, model: Model):
        self.weights = np.array(model.weights)
        self.compressors = [self._compressor(model.ordinary), self._compressor(model.toxic + model.ordinary)] if model.toxic else []

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        # As raw content, what isn't matched costs a byte a byte, so a match shows in the length. At this level zstandard
        # finds the cheapest parse, and matches anywhere in a dictionary; lower ones index only some of its places.
        dictionary = zstandard.ZstdCompressionDict(content or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=128, dict_size=max(8, len(content)), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False)
        dictionary.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)

    def gains(self, data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Bytes that each window is shorter by when the toxic dictionary is there too."""
        if not len(start) or not self.compressors:
            return np.zeros(len(start), np.int64)
        segments = np.stack([start, length], 1).astype(np.uint64).tobytes()
        sizes = []
        for c in self.compressors:
            out = c.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments))
            sizes.append(np.fromiter(map(len, (out[i] for i in range(len(out)))), np.int64, len(out)))
        return sizes[0] - sizes[1]

    def features(self, a: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        start, length, doc = _windows(a, off)
        gain = np.maximum(self.gains(a.tobytes(), start, length), 0)
        top = np.zeros(n)
        np.maximum.at(top, doc, gain)
        count = lambda least: np.bincount(doc[gain >= least], minlength=n)
        total = np.bincount(doc, weights=gain, minlength=n)
        windows = np.bincount(doc, minlength=n)
        return np.stack([np.ones(n), top, np.minimum(top, 3), np.log1p(total), np.log1p(count(2)), np.log1p(count(3)), np.log1p(count(4)), np.log1p(windows), count(3) / np.maximum(windows, 1)], 1)

    def scores(self, a: np.ndarray, off: np.ndarray) -> np.ndarray:
        if not self.compressors:
            return np.zeros(len(off) - 1)
        return 1 / (1 + np.exp(-np.clip(self.features(a, off) @ self.weights, -30, 30)))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)


def _trained(size: int, samples: list[bytes], k: int) -> bytes:
    """A trained dictionary's content; of too few samples, their distinct texts end to end."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except (zstandard.ZstdError, MemoryError, ValueError):
        return b"".join(dict.fromkeys(samples))[:size]


def _squeezed(text: bytes) -> np.ndarray:
    """The words with one space around each."""
    return np.frombuffer(b" " + b" ".join(text.split()) + b" ", np.uint8)


def _run_hashes(a: np.ndarray) -> np.ndarray:
    """The runs of RUN bytes, as numbers."""
    h = np.zeros(max(0, len(a) - RUN + 1), np.uint64)
    for i in range(RUN if len(h) else 0):
        h |= a[i : len(h) + i].astype(np.uint64) << np.uint64(8 * i)
    return h


def _chunks(texts: list[bytes]):
    """Runs of some texts end to end, with RUN zero bytes between texts, and a mask of those without a zero byte."""
    gap = np.zeros(2 * RUN, np.uint8)
    ends = np.cumsum([len(t) for t in texts]) // tx.STEP_BYTES  # texts whose ends lie in one step, or a longer one
    for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
        a = np.concatenate([gap, *[x for i in some for x in (_squeezed(texts[i]), gap)]])
        clear = np.cumsum(np.concatenate(([0], a == 0)))
        yield _run_hashes(a), clear[RUN:] == clear[:-RUN]


def _toxic_runs(toxic: list[bytes], ordinary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(runs, places): the runs that are RATIO times as frequent in toxic text, sorted, and in how many places."""
    size = [max(1, sum(map(len, texts))) for texts in (toxic, ordinary)]
    least = RATIO * SMOOTHING * size[0] / size[1]  # places that a run needs if no ordinary text has it
    known, often = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for h, clear in _chunks(toxic):
        u, n = np.unique(h[clear], return_counts=True)
        known, at = np.unique(np.concatenate((known, u)), return_inverse=True)
        often = np.bincount(at, weights=np.concatenate((often, n)), minlength=len(known)).astype(np.int64)
    known = known[often >= least]
    runs, weights = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in range(COUNT_PARTS if len(known) else 0):
        own = known[part::COUNT_PARTS]
        n, m = (_places(texts, own) for texts in (toxic, ordinary))
        good = n / size[0] >= RATIO * (m + SMOOTHING) / size[1]
        runs.append(own[good])
        weights.append(n[good])
    runs, weights = np.concatenate(runs), np.concatenate(weights)
    order = np.argsort(runs)
    return runs[order], weights[order]


def _places(texts: list[bytes], runs: np.ndarray) -> np.ndarray:
    """In how many different places each of the sorted runs stands."""
    if not len(runs):
        return np.zeros(0, np.int64)
    flag = lambda h: (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)
    flags = np.zeros(1 << 22, bool)  # most runs are told from these by a flag, without a search
    flags[flag(runs)] = True
    found, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for h, _ in _chunks(texts):
        maybe = np.flatnonzero(flags[flag(h)])
        at = np.minimum(np.searchsorted(runs, h[maybe]), len(runs) - 1)
        good = runs[at] == h[maybe]  # a run of the gap isn't among them
        hit, at = maybe[good], at[good]
        place = tx.mix(h[hit - RUN] * np.uint64(0x9E3779B97F4A7C15) + h[hit]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[hit + RUN]
        place, first = np.unique(place, return_index=True)
        found.append(place)
        where.append(at[first].astype(np.int32))
    first = np.unique(np.concatenate(found), return_index=True)[1]
    return np.bincount(np.concatenate(where)[first], minlength=len(runs))


def _covering(toxic: list[bytes], ordinary: list[bytes], size: int) -> bytes:
    """The toxic dictionary's content: of the segments of toxic text always the one with the most places of toxic runs a
    byte that no segment before it has, up to ``size`` bytes; the best come last, where they're nearest to a window."""
    runs, weights = _toxic_runs(toxic, ordinary)
    if not len(runs):
        return b""
    segments: dict[bytes, None] = {}
    for x in toxic:
        a = _squeezed(x)
        h = _run_hashes(a)
        at = np.minimum(np.searchsorted(runs, h), len(runs) - 1)
        hit = np.flatnonzero(runs[at] == h)
        if len(hit):
            cut = np.flatnonzero(np.diff(hit) > RUN)
            data = a.tobytes()
            for s, e in zip(hit[np.append(0, cut + 1)].tolist(), (hit[np.append(cut, len(hit) - 1)] + RUN).tolist()):
                segments.update((data[i : min(e, i + SEGMENT)], None) for i in range(s, max(s + 1, e - RUN + 1), SEGMENT // 2))
    value = dict(zip(runs.tolist(), weights.tolist()))
    inside = {s: [k for k in set(_run_hashes(np.frombuffer(s, np.uint8)).tolist()) if k in value] for s in segments}
    waiting = [(-sum(map(value.__getitem__, k)) / len(s), s) for s, k in inside.items()]
    heapify(waiting)
    out: list[bytes] = []
    left = size
    while waiting and left > 0:
        s = heappop(waiting)[1]
        now = -sum(map(value.__getitem__, inside[s])) / len(s)
        if not now:
            continue
        if waiting and now > waiting[0][0]:
            heappush(waiting, (now, s))
            continue
        out.append(s)
        left -= len(s)
        value.update((k, 0) for k in inside[s])
    return b"".join(reversed(out))


def fit(sample: list[tuple[int, bytes]], share: float | None = None) -> Model:
    """From (toxic 0 or 1, text) rows. ``share`` is the part of all labelled rows that is toxic, which the calibration
    assumes; by default it is the sample's. Without toxic and ordinary rows, or without toxic runs, all scores are 0.
    """
    rng = random.Random(5)
    rows = sorted({(text, int(y)) for y, text in sample if text})
    rng.shuffle(rows)
    cut = {y: [t for t, own in rows if own == y] for y in (0, 1)}
    at = {y: max(1, int(len(cut[y]) * DICTIONARY_PART[y])) for y in (0, 1)}
    ordinary, toxic = cut[0][: at[0]], cut[1][: at[1]]
    if not ordinary or not toxic:
        return Model(b"", b"", ())
    windows = [np.stack([np.full(len(start), i), start, length], 1) for i, x in enumerate(ordinary) for start, length, _ in [_windows(*_joined([x]), 2 * WINDOW)]]
    cuts = np.concatenate(windows)
    chosen = cuts[rng.sample(range(len(cuts)), min(MAX_SAMPLES, len(cuts)))].tolist()
    del windows, cuts
    model = Model(_trained(ORDINARY_BYTES, [ordinary[i][s : s + n] for i, s, n in chosen], 64), _covering(toxic, ordinary, TOXIC_BYTES), ())
    tx.trim()
    if not model.toxic:
        return model
    rest = [(1, x) for x in cut[1][at[1] :]] + [(0, x) for x in cut[0][at[0] :]]
    if len({y for y, _ in rest}) < 2:
        rest = [(y, t) for t, y in rows]
    scorer = Scorer(model)
    features = np.concatenate([scorer.features(*_joined([t])) for _, t in rest])
    y = np.array([y for y, _ in rest], float)
    share = sum(y for _, y in rows) / len(rows) if share is None else share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(model.ordinary, model.toxic, tuple(_logistic(features, y, weight)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[tuple[int, bytes]], float | None]:
    """The bounded sample, rows with a label of 0 or 1 that aren't held out, and the toxic part of all such labels."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("k"))).withColumn("h", F.xxhash64("k"))
    few = known.where("y = 1").orderBy("h", "k").limit(MAX_TOXIC).unionByName(known.where("y = 0").orderBy("h", "k").limit(MAX_ORDINARY))
    found = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(few), "k")
    # Of rows with one key and text one is enough; there are at most the sample's rows.
    once = written(found.groupBy("k", "y", "h", F.xxhash64("t").alias("x")).agg(F.first("t").alias("t")), "toxicity-sample")
    sizes = once.select("y", "h", "k", "x", F.octet_length("t").alias("size")).orderBy("y", "h", "k", "x").toArrow()
    left, seen, fits = {0: MAX_SAMPLE_BYTES // 2, 1: MAX_SAMPLE_BYTES // 2}, set(), []
    for y, size in zip(sizes.column("y").to_pylist(), sizes.column("size").to_pylist()):
        fits.append(size <= left[y])
        left[y] -= size * fits[-1]
        seen.add((y, fits[-1]))
    for y in (0, 1):
        if (y, False) in seen and (y, True) not in seen:
            raise ValueError(f"every text with label {y} is longer than the sample's {MAX_SAMPLE_BYTES // 2} bytes")
    chosen = docs.sparkSession.createDataFrame(sizes.filter(pa.array(fits, pa.bool_())).select(["y", "k", "x"]), once.select("y", "k", "x").schema)
    sample = once.join(F.broadcast(chosen), ["y", "k", "x"]).select("y", "t").toArrow()
    rows = list(zip(sample.column("y").to_pylist(), sample.column("t").to_pylist()))
    del sample
    pa.default_memory_pool().release_unused()
    tx.trim()
    return rows, known.agg(F.avg("y")).first()[0]


_SCORERS: dict[int, Scorer] = {}


def _scorer(dumped: bytes) -> Scorer:
    at = zlib.crc32(dumped)
    if at not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[at] = Scorer(pickle.loads(dumped))
    return _SCORERS[at]


def score(docs: DataFrame, model: Model, keep: list[str] | tuple[str, ...] = ("doc_id",), text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The kept columns, ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5), or ``names``, one row per input row.

    Whole texts are scored, null ones as empty. Nothing but the text counts. The model, some 70 KB, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.dump())
    kept = list(keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], *[] if text in kept else [F.col(f"`{text}`")])
    at, count = rows.columns.index(text), len(kept)
    schema = T.StructType(rows.schema.fields[:count] + [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches):
        scorer = _scorer(shared.value)
        for part, a, off in tx.steps(batches, at):
            s = scorer.scores(a, off)
            yield pa.RecordBatch.from_arrays([*part.columns[:count], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)


def clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that the model calls toxic."""
    names = ("score", "predicted")
    while set(names) & set(docs.columns):
        names = (names[0] + "_", names[1] + "_")
    marked = score(docs, fit(*training_sample(docs, labels, key, text)), docs.columns, text, names)
    return marked.where(F.col(names[1]) == 0).drop(*names)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | tuple[str, ...] = ("doc_id",), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``score`` under a model that is fitted first, on the sample of ``docs`` with ``labels``."""
    return score(docs, fit(*training_sample(docs, labels, key, text)), keep, text)
