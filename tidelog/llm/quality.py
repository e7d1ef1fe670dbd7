"""Quality rules: repetition inside one text, from a suffix array over its words.

The suffixes of a step of documents are sorted together by prefix doubling, and never compared across documents;
only suffixes whose prefix still has a twin go on to the next doubling, so rounds get cheaper. Neighbours in the
array have the longest common prefixes; the larger of a suffix's two is the maximal repeated run that starts there.
The spans of the runs are united; the covered fraction of the words and the longest run decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import text as tx

#: A repeated run counts from this many words on; more covered words than this fraction, or a longer repeat, reject.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 6, 0.45, 50
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True

SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_covered bigint, longest_repeat bigint, covered_fraction double, kept boolean"


def suffix_repeats(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run from it that also starts elsewhere in its document.

    ``h`` are the word hashes of documents end to end, ``doc`` their document numbers, in order.
    A run may overlap its twin.
    """
    n = len(h)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    last = np.searchsorted(doc, doc, side="right")  # where each word's document ends
    names, counts = np.unique(tx.mix(h) ^ tx.mix(doc.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)[1:]
    rank = (np.cumsum(counts) - counts)[names]  # the place of a suffix's group in the array
    shared = np.flatnonzero(counts[names] > 1)
    live, size, levels = shared, 1, []
    while len(live):
        levels.append(rank.copy())  # levels[k]: equal for suffixes that share 2^k words
        after = live + size
        second = np.where(after < last[live], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[live] * np.int64(n + 1) + second
        order = np.argsort(key)
        live, key = live[order], key[order]
        group = rank[live]
        place = np.arange(len(live))
        new_group = np.concatenate(([True], group[1:] != group[:-1]))
        new_part = np.concatenate(([True], key[1:] != key[:-1]))
        rank[live] = group + np.maximum.accumulate(np.where(new_part, place, 0)) - np.maximum.accumulate(np.where(new_group, place, 0))
        alone = new_part & np.concatenate((new_part[1:], [True]))
        live = live[~alone]
        size *= 2
    array = shared[np.argsort(rank[shared])]
    a, b = array[:-1], array[1:]
    lcp = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        i, j = a + lcp, b + lcp
        equal = (i < last[a]) & (j < last[b])
        equal &= levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)]
        lcp += np.where(equal, 1 << k, 0)
    best = np.zeros(len(array), np.int64)
    best[:-1] = lcp
    best[1:] = np.maximum(best[1:], lcp)
    longest[array] = best
    return longest


def _line_counts(a: np.ndarray, off: np.ndarray, word_start: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document, for each document."""
    n = len(off) - 1
    start, end, doc = tx.word_bounds(a, off, _NEWLINE)
    if not len(start):
        return np.zeros(n, np.int64)
    worded = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
    start, end, doc = start[worded], end[worded], doc[worded]
    key = tx.mix(tx.word_hashes(a, start, end)) ^ tx.mix(doc.astype(np.uint64) + np.uint64(1))
    first = np.unique(key, return_index=True)[1]
    again = np.ones(len(key), bool)
    again[first] = False
    return tx.per_doc(doc[again], n)


def measure(a: np.ndarray, off: np.ndarray, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All counts for the documents of one step."""
    n = len(off) - 1
    start, end, doc = tx.word_bounds(a, off)
    heads = np.concatenate(([0], np.cumsum((a & 0xC0) != 0x80)))  # code points before a byte
    h = tx.word_hashes(a, start, end)
    out = {
        "n_words": tx.per_doc(doc, n),
        "word_chars": tx.per_doc(doc, n, heads[end] - heads[start]),
        "n_symbols": np.diff(np.concatenate(([0], np.cumsum(_SYMBOL[a])))[off]),
        "n_dup_lines": _line_counts(a, off, start),
    }
    longest = suffix_repeats(h, doc)
    threes = np.flatnonzero(longest >= 3)
    out["n_repeat_words"] = tx.per_doc(doc[tx.cover(threes, 3, len(h))], n)
    spans = np.flatnonzero(longest >= min_repeat)
    out["n_covered"] = tx.per_doc(doc[tx.cover(spans, longest[spans], len(h))], n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, doc, longest)
    out["longest_repeat"] = top
    return out


def assess(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """key, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``n_covered``, ``longest_repeat`` (in words), ``covered_fraction`` and ``kept``, one row per input row.

    A null or empty text has no words and fails. Keys may be null or repeat. Other columns aren't read.
    Nothing is shuffled: a text is judged by itself.
    """
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))

    def run(batches):
        for part, a, off in tx.steps(batches, "__text"):
            m = measure(a, off, min_repeat)
            words = m["n_words"]
            failed = (words < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * words)
            fraction = m["n_covered"] / np.maximum(words, 1)
            kept = ~failed & (fraction <= max_covered) & (m["longest_repeat"] <= max_longest)
            cols = [*(m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed, m["n_covered"], m["longest_repeat"], fraction, kept]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols)], names=[key, *(c.split()[0] for c in SCHEMA.split(", "))])

    return rows.mapInArrow(run, T.StructType(rows.select(key).schema.fields + T.StructType.fromDDL(SCHEMA).fields))
