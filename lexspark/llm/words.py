"""Words, word hashes and n-grams of whole texts, vectorised over Arrow batches.

A word is a run of bytes other than ``0x20`` and ``0x09-0x0D`` (UTF-8 never uses
those bytes inside another character, so bytes and code points agree). Nothing in
here sees more than one slice of a batch, so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute

from lexspark.functions.layout import spread

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: A fixed 64-bit value for each byte; the radix of the rolling hash and its inverse.
BYTE_VALUE = np.random.default_rng(20_240_229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
RADIX_INVERSE = np.uint64(pow(int(RADIX), -1, 2**64))
GRAM = np.uint64(0xD6E8FEB86659FD93)
#: Texts are hashed in slices of about this many bytes.
SLICE_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX**i and RADIX**-i for i below n at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("up", RADIX), ("down", RADIX_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class DocBatch:
    """Some whole texts: their bytes end to end, and where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        self.n_docs = len(offsets) - 1

    @classmethod
    def of(cls, texts: pa.Array, lower: bool = False) -> DocBatch:
        """From an Arrow string array; a null is an empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(whole[at[0] : at[-1]], at - at[0], lower)

    @cached_property
    def in_word(self) -> np.ndarray:
        return ~SPACE[self.data]

    @cached_property
    def doc_starts(self) -> np.ndarray:
        """Offsets at which a text that isn't empty begins."""
        return np.unique(self.offsets[:-1][np.diff(self.offsets) > 0])

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word in the bytes."""
        word = self.in_word
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        first[self.doc_starts] = word[self.doc_starts]
        ends = self.doc_starts[self.doc_starts > 0] - 1
        last[ends] = word[ends]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Index of each text's first word, and the number of words at the end."""
        return np.searchsorted(self.spans[0], self.offsets).astype(np.int64)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    @cached_property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)

    @cached_property
    def prefix(self) -> np.ndarray:
        up, _ = powers(len(self.data))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[self.data] * up[: len(self.data)], dtype=np.uint64)])

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, the same wherever the bytes stand."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        _, down = powers(len(self.data) + 1)
        return mix((self.prefix[ends] - self.prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.hash_spans(*self.spans)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of n words of one text."""
        h, total = self.word_hashes, len(self.word_hashes)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        acc = h[: total - n + 1].copy()
        for j in range(1, n):
            acc *= GRAM
            acc += h[j : total - n + 1 + j]
        room = np.repeat(self.word_offsets[1:], self.n_words) - np.arange(total)
        at = np.flatnonzero(room[: total - n + 1] >= n)
        return at, mix(acc[at] + np.uint64(n))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum for each text of what stands at its bytes."""
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def word_sums(self, values: np.ndarray) -> np.ndarray:
        """Sum for each text of what stands at its words."""
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
        return total[self.word_offsets[1:]] - total[self.word_offsets[:-1]]

    def covered(self, at: np.ndarray, n: int) -> np.ndarray:
        """Which words lie in a run of n words that begins at one of these."""
        step = np.zeros(len(self.word_hashes) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + n, -1)
        return np.cumsum(step[:-1]) > 0

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, start, end and word count of each line between newlines."""
        breaks = np.flatnonzero(self.data == 10)
        doc = np.concatenate([np.arange(self.n_docs), np.searchsorted(self.offsets, breaks, "right") - 1])
        start = np.concatenate([self.offsets[:-1], breaks + 1])
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) if len(doc) else np.zeros(0, np.int64)
        end[last] = self.offsets[doc[last] + 1]
        words = np.searchsorted(self.spans[0], end) - np.searchsorted(self.spans[0], start)
        return doc, start, end, words


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    out = np.zeros(len(keys), bool)
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """Which keys equal one that stands before them."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:][ranked[1:] == ranked[:-1]]] = True
    return out


def within(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys made distinct between texts."""
    return keys ^ mix(doc.astype(np.uint64) * GRAM + np.uint64(1))


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text (one longer text stands alone)."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // most, prepend=0)) if len(lengths) else []
        edges = sorted({0, *map(int, cuts), batch.num_rows})
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


def map_texts(df, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str):
    """Apply fn to slices of rows with a ``text`` column, in Arrow."""

    def run(batches):
        for part in sliced(batches):
            if part.num_rows:
                yield fn(part)

    return spread(df).mapInArrow(run, schema)
