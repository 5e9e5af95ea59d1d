"""Vectorised text primitives over Arrow string arrays.

A batch of texts is cut into chunks of a quarter megabyte, so that memory stays
bounded whatever the batch, and every helper works on the chunk's UTF-8 bytes
with numpy. A text is never cut: a chunk holds whole texts, one at least.
Words are the maximal runs of ``[^\\x20\\x09-\\x0D]``; a null text has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: A-Z as a-z, and other ASCII than letters and digits as a space.
PLAIN = np.array([c if c > 127 or 9 <= c <= 13 or chr(c).isalnum() else 32 for c in _FOLD], dtype=np.uint8)
FOLD = _FOLD

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _BASE_INVERSE))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def large_strings(n: int, offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def codes(values: pa.Array) -> tuple[np.ndarray, int]:
    """Dense codes of equal values, and how many there are."""
    d = pc.dictionary_encode(values)
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(d.dictionary)


@dataclass
class Chunk:
    """Whole texts: bytes, byte bounds of each text, and the first text's place in its batch."""

    data: np.ndarray
    bounds: np.ndarray
    first: int

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value that each byte has."""
        return span_sums(flags, self.bounds)

    @cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        word = ~_SEPARATOR[self.data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = self.bounds[:-1] < self.bounds[1:]
        at, to = self.bounds[:-1][full], self.bounds[1:][full] - 1
        first[at], last[to] = word[at], word[to]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    @property
    def starts(self) -> np.ndarray:
        return self._words[0]

    @property
    def ends(self) -> np.ndarray:
        return self._words[1]

    @cached_property
    def word_bounds(self) -> np.ndarray:
        return np.searchsorted(self.starts, self.bounds)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_bounds)

    @cached_property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def points(self) -> np.ndarray:
        """True where a code point begins."""
        return (self.data & 0xC0) != 0x80

    def words(self) -> pa.Array:
        data = self.data[~_SEPARATOR[self.data]]
        return large_strings(len(self.starts), np.concatenate([[0], np.cumsum(self.ends - self.starts)]), data)

    def lines(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """``\\n``-split lines: strings, the text of each, and byte starts and ends."""
        cuts = np.flatnonzero(self.data == 10)
        per = np.diff(np.searchsorted(cuts, self.bounds)) + 1
        text = np.repeat(np.arange(self.n), per)
        last = np.cumsum(per) - 1
        ends = np.empty(len(text), np.int64)
        inner = np.ones(len(text), bool)
        inner[last] = False
        ends[inner], ends[last] = cuts, self.bounds[1:]
        starts = np.empty_like(ends)
        firsts = last - per + 1
        after = np.ones(len(text), bool)
        after[firsts] = False
        starts[after], starts[firsts] = cuts + 1, self.bounds[:-1]
        strings = large_strings(len(text), np.concatenate([[0], np.cumsum(ends - starts)]), self.data[self.data != 10])
        return strings, text, starts, ends

    def word_hashes(self) -> np.ndarray:
        return self._hashes

    @cached_property
    def _hashes(self) -> np.ndarray:
        """64-bit hashes of the words: polynomial over their bytes, from prefix sums, then mixed."""
        power, inverse = _powers(max(CHUNK_BYTES, len(self.data)))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], dtype=np.uint64)])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of k words, and the word at which each begins."""
        h = self.word_hashes()
        at = np.flatnonzero(np.arange(len(h)) + k <= np.repeat(self.word_bounds[1:], self.n_words))
        salt = _salts(k)
        total = h[at] * salt[0]
        for j in range(1, k):
            total += h[at + j] * salt[j]
        return mix(total), at

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k-word shingles and the text of each. A text of fewer words has its whole sequence as one."""
        long, at = self.windows(k)
        h, b, n = self.word_hashes(), self.word_bounds, self.n_words
        short = np.flatnonzero((n > 0) & (n < k))
        rest = n[short].astype(np.uint64)
        for j in range(k - 1):
            has = n[short] > j
            rest[has] += h[b[short[has]] + j] * _salts(k)[j]
        return np.concatenate([long, mix(rest)]), np.concatenate([self.text_of_word[at], short])


@lru_cache
def _salts(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)


def distinct_values(keys: np.ndarray) -> np.ndarray:
    s = np.sort(keys)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def repeats(keys: np.ndarray) -> np.ndarray:
    """True where a value occurs twice or more."""
    s = np.sort(keys)
    twice = distinct_values(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def span_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if values.dtype == bool:
        b = bounds.tolist()
        return np.array([np.count_nonzero(values[i:j]) for i, j in zip(b[:-1], b[1:])], np.int64)
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def chunks(texts: pa.Array, table: np.ndarray | None = None, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts in order. table: bytes to put for bytes, FOLD or PLAIN."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        part = raw[bounds[at] : bounds[to]]
        yield Chunk(part if table is None else table[part], bounds[at : to + 1] - bounds[at], at)
        at = to
