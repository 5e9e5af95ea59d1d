"""Periodic runs: stretches of a text whose words repeat with a fixed lag.

A run is a stretch of consecutive words with smallest period q, of at least
``least`` words and ``times`` periods, that no neighbouring word extends.

The words of a text get numbers, and each bit of these numbers is one big
integer with a bit for each word (a bit plane). For a lag q the planes are
XORed with themselves shifted by q; the OR of the results has a zero wherever
the words q apart are equal. ANDing the complement with itself, shifted by
1, 2, 4, ... up to the wanted length, leaves a bit only where a long enough
stretch of zeros begins. A lag is given up as soon as the planes seen so far
leave none. Stretches whose words also repeat with a shorter period lie inside
a run of that period, found before, as lags are tried in ascending order.

A text of n words takes n / (4 * 64) * n steps of a machine word at most, and
twenty bits of memory a word or so. Texts never leave their rows.

Defined cases: null and empty texts, and texts without a word, have no runs
and an empty collapsed text; repeated rows have equal results; an empty table
gives an empty table. The result is a column, so that names can't clash.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Chunk, chunks, codes

RESULT = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class Planes:
    """The bit planes of the numbers of a text's words, made as they are asked for."""

    def __init__(self, numbers: np.ndarray):
        self.numbers, self.n = numbers, len(numbers)
        self.bits = int(numbers.max()).bit_length() if self.n else 0
        self.made: list[int] = []

    def __getitem__(self, bit: int) -> int:
        while len(self.made) <= bit:
            flags = (self.numbers >> len(self.made)) & 1
            self.made.append(int.from_bytes(np.packbits(flags.astype(np.uint8), bitorder="little").tobytes(), "little"))
        return self.made[bit]

    def stretches(self, lag: int, need: int) -> list[tuple[int, int]]:
        """Start and end of the maximal stretches of at least ``need`` positions whose word equals that ``lag`` words later."""
        inside = (1 << (self.n - lag)) - 1
        differ, seen = 0, 0
        while True:
            for bit in range(seen, min(self.bits, max(1, 2 * seen))):
                differ |= self[bit] ^ (self[bit] >> lag)
            seen = min(self.bits, max(1, 2 * seen))
            begins = shrunk(inside & ~differ, need)
            if not begins or seen == self.bits:
                return [(start, end + need - 1) for start, end in ones(begins)]


def shrunk(flags: int, need: int) -> int:
    """The bits at which ``need`` set bits in a row begin."""
    have = 1
    while flags and have < need:
        step = min(have, need - have)
        flags &= flags >> step
        have += step
    return flags


def ones(flags: int) -> list[tuple[int, int]]:
    """Start and end of each row of set bits."""
    if not flags:
        return []
    edges = flags ^ (flags << 1)
    raw = np.frombuffer(edges.to_bytes((edges.bit_length() + 7) // 8, "little"), np.uint8)
    at = np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()
    return list(zip(at[::2], at[1::2]))


def find(numbers: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """Start, length and period of the runs of a sequence of numbers, by start and period."""
    planes, found = Planes(numbers), {}
    for lag in range(1, planes.n // times + 1):
        long = planes.stretches(lag, max(least, times * lag) - lag)
        if not long:
            continue
        shorter = [found[p] for p in found if lag % p == 0]
        own = ([], [])
        for start, end in long:
            if not any((at := bisect_right(s, start) - 1) >= 0 and e[at] >= end + lag for s, e in shorter):
                own[0].append(start)
                own[1].append(end + lag)
        if own[0]:
            found[lag] = own
    return sorted(((s, e - s, p) for p, own in found.items() for s, e in zip(*own)), key=lambda r: (r[0], r[2]))


def collapsed(chunk: Chunk, words: pa.Array, runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    """The texts' words joined by one space, without those that a run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for first, of_text in zip(chunk.word_bounds.tolist(), runs):
        for start, length, period in of_text:
            change[first + start + period] += 1
            change[first + start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    bounds = np.concatenate([[0], np.cumsum(kept)])[chunk.word_bounds]
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.filter(pa.array(kept)).cast(pa.string()))
    return pc.binary_join(lists, " ")


def periodic(text: Column, least: int = 6, times: int = 4) -> Column:
    """A struct of n_words, the runs in order of start and period (words numbered from 0), and the collapsed text."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            count, of_texts, short = [np.zeros(0, np.int64)], [], [pa.array([], pa.string())]
            for chunk in chunks(texts):
                words, b = chunk.words(), chunk.word_bounds
                numbers, _ = codes(words)
                runs = [find(numbers[i:j], least, times) for i, j in zip(b[:-1].tolist(), b[1:].tolist())]
                count.append(chunk.n_words)
                of_texts += runs
                short.append(collapsed(chunk, words, runs))
            flat = np.array([r for runs in of_texts for r in runs], np.int64).reshape(-1, 3)
            bounds = np.concatenate([[0], np.cumsum([len(runs) for runs in of_texts])]).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["start", "length", "period"])
            joined = pa.concat_arrays(short)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(count)), pa.ListArray.from_arrays(pa.array(bounds), structs), joined], ["n_words", "runs", "collapsed"])

    return F.arrow_udf(run, RESULT)(text)
