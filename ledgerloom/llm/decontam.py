"""Benchmark decontamination by edit distance, through CGK embeddings.

Items and texts are sequences of words (letters and digits, A-Z folded). A text
is contaminated by an item of n words if some run of its words is within
k = floor(max_edit * n) word edits of the item.

For each item size, windows of that many words are taken at every word of every
text that a lossless bound leaves. Of the r places of an item that hold words
of few items (``few``, 16), at least r - k must be met in a window within k
edits; sorted positions of such words give the windows that meet them. Items with r <= k take
every window with at least n - k words of the block's items, told by prefix
sums. What passes is embedded. The CGK random walk reads a sequence of n words into 3n steps: at
each step it writes the current word, and advances if a random bit, drawn for
step and word, says so. Sequences within k edits then differ in few places. Each
repetition has a walk of its own and samples a few places; windows and items
that agree in all of them are candidates, and the exact edit distance decides.
The number of repetitions is set by simulating k edits on items of each size at
hand until the target recall is reached. Sizes that do not reach it in
``most_repetitions``, and those over ``longest``, are not embedded: each stretch
of windows that the bound leaves for an item is searched by edit distance.

Items are handled in blocks of ``block`` items, each a pass over the texts.

Defined cases: null and empty texts and items match nothing; items with equal
texts all match; items with equal ids but different texts count as one item, the
nearest of them; a null item id is an id like any, last in order; where a text has several runs near an item, the nearest counts, the
first of equal ones; repeated rows are each judged; empty tables give empty
results or texts without matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import PLAIN, chunks, distinct_values, mix

KIND = "array<struct<item_id:bigint,distance:int,start_word:bigint>>"
_PAD = np.uint64(0)
#: Windows or pairs worked on at once.
_MOST = 20_000


@dataclass(frozen=True)
class Settings:
    max_edit: float = 0.2
    samples: int = 2
    recall: float = 0.99
    most_repetitions: int = 64
    longest: int = 128
    seed: int = 11


def _keys(settings: Settings, repetition: int, steps: int) -> np.ndarray:
    at = np.arange(steps, dtype=np.uint64) + np.uint64(repetition * 1_000_003 + settings.seed * 7_919)
    return mix(at + np.uint64(1)) | np.uint64(1)


def signatures(windows: np.ndarray, settings: Settings, repetition: int) -> np.ndarray:
    """CGK walk of each row of words, and a hash of the words written at the sampled steps."""
    m, n = windows.shape
    steps = 3 * n
    key = _keys(settings, repetition, steps)
    places = np.sort(np.random.default_rng([settings.seed, repetition]).choice(2 * n, min(settings.samples, 2 * n), replace=False))
    padded = np.concatenate([windows, np.full((m, 1), _PAD)], axis=1)
    row, at, out = np.arange(m), np.zeros(m, np.int64), np.zeros(m, np.uint64)
    for j in range(int(places[-1]) + 1):
        word = padded[row, at]
        if j in places:
            out = mix(out + word + key[j])
        at += (((word ^ key[j]) * key[j]) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, n, out=at)
    return out


@lru_cache(maxsize=4096)
def repetitions(n: int, settings: Settings, trials: int = 200) -> int | None:
    """The least number that finds the target share of simulated pairs of n words at the largest distance; None if there is none up to the most."""
    if n > settings.longest:
        return None
    rng, k = np.random.default_rng(settings.seed), int(settings.max_edit * n)
    items = rng.integers(1, 1 << 62, (trials, n)).astype(np.uint64)
    edited = np.empty_like(items)
    for i in range(trials):
        s = items[i].tolist()
        for _ in range(k):
            kind, at = rng.integers(3), int(rng.integers(len(s)))
            if kind == 0:
                s[at] = int(rng.integers(1, 1 << 62))
            elif kind == 1 and len(s) > 1:
                del s[at]
            else:
                s.insert(at, int(rng.integers(1, 1 << 62)))
        edited[i] = np.array((s + rng.integers(1, 1 << 62, n).tolist())[:n], np.uint64)
    found = np.zeros(trials, bool)
    for r in range(settings.most_repetitions):
        found |= signatures(items, settings, r) == signatures(edited, settings, r)
        if found.mean() >= settings.recall:
            return r + 1
    return None


def distances(items: np.ndarray, runs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Row by row, the least edit distance between an item and a prefix of a run of words (of the length given)."""
    m, n = items.shape
    width = runs.shape[1]
    steps = np.arange(width + 1)
    line = np.broadcast_to(steps, (m, width + 1)).astype(np.int64)
    inside = steps[None, :] <= lengths[:, None]
    for i in range(n):
        new = np.empty_like(line)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(line[:, :-1] + (runs != items[:, i : i + 1]), line[:, 1:] + 1)
        line = np.minimum.accumulate(new - steps, axis=1) + steps
    return np.where(inside, line, 1 << 30).min(axis=1)


def start_distances(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per word, the least edit distance between an item and a run of words that begins there."""
    back, steps = words[::-1], np.arange(len(words) + 1)
    line = np.zeros(len(words) + 1, np.int64)
    for word in item[::-1]:
        new = line + 1
        new[1:] = np.minimum(new[1:], line[:-1] + (back != word))
        line = np.minimum.accumulate(new - steps) + steps
    return line[:0:-1]


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], settings: Settings):
        self.settings = settings
        self.size = np.array([len(w) for _, w, _ in items])
        edits = (settings.max_edit * self.size).astype(int)
        words, held = np.unique(np.concatenate([np.unique(w) for _, w, _ in items]), return_counts=True)
        chosen, self.need = [], -(-(self.size - edits) // 3)
        for i, (_, w, length) in enumerate(items):
            rarest = np.lexsort((w, -length, held[np.searchsorted(words, w)]))[: edits[i] + self.need[i]]
            chosen.append(np.unique(w[rarest]))
        word, owner = np.concatenate(chosen), np.repeat(np.arange(len(items)), [len(c) for c in chosen])
        order = np.argsort(word, kind="stable")
        self.known, self.first, self.held = np.unique(word[order], return_index=True, return_counts=True)
        self.owners = owner[order]
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.groups, self.sizes = [], np.unique(self.size)
        need = {n: repetitions(n, settings) for n in self.sizes.tolist()}
        r = max((x for x in need.values() if x), default=0)
        self.exact = {n for n, x in need.items() if x is None}
        self.long = {i: items[i][:2] for i in np.flatnonzero(np.isin(self.size, list(self.exact))).tolist()}
        for n in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == n)
            words = np.stack([items[i][1] for i in at])
            tables = []
            for j in range(0 if n in self.exact else r):
                s = signatures(words, settings, j)
                order = np.argsort(s, kind="stable")
                tables.append((s[order], order))
            self.groups.append((n, int(settings.max_edit * n), [items[i][0] for i in at], words, tables))

    def _places(self, h: np.ndarray) -> np.ndarray:
        """Per word, its place among the known words, or -1."""
        place = np.full(len(h), -1)
        at = np.flatnonzero(self.flags[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        same = self.known[found] == h[at]
        place[at[same]] = found[same]
        return place

    def _met(self, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows, their sizes, and the item of whose own words they hold enough. first: per word, its text's first word."""
        at = np.flatnonzero(place >= 0)
        count = self.held[place[at]]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = self.owners[np.repeat(self.first[place[at]], count) + nth]
        at = np.repeat(at, count)
        order = np.argsort(item, kind="stable")
        at, item = at[order], item[order]
        last = np.arange(len(at)) + self.need[item] - 1
        ok = last < len(at)
        ok[ok] = (item[last[ok]] == item[ok]) & (at[last[ok]] - at[ok] < self.size[item[ok]]) & (first[at[last[ok]]] == first[at[ok]])
        a, z, item = at[ok], at[last[ok]], item[ok]
        n = self.size[item]
        low = np.maximum(first[a], z - n + 1)
        count = a - low + 1
        starts = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return starts, np.repeat(n, count), np.repeat(item, count)

    def find(self, texts: pa.Array) -> list[list[dict]]:
        """Windows are gathered over the whole batch, so that each walk is made for many at once."""
        best: dict[tuple[int, int | None], tuple[int, int]] = {}
        held, count = [[] for _ in self.groups], [0] * len(self.groups)
        for chunk in chunks(texts, PLAIN):
            h = chunk.word_hashes()
            if not len(h):
                continue
            first, stop = (np.repeat(b, chunk.n_words) for b in (chunk.word_bounds[:-1], chunk.word_bounds[1:]))
            met, sizes, owners = self._met(self._places(h), first)
            for g in np.flatnonzero(np.isin(self.sizes, sizes)):
                n, k = self.groups[g][:2]
                if n in self.exact:
                    self._search(k, met[sizes == n], owners[sizes == n], h, first, stop, chunk, best)
                    continue
                starts = distinct_values(met[sizes == n])
                for part in np.array_split(starts, len(starts) // _MOST + 1):
                    at = part[:, None] + np.arange(n + k)
                    inside = at < stop[part][:, None]
                    runs = np.where(inside, h[np.minimum(at, len(h) - 1)], _PAD)
                    held[g].append((runs, inside.sum(axis=1), chunk.text_of_word[part] + chunk.first, part - first[part]))
                    count[g] += len(part)
                    if count[g] >= _MOST:
                        self._group(self.groups[g], held[g], best)
                        held[g], count[g] = [], 0
        for group, windows in zip(self.groups, held):
            if windows:
                self._group(group, windows, best)
        out = [[] for _ in range(len(texts))]
        for (text, item), (d, start) in sorted(best.items(), key=lambda m: (m[0][0], m[0][1] is None, m[0][1] or 0)):
            out[text].append({"item_id": item, "distance": d, "start_word": start})
        return out

    def _search(self, k, met, owners, h, first, stop, chunk, best) -> None:
        """Edit distance over whole stretches of an item's windows, without embedding."""
        for owner in distinct_values(owners).tolist():
            name, item = self.long[owner]
            starts, reach = distinct_values(met[owners == owner]), len(item) + k
            torn = (np.diff(starts) > reach) | (np.diff(first[starts]) > 0)
            for part in np.split(starts, np.flatnonzero(torn) + 1):
                low = int(part[0])
                d = start_distances(item, h[low : min(int(part[-1]) + reach, int(stop[low]))])
                at = int(d.argmin())
                if d[at] <= k:
                    key, new = (int(chunk.text_of_word[low] + chunk.first), name), (int(d[at]), int(low + at - first[low]))
                    best[key] = min(best.get(key, new), new)

    def _group(self, group, windows, best) -> None:
        n, k, ids, words, tables = group
        runs, lengths, texts, starts = (np.concatenate(x) for x in zip(*windows))
        pairs = []
        for repetition, (keys, order) in enumerate(tables):
            s = signatures(runs[:, :n], self.settings, repetition)
            low, high = np.searchsorted(keys, s), np.searchsorted(keys, s, side="right")
            got = np.flatnonzero(high > low)
            for i in range(int((high - low).max(initial=0))):
                more = got[high[got] - low[got] > i]
                pairs.append(more * len(ids) + order[low[more] + i])
        found = distinct_values(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        for pair in np.array_split(found, len(found) // _MOST + 1):
            w, item = pair // len(ids), pair % len(ids)
            d = distances(words[item], runs[w], lengths[w])
            for i in np.flatnonzero(d <= k):
                key, new = (int(texts[w[i]]), ids[item[i]]), (int(d[i]), int(starts[w[i]]))
                best[key] = min(best.get(key, new), new)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block: int) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Items with a word, by id, a block at a time on the driver; items of one id are in one block, whatever its size."""
    held = []
    for r in items.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).orderBy(F.col(f"`{id_col}`")).toLocalIterator():
        words = next(chunks(pa.array([r[1]], pa.string()), PLAIN))
        if len(held) >= block and r[0] != held[-1][0]:
            yield held
            held = []
        if len(words.starts):
            held.append((r[0], words.word_hashes(), words.ends - words.starts))
    if held:
        yield held


def matches(text: Column, items: list[tuple[int, np.ndarray, np.ndarray]], spark: SparkSession, settings: Settings = Settings()) -> Column:
    """The items of one block that contaminate a text. The block's tables travel once to each executor."""
    shipped = spark.sparkContext.broadcast(Matcher(items, settings))

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield pa.array(shipped.value.find(texts), pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start_word", pa.int64())])))

    return F.arrow_udf(run, KIND)(text)


def find_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", as_col: str = "leaks", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings(), block: int = 20_000
) -> DataFrame:
    """The rows with the items that contaminate them beside, by item id."""
    found = [matches(F.col(f"`{text_col}`"), part, docs.sparkSession, settings) for part in item_blocks(items, item_id, item_text, block)]
    return docs.withColumn(as_col, F.concat(*found) if found else F.array().cast(KIND))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows that no item contaminates, with their own columns only, whatever their names."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own")
    return find_leaks(docs.select(own, F.col(f"`{text_col}`").alias("_text")), items, "_text", as_col="_leaks", **how).filter(F.size("_leaks") == 0).select("_own.*")
