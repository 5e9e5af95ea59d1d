"""Secret scans: fixed patterns, and character Markov models for the rest.

Patterns give the base spans. Beside them, every run of key-like characters
with a letter and a digit is scored by two first-order Markov models, one
trained on random strings and one on ordinary identifiers; a mean
log-likelihood ratio per character above a threshold, over the whole run or over
any stretch of 20 characters or more, adds a span of kind ``markov``, unless a
base span already covers the run or the stretch. Stretches have a threshold of their own, set
as that of runs. The span is the stretch of the largest sum of ratios, widened
to the separators around it; what is left of the run on both sides is searched
again. Spans are in code points, ends exclusive.

Defined cases: a null or empty text has no span; texts of any length are read
whole; repeated rows are each scanned; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAST = 20
_SEPARATORS = "/_-="
KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Linear-time searches that say which texts hold a match at all.
_SIFT = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""", r"AKIA", r"[0-9a-f]{32}", r"[A-Za-z0-9+/_=-]{20}")

_WORDS = (
    "account action active address alert amount answer archive array async attachment audit author backup balance batch border branch buffer build button cache "
    "calendar channel check client close cluster code column command commit compare config connect container content context control counter create current customer data "
    "default delete deploy detail device document domain driver editor element email engine entry error event export factory failure feature field filter folder format "
    "function gateway global group handler header height history image import index input instance internal invoice item journal label language layer length level library "
    "limit link list loader local location logger manager mapper master matrix memory message metric model module monitor network number object offset option order output "
    "package page parameter parser partition payment policy pointer position prefix process product profile project property provider query queue random range reader record "
    "region register report request resource response result return role route rule sample scale schema score search section select sender sequence server service session "
    "setting shadow signal size socket source split stage start state status storage stream string style subject suffix summary support switch symbol system table target task "
    "template test text thread time title total trace track transfer type update upload user value vector version view window worker wrapper"
).split()


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """(string, 1 if random): random keys over the usual alphabets, and identifiers in the usual cases and joints."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabets = (letters + letters.upper() + "0123456789", letters + letters.upper() + "0123456789+/", "0123456789abcdef", letters.upper() + "0123456789", letters + letters.upper() + "0123456789_-")
    out = []
    for i in range(n):
        out.append(("".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(20, 48))), 1))
        parts = rng.choices(_WORDS, k=rng.randint(3, 6))
        if rng.random() < 0.5:
            parts.insert(rng.randint(1, len(parts)), str(rng.randint(0, 2100)))
        style = i % 5
        out.append(({0: "_".join, 1: "-".join, 2: "/".join, 3: lambda p: "".join(x.title() for x in p), 4: lambda p: "_".join(p).upper()}[style](parts), 0))
    return out


class MarkovPair:
    """First-order character models of random and ordinary strings, add-one smoothed, as one table of log ratios."""

    CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

    def __init__(self, samples: list[tuple[str, int]]):
        self.code = {c: i + 1 for i, c in enumerate(self.CHARS)}
        n = len(self.CHARS) + 1
        counts = np.ones((2, n, n))
        for text, label in samples:
            at = [0, *(self.code.get(c, 0) for c in text)]
            np.add.at(counts[label], (at[:-1], at[1:]), 1)
        p = counts / counts.sum(axis=2, keepdims=True)
        self.ratio = np.log(p[1] / p[0])
        self.stretch = self.threshold(samples, score=self.best_stretch)

    def ratios(self, text: str) -> np.ndarray:
        at = [0, *(self.code.get(c, 0) for c in text)]
        return self.ratio[at[:-1], at[1:]]

    def largest_sum(self, text: str, level: float = 0.0) -> tuple[float, int, int]:
        """The largest sum of ratios less a level, over stretches of 20 characters or more with a letter and a digit, and where it is; one pass."""
        b = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
        last = lambda has: np.maximum.accumulate(np.where(has, np.arange(len(b)), -1))
        most = np.minimum(last((b >= 48) & (b < 58)), last(((b | 32) >= 97) & ((b | 32) < 123)))
        most = np.minimum(most, np.arange(1, len(b) + 1) - _LEAST)
        ends = np.flatnonzero(most >= 0)
        if not len(ends):
            return -math.inf, 0, 0
        sums = np.concatenate([[0], np.cumsum(self.ratios(text) - level)])
        gain = sums[ends + 1] - np.minimum.accumulate(sums)[most[ends]]
        i = int(gain.argmax())
        return float(gain[i]), int(sums[: most[ends[i]] + 1].argmin()), int(ends[i]) + 1

    def best_stretch(self, text: str) -> float:
        """The largest mean over such stretches, of a short string."""
        best, level = -math.inf, -20.0
        while True:
            gain, a, z = self.largest_sum(text, level)
            if gain <= 1e-9:
                return best
            best = level = level + gain / (z - a)

    def score(self, text: str) -> float:
        """Mean log-likelihood ratio per character; above 0 is likelier random."""
        at = [0, *(self.code.get(c, 0) for c in text)]
        return float(self.ratio[at[:-1], at[1:]].sum() / max(1, len(text)))

    def threshold(self, samples: list[tuple[str, int]], most_false: float = 0.001, score=None) -> float:
        """The least threshold that at most this share of the ordinary samples passes."""
        s = sorted((score or self.score)(t) for t, label in samples if not label)
        return max(0.0, s[min(len(s) - 1, math.ceil(len(s) * (1 - most_false)) - 1)])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _keys(run: str, model: MarkovPair, threshold: float) -> list[tuple[int, int]]:
    """Spans of the stretches of a run that are likelier random."""
    found, left = [], [(0, len(run))]
    while left:
        low, high = left.pop()
        part = run[low:high]
        gain, a, z = model.largest_sum(part) if len(part) >= _LEAST else (-math.inf, 0, 0)
        if gain > -math.inf and (model.score(part) > threshold or model.largest_sum(part, model.stretch)[0] > 0):
            while a and part[a - 1] not in _SEPARATORS:
                a -= 1
            while z < len(part) and part[z] not in _SEPARATORS:
                z += 1
            found.append((low + a, low + z))
            left += [(low, low + a), (low + z, high)]
    return found


def scan(text: str, model: MarkovPair, threshold: float) -> list[tuple[str, int, int]]:
    """Spans by start, then kind as listed in KINDS."""
    base = sorted(base_spans(text), key=lambda s: s[1])
    found, starts, ends = list(base), [s[1] for s in base], list(accumulate((s[2] for s in base), max))

    def covered(a: int, z: int) -> bool:
        at = bisect_right(starts, a)
        return at > 0 and ends[at - 1] >= z

    for m in _RUN.finditer(text):
        if not covered(*m.span()):
            keys = [(m.start() + a, m.start() + z) for a, z in _keys(m[0], model, threshold)]
            found += [("markov", *k) for k in keys if not covered(*k)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spans(text: Column, samples: list[tuple[str, int]] | None = None) -> Column:
    """array<struct<kind, start, end>> of each text; the models are trained from the labelled samples here, once."""
    samples = samples or labelled_samples()
    model = MarkovPair(samples)
    threshold = model.threshold(samples)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for texts in it:
            maybe = np.zeros(len(texts), bool)
            for pattern in _SIFT:
                maybe |= pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)
            found = [[] for _ in range(len(texts))]
            for i in np.flatnonzero(maybe):
                found[i] = [{"kind": k, "start": a, "end": z} for k, a, z in scan(texts[i].as_py(), model, threshold)]
            yield pa.array(found, kind)

    return F.arrow_udf(run, "array<struct<kind:string,start:bigint,end:bigint>>")(text)


def find_secrets(docs: DataFrame, text_col: str = "text", as_col: str = "secrets") -> DataFrame:
    """The rows with their spans beside them."""
    return docs.withColumn(as_col, spans(F.col(text_col)))


def joined(found: Column, base_only: bool) -> Column:
    """``kind:start:end`` of the spans, comma-joined in their order."""
    kept = F.filter(found, lambda s: s["kind"] != "markov") if base_only else found
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
