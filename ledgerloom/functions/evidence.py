"""Texts as rules read them, with the place that each character was written at, and phrases quoted as written."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of other scripts that look like a Latin one, and signs that stand for a plain one.
LOOK_ALIKES = str.maketrans(
    {
        **dict(zip("аеорсухкмнтѕіјԁԛԝһӏ", "aeopcyxkmhtsijdqwhl")),
        **dict(zip("АВЕКМНОРСТХУЅІЈԚԜҺӀ", "ABEKMHOPCTXYSIJQWHI")),
        **dict(zip("αειικνορτυχωϲϳ", "aeiikvoptuxwcj")),
        **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC")),
        **dict(zip("ıȷɑɡօս", "ijagou")),
        **dict.fromkeys("‘’‚‛′", "'"),
        **dict.fromkeys("“”„‟″", '"'),
        **dict.fromkeys("‐‒–—―−", "-"),
    }
)
_GONE = re.compile(r"<!--.*?-->|</?(?:a|abbr|b|big|code|em|font|i|mark|small|span|strike|strong|sub|sup|u)\b[^<>]*>", re.S | re.I)
_ENTITY = re.compile(r"&(?:#\d+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z]\w{1,31};)")
RESULT = "plain string, starts array<int>, ends array<int>"


def _hidden(c: str) -> bool:
    """Marks on the letter before, and characters that show nothing."""
    return unicodedata.category(c) in ("Mn", "Me", "Cf") or c == "ᅟ" or "︀" <= c <= "️"


def mapped(text: str) -> tuple[str, list[int], list[int]]:
    """The plain text, and of each of its characters where its writing starts and ends.

    Entities are read first, then comments and inline tags go, then each character
    is decomposed, stripped of marks and what is invisible, and read as its Latin
    look-alike. The spans of what a character was written as are carried along.
    """
    plain, starts, ends = _mapped(text)
    return plain, starts.tolist(), ends.tolist()


class _Reads(dict):
    """How a character is read, worked out once for each."""

    def __missing__(self, c: str) -> str:
        self[c] = out = "".join(d.translate(LOOK_ALIKES) for d in (c if c.isascii() else unicodedata.normalize("NFKD", c)) if d.isascii() or not _hidden(d))
        return out


_READS = _Reads()


def _mapped(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    pieces, starts, ends, at = [], [], [], 0
    for m in _ENTITY.finditer(text):
        meant = html.unescape(m[0])
        pieces += [text[at : m.start()], meant]
        starts += [np.arange(at, m.start()), np.full(len(meant), m.start())]
        ends += [np.arange(at + 1, m.start() + 1), np.full(len(meant), m.end())]
        at = m.end()
    read = "".join([*pieces, text[at:]])
    start, end = np.concatenate([*starts, np.arange(at, len(text))]), np.concatenate([*ends, np.arange(at + 1, len(text) + 1)])
    if "<" in read:
        kept = np.ones(len(read), bool)
        for m in _GONE.finditer(read):
            kept[m.start() : m.end()] = False
        read, start, end = "".join(compress(read, kept)), start[kept], end[kept]
    parts = [_READS[c] for c in read]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return "".join(parts), np.repeat(start, sizes), np.repeat(end, sizes)


def normalised(text: Column) -> Column:
    """A struct of the plain text and, for each of its characters, where in the text it starts and ends; nulls stay null."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in it:
            rows = [None if t is None else mapped(t) for t in batch.to_pylist()]
            yield pa.array([r and dict(zip(("plain", "starts", "ends"), r)) for r in rows], pa.struct([("plain", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]))

    return F.arrow_udf(run, RESULT)(text)


_QUOTES = "array<struct<phrase:string,start:int,quoted:string>>"
_QUOTES_ARROW = pa.list_(pa.struct([("phrase", pa.string()), ("start", pa.int32()), ("quoted", pa.string())]))


def _pattern(phrases: Sequence[str]) -> re.Pattern:
    """All phrases as whole words, the longest first at each place, case and words in ASCII as in Java's patterns."""
    return re.compile(rf"(?<!\w)(?:{'|'.join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))})(?!\w)", re.I | re.A)


def _found(pattern: re.Pattern, text: str, plain: str, starts: Sequence[int], ends: Sequence[int]) -> list[dict]:
    hits = [(m[0].lower(), int(starts[m.start()]), int(ends[m.end() - 1])) for m in pattern.finditer(plain)]
    return [{"phrase": h, "start": i, "quoted": text[i:j]} for h, i, j in hits]


def evidence(text: Column, normal: Column, phrases: Sequence[str]) -> Column:
    """array of struct(phrase, start, quoted): every place of a phrase as whole words in the plain text, whatever its case, quoted as the text has it.

    normal: a column that holds ``normalised(text)``. One pass of one pattern finds all phrases, the longest first at each place. start counts the text's own characters from 0.
    """
    pattern = _pattern(phrases)

    def run(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, normals in it:
            rows = zip(texts.to_pylist(), normals.to_pylist())
            yield pa.array([None if t is None or n is None else _found(pattern, t, n["plain"], n["starts"], n["ends"]) for t, n in rows], _QUOTES_ARROW)

    return F.arrow_udf(run, _QUOTES)(text, normal)


def quotes(text: Column, phrases: Sequence[str]) -> Column:
    """evidence() of a text whose plain form nobody else needs: the places of its characters stay in the task that reads it."""
    pattern = _pattern(phrases)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in it:
            yield pa.array([None if t is None else _found(pattern, t, *_mapped(t)) for t in batch.to_pylist()], _QUOTES_ARROW)

    return F.arrow_udf(run, _QUOTES)(text)
