"""LIKE and GLOB for every letter's case, in time that patterns can't blow up."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _folds() -> dict[int, int | str]:
    """Case folding that keeps a character one character: what folds to several ("ß") is a sign of its own for all that fold so."""
    out, several = {}, {}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        folded = c.casefold()
        if len(folded) > 1:
            out[code] = several.setdefault(folded, 0xF0000 + len(several))
        elif folded != c:
            out[code] = folded
    return out


def fold(text: str) -> str:
    return text.casefold() if text.isascii() else text.translate(_folds())


def like_pieces(pattern: str, escape: str | None = None) -> list[str]:
    """The pattern's stretches between runs of %, as regular expressions of one width each."""
    pieces, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if escape and c == escape and at + 1 < len(pattern):
            at += 1
            pieces[-1] += re.escape(fold(pattern[at]))
        elif c == "%":
            pieces.append("")
        else:
            pieces[-1] += "(?s:.)" if c == "_" else re.escape(fold(c))
        at += 1
    return pieces


def glob_pieces(pattern: str) -> list[str]:
    """The same for GLOB, which minds case: * any run, ? one character, [a-c] one of a set, [^a-c] one outside of it. A bracket without its end is a bracket."""
    pieces, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        closed = pattern.find("]", at + 2 + (pattern[at + 1 : at + 2] == "^")) if c == "[" else -1
        if c == "*":
            pieces.append("")
        elif c == "?":
            pieces[-1] += "(?s:.)"
        elif closed > 0:
            inside, apart = pattern[at + 1 : closed], pattern[at + 1] == "^"
            ranges = re.findall(r"(?s)(.)-(.)|(.)", inside[apart:])
            one = "".join(f"{re.escape(a)}-{re.escape(z)}" if a and a <= z else re.escape(x) for a, z, x in ranges if x or a <= z)
            pieces[-1] += f"[{'^' if apart else ''}{one}]" if one else ("(?s:.)" if apart else "(?!)")
            at = closed
        else:
            pieces[-1] += re.escape(c)
        at += 1
    return pieces


def matcher(pieces: list[str]):
    """Whether a text is the pieces in order with anything between them.

    The first piece stands at the start, the last at the end, each other one at
    the first place after the one before: no later place could do better, so
    nothing is ever tried again, and no piece has a choice of widths.
    """
    first, *rest = [re.compile(p) for p in pieces]
    if not rest:
        return lambda text: first.fullmatch(text) is not None
    *inner, last = rest
    inner = [p for p in inner if p.pattern]
    ends = re.compile(rf"{last.pattern}\Z")

    def run(text: str) -> bool:
        found = first.match(text)
        for piece in inner:
            found = found and piece.search(text, found.end())
        return found is not None and _at_end(ends, text, found.end(), _width(last.pattern))

    return run


@cache
def _width(piece: str) -> int:
    low, high = re._parser.parse(piece).getwidth()
    return high


def _at_end(ends: re.Pattern, text: str, after: int, width: int) -> bool:
    return len(text) - width >= after and ends.match(text, len(text) - width) is not None


def tested(text: Column, tests: dict[str, tuple]) -> Column:
    """struct of one boolean for each of ``tests``, by name: what LIKE or GLOB says of a text, for ("like", pattern), ("like", pattern, escape) and ("glob", pattern).

    LIKE is SQL's whatever the case of any letter; _ is one character, "ß"
    included. GLOB minds case. Nulls stay null. One Python worker reads a text for all tests, one text at a time.
    """

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = [(kind == "like", matcher((like_pieces if kind == "like" else glob_pieces)(*how))) for kind, *how in tests.values()]
        folds = any(folded for folded, _ in ready)
        for batch in it:
            told = [[] for _ in ready]
            for value in batch:
                text = value.as_py()
                low = fold(text) if folds and text is not None else text
                for out, (folded, test) in zip(told, ready):
                    out.append(None if text is None else test(low if folded else text))
            yield pa.StructArray.from_arrays([pa.array(out, pa.bool_()) for out in told], names=list(tests))

    return F.arrow_udf(run, "struct<" + ", ".join(f"`{name}`: boolean" for name in tests) + ">")(text)


def like(text: Column, pattern: str, escape: str | None = None) -> Column:
    """SQL's LIKE whatever the case of any letter; _ is one character, "ß" included. Nulls stay null."""
    return tested(text, {"told": ("like", pattern, escape)})["told"]


def glob(text: Column, pattern: str) -> Column:
    """GLOB, which minds case. Nulls stay null."""
    return tested(text, {"told": ("glob", pattern)})["told"]
