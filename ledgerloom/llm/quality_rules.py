"""Quality rules with host verdicts.

Every document is measured by a few rules. Failures are added up by host, each
host's failure rate is shrunk towards a beta prior whose mean and strength are
estimated from all hosts (method of moments), and hosts above a rate are
rejected with all they hold. A document is kept if it fails no rule itself and
its host stands.

Defined cases: a null or empty text has no words and fails; a null host is a
host of its own; repeated rows count and are returned each; an empty table
gives an empty table; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .store import spread_join, stored
from .text import Chunk, chunks, codes, distinct_values, mix, repeats, span_sums

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Limits. Shares are in hundredths of the words, or of the lines that have a word."""

    min_words: int = 50
    max_repeat: int = 50
    max_symbols: int = 25
    max_dup_lines: int = 60
    max_word_chars: int = 15
    max_host_rate: float = 0.5


def repeated_words(chunk: Chunk, width: int = 3) -> np.ndarray:
    """Per text, the words that stand in a window of ``width`` words found twice or more in it. Windows are compared by 64-bit hashes that hold the text's number."""
    key, at = chunk.windows(width)
    twice = at[repeats(mix(key + chunk.text_of_word[at].astype(np.uint64)))]
    n = len(chunk.starts)
    inside = np.zeros(n, bool)
    for j in range(width):
        inside[twice + j] = True
    return span_sums(inside, chunk.word_bounds)


def line_counts(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Per text, its lines that have a word, and those of them equal to an earlier one."""
    strings, text, starts, ends = chunk.lines()
    full = np.searchsorted(chunk.starts, ends) > np.searchsorted(chunk.starts, starts)
    code, size = codes(strings)
    total = np.bincount(text[full], minlength=chunk.n)
    distinct = np.bincount(distinct_values(text[full] * max(size, 1) + code[full]) // max(size, 1), minlength=chunk.n)
    return total, total - distinct


def measure(chunk: Chunk) -> dict[str, np.ndarray]:
    lines, dup = line_counts(chunk)
    points = np.concatenate([[0], np.cumsum(chunk.points)])
    return {
        "n_words": chunk.n_words,
        "word_chars": span_sums(points[chunk.ends] - points[chunk.starts], chunk.word_bounds),
        "n_symbols": chunk.sums(_SYMBOL[chunk.data]),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(chunk),
        "n_lines": lines,
    }


_TYPE = StructType([StructField(m, LongType()) for m in MEASURES])


def _measured(texts: pa.Array) -> pa.Array:
    parts = [measure(c) for c in chunks(texts)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[m] for p in parts]) if parts else [], pa.int64()) for m in MEASURES], list(MEASURES))


def measures(text: Column) -> Column:
    """A struct of the measures of each text."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield _measured(texts)

    return F.arrow_udf(run, _TYPE)(text)


def base_failed(m: Column | str = "_m", rules: Rules = Rules()) -> Column:
    at = F.col(m) if isinstance(m, str) else m
    return (at["n_words"] < rules.min_words) | (100 * at["n_repeat_words"] > rules.max_repeat * at["n_words"])


def own_failed(m: Column | str = "_m", rules: Rules = Rules()) -> Column:
    at = F.col(m) if isinstance(m, str) else m
    return (
        base_failed(at, rules)
        | (100 * at["n_symbols"] > rules.max_symbols * at["n_words"])
        | (100 * at["n_dup_lines"] > rules.max_dup_lines * at["n_lines"])
        | (at["word_chars"] > rules.max_word_chars * at["n_words"])
    )


def host_verdicts(failed: DataFrame, host: str, rules: Rules = Rules()) -> DataFrame:
    """host, docs, failures, host_rate (shrunk), host_rejected, from rows of (host, _failed).

    The prior's mean is the failure rate of all documents; its strength m(1-m)/v - 1
    has v, the variance of the hosts' rates weighted by size, less what sampling
    alone would give. Both are sums over hosts, in one aggregated row.
    """
    hosts = stored(failed.groupBy(host).agg(F.count("*").alias("docs"), F.sum(F.col("_failed").cast("long")).alias("failures")))
    p = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("docs").alias("n"),
        F.sum("failures").alias("k"),
        F.sum(F.col("failures").cast("double") * F.col("failures") / F.col("docs")).alias("sq"),
    ).first()
    n = max(p["n"] or 0, 1)
    mean = (p["k"] or 0) / n
    spread = mean * (1 - mean)
    var = (p["sq"] or 0.0) / n - mean * mean - spread * p["hosts"] / n
    strength = min(1e4, max(1.0, spread / var - 1)) if var > 0 else 1e4
    rate = (F.col("failures") + F.lit(mean * strength)) / (F.col("docs") + F.lit(strength))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > rules.max_host_rate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """id, the measures, base_failed, own_failed, host_rate and kept of every row. The measures are stored once, without the text."""
    m = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{host_col}`").alias("_host"), measures(F.col(f"`{text_col}`")).alias("_m"))
    m = stored(m.select(id_col, "_host", "_m.*", base_failed(rules=rules).alias("base_failed"), own_failed(rules=rules).alias("own_failed")))
    verdicts = host_verdicts(m.select("_host", F.col("own_failed").alias("_failed")), "_host", rules)
    out = spread_join(m, verdicts.select("_host", "host_rate", "host_rejected"), "_host", id_col)
    return out.withColumn("kept", ~F.col("own_failed") & ~F.col("host_rejected")).drop("_host", "host_rejected")


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows that are kept, with their own columns only, whatever their names.

    Texts are measured twice, for the hosts and for the rows. Rows that fail go
    before the join with the host verdicts; only if those are too many to be
    broadcast are the others dealt out, by host and salt.
    """
    text, host = F.col(f"`{text_col}`"), F.col(f"`{host_col}`")
    first = docs.select(host.alias("_host"), own_failed(measures(text), rules).alias("_failed"))
    verdicts = host_verdicts(first, "_host", rules).select("_host", "host_rejected")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own")
    rows = docs.select(own, host.alias("_host"), F.xxhash64(text).alias("_by"), measures(text).alias("_m")).filter(~own_failed("_m", rules)).drop("_m")
    return spread_join(rows, verdicts, "_host", "_by").filter(~F.col("host_rejected")).select("_own.*")
