"""Operators on figures of tables: discovery of identities and running balances, and subtotal checks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 0.015
WIDEST = 12
# Columns named so are results where an identity can be read both ways.
RESULT_WORDS = "total net ending end closing variance change difference balance".split()
RESULT = re.compile(rf"(?i)(?<![a-z])({'|'.join(RESULT_WORDS)})(?![a-z])")


def candidates(count: int) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
    """(target, signed terms) over column places: runs of 2 to 12 neighbours on either side, every sign pattern with a plus up to five terms, else plus only."""
    for target in range(count):
        for width in range(2, WIDEST + 1):
            for first in (target - width, target + 1):
                if first < 0 or first + width > count:
                    continue
                patterns = product((1, -1), repeat=width) if width <= 5 else [(1,) * width]
                yield from ((target, tuple(zip(signs, range(first, first + width)))) for signs in patterns if 1 in signs)


def identities(df: DataFrame, columns: Sequence[str], share: float = 0.9, least_rows: int = 3) -> list[tuple[str, str, float]]:
    """(target, formula, share of rows) of sums of neighbouring columns that hold on enough rows, one for each target.

    All candidates meet all rows: a batch of rows times a matrix of signs, in
    each task, and the counts are added up by candidate. A blank part adds
    nothing; rows without the target or without any part don't count. A sum
    that is a mere copy of one part on four rows in five is none.
    """
    found = list(candidates(len(columns)))
    signs = np.zeros((len(columns), len(found)))
    for i, (_, terms) in enumerate(found):
        for sign, at in terms:
            signs[at, i] = sign
    target = np.array([t for t, _ in found])
    tolerance = TOLERANCE * (np.abs(signs).sum(axis=0) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(found)), np.int64)
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            for part in np.array_split(x, len(x) // 1000 + 1):
                known, filled = ~np.isnan(part), np.nan_to_num(part)
                used = known[:, target] & ((known.astype(float) @ np.abs(signs)) > 0)
                held = used & (np.abs(filled @ signs - filled[:, target]) <= tolerance)
                copies = used & (((filled != 0).astype(float) @ np.abs(signs)) <= 1)
                total += np.stack([used.sum(axis=0), held.sum(axis=0), copies.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), *map(pa.array, total)], ["i", "used", "held", "copies"])

    counts = df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(count, "i bigint, used bigint, held bigint, copies bigint")
    sums = counts.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("used", "held", "copies")])
    good = sums.filter((F.col("used") >= least_rows) & (F.col("held") >= share * F.col("used")) & (F.col("copies") < 0.8 * F.col("used"))).collect()
    best = {}
    for r in sorted(good, key=lambda r: (r["held"] < r["used"], r["i"])):
        best.setdefault(found[r["i"]][0], (found[r["i"]][1], r["held"] / r["used"]))
    result = lambda at: (bool(RESULT.search(columns[at])), at)
    for at in sorted(best, key=result):
        if any(at in {p for _, p in best[other][0]} and result(at) < result(other) for _, other in best[at][0] if other in best):
            del best[at]
    return [(columns[at], " ".join(f"{'+' if s > 0 else '-'} {columns[p]}" for s, p in sorted(terms, key=lambda t: -t[0])).removeprefix("+ "), held) for at, (terms, held) in sorted(best.items())]


def running_balance(df: DataFrame, balance: str, steps: Sequence[tuple[int, str]], order: Sequence[str], by: Sequence[str] = (), share: float = 0.9, least: int = 3) -> bool:
    """Whether each row's balance is the one before plus the signed columns, on enough of the rows that moved."""
    was = F.lag(balance).over(Window.partitionBy(*by).orderBy(*order))
    move = sum((sign * F.coalesce(F.col(c), F.lit(0.0)) for sign, c in steps), F.lit(0.0))
    at = df.select(F.col(balance).alias("b"), was.alias("was"), move.alias("m")).filter("was is not null")
    row = at.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("b") - F.col("was") - F.col("m")) <= TOLERANCE * (len(steps) + 1)).alias("h"), F.count_if(F.col("m") != 0).alias("moved")).first()
    return row["n"] >= least and row["h"] >= share * row["n"] and row["moved"] >= 0.5 * row["n"]


def subtotals(df: DataFrame, figure: str, is_total: Column, order: Sequence[str], by: Sequence[str] = (), places: int = 2) -> DataFrame:
    """Each printed total with ``holds``: it equals the sum of its group, of all rows so far, or of all totals so far.

    A group ends at its total. The tolerance is half a unit in the last place for each part and the total.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("_t", is_total).withColumn("_g", F.coalesce(F.sum(F.col("_t").cast("int")).over(before), F.lit(0)))
    body = F.when(~F.col("_t"), F.col(figure)).otherwise(0.0)
    group = Window.partitionBy(*by, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = marked.select(
        "*",
        F.sum(body).over(group).alias("_group"),
        F.sum(F.when(~F.col("_t"), 1).otherwise(0)).over(group).alias("_parts"),
        F.sum(body).over(upto).alias("_all"),
        F.sum(F.when(~F.col("_t"), 1).otherwise(0)).over(upto).alias("_n"),
        F.coalesce(F.sum(F.when(F.col("_t"), F.col(figure)).otherwise(0.0)).over(before), F.lit(0.0)).alias("_totals"),
    )
    near = lambda c, n: F.abs(F.col(figure) - F.col(c)) <= 0.5 * 10.0**-places * (n + 1) + 1e-9
    holds = (near("_group", F.col("_parts")) & (F.col("_parts") > 0)) | near("_all", F.col("_n")) | near("_totals", F.col("_n"))
    return sums.filter("_t").select(*df.columns, holds.alias("holds"))
