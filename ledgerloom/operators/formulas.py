"""Formulas of sheets: the cells that each depends on, ranges included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import any_of, stored

_SHEET = r"(?:(?:'((?:[^']|'')+)'|([A-Za-z_][A-Za-z0-9_.]*))!)?"
_CELL = r"\$?([A-Za-z]{1,3})\$?([0-9]{1,7})"
#: One cell or a range of cells, or whole columns or rows; a sheet may stand before.
REFERENCE = rf"(?<![A-Za-z0-9_.\]$'!]){_SHEET}(?:{_CELL}(?::{_CELL})?|\$?([A-Za-z]{{1,3}}):\$?([A-Za-z]{{1,3}})|\$?([0-9]{{1,7}}):\$?([0-9]{{1,7}}))(?![A-Za-z0-9_(!.])"
LAST_ROW, LAST_COLUMN = 1 << 20, 1 << 14
#: Rows that a range and a cell meet by.
_BAND = 1024


def column_number(letters: Column) -> Column:
    """A is 1, Z 26, AA 27."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)


def _short_number(letters: Column) -> Column:
    """The same for one to three capitals, without a loop."""
    at = lambda i: F.ascii(F.substring(letters, i, 1)) - 64
    return F.when(F.length(letters) == 1, at(1)).when(F.length(letters) == 2, at(1) * 26 + at(2)).otherwise((at(1) * 26 + at(2)) * 26 + at(3))


def column_letters(number: Column) -> Column:
    """The other way, up to three letters."""
    low, mid, high = (number - 1) % 26, F.floor((number - 27) / 26) % 26, F.floor((number - 703) / 676)
    letter = lambda n: F.char(n + 65)
    return F.concat(F.when(number > 702, letter(high)).otherwise(""), F.when(number > 26, letter(mid)).otherwise(""), letter(low))


def references(formulas: DataFrame, formula: str = "formula", sheet: str = "sheet") -> DataFrame:
    """The rows of formulas with, for each reference: p_sheet, row_from, row_to, col_from, col_to.

    Texts in quotes and references to other workbooks are left out; a name of a
    function such as LOG10 is no cell. Ends may stand in any order.
    """
    has = lambda c, *marks: any_of([F.contains(c, F.lit(m)) for m in marks])
    bare = formulas.filter(F.startswith(formula, F.lit("="))).withColumn("_b", F.when(has(formula, '"'), F.regexp_replace(formula, r'"(?:[^"]|"")*"', '""')).otherwise(F.col(formula)))
    others = F.regexp_replace("_b", r"'(?:[^']|'')*\[[^']*'!|\[[^\]]*\][A-Za-z0-9_.]*!", "#")
    bare = bare.withColumn("_b", F.when(has("_b", "[", "#"), F.regexp_replace(others, r"#\$?[A-Za-z]{1,3}\$?[0-9]{1,7}(?::\$?[A-Za-z]{1,3}\$?[0-9]{1,7})?", "")).otherwise(F.col("_b")))
    found = bare.withColumn("_r", F.explode(F.array_distinct(F.regexp_extract_all("_b", F.lit(REFERENCE), 0))))
    # what the pattern has found is taken apart without patterns
    found = found.withColumn("_a", F.substring_index("_r", "!", -1))
    found = found.withColumns({"_s": F.substring("_r", F.lit(1), F.length("_r") - F.length("_a") - 1), "_a": F.upper(F.replace("_a", F.lit("$"), F.lit("")))})
    found = found.withColumns({"_1": F.substring_index("_a", ":", 1), "_2": F.substring_index("_a", ":", -1)})
    found = found.withColumns({f"_{kind}{i}": trim(f"_{i}", F.lit(marks)) for i in (1, 2) for kind, trim, marks in [("c", F.rtrim, "0123456789"), ("r", F.ltrim, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")]})
    row = lambda c, none: F.when(F.col(c) == "", none).otherwise(F.col(c).cast("int"))
    col = lambda c, none: F.when(F.col(c) == "", none).otherwise(_short_number(F.col(c)))
    r1, r2, c1, c2 = row("_r1", 1), row("_r2", LAST_ROW), col("_c1", 1), col("_c2", LAST_COLUMN)
    quoted = F.replace(F.substring("_s", F.lit(2), F.length("_s") - 2), F.lit("''"), F.lit("'"))
    target = F.when(F.col("_s") == "", F.col(sheet)).when(F.startswith("_s", F.lit("'")), quoted).otherwise(F.col("_s"))
    return found.select(*formulas.columns, target.alias("p_sheet"), F.least(r1, r2).alias("row_from"), F.greatest(r1, r2).alias("row_to"), F.least(c1, c2).alias("col_from"), F.greatest(c1, c2).alias("col_to"))


def direct_precedents(cells: DataFrame) -> DataFrame:
    """(book, sheet, row, col, p_sheet, p_row, p_col): held cells that the formulas of (book, sheet, row, col, formula, ..) name.

    Ranges are cut to the rows that their sheet holds and dealt into bands of rows,
    so that ranges and cells meet in an equi-join; only cells there are count, as
    a range may be far larger than what it holds. Sheets match whatever their case.
    """
    used = cells.groupBy("book", F.lower("sheet").alias("_t")).agg(F.max("row").alias("_last"))
    asked = stored(references(cells.filter("formula is not null").select("book", "sheet", "row", "col", "formula")).drop("formula"))  # with the join, its code would be too long for the compiler
    asked = asked.withColumn("_t", F.lower("p_sheet")).join(used, ["book", "_t"]).withColumn("row_to", F.least("row_to", "_last")).filter("row_from <= row_to")
    asked = asked.withColumn("_band", F.explode(F.sequence(F.floor(F.col("row_from") / _BAND), F.floor(F.col("row_to") / _BAND))))
    held = cells.select("book", F.lower("sheet").alias("_t"), F.col("sheet").alias("_s"), F.col("row").alias("p_row"), F.col("col").alias("p_col"), F.floor(F.col("row") / _BAND).alias("_band"))
    inside = F.col("p_row").between(F.col("row_from"), F.col("row_to")) & F.col("p_col").between(F.col("col_from"), F.col("col_to"))
    met = asked.join(held, ["book", "_t", "_band"]).filter(inside)
    return met.select("book", "sheet", "row", "col", F.col("_s").alias("p_sheet"), "p_row", "p_col").distinct()


def precedents(cells: DataFrame, depth: int = 2) -> DataFrame:
    """Direct precedents and theirs, down to ``depth``, each with the least depth at which a cell depends on it. Circles end, as a cell keeps its least depth."""
    edges = stored(direct_precedents(stored(cells)))  # each is read several times below
    start = ["book", "sheet", "row", "col"]
    reached = edges.withColumn("depth", F.lit(1))
    level = reached
    for k in range(2, depth + 1):
        onward = edges.select("book", F.col("sheet").alias("p_sheet"), F.col("row").alias("p_row"), F.col("col").alias("p_col"), F.col("p_sheet").alias("_s"), F.col("p_row").alias("_r"), F.col("p_col").alias("_c"))
        level = level.join(onward, ["book", "p_sheet", "p_row", "p_col"]).select(*start, F.col("_s").alias("p_sheet"), F.col("_r").alias("p_row"), F.col("_c").alias("p_col")).distinct().withColumn("depth", F.lit(k))
        reached = reached.unionByName(level)
    return reached.groupBy(*start, "p_sheet", "p_row", "p_col").agg(F.min("depth").alias("depth"))
