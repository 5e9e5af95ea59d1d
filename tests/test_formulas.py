import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import formulas as X


@pytest.mark.parametrize(
    "formula, want",
    [
        ("=SUM(B2:D9)", {("S", 2, 9, 2, 4)}),
        ("=$B$2 + c3*A10", {("S", 2, 2, 2, 2), ("S", 3, 3, 3, 3), ("S", 10, 10, 1, 1)}),
        ("=D9:B2", {("S", 2, 9, 2, 4)}),
        ("='P & L''s 2026'!AA1 - Data!XFD1048576", {("P & L's 2026", 1, 1, 27, 27), ("Data", 1 << 20, 1 << 20, 1 << 14, 1 << 14)}),
        ("=LOG10(A1) & \"see B2, 'C3'!D4\" & SHEET1(2)", {("S", 1, 1, 1, 1)}),
        ("='[old.xlsx]Sheet'!A1 + [2]Other!B2:B9 + C1", {("S", 1, 1, 3, 3)}),
        ("=SUM(A:B) + SUM(3:4)", {("S", 1, 1 << 20, 1, 2), ("S", 3, 4, 1, 1 << 14)}),
        ("=Taxes2026 + rate_A1 + A1B2 + 1E5 + 12", set()),
        ("A1+B2", set()),
    ],
)
def test_references(spark, formula, want):
    got = X.references(spark.createDataFrame([("S", formula)], "sheet string, formula string")).drop("sheet", "formula")
    assert {tuple(r) for r in got.collect()} == want


def test_letters_and_numbers(spark):
    got = spark.range(1, 16385).select("id", X.column_letters(F.col("id")).alias("l")).withColumn("n", X.column_number(F.col("l")))
    assert got.filter("id <> n").count() == 0
    assert [r["l"] for r in got.filter("id in (1, 26, 27, 702, 703, 16384)").orderBy("id").collect()] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]


def test_precedents_of_ranges_sheets_and_circles(spark):
    rows = [(1, "Main", 1, 1, "=SUM(B1:C5000) + Other!A1"), (1, "Main", 2, 2, "=other!a2"), (1, "Main", 3000, 3, None), (1, "Main", 9, 4, None), (1, "Other", 1, 1, "=Main!A1"), (1, "Other", 2, 1, "=Missing!A1 + A2"), (2, "Main", 3000, 3, "=A1"), (2, "Main", 1, 1, None)]
    frame = spark.createDataFrame(rows, "book int, sheet string, row int, col int, formula string")
    at = lambda depth: {(r["book"], r["sheet"], r["row"], r["p_sheet"], r["p_row"], r["depth"]) for r in X.precedents(frame, depth).collect()}
    one = {(1, "Main", 1, "Main", 2, 1), (1, "Main", 1, "Main", 3000, 1), (1, "Main", 1, "Other", 1, 1), (1, "Main", 2, "Other", 2, 1), (1, "Other", 1, "Main", 1, 1), (1, "Other", 2, "Other", 2, 1), (2, "Main", 3000, "Main", 1, 1)}
    two = {(1, "Main", 1, "Other", 2, 2), (1, "Main", 1, "Main", 1, 2), (1, "Other", 1, "Main", 2, 2), (1, "Other", 1, "Main", 3000, 2), (1, "Other", 1, "Other", 1, 2)}
    assert at(1) == one and at(2) == one | two
    assert {x for x in at(6) if x[1] == "Other" and x[2] == 1 and x[5] > 2} == {(1, "Other", 1, "Other", 2, 3)}
