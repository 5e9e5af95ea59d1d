"""Questions over one table: naming rows, limits, pairs of columns, changes, totals by arithmetic, families of tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .relational import prefix_pairs


def row_score(cells: Sequence[Column], asked: Sequence[str], is_total: Column) -> Column:
    """How much a question's words name a row: 1 for each word of its cells, 2 for figures and dates; total rows half a point less unless asked for."""
    own = F.array_distinct(F.flatten(F.array(*[T.tokens(F.coalesce(c, F.lit(""))) for c in cells])))
    score = F.lit(0.0)
    for word in dict.fromkeys(w.lower() for w in asked):
        score = score + F.when(F.array_contains(own, word), 2.0 if re.search(r"\d", word) else 1.0).otherwise(0.0)
    fine = F.lit(any(w.lower().startswith("total") for w in asked))
    return F.when(is_total & (score > 0) & ~fine, score - 0.5).otherwise(score)


def best_rows(df: DataFrame, score: Column) -> DataFrame:
    """The rows with the highest score above 0; the highest is one aggregated row, joined by broadcast."""
    scored = df.withColumn("score", score).filter("score > 0")
    top = scored.agg(F.max("score").alias("_top"))
    return scored.join(F.broadcast(top), F.col("score") == F.col("_top")).drop("_top")


def by_column(df: DataFrame, words: dict[str, str]) -> DataFrame:
    """Rows whose column has the word given for it, as a whole word."""
    for column, word in words.items():
        df = df.filter(F.array_contains(T.tokens(F.col(column)), word.lower()))
    return df


def limit(figure: Column, op: str, said: str) -> Column:
    """A limit as written, '> 5%' or 'over 1.2k': null figures fail; shares below one are read as percent where the limit is in percent and the cell isn't."""
    bound = T.scaled_number(F.lit(said.replace("%", "").strip()))
    value = F.when(F.lit("%" in said) & (F.abs(figure) <= 1), F.round(figure * 100, 9)).otherwise(figure)
    test = {">": value > bound, ">=": value >= bound, "<": value < bound, "<=": value <= bound, "=": value == bound}[op]
    return F.coalesce(test, F.lit(False))


def date_limit(day: Column, op: str, low: str, high: str | None = None) -> Column:
    """before, after, from, until, in, between a written date; partial dates are the days they cover; null days fail."""
    a, z = T.date_span(F.lit(low)), T.date_span(F.lit(high or low))
    test = {"before": day < a["low"], "after": day > z["high"], "from": day >= a["low"], "until": day <= z["high"], "in": day.between(a["low"], z["high"]), "between": day.between(a["low"], z["high"])}[op]
    return F.coalesce(test, F.lit(False))


def group_totals(df: DataFrame, group: str, figure: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sum, average and count by group, a blank group label taking the one above it; empty with fewer than two groups or one row in each."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = df.withColumn(group, F.last(F.nullif(F.trim(group), F.lit("")), ignorenulls=True).over(w))
    sums = filled.groupBy(group).agg(F.round(F.sum(figure), 2).alias("total"), F.round(F.avg(figure), 4).alias("average"), F.count("*").alias("n"))
    fine = sums.agg(((F.count("*") >= 2) & (F.max("n") > 1)).alias("_fine"))
    return sums.join(F.broadcast(fine)).filter("_fine").drop("_fine")


def difference(df: DataFrame, label: str, first: str, second: str, figure: str) -> Column:
    """The figure of the rows named first less that of those named second, as one row."""
    at = lambda name: F.sum(F.when(F.col(label) == name, F.col(figure)))
    return df.agg((at(first) - at(second)).alias("difference"))


def change(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Per row, the change from the first to the last of the columns, and its percent of the first."""
    a, z = F.col(columns[0]), F.col(columns[-1])
    return df.select(label, F.round(z - a, 2).alias("change"), F.round(F.try_divide(100 * (z - a), F.abs(a)), 2).alias("percent"))


def budget_pair(columns: Sequence[str]) -> tuple[str, str] | None:
    """The actual and budget columns whose headings agree but for these words; else the first actual and the last budget."""
    words = lambda c: set(re.findall(r"[a-z0-9]+", c.lower()))
    budgets = [c for c in columns if "budget" in words(c)]
    actuals = [c for c in columns if words(c) & {"actual", "forecast", "spent", "spend"}]
    for a in sorted(actuals, key=lambda c: "actual" not in words(c)):
        for b in budgets:
            if words(a) - {"actual", "forecast", "spent", "spend"} == words(b) - {"budget"}:
                return a, b
    return (actuals[0], budgets[-1]) if actuals and budgets else None


def over_under(df: DataFrame, way: str) -> DataFrame:
    """Rows over or under their budget, by the pair of columns found."""
    actual, budget = budget_pair(df.columns)
    a, b = F.col(f"`{actual}`"), F.col(f"`{budget}`")
    return df.filter(a > b if way == "over" else a < b).withColumn("gap", F.round(a - b, 2))


def settle_totals(df: DataFrame, label: str, figures: Sequence[str], order: Sequence[str], by: Sequence[str] = (), places: int = 2) -> DataFrame:
    """Rows with ``is_total``: labelled as one, or without a label and with every figure adding up the rows since the last total, or all rows, above it.

    Labels decide first; unlabelled rows are then told by sums over the rows
    above, in windows by table. Two ordinary rows must stand above.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    said = F.coalesce(T.is_total_label(F.col(label)), F.lit(False))
    at = df.withColumn("_said", said).withColumn("_g", F.coalesce(F.sum(F.col("_said").cast("int")).over(before), F.lit(0)))
    inside = Window.partitionBy(*by, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    body = ~F.col("_said")
    n, n_all = F.coalesce(F.sum(body.cast("int")).over(inside), F.lit(0)), F.coalesce(F.sum(body.cast("int")).over(before), F.lit(0))
    near = lambda v, s, k: F.coalesce(F.abs(v - s) <= 0.5 * 10.0**-places * (k + 1) + 1e-9, F.lit(False))
    sums = lambda f, over: F.sum(F.when(body, F.col(f))).over(over)
    group = [near(F.col(f), sums(f, inside), n) for f in figures]
    whole = [near(F.col(f), sums(f, before), n_all) for f in figures]
    some = [F.coalesce(F.col(f), F.lit(0.0)) != 0 for f in figures]
    every = lambda tests: F.forall(F.array(*tests), lambda x: x)
    bare = F.trim(F.coalesce(F.col(label), F.lit(""))) == ""
    told = bare & F.exists(F.array(*some), lambda x: x) & (((n >= 2) & every(group)) | ((n_all >= 2) & every(whole)))
    return at.withColumn("is_total", F.col("_said") | F.coalesce(told, F.lit(False))).drop("_said", "_g")


def profile(df: DataFrame, text_columns: Sequence[str], figure_columns: Sequence[str], samples: int = 3) -> DataFrame:
    """A row for each column: filled cells, figures below zero, its style, and the first samples in order.

    Figures are counted in one pass. Texts are made distinct by value before
    the first of each column are ranked, so no task holds a column's values.
    """
    parts = []
    for c in figure_columns:
        whole = F.count_if(F.col(c) == F.floor(c)) == F.count(c)
        style = F.when(F.max(F.abs(c)) <= 1, "share").when(whole, "whole").otherwise("decimal")
        parts.append(F.struct(F.lit(c).alias("column"), F.count(c).alias("filled"), F.count_if(F.col(c) < 0).alias("below_zero"), style.alias("style"), F.array().cast("array<string>").alias("samples")))
    for c in text_columns:
        parts.append(F.struct(F.lit(c).alias("column"), F.count(c).alias("filled"), F.lit(0).cast("long").alias("below_zero"), F.lit("text").alias("style"), F.lit(None).cast("array<string>").alias("samples")))
    counted = df.agg(F.explode(F.array(*parts)).alias("p")).select("p.*")
    if not text_columns:
        return counted
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in text_columns])
    values = df.select(F.explode(cells).alias("x")).select("x.*").filter("v <> ''").distinct()
    first = values.withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy("v"))).filter(F.col("_r") <= samples)
    kept = first.groupBy("column").agg(F.array_sort(F.collect_list("v")).alias("kept"))
    out = counted.join(kept, "column", "left").withColumn("samples", F.coalesce("samples", "kept", F.array().cast("array<string>")))
    return out.select(*counted.columns)


def families(cells: DataFrame, share: float = 0.4, least_months: int = 3) -> DataFrame:
    """(a, b, jaccard): pairs of tables with at least so many month columns in common whose text values agree by Jaccard similarity.

    cells: (sheet, month, value), one row for each text value and month column of a table.
    Tables meet by their rarest values only, one of which two tables so alike
    share; months and all values are then counted for the pairs that met.
    """
    months, values = cells.select("sheet", "month").distinct(), cells.select("sheet", "value").distinct()
    met = prefix_pairs(values, "sheet", "value", share)

    def shared(pairs: DataFrame, x: DataFrame, c: str) -> DataFrame:
        a, b = x.select(F.col("sheet").alias("a"), c), x.select(F.col("sheet").alias("b"), c)
        return pairs.join(a, "a").join(b, ["b", c]).groupBy("a", "b").agg(F.count("*").alias(f"_{c}"))

    sizes = values.groupBy("sheet").agg(F.count("*").alias("n"))
    long = shared(met, months, "month").filter(F.col("_month") >= least_months).select("a", "b")
    both = shared(long, values, "value").join(sizes.select(F.col("sheet").alias("a"), F.col("n").alias("_n")), "a").join(sizes.select(F.col("sheet").alias("b"), F.col("n").alias("_m")), "b")
    jaccard = F.col("_value") / (F.col("_n") + F.col("_m") - F.col("_value"))
    return both.filter(jaccard >= share).select("a", "b", F.round(jaccard, 6).alias("jaccard"))


def cautious_total(df: DataFrame, table: str, figure: str, read: int, available: DataFrame) -> DataFrame:
    """(table, total, left_out, exact): totals over the rows read of each table; one cut at the limit says how many it left out and isn't exact."""
    w = Window.partitionBy(table).orderBy("at")
    taken = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= read)
    sums = taken.groupBy(table).agg(F.round(F.sum(figure), 2).alias("total"), F.count("*").alias("_n"))
    left = F.col("rows") - F.col("_n")
    return sums.join(available, table).select(table, "total", left.alias("left_out"), (left == 0).alias("exact"))


def table_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table, row, label, value) of runs of ``Label: value | Label: value`` lines with the same labels.

    A new run begins at a heading, a blank line, or other labels; shorter rows
    whose labels begin those of the row before belong to it, padded with nulls.
    """
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    cells = F.filter(F.split("line", r"\s*\|\s*"), lambda c: c.rlike(r"^[^:|]{1,60}:\s?\S"))
    rows = lines.withColumn("_c", F.when(F.col("line").contains("|"), cells).otherwise(F.array().cast("array<string>")))
    label = lambda c: F.trim(F.substring_index(c, ":", 1))
    rows = rows.withColumn("_l", F.array_join(F.transform("_c", label), "|"))
    w = Window.partitionBy(key).orderBy("at")
    before = F.lag("_l").over(w)
    begins = (F.col("_l") != "") & ~F.coalesce((before != "") & (F.startswith(before, F.col("_l")) | F.startswith(F.col("_l"), before)), F.lit(False))
    rows = rows.withColumn("table", F.sum(begins.cast("int")).over(w)).filter("_l <> ''")
    full = F.max_by("_l", F.length("_l")).over(Window.partitionBy(key, "table"))
    out = rows.withColumn("_full", F.split(full, r"\|")).withColumn("row", F.row_number().over(Window.partitionBy(key, "table").orderBy("at")))
    each = out.select(key, "table", "row", "_c", F.posexplode("_full").alias("i", "label"))
    return each.select(key, "table", "row", "label", F.trim(F.regexp_replace(F.get("_c", F.col("i")), r"^[^:]*:", "")).alias("value"))


def facts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, value) of ``Name: value`` lines that belong to no table line."""
    lines = texts.select(key, F.explode(F.split(text, "\n")).alias("line")).filter(~F.col("line").contains("|"))
    return lines.filter(F.col("line").rlike(r"^[A-Z][^:]{0,40}:\s*\S")).select(key, F.trim(F.substring_index("line", ":", 1)).alias("name"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))


def cell_range(cells: DataFrame, span: str) -> DataFrame:
    """The cells (row, col, value) of a range such as B2:D20."""
    a, r, b, z = re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", span).groups()

    def number(letters: str) -> int:
        n = 0
        for x in letters:
            n = 26 * n + ord(x) - 64
        return n

    return cells.filter(F.col("row").between(int(r), int(z)) & F.col("col").between(number(a), number(b)))


def closed_sections(df: DataFrame, section: str, is_total: Column, order: Sequence[str]) -> DataFrame:
    """Rows with ``after_total``: whether their section was closed by its own total above them."""
    w = Window.partitionBy(section).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("after_total", F.coalesce(F.max(is_total.cast("int")).over(w), F.lit(0)) == 1)


def key_column(df: DataFrame, columns: Sequence[str], share: float = 0.9) -> str | None:
    """The first text column whose values are distinct on enough rows, told by one aggregate."""
    row = df.agg(F.count("*").alias("_n"), *[F.approx_count_distinct(c, 0.01).alias(c) for c in columns]).first()
    return next((c for c in columns if row["_n"] and row[c] >= share * row["_n"]), None)
