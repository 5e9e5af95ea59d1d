"""Delimited files, HTML tables and drop folders, read by Spark jobs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def separator(spark: SparkSession, path: str, lines: int = 50) -> str:
    """The separator that occurs equally often, and most, on the first lines."""
    sample = [r[0] for r in spark.read.text(path).limit(lines).collect() if r[0].strip()]

    def rank(mark: str) -> tuple[int, int]:
        count = Counter(line.count(mark) for line in sample)
        times, rows = max(count.items(), key=lambda p: (p[1], p[0]), default=(0, 0))
        return (rows if times else 0, times)

    return max(",;\t|", key=rank)


def stray_quotes(line: Column, mark: str) -> Column:
    """Whether a line has a quote inside an unquoted field, or one too many: such lines are read without quoting."""
    at = f"\\Q{mark}\\E"
    return F.regexp_replace(line, f'(?<=^|{at})\\s*"(?:[^"]|"")*"\\s*(?={at}|$)', "").contains('"')


def delimited(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A delimited file with its separator found on a sample, rows that don't fit in ``_corrupt``, lines with stray quotes taken literally."""
    mark = separator(spark, path)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    repaired = F.when(stray_quotes(F.col("value"), mark), F.regexp_replace("value", '"', "")).otherwise(F.col("value"))
    options = {"sep": mark, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    full = f"{schema}, _corrupt string"
    rows = lines.select(F.from_csv(repaired, full, options).alias("r"), "value")
    if header:
        first = spark.read.text(path).limit(1).first()
        rows = rows.filter(F.col("value") != (first[0] if first else ""))
    return rows.select("r.*")


class _Cells(HTMLParser):
    """The cells of a page's tables as pages have them: cells, rows and tables may be left open, and tables may stand in cells."""

    def __init__(self):
        super().__init__()
        self.out, self.count, self.open = [], 0, []  # open: of each table not yet closed, its number, row, column, cell

    def _end_cell(self):
        at = self.open[-1]
        if at["text"] is not None:
            self.out.append((at["table"], at["row"], at["col"], at["rows"], at["cols"], " ".join("".join(at["text"]).split())))
            at["col"], at["text"] = at["col"] + at["cols"], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"table": self.count, "row": -1, "col": 0, "rows": 1, "cols": 1, "text": None})
            self.count += 1
        elif self.open and tag in ("tr", "td", "th"):
            self._end_cell()
            at = self.open[-1]
            if tag == "tr" or at["row"] < 0:
                at["row"], at["col"] = at["row"] + 1, 0
            if tag != "tr":
                span = {k: int(v) for k, v in attrs if k in ("rowspan", "colspan") and v and v.strip().isdecimal() and len(v) < 5}
                at["text"], at["rows"], at["cols"] = [], max(1, span.get("rowspan", 1)), max(1, min(1000, span.get("colspan", 1)))
        elif tag in ("br", "p", "div", "li"):
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr", "table"):
            self._end_cell()
            if tag == "table":
                self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1]["text"] is not None:
            self.open[-1]["text"].append(data)

    def close(self):
        super().close()
        while self.open:
            self._end_cell()
            self.open.pop()


def html_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, col, rowspan, colspan, text) of every table cell of pages, by Arrow batches.

    A cell ends where the next cell, row or table's end begins, if it isn't closed.
    A table inside a cell is a table of its own; columns count what cells before
    in the row span.
    """
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = _Cells()
                reader.feed(page or "")
                reader.close()
                out += [(k, *cell) for cell in reader.out]
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *[pa.array(c, pa.int32()) for c in columns[1:6]], pa.array(columns[6], pa.string())], ["key", "table", "row", "col", "rowspan", "colspan", "text"])

    return pages.select(key, html).mapInArrow(run, f"key {kind}, table int, row int, col int, rowspan int, colspan int, text string").withColumnRenamed("key", key)


def batches(files: DataFrame) -> DataFrame:
    """(folder, batch, main, sidecars) of a drop folder's files (path, modificationTime, length): files of one folder and stem belong together, the largest is the main one."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(\.meta)?\.[A-Za-z0-9]+$", "")
    folder = F.regexp_replace(F.col("path"), "/?[^/]*$", "")
    groups = files.groupBy(folder.alias("folder"), stem.alias("batch")).agg(F.max(F.struct("length", "path")).alias("m"), F.array_sort(F.collect_list("path")).alias("all"))
    return groups.select("folder", "batch", F.col("m.path").alias("main"), F.array_except("all", F.array("m.path")).alias("sidecars"))


def drop_folder(spark: SparkSession, path: str, settled_before: str | None = None, stream: bool = False, files_per_trigger: int = 100) -> DataFrame:
    """The files of a folder as binary rows; those changed after ``settled_before`` may still be copied and are left for later."""
    reader = spark.readStream if stream else spark.read
    reader = reader.format("binaryFile").option("recursiveFileLookup", "true")
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_trigger)
    elif settled_before:
        reader = reader.option("modifiedBefore", settled_before)
    return reader.load(path)
