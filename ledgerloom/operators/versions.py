"""Line by line differences of two versions of many files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trimmed(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both versions (file, at, line), at counted from 0, without the lines that they begin and end with alike.

    Lines meet by place, from the start and from the end; the first place where
    they differ, or where one version has none, tells how many go. Where the two
    runs would overlap in the shorter version, the one at the start counts.
    """
    size = lambda v: v.groupBy("file").agg((F.max("at") + 1).alias("n"))
    sizes = size(old).withColumnRenamed("n", "n_old").join(size(new).withColumnRenamed("n", "n_new"), "file", "full").fillna(0)

    def back(v: DataFrame, n: str) -> DataFrame:
        return v.join(sizes, "file").withColumn("at", F.col(n) - 1 - F.col("at")).select("file", "at", "line")

    def alike(a: DataFrame, b: DataFrame) -> DataFrame:
        """(file, k): the first place at which the lines differ; none where they never do."""
        both = a.withColumnRenamed("line", "a").withColumn("has_a", F.lit(True)).join(b.withColumnRenamed("line", "b").withColumn("has_b", F.lit(True)), ["file", "at"], "full")
        return both.filter(F.col("has_a").isNull() | F.col("has_b").isNull() | ~F.col("a").eqNullSafe(F.col("b"))).groupBy("file").agg(F.min("at").alias("k"))

    starts, ends = alike(old, new).withColumnRenamed("k", "start"), alike(back(old, "n_old"), back(new, "n_new")).withColumnRenamed("k", "end")
    shorter = F.least("n_old", "n_new")
    cut = sizes.join(starts, "file", "left").join(ends, "file", "left").withColumn("start", F.coalesce("start", shorter)).withColumn("end", F.least(F.coalesce("end", shorter), shorter - F.col("start")))
    middle = lambda v, n: v.join(cut, "file").filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col(n) - F.col("end"))).select("file", (F.col("at") - F.col("start")).alias("at"), "line")
    return middle(old, "n_old"), middle(new, "n_new")


def line_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, at, change, line): lines removed and added between the versions (file, at, line).

    What both begin and end with is left out. Of a line that the rest of both has,
    as many go unmentioned as the other version has, the first ones. at counts from
    the first line that differs; a removed line stands before one added at its place.
    """
    a, b = trimmed(old, new)
    times = lambda v: v.groupBy("file", "line").agg(F.count("*").alias("_n"))

    def only(v: DataFrame, other: DataFrame, change: str) -> DataFrame:
        count = times(other).withColumnRenamed("line", "_l").withColumnRenamed("file", "_f")
        ranked = v.withColumn("_r", F.row_number().over(Window.partitionBy("file", "line").orderBy("at")))
        met = ranked.join(count, F.col("file").eqNullSafe(F.col("_f")) & F.col("line").eqNullSafe(F.col("_l")), "left")
        return met.filter(F.col("_r") > F.coalesce("_n", F.lit(0))).select("file", "at", F.lit(change).alias("change"), "line")

    return only(a, b, "Removed").unionByName(only(b, a, "Added"))
