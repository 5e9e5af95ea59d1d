"""What is written: upserted tables, exports, digests and quarantined rows. Every sink can be run again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_safe
from ..operators.relational import upsert


def upsert_table(new: DataFrame, path: str, version: int, keys: Sequence[str], keep: Sequence[str] = ()) -> str:
    """Writes the next version of a table: what the last one holds, new rows in place of those with their key. Returns its path.

    A version is a folder of its own, so that readers of the last one go on and a run that fails leaves it as it was.
    """
    spark = new.sparkSession
    merged = upsert(spark.read.parquet(f"{path}/v{version}"), new, keys, keep) if version >= 0 else new
    merged.write.mode("overwrite").parquet(f"{path}/v{version + 1}")
    return f"{path}/v{version + 1}"


def replace_children(stored: DataFrame, new: DataFrame, parent: str, finished: str) -> DataFrame:
    """Children of the parents in ``new`` are replaced; those marked finished stay."""
    own = new.select(F.col(parent).alias("_p")).distinct()
    kept = stored.join(own, stored[parent] == own["_p"], "left").filter(F.col("_p").isNull() | F.expr(finished)).select(*stored.columns)
    return kept.unionByName(new)


def export_csv(df: DataFrame, path: str) -> None:
    """A CSV export whose text cells a spreadsheet won't run."""
    guarded = [csv_safe(F.col(f"`{c}`")).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes]
    df.select(*guarded).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_digest(measures: DataFrame, path: str, day: str = "day") -> None:
    """A digest for each day: its measures as parquet by day, and a markdown text built by the same job. A day written again replaces its own."""
    lines = [F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in measures.columns if c != day]
    text = F.concat_ws("\n", F.concat(F.lit("# Digest of "), F.col(day).cast("string")), *lines)
    out = measures.withColumn("markdown", text)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def write_files(df: DataFrame, path: str, name: str, content: str) -> None:
    """Texts as files of one folder for each name."""
    df.select(F.col(name).alias("name"), F.col(content).alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def quarantine(rows: DataFrame, path: str, reason: str = "_corrupt") -> DataFrame:
    """Rows that could not be read go to their own table with when and why; the others are returned."""
    rows.filter(F.col(reason).isNotNull()).withColumn("quarantined_at", F.current_timestamp()).write.mode("append").parquet(path)
    return rows.filter(F.col(reason).isNull()).drop(reason)
