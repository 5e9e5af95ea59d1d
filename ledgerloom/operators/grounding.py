"""Figures of answers held against the texts they were drawn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .relational import stored

SUPPORT = ("stated", "percent", "worked out", "unsupported")


def _figures(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(T.figures(F.col(text))).alias("f")).select(key, F.round(F.col("f.value"), 6).alias("value"), F.col("f.tolerance").alias("tolerance"), F.col("f.percent").alias("percent")).distinct()


def _near(claims: DataFrame, found: DataFrame, target: Column, key: str, width: float) -> DataFrame:
    """Claims (key, value, ..) that have a row of found (key, _v) with ``target`` = _v within the claim's tolerance.

    Equal widths cut the numbers into buckets at least as wide as any tolerance,
    so that a match is in the same bucket or one beside it: an equi-join.
    """
    at = claims.withColumn("_t", target).withColumn("_b", F.explode(F.sequence(F.floor((F.col("_t") - F.col("tolerance")) / width), F.floor((F.col("_t") + F.col("tolerance")) / width))))
    held = found.withColumn("_b", F.floor(F.col("_v") / width))
    return at.join(held, [key, "_b"]).filter(F.abs(F.col("_t") - F.col("_v")) <= F.col("tolerance") + 1e-9)


def supported(answers: DataFrame, sources: DataFrame, key: str = "answer", text: str = "text", source: str = "source", width: float = 1.0) -> DataFrame:
    """(key, figure, support) of every figure of the answers' texts.

    stated: a figure of the source within the tolerance of how the answer writes
    it. percent: written in percent, and a source figure is that share. worked
    out: the sum or the difference of two different source figures. For these,
    each claim is taken less, or added to, every figure of its own source, and
    the result is looked up among them in buckets: figures times claims of one
    answer, never pairs of figures. Sources of several rows are read together.
    """
    claims, known = _figures(answers, key, text), _figures(sources, key, source).select(key, F.col("value").alias("_v")).distinct()
    claims, known = stored(claims.withColumn("tolerance", F.least("tolerance", F.lit(width)))), stored(known)  # texts are read for figures once
    stated = _near(claims, known, F.col("value"), key, width).select(key, "value", F.lit("stated").alias("support"))
    share = _near(claims.filter("percent").withColumn("tolerance", F.col("tolerance") / 100), known, F.col("value") / 100, key, width / 100).select(key, "value", F.lit("percent").alias("support"))
    parts = claims.join(known.withColumnRenamed("_v", "_x"), key)
    second = known.select(key, "_v")
    total = _near(parts, second, F.col("value") - F.col("_x"), key, width).filter(F.col("_x") != F.col("_v"))
    less = _near(parts, second, F.col("value") + F.col("_x"), key, width).filter(F.col("_x") != F.col("_v"))
    worked = total.unionByName(less).select(key, "value", F.lit("worked out").alias("support"))
    best = stated.unionByName(share).unionByName(worked).groupBy(key, "value").agg(F.min(F.array_position(F.array(*[F.lit(s) for s in SUPPORT]), F.col("support"))).alias("_r"))
    out = claims.select(key, "value").distinct().join(best, [key, "value"], "left")
    return out.select(key, F.col("value").alias("figure"), F.element_at(F.array(*[F.lit(s) for s in SUPPORT]), F.coalesce("_r", F.lit(len(SUPPORT))).cast("int")).alias("support"))
