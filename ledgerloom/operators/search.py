"""Search and ranking: keyword, TF-IDF and vector scores, and their fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product as double; null for vectors of different length."""
    sums = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), sums)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.nullif(norm, F.lit(0.0)))


def occurrences(text: Column, word: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))


def tf_idf(df: DataFrame, text: str, terms: Sequence[str]) -> DataFrame:
    """Adds ``score``: the sum over terms of (1 + ln tf) * ln(1 + N / df), by substring counts; rows without a hit are dropped.

    N and the document frequencies are one aggregated row, joined by broadcast.
    """
    low = F.lower(F.col(text))
    counted = df
    for i, w in enumerate(terms):
        counted = counted.withColumn(f"_tf{i}", occurrences(low, w.lower()))
    stats = counted.agg(F.count("*").alias("_n"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(terms))])
    parts = [F.when(F.col(f"_tf{i}") > 0, (1 + F.log(f"_tf{i}")) * F.log(1 + F.col("_n") / F.col(f"_df{i}"))).otherwise(0.0) for i in range(len(terms))]
    scored = counted.join(F.broadcast(stats)).withColumn("score", sum(parts, F.lit(0.0))).filter("score > 0")
    return scored.select(*df.columns, "score")


def vector_search(df: DataFrame, owner: str, vector: str, asked: Sequence[float], least: float = 0.6, margin: float = 0.08) -> DataFrame:
    """(owner, score): the best vector of each owner, kept if it is over ``least``, near the top and stands out from the rest."""
    q = F.array(*[F.lit(float(x)) for x in asked])
    best = df.select(owner, dot(F.col(vector), q).alias("score")).filter("score is not null").groupBy(owner).agg(F.max("score").alias("score"))
    stats = best.agg(F.avg("score").alias("_mean"), F.stddev_pop("score").alias("_std"), F.count("*").alias("_n"), F.max("score").alias("_top"))
    z = F.when(F.col("_std") > 0, (F.col("score") - F.col("_mean")) / F.col("_std"))
    out = z.isNull() | (z >= F.least(F.lit(2.5), 0.75 * F.sqrt(F.col("_n") - 1)))
    return best.join(F.broadcast(stats)).filter((F.col("score") >= least) & (F.col("score") >= F.col("_top") - margin) & out).select(owner, "score")


def text_hash(text: Column) -> Column:
    """What a vector is stored under, so that it is known to be of this very text."""
    return F.sha2(text.cast("binary"), 256)


def index_changes(texts: DataFrame, indexed: DataFrame) -> DataFrame:
    """(owner, key, state): what an index lacks, holds as it should, or holds too much, as ``todo``, ``current`` or ``stale``.

    texts (owner, key, text) are all parts of the owners asked about; null and
    blank texts have no part in an index. indexed (owner, key, hash) is the
    index; a part whose hash isn't that of its text is to do again, one that
    its owner no longer has is stale, and those of other owners are left alone.
    """
    parts = texts.filter("trim(text) <> ''").select("owner", "key", text_hash(F.col("text")).alias("_now"))
    held = indexed.join(texts.select("owner").distinct(), "owner", "left_semi").select("owner", "key", F.col("hash").alias("_was"))
    state = F.when(F.col("_now").isNull(), "stale").when(F.col("_now").eqNullSafe(F.col("_was")), "current").otherwise("todo")
    return parts.join(held, ["owner", "key"], "full").select("owner", "key", state.alias("state"))


def keyword_search(df: DataFrame, weighted: dict[str, int], terms: Sequence[str], head: Sequence[str], order: Sequence[Column], limit: int = 20) -> DataFrame:
    """Two stages: weighted containment of up to ten terms over fetches, then whole words in the head count 4 and elsewhere 1; whole-word hits push out the others."""
    terms = [t.lower() for t in terms[:10]]
    hits = sum((F.when(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t)), w).otherwise(0) for t in terms for c, w in weighted.items()), F.lit(0))
    first = df.withColumn("hits", hits).filter("hits > 0").orderBy(F.desc("hits"), *order).limit(max(4 * limit, 20))
    text = lambda cs: F.concat_ws(" ", *cs)
    rest = [c for c in weighted if c not in head]
    pattern = lambda t: rf"(?i)(?<![\w]){t}(s|es)?(?![\w])"
    whole = sum((F.when(text(head).rlike(pattern(t)), 4).when(text(rest).rlike(pattern(t)), 1).otherwise(0) for t in terms), F.lit(0))
    scored = first.withColumn("whole", whole).withColumn("_any", F.max("whole").over(Window.partitionBy()))
    return scored.filter("whole > 0 or _any = 0").orderBy(F.desc("whole"), F.desc("hits"), *order).limit(limit).drop("_any")


def fuse(words: DataFrame, meaning: DataFrame, key: str, limit: int) -> DataFrame:
    """One ranking of two, of (key, rank); words also tell in ``every`` whether a hit has every term.

    Words alone where some hit has every term and there are ``limit`` of them; else words first if some hit has every term, and meaning first if not.
    What both found counts with the words. ``source_rank`` is 0 for the ranking that comes first.
    """
    stats = words.agg(F.coalesce(F.max("every"), F.lit(False)).alias("_exact"), F.count("*").alias("_n"))
    own = words.select(key, F.lit(True).alias("_words"), "rank")
    both = own.unionByName(meaning.join(words, key, "left_anti").select(key, F.lit(False).alias("_words"), "rank")).join(F.broadcast(stats))
    kept = both.filter(F.col("_words") | ~F.col("_exact") | (F.col("_n") < limit))
    first = kept.select(key, (F.col("_words") != F.col("_exact")).cast("int").alias("source_rank"), "rank")
    return first.orderBy("source_rank", "rank", key).limit(limit)
