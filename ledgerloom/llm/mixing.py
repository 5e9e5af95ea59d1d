"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Every source has a target in words. Documents differ in how often they are
wanted: a document of n words has the weight n ** by_size, times its preference
where a column gives one, in steps of a quarter of a doubling. The expected
copies of a document are its weight times a level that meets the source's
target; none is above ``most``, and what that cuts off raises the level of the
others. The whole part of the expected copies is certain. The rest is a sample
without replacement: the fractional part is the inclusion probability, the rank
is the random odds U / (1 - U) divided by the inclusion odds, and documents are
taken in rank order while they fit the words that are left. One more document
of the source closes the gap: the one that fits it best. U is a hash of the id,
so reruns agree.

Ranks are found without sorting a source in one task: log ranks fall in bins of
1/64, then 1/65536; words are added up by source and bin; and only the bin in
which the words run out is ordered by rows. Totals by source and weight step
(129 steps at most) meet the documents in a join that spreads a large source.

Defined cases: a null source is one of its own, last in order; null and empty
texts have size 0 and are never taken; rows repeated exactly share their rank
and each counts; a null id has a rank like any value; a null or non-positive
preference is the least one; an empty table gives an empty table; other
columns pass through ``expand`` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import spread_join, stored

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """In (0, 1), from the first 48 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from rows of (source, source_size).

    Sources in order of code points, null last, take the weights in turn and
    share ``share`` times all words; none gets above ``most`` times its own, and
    what is above is shared again. In order of cap / weight, the first k
    sources are capped, for the least k at which the level (words left / weight
    left) of the others is under the next one's cap / weight. Windows run over
    one row for each source.
    """
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    caps = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after, every = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = caps.withColumn("_level", left / F.sum("_w").over(after)).withColumn("_open", F.col("_level") <= F.col("_cap") / F.col("_w"))
    final = level.withColumn("_final", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source", F.col("_level")))).over(every))
    return final.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_final")["_level"] * F.col("_w"), F.col("_cap"))).alias("target"))


def _run_out(bins: DataFrame, budget: DataFrame, bin_col: str) -> DataFrame:
    """Per source, the bin in which its words pass the budget, and the words before it."""
    w = W.partitionBy("source").orderBy(bin_col).rowsBetween(W.unboundedPreceding, 0)
    run = bins.join(budget, bins["source"].eqNullSafe(budget["_source"])).drop("_source").withColumn("_upto", F.col("_before") + F.sum("_words").over(w))
    first = run.filter(F.col("_upto") > F.col("_budget")).groupBy("source").agg(F.min(F.struct(bin_col, (F.col("_upto") - F.col("_words")).alias("_before"), "_budget")).alias("_at"))
    return first.select(F.col("source").alias("_source"), F.col("_at")[bin_col].alias(f"_last_{bin_col}"), F.col("_at")["_before"].alias("_before"), F.col("_at")["_budget"].alias("_budget"))


class Plan:
    """The decisions of a mix in two small stored tables.

    ``steps`` has per source and weight step its size, target, certain copies,
    inclusion probability and the last bin of ranks of its source; documents
    before that bin are sampled. ``exceptions`` has the (source, id, size)
    sampled from the last bin itself or to close the gap. Rows that agree in
    these three are taken alike.
    """

    def __init__(self, steps: DataFrame, exceptions: DataFrame):
        self.steps, self.exceptions = steps, exceptions

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows (with _id, source, size, _step) and source_size, target, copies."""
        picked = self.exceptions.select(F.col("source").alias("_xs"), F.col("_id").alias("_xi"), F.col("size").alias("_xn"), F.lit(True).alias("_picked"))
        at = ranked(rows, self.steps)
        at = at.join(picked, at["_id"].eqNullSafe(F.col("_xi")) & at["source"].eqNullSafe(F.col("_xs")) & (at["size"] == F.col("_xn")), "left")
        sampled = F.coalesce(F.col("_bin") < F.col("_last"), F.col("_chance") > 0) | F.coalesce(F.col("_picked"), F.lit(False))
        copies = F.when(F.col("size") > 0, F.col("_whole") + sampled.cast("long")).otherwise(F.lit(0)).cast("long")
        return at.withColumn("copies", copies).drop("_xs", "_xi", "_xn", "_picked", "_whole", "_chance", "_last", "_rank", "_bin", "_step")


def ranked(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows with what their source and weight step say, the log of the Pareto rank and its bin. Rows that can't be sampled rank last."""
    keyed = rows.withColumn("_at", F.struct("source", "_step"))
    told = spread_join(keyed, steps.withColumn("_at", F.struct("source", "_step")).drop("source", "_step"), "_at", "_id").drop("_at")
    chance = F.least(F.greatest(F.coalesce("_chance", F.lit(0.5)), F.lit(1e-9)), F.lit(1 - 1e-9))
    u = uniform(F.col("_id"))
    rank = F.log(u / (1 - u)) - F.log(chance / (1 - chance))
    return told.withColumn("_rank", F.when((F.col("size") > 0) & (F.col("_chance") > 0), rank).otherwise(F.lit(1e6))).withColumn("_bin", F.floor(F.col("_rank") * 65536))


#: Weights lie between 2 ** -16 and 2 ** 16, four steps for each doubling.
_REACH = 64


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, preference: str | None, by_size: float) -> list[Column]:
    size = n_words(F.col(f"`{text_col}`"))
    doublings = F.log2(F.greatest(size, F.lit(1))) * float(by_size)
    if preference:
        liking = F.col(f"`{preference}`").cast("double")
        doublings = doublings + F.when(liking > 0, F.log2(liking)).otherwise(F.lit(-1e3))
    step = F.greatest(F.lit(-_REACH), F.least(F.lit(_REACH), F.round(4 * doublings).cast("int")))
    return [F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), F.when(size > 0, step).otherwise(F.lit(0)).alias("_step")]


def levels(sizes: DataFrame, goal: DataFrame, most: float) -> DataFrame:
    """source, _step, source_size, target, _whole, _chance from rows of (source, _step, _words) and (source, source_size, target).

    In falling weight, the first k steps of a source are cut at ``most``, for
    the least k at which the level of the others (words left / weighted words
    left) leaves the next one at or under it.
    """
    g = goal.withColumnRenamed("source", "_s")
    w = F.pow(F.lit(2.0), F.col("_step") / 4)
    at = sizes.filter("_words > 0").join(g, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_w", w)
    falling = W.partitionBy("source").orderBy(F.desc("_step"))
    before, after = falling.rowsBetween(W.unboundedPreceding, -1), falling.rowsBetween(0, W.unboundedFollowing)
    left = F.col("target") - float(most) * F.coalesce(F.sum("_words").over(before), F.lit(0))
    at = at.withColumn("_level", left / F.sum(F.col("_words") * F.col("_w")).over(after)).withColumn("_free", F.col("_level") * F.col("_w") <= float(most) * (1 + 1e-12))
    first = F.max(F.when(F.col("_free"), F.struct("_step", "_level"))).over(W.partitionBy("source"))
    at = at.withColumn("_first", first)
    copies = F.when(F.col("_step") <= F.col("_first")["_step"], F.least(F.lit(float(most)), F.col("_first")["_level"] * F.col("_w"))).otherwise(F.lit(float(most)))
    whole = F.floor(copies + 1e-9)
    at = at.withColumn("_whole", whole.cast("long")).withColumn("_chance", F.greatest(F.lit(0.0), copies - whole))
    at = at.withColumn("_chance", F.when(F.col("_chance") < 1e-9, 0.0).otherwise(F.col("_chance")))
    return at.select("source", "_step", "source_size", "target", "_words", "_whole", "_chance")


def plan_mix(base: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> Plan:
    """base: stored rows of (_id, source, size, _step)."""
    sizes = stored(base.groupBy("source", "_step").agg(F.sum("size").alias("_words")))
    goal = stored(targets(sizes.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, most))
    plan = stored(levels(sizes, goal, most))
    left = plan.groupBy("source").agg((F.first("target") - F.sum(F.col("_whole") * F.col("_words"))).alias("_left"))
    left = stored(left.select("source", F.greatest(F.lit(0.0), "_left").alias("_budget")))

    rows = ranked(base, plan).filter("size > 0 and _chance > 0").select("source", "_id", "size", "_rank", "_bin")
    coarse = F.floor(F.col("_bin") / 1024)
    budget = left.select(F.col("source").alias("_source"), F.lit(0).cast("long").alias("_before"), "_budget")
    one = stored(_run_out(rows.groupBy("source", coarse.alias("_b1")).agg(F.sum("size").alias("_words")), budget, "_b1"))
    within = spread_join(rows, one.withColumnRenamed("_source", "source"), "source", "_id", how="inner").filter(coarse == F.col("_last__b1"))
    two = _run_out(within.groupBy("source", F.col("_bin").alias("_b2")).agg(F.sum("size").alias("_words")), one.select("_source", "_before", "_budget"), "_b2")
    two = stored(two.withColumnRenamed("_source", "source").withColumnRenamed("_last__b2", "_last"))

    at = spread_join(rows, two, "source", "_id", how="inner").filter("_bin >= _last")
    alike = at.groupBy("source", "_id", "size", "_rank", (F.col("_bin") == F.col("_last")).alias("_edge"), "_before", "_budget").agg((F.col("size") * F.count("*")).alias("_all"))
    ordered = W.partitionBy("source").orderBy("_rank", F.col("_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, 0)
    edge = stored(alike.filter("_edge").withColumn("_upto", F.col("_before") + F.sum("_all").over(ordered)).withColumn("_in", F.col("_upto") <= F.col("_budget")))
    spent = edge.groupBy("source").agg(F.first("_budget").alias("_of"), F.max(F.when(F.col("_in"), F.col("_upto")).otherwise(F.col("_before"))).alias("_spent"))
    gap = stored(spent.select("source", (F.col("_of") - F.col("_spent")).alias("_gap")))
    units = ["source", "_id", "size", "_rank", "_all"]
    free = alike.filter("not _edge").select(units).unionByName(edge.filter("not _in").select(units))
    free = spread_join(free, gap, "source", "_id", how="inner").withColumn("_miss", F.abs(F.col("_all") - F.col("_gap"))).filter("_miss < _gap")
    best = F.min(F.struct("_miss", "_rank", F.col("_id").isNull().alias("_none"), "_id", "size")).alias("_c")
    close = free.groupBy("source").agg(best).select("source", "_c._id", "_c.size")
    exceptions = stored(edge.filter("_in").select("source", "_id", "size").unionByName(close))
    every = sizes.select("source", "_step").join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    p = plan.select(F.col("source").alias("_s"), F.col("_step").alias("_t"), "_whole", "_chance")
    last = two.select(F.col("source").alias("_z"), "_last")
    steps = every.join(p, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_step") == F.col("_t")), "left").join(last, F.col("source").eqNullSafe(F.col("_z")), "left")
    steps = steps.select("source", "_step", "source_size", "target", F.coalesce("_whole", F.lit(0)).alias("_whole"), F.coalesce("_chance", F.lit(0.0)).alias("_chance"), "_last")
    return Plan(stored(steps), exceptions)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", preference: str | None = None, by_size: float = 0.25, **how) -> DataFrame:
    """id, source, size, source_size, target, copies and taken (words) of every row.

    preference: a column of positive relative weights within a source.
    """
    base = stored(docs.select(*_sized(docs, id_col, text_col, source_col, preference, by_size)))
    out = plan_mix(base, **how).apply(base).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(F.col("_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", "taken")


def expand(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", preference: str | None = None, by_size: float = 0.25, **how) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its own columns only. Texts stay where they are read."""
    columns = _sized(docs, id_col, text_col, source_col, preference, by_size)
    plan = plan_mix(stored(docs.select(*columns)), **how)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own")
    taken = plan.apply(docs.select(own, *columns)).filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_own.*")
