"""Reusable relational operators over DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def all_of(conditions: Sequence[Column | None]) -> Column:
    """The conjunction of the conditions that are set; true without any."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def words_in_places(words: Sequence[str], places: Sequence[Column], most: int = 8) -> Column:
    """Every word (up to ``most``) occurs in some place, whatever its case; % and _ are ordinary characters."""
    return all_of([any_of([F.contains(F.lower(F.coalesce(p, F.lit(""))), F.lit(w.lower())) for p in places]) for w in list(words)[:most]])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def ranked_value(col: Column, values: Sequence[str]) -> Column:
    """The place of an enumerated value; others come last."""
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(col == v, i).otherwise(out)
    return out


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """New rows replace stored ones of the same key; the columns in ``keep`` stay as stored where the key was known."""
    old = stored.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_o_{c}") for c in keep], F.lit(True).alias("_known"))
    on = all_of([new[k].eqNullSafe(old[f"_k_{k}"]) for k in keys])
    merged = new.join(old, on, "left").select(*[F.when(F.col("_known"), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in new.columns])
    gone = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys])
    rest = stored.join(gone, all_of([stored[k].eqNullSafe(gone[f"_n_{k}"]) for k in keys]), "left_anti")
    return rest.unionByName(merged, allowMissingColumns=True)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key and change: added, removed or changed."""
    b = before.select(F.col(key).alias("_b"), F.struct(*columns).alias("_bv"))
    a = after.select(F.col(key).alias("_a"), F.struct(*columns).alias("_av"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_bv").eqNullSafe(F.col("_av")), "changed")
    return b.join(a, F.col("_b") == F.col("_a"), "full").select(F.coalesce("_a", "_b").alias(key), change.alias("change")).filter("change is not null")


def synced(before: DataFrame, after: DataFrame, key: str, place: str, columns: Sequence[str]) -> DataFrame:
    """key and kind of what a sync finds: new, removed, moved (another place), or updated."""
    b = before.select(F.col(key).alias("_b"), F.col(place).alias("_bp"), F.struct(*columns).alias("_bv"))
    a = after.select(F.col(key).alias("_a"), F.col(place).alias("_ap"), F.struct(*columns).alias("_av"))
    kind = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "removed").when(~F.col("_bp").eqNullSafe(F.col("_ap")), "moved").when(~F.col("_bv").eqNullSafe(F.col("_av")), "updated")
    return b.join(a, F.col("_b") == F.col("_a"), "full").select(F.coalesce("_a", "_b").alias(key), kind.alias("kind")).filter("kind is not null")


def overlaps(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], equal: Sequence[tuple[str, str]] = (), bucket_seconds: int = 86400) -> DataFrame:
    """Pairs of rows whose half-open spans of timestamps overlap.

    Both sides are dealt into buckets of time, so that the join is an equi-join;
    of a pair that meets in several buckets only the first counts.
    """

    def dealt(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        a, z = (F.floor(F.unix_timestamp(F.col(c)) / bucket_seconds) for c in span)
        return df.withColumn(name, F.explode(F.sequence(a, F.greatest(a, z))))

    x, y = dealt(left, left_span, "_lb"), dealt(right, right_span, "_rb")
    starts = F.greatest(F.col(left_span[0]), F.col(right_span[0]))
    first = F.floor(F.unix_timestamp(starts) / bucket_seconds)
    on = [F.col("_lb") == F.col("_rb"), *[F.col(a) == F.col(b) for a, b in equal]]
    inside = (F.col(left_span[0]) < F.col(right_span[1])) & (F.col(left_span[1]) > F.col(right_span[0]))
    return x.join(y, all_of(on)).filter(inside & (F.col("_lb") == first)).drop("_lb", "_rb")


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that all executors reach; on one machine a temporary one where none is set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        top = tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{top.rstrip('/')}/ledgerloom/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read again, which cuts its lineage and tells the planner its size."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task puts in order, groups and joins at most, as long as no key has more.
PART_ROWS = 250_000


def dealt(table: DataFrame, *keys: str, share: int = 1) -> DataFrame:
    """A stored table dealt by keys into parts that grow in number, not in size, with its rows (a footer tells these); ``share`` makes parts so many times smaller.

    Windows, groups and joins by these keys stay on the parts, so that the memory of a task stays the same.
    """
    least = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(max(least, -(-table.count() * share // PART_ROWS)), *keys)


def number_sets(rows: DataFrame, key: str, number: str) -> DataFrame:
    """(key, numbers): the whole numbers that each key holds, in order, as (block, bits) of 64 numbers each; equal sets have equal ``numbers``. A key without any has none."""
    blocks = rows.groupBy(key, F.shiftright(number, 6).alias("block")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(number).bitwiseAND(63).cast("int"))).alias("bits"))
    return blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("bits").isNotNull(), F.struct("block", "bits")))).alias("numbers"))


def numbers_of(numbers: Column) -> Column:
    """The numbers of such a set, as an array."""
    of = lambda b: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(b["bits"], i) == 1), lambda i: b["block"] * 64 + i)
    return F.flatten(F.transform(numbers, of))


def contracted(edges: DataFrame) -> tuple[DataFrame, int]:
    """(n, root) of every node of the edges (a, b), root being the same for all nodes of a component, and how many rounds it took.

    In a round every node joins the neighbour, or itself, that is first in an
    order drawn anew; what has joined one node is one node from then on. Half of
    the nodes of a path remain, fewer of other graphs, so that rounds grow with
    the logarithm of the largest component, whatever its shape, and the rounds
    together cost a few passes over the edges. Components that are one node are done.
    """
    live = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    live = stored(live)
    joined = []
    while not live.isEmpty():
        order = lambda c, turn=len(joined): F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("n"))
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("n"), F.least("m", order("a"))["n"].alias("to")))
        of = lambda c, to=to: to.select(F.col("n").alias(c), F.col("to").alias(f"_{c}"))
        moved = live.join(of("a"), "a").join(of("b"), "b").filter("_a <> _b")
        live = stored(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        joined.append(to)
    if not joined:
        return edges.select(F.col("a").alias("n"), F.col("b").alias("root")), 0
    roots = joined[-1].withColumnRenamed("to", "root")
    for i, to in enumerate(reversed(joined[:-1])):  # the last rounds have the fewest nodes
        roots = to.join(roots.select(F.col("n").alias("to"), "root"), "to", "left").select("n", F.coalesce("root", "to").alias("root"))
        if i % 4 == 3:
            roots = stored(roots)
    return roots, len(joined)


def closure(pairs: DataFrame, node: str, key: str) -> DataFrame:
    """(node, root): the least node reachable through shared keys, for every node. Nodes of a key meet its least node."""
    own = pairs.select(F.col(node).alias("n"), F.col(key).alias("k")).distinct()
    least = own.groupBy("k").agg(F.min("n").alias("b"))
    edges = stored(own.join(least, "k").select(F.col("n").alias("a"), "b").distinct())
    roots, _ = contracted(edges)
    of = edges.select(F.col("a").alias("n")).distinct().join(roots, "n", "left").withColumn("root", F.coalesce("root", "n"))
    top = of.groupBy("root").agg(F.min("n").alias("top"))
    return of.join(top, "root").select(F.col("n").alias(node), F.col("top").alias("root"))


def near_names(names: DataFrame, name: str, long_from: int) -> DataFrame:
    """Pairs (a < b) of different names within one edit, two for names of ``long_from`` letters and more.

    Names meet by what is left when up to two characters are dropped, which two
    names within as many edits share; the edit distance then decides.
    """

    def less(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))

    own = names.select(F.col(name).alias("v")).distinct()
    one = F.concat(F.array("v"), less(F.col("v")))
    two = F.flatten(F.transform(less(F.col("v")), less))
    keyed = own.select("v", F.explode(F.array_distinct(F.when(F.length("v") >= long_from - 2, F.concat(one, two)).otherwise(one))).alias("k"))
    a, b = keyed.select(F.col("v").alias("a"), "k"), keyed.select(F.col("v").alias("b"), "k")
    near = F.levenshtein("a", "b") <= F.when(F.length("a") >= long_from, 2).otherwise(1)
    return a.join(b, "k").filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def shared_keys(keys: DataFrame, node: str, key: str, most: int = 25) -> DataFrame:
    """Pairs (a < b) of nodes that share a key of at most ``most`` nodes, with the number of such keys."""
    own = keys.select(F.col(node).alias("n"), F.col(key).alias("k")).distinct()
    rare = own.groupBy("k").agg(F.count("*").alias("c")).filter(F.col("c").between(2, most))
    held = own.join(rare, "k").select("n", "k")
    a, b = held.alias("a"), held.alias("b")
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.n") < F.col("b.n")))
    return pairs.groupBy(F.col("a.n").alias("a"), F.col("b.n").alias("b")).agg(F.count("*").alias("shared"))


def prefix_pairs(tokens: DataFrame, node: str, token: str, share: float, one_sided: bool = False, both_ways: bool = False) -> DataFrame:
    """Pairs (a < b) of nodes that may share ``share`` of their tokens: of both sets together, or with ``one_sided`` of a's; ``both_ways`` gives (b, a) too.

    tokens: one row for each node and token. A node of n tokens shares ceil(share * n)
    of them at least, so one of its n - ceil(share * n) + 1 rarest is among
    them. These meet each other, or with ``one_sided`` all tokens, so that no
    common token pairs all its nodes. Callers count what the pairs share.
    """
    own = tokens.select(F.col(node).alias("n"), F.col(token).alias("t")).filter("n is not null and t is not null").distinct()
    counts = own.groupBy("t").agg(F.count("*").alias("c"))
    each = Window.partitionBy("n")
    ranked = own.join(counts, "t").select("n", "t", F.row_number().over(each.orderBy("c", "t")).alias("r"), F.count("*").over(each).alias("size"))
    rare = ranked.filter(F.col("r") <= F.col("size") - F.ceil(share * F.col("size") - 1e-9) + 1)
    a, b = rare.select(F.col("n").alias("a"), "t"), (own if one_sided else rare).select(F.col("n").alias("b"), "t")
    return a.join(b, "t").filter("a <> b" if both_ways else "a < b").select("a", "b").distinct()


def counts_of_codes(printed: DataFrame, book: DataFrame, key: str, code: str) -> DataFrame:
    """(key, n): how often the codes of each key were printed, of those printed at all; a code listed twice for a key counts once.

    Printed codes (code) are counted before they meet the book, so the join makes
    one row for each entry of the book, not one for each entry and print.
    """
    told = printed.groupBy(F.col("code").alias("_code")).agg(F.count("*").alias("_n"))
    return book.select(key, code).distinct().join(told, F.col(code) == F.col("_code")).groupBy(key).agg(F.sum("_n").alias("n"))


def word_overlap(words: DataFrame, node: str, word: str, share: float, both_ways: bool = False) -> DataFrame:
    """Pairs (a < b, or with ``both_ways`` a <> b) of nodes where b has at least ``share`` of a's words."""
    own = words.select(F.col(node).alias("n"), F.col(word).alias("t")).filter("n is not null and t is not null").distinct()
    held = own.groupBy("n").agg(F.collect_list("t").alias("held"))  # the words of one name
    of = lambda c: held.select(F.col("n").alias(c), F.col("held").alias(f"_{c}"))
    pairs = prefix_pairs(own, "n", "t", share, one_sided=True, both_ways=both_ways).join(of("a"), "a").join(of("b"), "b")
    return pairs.filter(F.size(F.array_intersect("_a", "_b")) >= F.size("_a") * share - 1e-9).select("a", "b")


def class_overlap(words: DataFrame, node: str, word: str, share: float) -> DataFrame:
    """(a, b, kind): 'same' for each node a and the least node b of just its words; 'overlap' for such least nodes where b has at least ``share`` of a's words.

    Two nodes overlap where they are of one class, or a's class overlaps with b's:
    no link is lost, and copies of a name don't make pairs with each other.
    """
    sets = words.select(F.col(node).alias("a"), F.col(word).alias("t")).filter("a is not null and t is not null").groupBy("a").agg(F.array_sort(F.collect_set("t")).alias("w"))
    classes = stored(sets.groupBy("w").agg(F.min("a").alias("b")))
    between = word_overlap(classes.select("b", F.explode("w").alias("t")), "b", "t", share, both_ways=True)
    return sets.join(classes, "w").select("a", "b", F.lit("same").alias("kind")).unionByName(between.select("a", "b", F.lit("overlap").alias("kind")))


def nearest_of_other_kinds(df: DataFrame, id_col: str, key: str, kind: str, kinds: Sequence[str], value: str, most: int = 3) -> DataFrame:
    """(a, b): with each row, the ``most`` rows of its key nearest in value among those of another kind; ties go to the lesser id.

    Windows carry the last ``most`` rows of each kind up and down the values,
    so a key's pairs are never made. Rows without a value take no part.
    """
    own = df.filter(F.col(value).isNotNull()).select(F.col(id_col).alias("i"), F.col(key).alias("g"), F.col(kind).alias("t"), F.col(value).alias("v"))
    found = []
    for name, along in (("_below", F.col("v")), ("_above", -F.col("v"))):
        same = Window.partitionBy("g", "t").orderBy(along, F.desc("i"))
        passed = Window.partitionBy("g").orderBy(along).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        at = F.struct("v", "i")
        own = own.withColumn(name, F.struct(along.alias("o"), (-F.col("i")).alias("n"), F.array_compact(F.array(at, *[F.lag(at, k).over(same) for k in range(1, most)])).alias("rows")))
        for k, one in enumerate(kinds):
            found.append((f"{name}{k}", one))
            own = own.withColumn(f"{name}{k}", F.max(F.when(F.col("t") == one, F.col(name))).over(passed)["rows"])
    none = F.array().cast("array<struct<v:double,i:bigint>>")
    near = F.array_distinct(F.concat(*[F.when(F.col("t") == one, none).otherwise(F.coalesce(c, none)) for c, one in found]))
    ranked = F.array_sort(F.transform(near, lambda x: F.struct(F.abs(x["v"] - F.col("v")).alias("d"), x["i"].alias("i"))))
    return own.select(F.col("i").alias("a"), F.explode(F.slice(ranked, 1, most)).alias("b")).select("a", F.col("b.i").alias("b"))


def medians(df: DataFrame, by: Sequence[str], value: str, bins: int = 1024) -> DataFrame:
    """``by`` and ``middle``: the exact median of each group's finite values, nulls left out.

    Equal values are counted first. Counts of bins between a group's least and
    greatest value tell which bins hold the middle, and only these are put in
    order, so no task orders a whole group.
    """
    held = df.filter(F.col(value).isNotNull()).groupBy(F.struct(*by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    span = held.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("all"))
    share = F.coalesce((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0))
    binned = held.join(span, "g").select("g", "v", "n", "all", F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin"))
    first, second = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    counted = binned.groupBy("g", "bin").agg(F.sum("n").alias("c"), F.first("all").alias("all"))
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("bin"))
    middle = counted.withColumn("upto", upto).filter((F.col("upto") - F.col("c") < second) & (F.col("upto") >= first)).select("g", "bin", (F.col("upto") - F.col("c")).alias("before"))
    inside = binned.join(middle, ["g", "bin"]).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("g", "bin").orderBy("v")))
    of = inside.filter((F.col("upto") - F.col("n") < second) & (F.col("upto") >= first))
    return of.groupBy("g").agg(F.avg("v").alias("middle")).select("g.*", "middle")


def fill_down(df: DataFrame, col: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A blank takes the last value above it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(col, F.last(F.nullif(F.trim(F.col(col)), F.lit("")), ignorenulls=True).over(w))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page in a total order; a negative limit is none."""
    out = df.orderBy(*order).offset(offset)
    return out if limit < 0 else out.limit(limit)


def keyset_page(df: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    return df.filter(F.col(key) > after).orderBy(key).limit(limit)
