"""N-gram Jaccard join: a grouped prefix join that returns linked components.

Documents are sets of k-word shingles (the whole sequence where there are fewer
words). Two documents link when 100 * intersection >= t * union. Nothing is
capped: every link between different sets is found, up to the component that
holds it.

1. Equal sets fall together by a 64-bit fingerprint, the node.
2. Shingles are ordered by how rare they are in all texts (a table of fixed
   size, see ``rarity``), then by hash. A pair that links shares a shingle among
   the first n - ceil(t n / 100) + 1 of both: the prefix. Passages that many
   documents share are last in the order and in few prefixes.
3. Nodes with equal prefix and size form a group. Groups meet by prefix
   shingles; pairs of groups that sizes and places in the prefixes rule out go.
4. Where a shingle has ``cap`` groups at most, all its pairs of groups are
   expanded to pairs of members. Larger keys (families of copies), and groups of
   several nodes, are not paired in full: in rounds, members meet a few pivots of
   the key, those with the most large keys, and keys whose members are all in
   one component are done. Members outside the main component of their key then
   meet all others of the key, so that no link is lost.
5. Pairs are verified on the sets, which are made once for all nodes that occur
   in step 4.

Defined cases: null texts and texts without words have an empty set, link with
nothing and are their own component; repeated rows link; a null id belongs to
the component of its text, which has a null id if no other is reachable; an
empty table gives an empty table; other columns, whatever their names, pass
through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rarity import classes
from .store import Marks, Scratch, stored
from .text import FOLD, chunks, mix

_LOW = np.uint64((1 << 56) - 1)


@dataclass(frozen=True)
class Join:
    """k: words of a shingle. t: least Jaccard similarity in hundredths. cap: most groups of a key that is paired in full. pivots: of a key and round. bits: of the rarity table's size."""

    k: int = 5
    t: int = 80
    cap: int = 16
    pivots: int = 4
    bits: int = 23

    def prefix(self, n: int) -> int:
        return n + (-self.t * n) // 100 + 1


def sets(texts: pa.Array, k: int, table: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Per text, its sorted distinct tokens: 8 bits of rarity class (0 without a table), 56 bits of hash."""
    for chunk in chunks(texts, FOLD):
        h, text = chunk.shingles(k)
        token = h & _LOW
        if table is not None:
            token |= table[(h >> np.uint64(64 - (len(table).bit_length() - 1))).astype(np.int64)].astype(np.uint64) << np.uint64(56)
        per = np.bincount(text, minlength=chunk.n)
        ends = np.cumsum(np.where(chunk.n_words >= k, per, 0))
        short = dict(zip(text[int(ends[-1]) :].tolist(), token[int(ends[-1]) :]))
        for i in range(chunk.n):
            if i in short:
                yield np.array([short[i]], np.uint64)
            else:
                s = np.sort(token[ends[i - 1] if i else 0 : ends[i]])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def fingerprint(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s & _LOW).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _mapped(text: Column, kind: str, f) -> Column:
    """f over the texts, marked as not deterministic: else a filter that a join infers is pushed below it and every text is mapped twice, the second time before rows are left out."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield f(texts)

    return F.arrow_udf(run, kind).asNondeterministic()(text)


def _struct(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Array:
    columns = list(zip(*rows)) or [() for _ in kinds]
    return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values())], list(kinds))


def _prefixes(join: Join, table) -> Column:
    """Of each text: its node, set size, group and prefix."""

    def row(s: np.ndarray) -> tuple:
        if not len(s):
            return None, 0, None, None
        first = s[: join.prefix(len(s))]
        return fingerprint(s), len(s), fingerprint(mix(first + np.uint64(len(s)))), first.view(np.int64).copy()

    kinds = {"node": pa.int64(), "n": pa.int64(), "group": pa.int64(), "prefix": pa.list_(pa.int64())}
    return lambda texts: _struct([row(s) for s in sets(texts, join.k, table.value)], kinds)


def _bodies(join: Join):
    """Of each text: its node, and the sorted 48-bit hashes of its set."""
    low = np.uint64((1 << 48) - 1)
    body = lambda s: np.sort(mix(s) & low).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return lambda texts: _struct([(fingerprint(s), body(s)) if len(s) else (None, b"") for s in sets(texts, join.k)], {"node": pa.int64(), "body": pa.binary()})


def _nodes(join: Join):
    return lambda texts: pa.array([fingerprint(s) if len(s) else None for s in sets(texts, join.k)], pa.int64())


def _body(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _linked(t: int):
    def run(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in it:
            out = []
            for a, b in zip(left, right):
                x, y = _body(a.as_py()), _body(b.as_py())
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                out.append(100 * both >= t * (len(x) + len(y) - both))
            yield pa.array(out, pa.bool_())

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node of the edges (a, b), a stored table: the least node of its component.

    Least neighbours and pointer jumping in turn; each step is a stored table,
    and the steps grow with the logarithm of a component's width.
    """
    ends = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = scratch(ends.unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = scratch(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("_near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("_was"), F.least("label", "_near").alias("label"))
        up = labels.select(F.col("node").alias("_up"), F.col("label").alias("_top"))
        jump = scratch(step.join(up, F.col("label") == F.col("_up"), "left").select("node", "_was", F.least("label", F.coalesce("_top", "label")).alias("label")))
        scratch.drop(labels)
        labels = jump.select("node", "label")
        moved = jump.filter("label <> _was").limit(1).count()
        if not moved:
            scratch.drop(both)
            return jump.select("node", "label")
        labels = scratch(labels)
        scratch.drop(jump)


class _Run:
    """One join over (id, text) rows: what each step needs of the others."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, join: Join):
        self.join, self.spark = join, docs.sparkSession
        self.scratch = Scratch(self.spark)
        self.docs = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
        table = self.spark.sparkContext.broadcast(classes(self.docs.select("_text"), join.k, join.bits))
        made = _mapped(F.col("_text"), "node bigint, n bigint, group bigint, prefix array<bigint>", _prefixes(join, table))
        self.made = self.scratch(self.docs.select("_id", made.alias("s")).select("_id", "s.*"))
        table.unpersist()
        self.rows = self.scratch(self.made.select("_id", "node", "n"))
        full = self.made.filter("n > 0").groupBy("node")
        self.nodes = self.scratch(full.agg(F.min("_id").alias("least"), F.max("n").alias("n"), F.max("group").alias("group")))
        self.labels = None

    def fits(self, x: str, y: str) -> Column:
        """Sizes can link, and so can what is left of both sets behind the places at which they meet."""
        n, m, i, j = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.at"), F.col(f"{y}.at")
        t = self.join.t
        return (F.least(n, m) * 100 >= F.greatest(n, m) * t) & ((F.least(n - i, m - j)) * (100 + t) >= t * (n + m))

    def postings(self) -> tuple[DataFrame, DataFrame]:
        """(key, group, n, at) of prefix shingles of several groups: of at most ``cap``, and of more."""
        tokens = self.made.filter("n > 0").select("group", "n", F.posexplode("prefix").alias("at", "key"))
        shared = self.scratch(tokens.groupBy("key").agg(F.min("group").alias("_a"), F.max("group").alias("_z")).filter("_a <> _z").select("key"))
        keyed = self.scratch(tokens.join(shared, "key", "left_semi").groupBy("key", "group").agg(F.max("n").alias("n"), F.max("at").alias("at")))
        self.scratch.drop(shared)
        hot = keyed.groupBy("key").agg(F.count("*").alias("_c")).filter(F.col("_c") > self.join.cap).select("key")
        hot = self.scratch(hot)
        self.scratch.drop(self.made)
        return keyed.join(hot, "key", "left_anti"), keyed.join(hot, "key", "left_semi")

    def light_pairs(self, light: DataFrame) -> DataFrame:
        """Pairs of groups (g, g2)."""
        x, y = light.alias("x"), light.alias("y")
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.group") < F.col("y.group")) & self.fits("x", "y"))
        return pairs.select(F.col("x.group").alias("g"), F.col("y.group").alias("g2")).distinct()

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """Pairs of nodes (a, b), and (key, node, n, at) of the keys that are not paired in full."""
        light, hot = self.postings()
        members = self.nodes.select("group", "node", "n")
        sizes = members.groupBy("group").agg(F.count("*").alias("m"))
        several = self.scratch(sizes.filter("m > 1"))
        groups = self.scratch(self.light_pairs(light))
        one, two = several.select(F.col("group").alias("g"), F.col("m").alias("_m")), several.select(F.col("group").alias("g2"), F.col("m").alias("_m2"))
        many = groups.join(one, "g", "left").join(two, "g2", "left").withColumn("_wide", F.coalesce("_m", F.lit(1)) * F.coalesce("_m2", F.lit(1)) > self.join.cap**2)
        many = self.scratch(many.select("g", "g2", "_wide"))
        a, b = members.select(F.col("group").alias("g"), F.col("node").alias("_x")), members.select(F.col("group").alias("g2"), F.col("node").alias("_y"))
        pairs = many.filter("not _wide").join(a, "g").join(b, "g2")
        pairs = self.scratch(pairs.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")))
        start = F.lit(0).alias("at")
        wide = many.filter("_wide").select(F.xxhash64("g", "g2").alias("key"), F.explode(F.array("g", "g2")).alias("group"))
        keys = hot.join(members.select("group", "node"), "group").select("key", "node", "n", "at")
        keys = keys.unionByName(wide.join(members, "group").select("key", "node", "n", start))
        keys = self.scratch(keys.unionByName(members.join(several, "group", "left_semi").select(F.col("group").alias("key"), "node", "n", start)))
        self.scratch.clear(self.rows, self.nodes, pairs, keys)
        return pairs, keys

    def make_bodies(self, named: DataFrame) -> None:
        """The sets of the nodes named, from the texts again; rows that surely hold none of them are left out before."""
        named = self.scratch(named)
        ids = self.scratch(self.nodes.join(named, "node", "left_semi").select(F.xxhash64("least").alias("h")))
        marks = Marks(ids, "h")
        made = self.docs.select(marks.having(F.xxhash64("_id"), F.col("_text"), "struct<node:bigint,body:binary>", _bodies(self.join)).alias("_s"))
        self.bodies = self.scratch(made.filter("_s.marked").select("_s.value.*").join(named, "node", "left_semi").dropDuplicates(["node"]))
        marks.shipped.unpersist()

    def link_pairs(self, pairs: DataFrame) -> bool:
        """Verifies pairs (a, b) and merges the labels of those that link."""
        one, two = self.bodies.select(F.col("node").alias("a"), F.col("body").alias("left")), self.bodies.select(F.col("node").alias("b"), F.col("body").alias("right"))
        linked = F.arrow_udf(_linked(self.join.t), "boolean")
        edges = self.scratch(pairs.join(one, "a").join(two, "b").filter(linked("left", "right")).select("a", "b"))
        if not edges.limit(1).count():
            self.scratch.drop(edges)
            return False
        if self.labels is None:
            self.labels = components(edges, self.scratch)
            return True
        of = lambda c: self.labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
        between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).distinct()
        merged = components(between, self.scratch)
        known = self.labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
        new = merged.join(self.labels.select("node"), "node", "left_anti")
        self.labels = self.scratch(known.unionByName(new.select("node", "label")))
        return True

    def named(self, keys: DataFrame) -> DataFrame:
        if self.labels is None:
            return keys.withColumn("label", F.col("node"))
        return keys.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def torn(self, keys: DataFrame) -> tuple[DataFrame, int, int]:
        """(key, major label) of keys with several labels; their rows, and the comparisons that would settle them."""
        counts = self.named(keys).groupBy("key", "label").agg(F.count("*").alias("c"))
        of = counts.groupBy("key").agg(F.count("*").alias("labels"), F.sum("c").alias("c"), F.max(F.struct("c", "label")).alias("top")).filter("labels > 1")
        torn = self.scratch(of.select("key", F.col("top")["label"].alias("major"), "c", (F.col("c") - F.col("top")["c"]).alias("minor")))
        s = torn.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("c").cast("double") * F.col("minor")), F.lit(0.0)).alias("cost")).first()
        return torn, s["rows"], s["cost"]

    def untested(self, pairs: DataFrame) -> DataFrame:
        ordered = pairs.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct()
        new = self.scratch(ordered.join(self.tested, ["a", "b"], "left_anti"))
        self.tested = self.tested.unionByName(new)
        return new

    def settle(self, keys: DataFrame) -> None:
        """Links of the keys that are not paired in full."""
        weight = self.scratch(keys.groupBy("node").agg(F.count("*").alias("w")))
        torn, rows, cost = self.torn(keys)
        turn = 0
        while cost > 4 * rows:
            at = self.scratch(self.named(keys.join(torn.select("key"), "key", "left_semi")).join(weight, "node"))
            place = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(self.join.pivots))
            what = F.struct("w", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "label", "n", "at")
            best = at.groupBy("key").agg(F.array_compact(F.array(*[F.max(F.when(place == i, what)) for i in range(self.join.pivots)])).alias("_p"))
            x = at.join(self.scratch(best), "key").withColumn("y", F.explode("_p")).select(F.struct("node", "label", "n", "at").alias("x"), "y")
            pairs = x.filter((F.col("x.label") != F.col("y.label")) & self.fits("x", "y")).select(F.col("x.node").alias("_x"), F.col("y.node").alias("_y"))
            self.link_pairs(self.untested(pairs))
            self.scratch.drop(at, torn)
            was = cost
            torn, rows, cost = self.torn(keys)
            turn += 1
            if cost > was / 2:
                break
        if not rows:
            return
        at = self.scratch(self.named(keys).join(torn.select("key", "major"), "key"))
        x, y = at.filter("label <> major").alias("x"), at.alias("y")
        once = (F.col("y.label") == F.col("y.major")) | (F.col("x.node") < F.col("y.node"))
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & once & self.fits("x", "y"))
        self.link_pairs(self.untested(pairs.select(F.col("x.node").alias("_x"), F.col("y.node").alias("_y"))))

    def labelled(self) -> DataFrame:
        """(node, label) of every node that has a link; None if there is none."""
        pairs, keys = self.candidates()
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        self.make_bodies(ends.unionByName(keys.select("node")).distinct())
        self.tested = pairs
        self.link_pairs(pairs)
        self.settle(keys)
        return self.labels


def _components(run: _Run) -> DataFrame:
    """(node, least id of it, label) of every node."""
    labels = run.labelled()
    if labels is None:
        return run.nodes.select("node", "least", F.col("node").alias("label"))
    return run.nodes.select("node", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """id, n_shingles and component_id of every row."""
    run = _Run(docs, id_col, text_col, join)
    labelled = run.scratch(_components(run))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of = run.scratch(labelled.join(least, "label").select("node", "component_id"))
    rows = stored(run.rows.join(of, "node", "left").select("_id", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id")))
    run.scratch.clear()
    return rows.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """One row of each component, that with the least id (null ids last); of rows repeated with it, one. Rows with an empty set stay.

    Rows are told by id and node, as an id may be null or have several texts.
    Texts of ids that lose no row are not dealt out: marks of the other ids tell
    most of them. Of the rest the node is made again and joined.
    """
    run = _Run(docs, id_col, text_col, join)
    labelled = run.scratch(_components(run))
    first = labelled.groupBy("label").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("_p"))
    first = run.scratch(first.select(F.col("_p")["node"].alias("_node"), F.col("_p")["least"].alias("_least")))
    rows = run.rows.filter("n > 0").groupBy("_id", "node").agg(F.count("*").alias("copies"))
    rows = rows.join(first, (F.col("node") == F.col("_node")) & F.col("_id").eqNullSafe(F.col("_least")), "left")
    lost = run.scratch(rows.select("_id", "node", "copies", F.col("_node").isNotNull().alias("kept")).filter("not kept or copies > 1"))
    lost = stored(lost.select(F.col("_id").alias("_lost_id"), F.col("node").alias("_lost"), "kept"))
    marks = Marks(stored(lost.select(F.xxhash64("_lost_id").alias("h"))), "h")
    run.scratch.clear()
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own")
    all_rows = docs.select(own, F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    sure = all_rows.filter(~marks.has(F.xxhash64("_id"))).select("_own")
    asked = all_rows.withColumn("_s", marks.having(F.xxhash64("_id"), F.col("_text"), "bigint", _nodes(join)))
    asked = asked.filter("_s.marked").select("_own", "_id", "_text", F.col("_s")["value"].alias("_node"))
    told = asked.join(lost, F.col("_node").eqNullSafe(F.col("_lost")) & F.col("_id").eqNullSafe(F.col("_lost_id")), "left")
    alone = told.filter("kept is null").select("_own")
    one = told.filter("kept").groupBy("_id", "_node").agg(F.min_by("_own", F.xxhash64("_text")).alias("_own")).select("_own")
    return sure.unionByName(alone).unionByName(one).select("_own.*")
