"""What is kept from readers of mail because it quotes mail that is held: threads merged batch by batch, and texts cut at their quotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .relational import contracted, stored

NODES = "n string, root string"
QUOTE = r"(?i)(?:^|\n)(?:-{2,}\s?original message|on [^\n]{5,80} wrote:|from: |>)"
LEFT_OUT = "(What follows quotes a message that is held, and is left out.)"


def edges(mail: DataFrame) -> DataFrame:
    """(a, b): each message (id, message_id, in_reply_to, refs) with itself and with the message ids that it has or names.

    Ids of messages are nodes of their own, so that answers meet what they answer
    even where that was never stored, and a message that came late finds its answers.
    """
    own = F.concat(F.lit("m"), F.col("id").cast("string"))
    named = F.array_distinct(F.flatten(F.array(*[T.message_ids(F.col(c)) for c in ("message_id", "in_reply_to", "refs")])))
    keys = F.transform(named, lambda k: F.concat(F.lit("k"), k))
    return mail.filter("id is not null").select(own.alias("a"), F.explode(F.concat(F.array(own), keys)).alias("b"))


def merged(components: DataFrame, new: DataFrame) -> DataFrame:
    """(n, root) of components (n, root) and the edges (a, b) that came: root is one of the component's nodes, the same for all of them.

    New ends stand for the components they are in already, and only these are
    contracted, so that the rounds cost what has arrived; what was stored is read
    once for the roots of the new ends, and once to give them their new ones.
    """
    new = stored(new.filter("a is not null and b is not null").distinct())
    ends = new.select(F.col("a").alias("n")).union(new.select("b")).distinct()
    at = stored(ends.join(components.select("n", "root"), "n", "left").withColumn("fresh", F.col("root").isNull()).withColumn("root", F.coalesce("root", "n")))
    of = lambda c: at.select(F.col("n").alias(c), F.col("root").alias(f"_{c}"))
    between = new.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b").distinct()
    roots, _ = contracted(between)
    moved = roots.select(F.col("n").alias("root"), F.col("root").alias("_to"))
    every = components.select("n", "root").unionByName(at.filter("fresh").select("n", "root"))
    return stored(every.join(moved, "root", "left").select("n", F.coalesce("_to", "root").alias("root")))


def beside_held(components: DataFrame, mail: DataFrame) -> DataFrame:
    """id of mail (id, held) that isn't held, in a thread with mail that is."""
    at = mail.filter("id is not null").select("id", F.coalesce("held", F.lit(False)).alias("held"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("n")).join(components, "n")
    roots = at.filter("held").select("root").distinct()
    return at.filter("not held").join(roots, "root", "left_semi").select("id").distinct()


def quotes(body: Column) -> Column:
    """Whether a text quotes another below its own words."""
    return F.coalesce(F.replace(body, F.lit("\r\n"), F.lit("\n")).rlike(QUOTE), F.lit(False))


def as_read(body: Column) -> Column:
    """The text ahead of its quotation, and a note that the rest is left out."""
    ahead = F.get(F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), QUOTE, 2), F.lit(0))
    return F.ltrim(F.concat(F.regexp_replace(ahead, r"(?<!\s)\s+$", ""), F.lit("\n\n" + LEFT_OUT)), F.lit("\n"))


def readable(mail: DataFrame, components: DataFrame) -> DataFrame:
    """mail (id, body, held, ..) with ``quotes_held`` and ``read``, the text a reader is given.

    Held mail itself is untouched, and so is what quotes nothing. A reply or
    forward that quotes its thread, where any of the thread is held, keeps its own
    words only. Mail without an id is in no thread; columns of these names are replaced.
    """
    near = beside_held(components, mail).select(F.col("id").alias("_near"))
    at = mail.drop("quotes_held", "read").join(near, F.col("id") == F.col("_near"), "left")
    cut = F.col("_near").isNotNull() & quotes(F.col("body"))
    return at.withColumn("quotes_held", cut).withColumn("read", F.when(cut, as_read(F.col("body"))).otherwise(F.col("body"))).drop("_near")
