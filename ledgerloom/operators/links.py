"""Messages linked by keys: what each names, who is new to a conversation, and which invoices are held twice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .relational import stored

# Kinds of pictures, and words that stand before one sender's own numbers.
PICTURES = "png jpg jpeg gif bmp emz wmz ico svg".split()
SENDERS_OWN = "INVOICE INV IN BILL NO NR".split()


def extracted(text: Column) -> Column:
    """struct of the invoices, purchase orders, amounts, due dates and last four account digits a text names, each list in order, each value once."""
    patterns = {"invoices": r"\bINV-(\d+)", "pos": r"\bPO (\d+)", "amounts": r"\$(\d[\d,]*\.\d\d)", "due": r"\bdue (\d{4}-\d\d-\d\d)", "last4": r"\bacct \d+(\d{4})\b"}
    return F.struct(*[F.array_distinct(F.regexp_extract_all(text, F.lit(p), 1)).alias(k) for k, p in patterns.items()])


def real_file(name: Column, size: Column) -> Column:
    """A file someone sent: not tiny (lists may be), no small picture, no part of the message itself."""
    big = (size >= 1024) | F.lower(name).rlike(r"\.(csv|txt)$")
    picture = F.substring_index(F.lower(name), ".", -1).isin(PICTURES) & name.contains(".") & (size < 200_000)
    return big & ~picture & ~F.lower(name).rlike(r"^(winmail|smime|message|att\d+)\b")


def link_keys(mail: DataFrame) -> DataFrame:
    """(id, kind, value) of each message: thread, msg, invoice, po and stem keys.

    Short numbers that only put a common word ahead of digits, and numbers of
    digits alone but long purchase orders, count within the sender's domain.
    Held mail names only numbers that its own text writes, and no files.
    """
    domain = T.sender_domain(F.col("sender"))
    said = F.transform(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"([A-Za-z]*[-#\s]?\d[\dA-Za-z-]*)"), 1), T.number_key)

    def scoped(kind: str, key: Column) -> Column:
        plain = F.regexp_replace(key, rf"^({'|'.join(SENDERS_OWN)})(?=\d+$)", "")
        digits = key.rlike(r"^\d+$")
        if kind == "invoice":
            return F.when(plain.rlike(r"^\d{1,4}$"), F.concat(domain, F.lit("|"), plain)).when(digits, F.concat(domain, F.lit("|"), key)).otherwise(key)
        return F.when(digits & (F.length(key) < 5), F.concat(domain, F.lit("|"), key)).otherwise(key)

    def numbers(kind: str, column: str, key) -> Column:
        named = F.filter(F.transform(F.col(column), key), lambda k: k.rlike(r"\d") & (~F.col("held") | F.array_contains(said, k)))
        return F.transform(named, lambda k: F.struct(F.lit(kind).alias("kind"), scoped(kind, k).alias("value")))

    stems = F.filter(F.transform(F.when(F.col("held"), F.array().cast("array<string>")).otherwise(F.col("files")), T.file_stem), lambda s: F.length(s) >= 4)
    one = lambda kind, c: F.transform(c, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    mid = lambda c: F.transform(T.message_ids(c), lambda v: F.concat(F.lit("mid:"), v))
    every = F.concat(numbers("invoice", "invoices", T.number_key), numbers("po", "pos", T.po_key), one("stem", F.transform(stems, lambda s: F.concat(domain, F.lit("|"), s))), one("thread", mid(F.col("in_reply_to"))), one("msg", mid(F.col("message_id"))))
    return mail.select("id", F.explode(F.array_distinct(every)).alias("k")).select("id", "k.kind", "k.value")


def _depths(replies: DataFrame) -> DataFrame:
    """(c, id, depth) of replies (c, id, up): how many messages of its conversation each answers, one inside the other.

    Pointers double, so rounds grow with the logarithm of the depth; messages
    that have met the top of their tree leave. A round in which none does leaves
    only circles of answers and what hangs on them, which count as 0.
    """
    live, done = stored(replies.withColumn("depth", F.col("up").isNotNull().cast("long"))), []
    while True:
        done.append(live.filter("up is null").select("c", "id", "depth"))
        held = live.filter("up is not null")
        if held.isEmpty() or (len(done) > 1 and done[-1].isEmpty()):
            return reduce(DataFrame.unionByName, [*done, held.withColumn("depth", F.lit(0).cast("long")).drop("up")])
        tops = reduce(DataFrame.unionByName, done).withColumn("up", F.lit(None).cast(dict(live.dtypes)["up"]))
        above = held.unionByName(tops).select("c", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        live = stored(held.join(above, ["c", "up"]).select("c", "id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth")))


def newcomers(mail: DataFrame) -> DataFrame:
    """mail (conversation, id, arrival, message_id, in_reply_to, party, to_parties) with ``newcomer``, for every row; id is unique.

    A conversation starts with its first stored message that answers none of it,
    of those stored at one moment the one that another party answered. Its
    party and addressees take part; so do those of each later accepted message,
    in order of reply depth, then arrival. A message is accepted where its
    party, or a domain it is under (an address is only itself), took part
    before it. Null to_parties are addressees that aren't known: whoever comes
    later may be one. Others are newcomers, as are messages without a party and
    those that claim the id of another party's message; whom a newcomer writes
    to doesn't count. Without a conversation a message is no newcomer.

    Acceptance rests on earlier acceptance only, so it is the least fixed point
    of "a party takes part from the first accepted message that names it": each
    round carries the parties whose first place has moved forward, and rounds
    grow with the longest chain of introductions, not with a conversation's size.
    """
    kept = mail.select("conversation", "id", "arrival", "message_id", "in_reply_to", "party", "to_parties")
    own = kept.filter("conversation is not null").select(F.col("conversation").alias("c"), "id", "arrival", "message_id", "in_reply_to", F.coalesce("party", F.lit("")).alias("party"), F.col("to_parties").alias("to"))
    owners = own.filter("message_id is not null").groupBy("c", "message_id").agg(F.min_by(F.struct("id", "party"), F.struct("arrival", "id")).alias("o"))
    claimed = owners.select("c", "message_id", F.col("o.party").alias("_first"))
    parents = owners.select("c", F.col("message_id").alias("in_reply_to"), F.col("o.id").alias("up"))
    answers = own.filter("in_reply_to is not null").groupBy("c", F.col("in_reply_to").alias("message_id")).agg(F.min("party").alias("_lo"), F.max("party").alias("_hi"))
    told = own.join(claimed, ["c", "message_id"], "left").join(parents, ["c", "in_reply_to"], "left").join(answers, ["c", "message_id"], "left")
    answered = F.coalesce((F.col("_lo") != F.col("party")) | (F.col("_hi") != F.col("party")), F.lit(False))
    told = stored(told.select("c", "id", "arrival", "party", "to", "up", F.coalesce(F.col("_first") != F.col("party"), F.lit(False)).alias("forged"), answered.alias("answered")))
    starts = told.groupBy("c").agg(F.min_by("id", F.struct(F.col("forged") | F.col("up").isNotNull(), "arrival", ~F.col("answered"), "id")).alias("root"))
    names = F.concat(F.array("party"), F.coalesce("to", F.array(F.lit("*"))))
    placed = told.join(_depths(told.select("c", "id", "up")), ["c", "id"]).join(starts, "c").withColumn("is_root", F.col("id") == F.col("root"))
    at = F.struct(F.when(F.col("is_root"), -1).otherwise(F.col("depth")).alias("depth"), "arrival", "id")
    placed = stored(placed.select("c", "id", "party", F.filter(names, lambda n: n != "").alias("names"), at.alias("at"), "forged", "is_root"))

    labels = F.split("party", r"\.")
    under = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parties = placed.filter("party <> ''").select("c", "party").distinct()
    parties = stored(parties.select("c", "party", F.explode(F.concat(F.when(F.col("party").contains("@"), F.array("party")).otherwise(under), F.array(F.lit("*")))).alias("name")))
    sends = placed.filter("party <> '' and not forged and not is_root")
    named = lambda rows: rows.select("c", F.explode("names").alias("name"), "at").groupBy("c", "name").agg(F.min("at").alias("at"))
    met = lambda found: found.join(parties, ["c", "name"]).groupBy("c", "party").agg(F.min("at").alias("since"))
    since = stored(met(named(placed.filter("is_root"))))
    moved = since.withColumn("until", F.lit(None).cast(since.schema["since"].dataType))
    while not moved.isEmpty():
        fresh = sends.join(moved, ["c", "party"]).filter("at > since and (until is null or at <= until)")
        found = met(named(fresh)).join(since.withColumnRenamed("since", "until"), ["c", "party"], "left")
        moved = stored(found.filter("until is null or since < until").select("c", "party", "since", "until"))
        since = stored(since.unionByName(moved.drop("until")).groupBy("c", "party").agg(F.min("since").alias("since")))
    judged = placed.join(since, ["c", "party"], "left")
    new = F.col("forged") | (~F.col("is_root") & ~F.coalesce(F.col("at") > F.col("since"), F.lit(False)))
    verdicts = judged.select(F.col("c").alias("conversation"), "id", new.alias("newcomer"))
    return verdicts.unionByName(kept.filter("conversation is null").select("conversation", "id", F.lit(False).alias("newcomer")))


def side_names(sender: Column) -> Column:
    """What an address is known by: itself, and its domain unless that is a free mail service; none without an address."""
    address = F.lower(F.trim(F.coalesce(sender, F.lit(""))))
    domain = T.sender_domain(address)
    names = F.when(domain.isin(*T.FREEMAIL), F.array(address)).otherwise(F.array(address, domain))
    return F.when(address.contains("@"), names).otherwise(F.array().cast("array<string>"))


def sides(sender: Column, reply_to: Column, to: Column) -> Column:
    """Who may answer for a message: its sender, where answers go, whom it went to, and others of their domains.

    Where answers go to another domain, the sender is a service that wrote for
    that company and counts by its address alone.
    """
    address = F.lower(F.trim(F.coalesce(sender, F.lit(""))))
    answers = F.lower(F.trim(F.coalesce(reply_to, F.lit(""))))
    service = answers.contains("@") & (T.sender_domain(answers) != T.sender_domain(address))
    own = F.when(service, F.filter(F.array(address), lambda x: x.contains("@"))).otherwise(side_names(address))
    went = F.flatten(F.transform(F.coalesce(to, F.array().cast("array<string>")), side_names))
    return F.array_distinct(F.concat(own, side_names(answers), went))


def duplicate_invoices(mail: DataFrame) -> DataFrame:
    """(id, others): messages that hold an invoice number that others hold too, and how many count as its copies.

    mail: (id, invoice, conversation, sent, held, cautioned, replying, file,
    names, sides), one row for each message and number; ``file`` says that it
    brings an invoice's file, ``names`` and ``sides`` are those above. A reply
    without a file is talk. Talk of the same conversation is never a copy. Held
    mail is none either, unless the message itself is held or cautioned. A
    message that answers nothing isn't a copy of the replies its conversation
    sent after it. Talk itself is a copy of its conversation's invoices only
    where it comes from none of their sides. Null numbers are held by none; a
    message without a conversation stands alone in it.

    Counts by number, conversation and time are joined, never pairs of messages.
    """
    talk, free = F.col("replying") & ~F.col("file"), ~F.col("held")
    own = mail.filter("invoice is not null").withColumn("talk", talk).withColumn("doubtful", F.col("held") | F.col("cautioned"))
    every = own.groupBy("invoice").agg(F.count("*").alias("_all"), F.count_if(free).alias("_free"))
    key = ["invoice", "conversation"]
    inside = own.groupBy(*key).agg(F.count_if("talk").alias("_talk"), F.count_if(F.col("talk") & free).alias("_free_talk"), F.count_if(~F.col("talk") & free).alias("_invoices"))
    moments = own.groupBy(*key, "sent").agg(F.count_if(F.col("replying") & F.col("file") & free).alias("n"))
    after = Window.partitionBy(*key).orderBy(F.desc("sent")).rowsBetween(Window.unboundedPreceding, -1)
    later = moments.select(*key, "sent", F.sum("n").over(after).alias("_later"))
    allowed = own.filter(~F.col("talk") & free).select(*key, F.explode("sides").alias("name")).distinct()
    asked = own.filter("talk and not doubtful").select("id", *key, F.explode("names").alias("name"))
    answered = asked.join(allowed, [*key, "name"]).select("id", "invoice").distinct().withColumn("_side", F.lit(True))
    told = own.join(every, "invoice").join(inside, key, "left").join(later, [*key, "sent"], "left").join(answered, ["id", "invoice"], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    mine = (F.col("talk") & F.col("conversation").isNotNull()).cast("long")
    follow = F.when(~F.col("replying"), n("_later")).otherwise(0)
    others = (
        F.when(F.col("doubtful"), F.col("_all") - 1 - (n("_talk") - mine))
        .when(F.col("talk"), F.when(F.col("_side"), 0).otherwise(n("_invoices")))
        .otherwise(F.col("_free") - 1 - n("_free_talk") - follow)
    )
    return told.select("id", others.alias("others")).filter("others > 0")


def entered_elsewhere(mail: DataFrame) -> DataFrame:
    """id of talk whose conversation has the same invoice, sent no later, by a message that is no talk."""
    first = mail.filter("not talk").groupBy("conversation", "invoice").agg(F.min("sent").alias("_first"))
    return mail.filter("talk").join(first, ["conversation", "invoice"]).filter("_first <= sent").select("id")


def look_alikes(asked: DataFrame, domain: str, known: DataFrame, like: str) -> DataFrame:
    """Rows whose domain isn't a known one but looks like it: equal skeletons, or one edit apart in their names of five letters and more.

    Both meet by keys, never all with all: the skeleton, and the skeleton with
    each of its characters left out, as two within one edit share one of these.
    """

    def keyed(df: DataFrame, c: str, name: str) -> DataFrame:
        s = T.skeleton(F.regexp_replace(F.col(c), r"\d+(?=\.)", ""))
        cuts = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        return df.withColumn(f"_{name}", s).withColumn("_k", F.explode(F.array_distinct(F.concat(F.array(s), cuts))))

    left, right = keyed(asked, domain, "s"), keyed(known.select(like), like, "r").select("_k", "_r", like)
    near = left.join(right, "_k").filter(F.col(domain) != F.col(like))
    close = (F.col("_s") == F.col("_r")) | ((F.length("_s") >= 5) & (F.levenshtein("_s", "_r") <= 1))
    return near.filter(close).select(*asked.columns, like).distinct()


def unique_names(files: DataFrame, name: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Equal names within a folder, whatever their case, get a number: ``x (2).pdf``."""
    r = F.row_number().over(Window.partitionBy(*by, F.lower(name)).orderBy(*order))
    return files.withColumn("_r", r).withColumn(name, F.when(F.col("_r") == 1, F.col(name)).otherwise(F.regexp_replace(F.col(name), r"^(.*?)(\.[^.]*)?$", F.concat(F.lit("$1 ("), F.col("_r"), F.lit(")$2"))))).drop("_r")
