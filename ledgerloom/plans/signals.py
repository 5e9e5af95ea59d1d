"""Signals of fraud found in whole texts, from the words to the level; held mail followed along answers."""

from pyspark.sql import functions as F

from ..operators import held as H
from ..operators import scoring as S
from ..operators import signals as G
from ..registry import query

#: What is written into the documents, and which signals a reader would find in it, known without the code.
_SAID = [
    ("Please note that our bank details have changed.", ["bank_change"]),
    ("We will never change our bank details by email.", []),
    ("If you get a message from anyone, saying our bank details have changed, call us.", []),
    ("Thanks for the report of last week.", []),
    ("Kindly buy ten gift cards and send me the codes.", ["gift_cards"]),
    ("Please do not buy gift cards for anybody.", []),
    ("Please wire the balance by end of day.", ["payment_request", "pressure"]),
    ("Our account number is 12345678901.", ["account_numbers"]),
    ("We have updated our remittance information, so kindly pay the attached invoice.", ["bank_change", "payment_request"]),
    ("Beware of letters about new bank accounts.", []),
    ("We never ask for cards, but our wire instructions are different.", ["bank_change"]),
]
_VALUES = ", ".join(f"({i}, {signals!r}::VARCHAR[], '{said}')" for i, (said, signals) in enumerate(_SAID))
_POINTS = "CASE x " + " ".join(f"WHEN '{k}' THEN {p}" for k, p in S.SIGNALS.items()) + " END"
_PLACE = f"list_position({list(G.ORDER)!r}, x)"

_RK10 = f"""
WITH said(k, signals, words) AS (VALUES {_VALUES}),
n AS (SELECT n_nationkey AS nk, lower(n_name) || ' payables' AS name, replace(lower(n_name), ' ', '') || '-trade.com' AS home FROM nation),
m AS (SELECT doc_id AS id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' AS bare, doc_id % 5 = 0 AS below, doc_id % 7 = 0 AS answers_elsewhere, k, signals, home,
        CASE doc_id % 50 % 4 WHEN 0 THEN home WHEN 1 THEN replace(home, '.com', 'x.com') WHEN 2 THEN 'gmail.com' ELSE 'p' || doc_id % 50 || '.org' END AS domain,
        CASE doc_id % 50 % 3 WHEN 0 THEN name WHEN 1 THEN substr(name, 2) ELSE 'somebody ' || doc_id % 50 END AS name, doc_id % 50 AS p
      FROM documents JOIN said ON k = doc_id % {len(_SAID)} JOIN n ON nk = doc_id % 25),
near AS (SELECT DISTINCT name, domain FROM (SELECT DISTINCT name, domain FROM m) AS a WHERE EXISTS (FROM n WHERE levenshtein(n.name, a.name) <= 1) AND NOT EXISTS (FROM n WHERE levenshtein(n.name, a.name) <= 1 AND n.home = a.domain)),
f AS (SELECT m.*, domain = home AS own, near.name IS NOT NULL AS borrowed, row_number() OVER (PARTITION BY p ORDER BY id) = 1 AS first,
        CASE WHEN below AND NOT bare THEN CASE WHEN list_contains(signals, 'bank_change') THEN ['bank_change_quoted'] ELSE [] END ELSE signals END AS said
      FROM m LEFT JOIN near USING (name, domain)),
s AS (SELECT id, own, list_concat(said, list_filter([
        CASE WHEN domain = 'gmail.com' AND list_has_any(said, ['bank_change', 'bank_change_quoted', 'gift_cards', 'account_numbers', 'payment_request']) THEN 'freemail_request' END,
        CASE WHEN first AND list_has_any(said, ['bank_change', 'gift_cards']) THEN 'first_contact' END,
        CASE WHEN answers_elsewhere THEN 'reply_to_mismatch' END,
        CASE WHEN domain LIKE '%-tradex.com' THEN 'lookalike_domain' END,
        CASE WHEN borrowed AND NOT own THEN 'display_name_spoof' END,
        CASE WHEN own AND NOT answers_elsewhere THEN 'trusted_domain' END], lambda x: x IS NOT NULL)) AS signals FROM f),
p AS (SELECT id, signals, greatest(0, coalesce(list_sum(list_transform(signals, lambda x: {_POINTS})), 0))::INT AS score FROM s)
SELECT id, array_to_string(list_transform(list_sort(list_transform(signals, lambda x: lpad({_PLACE}::VARCHAR, 2, '0') || x)), lambda x: substr(x, 3)), ' ') AS signals, score,
       CASE WHEN list_has_any(signals, ['bank_change', 'gift_cards']) THEN CASE WHEN list_contains(signals, 'trusted_domain') AND score < 50 THEN 'caution' ELSE 'high' END
            WHEN list_contains(signals, 'bank_change_quoted') AND score >= 60 THEN 'high'
            WHEN score >= 20 AND list_has_any(signals, ['bank_change_quoted', 'account_numbers', 'payment_request', 'lookalike_domain', 'display_name_spoof']) THEN 'caution'
            WHEN list_contains(signals, 'bank_change_quoted') THEN 'caution' ELSE 'none' END AS level
FROM p
"""


def _nations(t):
    return t.nation.select("n_nationkey", F.concat(F.lower("n_name"), F.lit(" payables")).alias("name"), F.concat(F.regexp_replace(F.lower("n_name"), " ", ""), F.lit("-trade.com")).alias("home"))


@query("rk10_signals_from_text", _RK10)
def _(t):
    """A sentence in each whole document, in its sender's words or below a quotation; senders like, or unlike, those of 25 traders."""
    nations = _nations(t)
    p = F.col("doc_id") % 50
    words = F.element_at(F.array(*[F.lit(s) for s, _ in _SAID]), (F.col("doc_id") % len(_SAID) + 1).cast("int"))
    domain = F.when(p % 4 == 0, F.col("home")).when(p % 4 == 1, F.replace("home", F.lit(".com"), F.lit("x.com"))).when(p % 4 == 2, "gmail.com").otherwise(F.concat(F.lit("p"), p, F.lit(".org")))
    name = F.when(p % 3 == 0, F.initcap("name")).when(p % 3 == 1, F.expr("substr(name, 2)")).otherwise(F.concat(F.lit("Somebody "), p))
    docs = t.documents.join(F.broadcast(nations), F.col("doc_id") % 25 == F.col("n_nationkey"))  # 25 nations
    mail = docs.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("at"), F.lit("Your order").alias("subject"),
        F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, "\n\nFrom: a colleague\n").otherwise("\n\n"), words).alias("body"),
        name.alias("sender_name"), F.concat(F.lit("p"), p, F.lit("@"), domain).alias("sender"), F.when(F.col("doc_id") % 7 == 0, "pay@elsewhere.net").alias("reply_to"),
    )
    people = nations.select("name", F.concat(F.lit("office@"), "home").alias("address"))
    signals = F.col("found.signal")
    out = G.found(mail, people, nations.select(F.col("home").alias("domain"))).select("id", signals.alias("signals"), S.fraud(signals, F.create_map(F.lit("x"), F.lit(1.0)), F.lit("")).alias("f"))
    return out.select("id", F.array_join("signals", " ").alias("signals"), "f.score", "f.level")


_EX11 = f"""
WITH c AS (SELECT DISTINCT conv_id FROM conversations),
g AS (SELECT conv_id, CASE WHEN conv_id % 4 = 3 AND conv_id - 1 IN (FROM c) THEN conv_id - 1 ELSE conv_id END AS thread FROM c),
m AS (SELECT conv_id * 1000 + turn AS id, thread, conv_id % 9 = 2 AND turn = 1 AS held, turn % 3 <> 0 AS cites, coalesce(text, '') AS said FROM conversations JOIN g USING (conv_id)),
h AS (SELECT DISTINCT thread FROM m WHERE held)
SELECT id, cites AND NOT held AND thread IN (FROM h) AS quotes_held,
       md5(CASE WHEN NOT cites THEN said WHEN held OR thread NOT IN (FROM h) THEN said || chr(10) || chr(10) || 'On Monday, a colleague wrote:' || chr(10) || '> ' || said
                ELSE ltrim(rtrim(said, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || chr(10) || '{H.LEFT_OUT}', chr(10)) END) AS read_md5
FROM m
"""


@query("ex11_quotes_of_held", _EX11)
def _(t):
    """Turns of conversations as mail that answers the turn before. Conversations 3, 7, 11 .. answer the end of the one before, and some hold a held mail; the threads come in two batches, answers first."""
    turns = t.conversations
    own = F.concat(F.lit("<"), F.col("conv_id"), F.lit("."), F.col("turn"), F.lit("@x>"))
    before = F.concat(F.lit("<"), F.col("conv_id"), F.lit("."), F.col("turn") - 1, F.lit("@x>"))
    said = F.coalesce("text", F.lit(""))
    body = F.when(F.col("turn") % 3 != 0, F.concat(said, F.lit("\n\nOn Monday, a colleague wrote:\n> "), said)).otherwise(said)
    mail = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), own.alias("message_id"), F.when(F.col("turn") > 0, before).alias("in_reply_to"), F.lit(None).cast("string").alias("refs"), body.alias("body"), ((F.col("conv_id") % 9 == 2) & (F.col("turn") == 1)).alias("held"))
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    joined = ends.filter("conv_id % 4 = 3").select("conv_id", (F.col("conv_id") - 1).alias("_c")).join(ends.select(F.col("conv_id").alias("_c"), "last"), "_c")
    across = joined.select((F.col("conv_id") * 1000).alias("id"), F.lit(None).cast("string").alias("message_id"), F.lit(None).cast("string").alias("in_reply_to"), F.concat(F.lit("<"), "_c", F.lit("."), "last", F.lit("@x>")).alias("refs"))
    heads = mail.select("id", "message_id", "in_reply_to", "refs").unionByName(across)
    late = F.col("id") % 1000 % 2 == 0
    first = H.merged(t.spark.createDataFrame([], H.NODES), H.edges(heads.filter(~late)))
    threads = H.merged(first, H.edges(heads.filter(late)))
    return H.readable(mail, threads).select("id", "quotes_held", F.md5(F.encode("read", "utf-8")).alias("read_md5"))
