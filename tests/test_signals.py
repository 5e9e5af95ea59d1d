"""Signals of fraud found in texts, and held mail followed along answers and quotations."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import held as H
from ledgerloom.operators import signals as G

PEOPLE = "name string, address string"
MAIL = "id bigint, at bigint, subject string, body string, sender_name string, sender string, reply_to string"


def signals(spark, rows, people=(("Ann Miller", "ann@acme.com"),), trusted=(("acme.com",),)):
    mail = spark.createDataFrame(rows, MAIL)
    out = G.found(mail, spark.createDataFrame(list(people), PEOPLE), spark.createDataFrame(list(trusted), "domain string"))
    return {r["id"]: {f["signal"]: f["detail"] for f in r["found"]} for r in out.collect()}


ASKED = [
    ("Our bank details have changed.", "bank_change"),
    ("Please note that from May\nour bank details have changed, pay the other account.", "bank_change"),
    ("We will never ask for codes, but our bank details have changed.", "bank_change"),
    ("Please use the new account number below.", "bank_change"),
    ("Not only that: kindly update our remittance information.", "bank_change"),
    ("Can you buy five Amazon gift cards for a client?", "gift_cards"),
    ("Gift cards are fine, send me the codes.", "gift_cards"),
    ("Kindly pay the attached invoice.", "payment_request"),
]
UNASKED = [
    "We will never change our bank details by email.",
    "If you receive an email saying our bank details have changed, call us.",
    "If you receive an email from us, or from anyone, saying our bank details have changed, call us.",
    "Beware of messages about new bank accounts.",
    "Any change of bank details must be confirmed by phone.",
    "Our bank details haven't changed.",
    "There is no change to our bank details.",
    "Please do not buy gift cards for anyone.",
    "Send the codes of the two warehouses.",
    "The embankment details were updated.",
    "Do not pay the invoice.",
    "",
]


def test_sentences_ask_or_warn(spark):
    rows = [(i, i, None, s, "x", f"u{i}@one.org", None) for i, s in enumerate([*[s for s, _ in ASKED], *UNASKED])]
    got = signals(spark, rows)
    for i, (s, signal) in enumerate(ASKED):
        assert signal in got[i], s
    for i, s in enumerate(UNASKED, len(ASKED)):
        assert not set(G.ASKS) & set(got[i]), s


def test_quoted_words_are_not_the_senders(spark):
    got = signals(spark, [(1, 1, "Re: x", "Is this right?\n\nFrom: Bo\nOur bank details have changed.", "x", "u@one.org", None), (2, 2, "Our bank details have changed", "See above.", "x", "v@one.org", None)])
    assert "bank_change_quoted" in got[1] and "bank_change" not in got[1]
    assert got[2]["bank_change"] == "bank details have changed"


def test_senders_who_pretend(spark):
    rows = [
        (1, 1, None, "Hello.", "Ann Miler", "ann@else.org", None),
        (2, 2, None, "Hello.", "Ann Miller", "ann@mail.acme.com", None),
        (3, 3, None, "Hello.", "ann@acme.com", "bo@else.org", "x@third.net"),
        (4, 4, None, "Hello.", "Bo", "bo@acmee.com", None),
        (5, 5, None, "Please buy gift cards.", None, "bo@gmail.com", None),
        (6, 6, None, "Please buy gift cards.", None, "bo@gmail.com", None),
        (7, 7, None, None, None, None, None),
        (8, 8, None, "Routing number: 021 000 021, keep this between us", "Bob", "no-reply@acme.com", "x@pay.acme.com"),
    ]
    got = signals(spark, rows, trusted=[("acme.com",), (None,)])
    assert got[1] == {"display_name_spoof": "ann@acme.com"}
    assert got[2] == {"trusted_domain": "mail.acme.com"}
    assert got[3] == {"reply_to_mismatch": "x@third.net", "display_name_spoof": "ann@acme.com"}
    assert got[4] == {"lookalike_domain": "acme.com"}
    assert set(got[5]) == {"gift_cards", "freemail_request", "first_contact"} and set(got[6]) == {"gift_cards", "freemail_request"}
    assert got[7] == {}
    assert set(got[8]) == {"account_numbers", "pressure", "automated_sender", "trusted_domain"}


@pytest.mark.parametrize("text", ["bank " * 60_000, "new " * 60_000, " " * 300_000 + "bank", "," * 200_000 + "wire", "pay x " * 50_000])
def test_very_long_sentences_end(spark, text):
    out = spark.range(1).select(F.lit(text).alias("t")).select(G.sentences(F.col("t")).alias("s"))
    assert len(out.select(*[G._first(F.col("s"), k).alias(k) for k in G.ASKS]).collect()) == 1


def test_threads_merge_by_batch_and_quotes_are_cut(spark):
    schema = "id bigint, message_id string, in_reply_to string, refs string, body string, held boolean"
    quote = "Fine.\r\n\r\nOn Mon, 3 May, Bo wrote:\r\n> pay here"
    batches = [
        [(1, "<a@x>", None, None, "pay here", True), (2, "<B@x>", "<A@x>", None, quote, False), (9, None, "", None, quote, False), (None, "<q@x>", "<a@x>", None, quote, None)],
        [(4, "<d@x>", "<c@x>", None, quote, False), (5, "<e@x>", None, "<d@x> <z@x>", "No quotation.", None), (6, "<z@x>", None, None, "> pay here", False)],
        [(3, "<c@x>", "<b@x>", None, quote, False), (7, "<f@x>", "<gone@x>", None, quote, False)],
        [(8, "<g@x>", "<gone@x>", None, None, True)],
        [],
    ]
    at = spark.createDataFrame([], H.NODES)
    near = []
    for i, batch in enumerate(batches):
        at = H.merged(at, H.edges(spark.createDataFrame(batch, schema)))
        mail = spark.createDataFrame([r for b in batches[: i + 1] for r in b], schema)
        near.append({r["id"] for r in H.readable(mail, at).collect() if r["quotes_held"]})
    assert near == [{2}, {2}, {2, 3, 4, 6}, {2, 3, 4, 6, 7}, {2, 3, 4, 6, 7}]
    read = {r["id"]: r["read"] for r in H.readable(mail.withColumn("read", F.lit("x")), at).collect()}
    assert read[4] == "Fine.\n\n" + H.LEFT_OUT and read[6] == H.LEFT_OUT
    assert (read[1], read[5], read[8], read[9], read[None]) == ("pay here", "No quotation.", None, quote, quote)


def test_merged_threads_are_those_of_brute_force(spark):
    import random

    draw = random.Random(5)
    pairs = [(f"m{draw.randrange(400)}", f"m{draw.randrange(400)}") for _ in range(330)] + [(f"p{i}", f"p{i + 1}") for i in range(300)]
    draw.shuffle(pairs)
    at = spark.createDataFrame([], H.NODES)
    for part in (pairs[:200], pairs[200:500], pairs[500:]):
        at = H.merged(at, spark.createDataFrame(part, "a string, b string"))
    group = {}
    for a, b in pairs:
        both = group.get(a, {a}) | group.get(b, {b})
        group.update(dict.fromkeys(both, both))
    rows = at.collect()
    assert len(rows) == len(group) and all(r["root"] in group[r["n"]] for r in rows)
    assert len({r["root"] for r in rows}) == len({id(g) for g in group.values()})
