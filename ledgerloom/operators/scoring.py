"""Classes, scores and levels of messages by weighted rules, as column expressions over rule tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes, their weights, and the words that speak for them.
RULES = {
    "payment_change": (120, ["new bank", "changed account", "update payment", "bank details"]),
    "tax": (95, ["tax notice", "form 1099", "vat return", "irs"]),
    "audit": (90, ["auditor", "audit request", "pbc list"]),
    "remittance": (86, ["remittance", "payment advice", "paid invoices"]),
    "payroll": (84, ["payroll", "payslip", "timesheet"]),
    "bank_statement": (82, ["bank statement", "account statement", "opening balance"]),
    "wire": (80, ["wire transfer", "ach", "swift"]),
    "bank_reconciliation": (80, ["reconciliation", "outstanding checks"]),
    "ap_invoice": (78, ["invoice", "amount due", "remit to", "bill to", "due date", "net 30"]),
    "credit_memo": (76, ["credit memo", "credit note"]),
    "purchase_order": (74, ["purchase order", "ship to"]),
    "expense": (72, ["expense report", "receipts"]),
    "approval": (70, ["please approve", "approval"]),
    "packing": (62, ["packing slip", "delivery note"]),
    "contract": (60, ["agreement", "contract"]),
    "insurance": (58, ["certificate of insurance", "policy number"]),
    "workpaper": (55, ["trial balance", "lead sheet"]),
    "meeting": (50, ["meeting", "invitation", "agenda"]),
    "reply": (45, ["let me know", "your thoughts"]),
    "newsletter": (40, ["unsubscribe", "newsletter"]),
    "notification": (36, ["do not reply", "automated message"]),
    "fyi": (34, ["fyi", "for your information"]),
}


def says(text: Column, phrase: str) -> Column:
    """Whether a text has a phrase as whole words, whatever its case: "first" doesn't say irs."""
    return F.coalesce(text.rlike(rf"(?i)(?<!\w)\Q{phrase}\E(?!\w)"), F.lit(False))


def _layers(phrases: Sequence[str]) -> list[list[str]]:
    """The phrases dealt so that none begins another of its layer: at one place of a text, a pattern of a layer then has at most one match."""
    out: list[list[str]] = []
    for p in sorted(set(phrases)):
        fits = next((x for x in out if not any(p.startswith(q) or q.startswith(p) for q in x)), None)
        out.append([p]) if fits is None else fits.append(p)
    return out


def said(text: Column, phrases: Sequence[str]) -> Column:
    """array<string>: the phrases, in small letters, that a text has as whole words, whatever its case, each once.

    One pass of the text finds them all, as the pattern only looks ahead: phrases that share words are all found.
    """
    found = [F.regexp_extract_all(text, F.lit(r"(?i)(?<!\w)(?=(" + "|".join(rf"\Q{p}\E" for p in x) + r")(?!\w))"), 1) for x in _layers(phrases)]
    return F.transform(F.array_distinct(F.flatten(F.array(*[F.coalesce(f, F.array().cast("array<string>")) for f in found]))), lambda h: F.lower(h))


def classify(text: Column, name: Column, is_file: Column) -> Column:
    """struct(kind, confidence): the class with the most points, null without any.

    Points are the weight, 25 more where the file's name has one of the words,
    and 5 for each word found beyond three, up to four times. Words count as whole
    words; in a file's name _ and digits part words too.

    Text and name are read once each, and only the classes of what was found
    there are looked at; each step's result is bound by a transform, so that it is
    worked out once.
    """
    file = F.regexp_replace(F.coalesce(name, F.lit("")), r"[_\d]+", " ")
    phrases = [w for _, words in RULES.values() for w in words]
    table = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    weights = F.array(*[F.lit(weight) for weight, _ in RULES.values()])
    kinds = F.array(*[F.lit(kind) for kind in RULES])
    top, base = F.when(is_file, 0.98).otherwise(0.9), F.when(is_file, 0.35).otherwise(0.3)

    def places(found: Column) -> Column:
        """The class of each phrase found, by its place; a phrase of several classes counts for each."""
        of = table([(w, ",".join(str(at) for at, (_, words) in enumerate(RULES.values()) if w in words)) for w in dict.fromkeys(phrases)])
        return F.split(F.array_join(F.transform(found, lambda p: F.try_element_at(of, p)), ","), ",").cast("array<int>")

    def best(hits: Column) -> Column:
        every = F.transform(F.array(F.struct(places(F.array_union(hits["text"], hits["file"])).alias("all"), F.when(F.size(hits["file"]) > 0, places(hits["file"])).otherwise(F.array().cast("array<int>")).alias("file"))), ranked)
        return F.when((F.size(hits["text"]) > 0) | (F.size(hits["file"]) > 0), F.get(every, F.lit(0)))

    def ranked(at: Column) -> Column:
        n = lambda k: F.size(F.filter(at["all"], lambda x: x == k))
        more = lambda k: F.when(F.array_contains(at["file"], k), 25).otherwise(0)
        return F.array_max(F.transform(F.array_distinct(at["all"]), lambda k: F.struct((F.get(weights, k) + more(k) + 5 * F.least(F.lit(4), F.greatest(F.lit(0), n(k) - 3))).alias("points"), (-k).alias("at"))))

    hits = F.array(F.struct(said(text, phrases).alias("text"), said(file, phrases).alias("file")))
    told = lambda b: F.when(b.isNotNull(), F.struct(F.get(kinds, -b["at"]).alias("kind"), F.least(top, base + b["points"] / 180).alias("confidence")))
    return F.get(F.transform(F.transform(hits, best), told), F.lit(0))


#: Points of a class and of a flag.
CLASS_POINTS = {"tax": 40, "audit": 35, "wire": 32, "approval": 24, "payroll": 22, "ap_invoice": 18, "reply": 16, "remittance": 14, "bank_statement": 12, "meeting": 6, "notification": -18, "newsletter": -20, "fyi": -20}


def importance(kind: Column, amount: Column, due: Column, as_of: Column, *, missing: Column, duplicate: Column, high: Column, vip: Column, urgent: Column, fraud: Column, threshold: float = 50_000.0) -> Column:
    """struct(score, level): points added up between 0 and 99, 100 for possible fraud."""
    no = lambda c: F.coalesce(c, F.lit(False))
    score = F.lit(30)
    for name, points in CLASS_POINTS.items():
        score = score + F.when(kind == name, points).otherwise(0)
    for flag, points in ((missing, 15), (duplicate, 20), (high, 10), (vip, 12), (urgent, 8), (amount >= threshold, 18), (amount >= 5 * threshold, 10)):
        score = score + F.when(no(flag), points).otherwise(0)
    days = F.date_diff(due, as_of)
    score = score + F.when(days < 0, 25).when(days == 0, 22).when(days <= 3, 16).when(days <= 7, 10).otherwise(0)
    close = F.date_diff(F.last_day(as_of), as_of) <= 7
    score = score + F.when(close & kind.isin("bank_statement", "bank_reconciliation", "workpaper", "ap_invoice", "payroll"), 12).otherwise(0)
    score = F.when(no(fraud) | (kind == "payment_change"), 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(99), score)))
    level = F.when(score >= 85, "critical").when(score >= 62, "high").when(score >= 38, "medium").otherwise("low")
    return F.struct(score.cast("int").alias("score"), level.alias("level"))


#: Points of the signals of possible fraud.
SIGNALS = {
    "bank_change": 50,
    "bank_change_quoted": 10,
    "bank_change_attachment": 20,
    "gift_cards": 35,
    "account_numbers": 12,
    "payment_request": 5,
    "reply_to_mismatch": 25,
    "lookalike_domain": 40,
    "display_name_spoof": 25,
    "freemail_request": 10,
    "pressure": 10,
    "first_contact": 10,
    "reported": 60,
    "automated_sender": -20,
    "trusted_domain": -30,
    "trusted_sender": -60,
}
CORE = ("bank_change", "gift_cards")
QUOTED = ("bank_change_quoted", "bank_change_attachment")
CONTEXT = (*CORE, *QUOTED, "account_numbers", "payment_request", "lookalike_domain", "display_name_spoof", "reported")


def learned_weights(verdicts: DataFrame) -> DataFrame:
    """(signal, weight) from verdicts (signals array, fraud boolean): 1 and 0.15 for each fraud verdict more than safe ones, between a floor and 1.6; core signals never weaken."""
    each = verdicts.select(F.explode("signals").alias("signal"), "fraud").filter(F.col("signal").isin(*[k for k, p in SIGNALS.items() if p > 0 and k != "reported"]))
    tally = each.groupBy("signal").agg(F.sum(F.when(F.col("fraud"), 1).otherwise(-1)).alias("n"))
    floor = F.when(F.col("signal").isin(*CORE), 1.0).otherwise(0.5)
    return tally.select("signal", F.round(F.greatest(floor, F.least(F.lit(1.6), 1 + 0.15 * F.col("n"))), 2).alias("weight"))


def fraud(signals: Column, weights: Column, verdict: Column) -> Column:
    """struct(score, level) of an array of signals, given a map of learned weights and the user's verdict."""
    points = F.create_map(*[F.lit(x) for pair in SIGNALS.items() for x in pair])
    weighted = F.transform(signals, lambda s: F.when(points[s] > 0, F.round(points[s] * F.coalesce(weights[s], F.lit(1.0))).cast("int")).otherwise(points[s]))
    score = F.greatest(F.lit(0), F.aggregate(weighted, F.lit(0), lambda a, x: a + x))
    has = lambda names: F.arrays_overlap(signals, F.array(*[F.lit(n) for n in names]))
    bank, trust = has(("bank_change", *QUOTED)), has(("trusted_domain", "trusted_sender"))
    level = (
        F.when((verdict == "fraud") | has(("reported",)), "high")
        .when((verdict == "safe") & bank, "caution")
        .when(verdict == "safe", "none")
        .when(has(CORE), F.when(~trust | (score >= 50), "high").otherwise("caution"))
        .when(has(QUOTED) & (score >= 60), "high")
        .when(has(CONTEXT) & (score >= 20), "caution")
        .when(has(("bank_change_quoted",)), "caution")
        .otherwise("none")
    )
    return F.struct(score.alias("score"), level.alias("level"))


def folder(kind: Column, level: Column, fraud_level: Column) -> Column:
    """The folder a message is filed in, by the first rule that fits."""
    return (
        F.when(fraud_level == "high", "Held")
        .when(fraud_level == "caution", "Check first")
        .when(kind.isin("ap_invoice", "credit_memo", "purchase_order", "packing"), "Payables")
        .when(kind.isin("remittance", "bank_statement", "bank_reconciliation", "wire"), "Bank")
        .when(kind.isin("tax", "audit", "workpaper"), "Close")
        .when(level.isin("critical", "high"), "Today")
        .when(kind.isin("newsletter", "notification", "fyi"), "Later")
        .otherwise("Inbox")
    )


def due_priority(rank: Column, days: Column) -> Column:
    """A task's priority (0 low, 1 medium, 2 high) raised by its due date: at least high within two days, medium within seven; never lowered."""
    return F.greatest(rank, F.when(days <= 2, 2).when(days <= 7, 1).otherwise(0))


def trust(history: DataFrame, verdicts: DataFrame, often: int = 3) -> DataFrame:
    """(domain, mails, frequent, trusted, reported): what is known of each sender domain, from mail (domain, held) and verdicts (domain, fraud, at); the latest verdict counts."""
    seen = history.groupBy("domain").agg(F.count_if(~F.col("held")).alias("mails"))
    said = verdicts.groupBy("domain").agg(F.max_by("fraud", "at").alias("fraud"))
    both = seen.join(said, "domain", "full")
    return both.select("domain", F.coalesce("mails", F.lit(0)).alias("mails"), (F.coalesce("mails", F.lit(0)) >= often).alias("frequent"), F.coalesce(~F.col("fraud"), F.lit(False)).alias("trusted"), F.coalesce("fraud", F.lit(False)).alias("reported"))


def corrected(mail: DataFrame, corrections: DataFrame) -> DataFrame:
    """mail (id, sender, kind, confidence, fraud_level) with the latest correction for the message, else for its sender: confidence 0.99; a fraud level stays."""
    own = corrections.filter("id is not null").groupBy("id").agg(F.max_by("to_kind", "at").alias("_own"))
    sender = corrections.groupBy("sender").agg(F.max_by("to_kind", "at").alias("_sender"))
    at = mail.join(own, "id", "left").join(sender, "sender", "left").withColumn("_to", F.coalesce("_own", "_sender"))
    return at.select("id", "sender", F.coalesce("_to", "kind").alias("kind"), F.when(F.col("_to").isNotNull(), 0.99).otherwise(F.col("confidence")).alias("confidence"), "fraud_level")


def past_answers(pairs: DataFrame, asked: list[str], most: int = 3) -> DataFrame:
    """The past (id, question, answer) pairs that share enough words with a question: 2 for each word of the question, 1 for each of the answer."""
    q = F.array_distinct(F.array(*[F.lit(w.lower()) for w in asked]))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(\w+)"), 1))
    in_question, in_answer = F.size(F.array_intersect(q, words(F.col("question")))), F.size(F.array_intersect(q, words(F.col("answer"))))
    shared = F.size(F.array_intersect(q, F.array_union(words(F.col("question")), words(F.col("answer")))))
    scored = pairs.filter(shared >= F.least(F.lit(2), F.size(q))).withColumn("score", 2 * in_question + in_answer)
    return scored.orderBy(F.desc("score"), "id").limit(most).select("id", "score")


def cost_codes(mail: DataFrame, codes: DataFrame, confirmed: DataFrame) -> DataFrame:
    """mail (id, sender, text) with ``code`` and ``why``: a listed code its text prints, else the last one confirmed for the sender, else that whose description shares most words with the text (two at least)."""
    words = mail.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\w+)"), 1))).alias("w"))
    printed = words.join(codes.select(F.lower("code").alias("w"), "code"), "w").groupBy("id").agg(F.min("code").alias("_printed"))
    last = confirmed.groupBy("sender").agg(F.max_by("code", "at").alias("_last"))
    of = codes.select("code", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("description"), F.lit(r"(\w+)"), 1))).alias("w"))
    shared = words.join(of, "w").groupBy("id", "code").agg(F.count("*").alias("n")).filter("n >= 2")
    best = shared.groupBy("id").agg(F.min(F.struct(-F.col("n"), "code")).alias("_b")).select("id", F.col("_b")["code"].alias("_best"))
    at = mail.join(printed, "id", "left").join(last, "sender", "left").join(best, "id", "left")
    why = F.when(F.col("_printed").isNotNull(), "printed").when(F.col("_last").isNotNull(), "confirmed").when(F.col("_best").isNotNull(), "described")
    return at.select("id", F.coalesce("_printed", "_last", "_best").alias("code"), why.alias("why"))
