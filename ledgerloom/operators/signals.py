"""Signals of payment fraud found in messages: what their sentences ask for, and who they pretend to come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .links import look_alikes

_GAP = r"(?:\W+\w+){0,5}?\W+"
_DETAILS = r"(?:(?:bank|banking|remittance|wire|wiring|payment|ach)\s+(?:details?|information|instructions?|accounts?|coordinates)|account\s+numbers?|iban|routing\s+numbers?|sort\s+codes?)"
_ALTERED = r"(?:new|chang(?:e|ed|ing)|updat(?:e|ed|ing)|switch(?:ed|ing)?|moved|revised?|replaced?|amended|different)"
_CARDS = r"(?:e-?)?(?:gift\s*cards?|gift\s+vouchers?|prepaid\s+cards?)"
#: What a clause asks for, by signal.
ASKS = {
    "bank_change": rf"(?:\b{_ALTERED}\b{_GAP}{_DETAILS}\b|\b{_DETAILS}\b{_GAP}{_ALTERED}\b|\bnew\s+bank\b(?!\s+(?:holiday|statement)))",
    "gift_cards": rf"(?:\b(?:buy|purchase|get|pick\s+up|order|grab)\b{_GAP}{_CARDS}\b|\b(?:send|text|email|forward|scratch)\b{_GAP}(?:codes?|pins?)\b)",
    "payment_request": rf"\b(?:pay|wire|transfer|remit|send|settle|process)\b{_GAP}(?:payments?|invoices?|funds|amount|money|balance)\b",
}
_ACCOUNT = r"\b(?:account|acct|iban|routing|aba|sort\s+code|swift)\b\W{0,3}(?:number|no|code)?\W{0,4}(?:is\s)?\W{0,2}[A-Z]{0,4}\d(?:[ -]?[0-9A-Z]){5,33}\b"
_PRESSURE = r"\b(?:urgent(?:ly)?|immediately|asap|right\s+away|within\s+the\s+hour|by\s+(?:the\s+)?end\s+of\s+(?:the\s+)?day|keep\s+this\s+(?:between\s+us|quiet)|(?:do\s+not|don't)\s+(?:call|tell|mention))\b"
#: What turns the words after it, to the end of the clause, into a warning, a condition or a denial.
_DENIED = r"\b(?:never|not(?!\s+only)|nor|without|any|if|whether|unless|beware|fraudsters?|scam(?:s|mers?)?|phishing|pretend(?:s|ing)?|no(?=\s+(?:changes?|new|updates?))|(?:do|does|did|has|have|had|is|was|are|were|wo|would|ca|could|should)n't)\b"
_HEARSAY = r"\b(?:saying|says|claiming|claims|stating|telling)\b"
_CUES = rf"\b(?:bank\w*|remittance|wir(?:e|ing)|payments?|ach|account|acct|iban|routing|aba|sort\s+code|swift|gift\w*|prepaid|e-?gift\w*|codes?|pins?|invoices?|funds|amount|money|balance)\b|{_PRESSURE}"
#: The order in which signals are listed.
ORDER = ("bank_change", "bank_change_quoted", "gift_cards", "account_numbers", "payment_request", "pressure", "freemail_request", "first_contact", "reply_to_mismatch", "lookalike_domain", "display_name_spoof", "automated_sender", "trusted_domain")


def _ci(pattern: str) -> str:
    return f"(?isU){pattern}"


def sentences(text: Column) -> Column:
    """The sentences of a text that hold any word a signal starts from; a line that goes on in lower case belongs to the one before."""
    joined = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), r"(?<!\n)\n[ \t]*(?=[a-z])", " ")
    return F.filter(F.split(joined, r"(?<=[.!?])\s+|\n"), lambda s: s.rlike(_ci(_CUES)))


def clauses(sentence: Column) -> Column:
    """The clauses of a sentence; one that reports what somebody says stays with the clause before."""
    return F.split(sentence, r"(?i)[,;:]\s++(?!(?:saying|claiming|stating|telling|that)\b)|\s(?=but\b)")


def asked(sentence: Column, signal: str) -> Column:
    """The words with which a sentence asks for something, null if it doesn't.

    A denial, warning or condition covers what follows it in its clause, up to the
    end of the words asked with. Where the sentence has one anywhere, what a clause
    only reports ("saying our bank details have changed") isn't asked either.
    """
    upto = lambda c: F.regexp_extract(c, _ci(rf"^(.*?{ASKS[signal]})"), 1)
    warned = sentence.rlike(_ci(_DENIED))

    def open_(c: Column) -> Column:
        return (upto(c) != "") & ~upto(c).rlike(_ci(_DENIED)) & ~(warned & upto(c).rlike(_ci(_HEARSAY)))

    first = F.get(F.filter(clauses(sentence), open_), F.lit(0))
    words = F.regexp_extract(first, _ci(f"({ASKS[signal]})"), 1)
    return F.when(sentence.rlike(_ci(_CARDS)), words) if signal == "gift_cards" else words


def _first(found: Column, signal: str) -> Column:
    return F.get(F.filter(F.transform(found, lambda s: asked(s, signal)), lambda w: w.isNotNull()), F.lit(0))


def _matched(found: Column, pattern: str) -> Column:
    return F.get(F.filter(F.transform(found, lambda s: F.regexp_extract(s, _ci(f"({pattern})"), 1)), lambda w: w != ""), F.lit(0))


def _domain(address: Column) -> Column:
    """The canonical domain of an address; null without one."""
    return F.when(address.contains("@"), T.canonical_domain(T.sender_domain(address)))


def trusted_domains(domains: DataFrame, trusted: DataFrame) -> DataFrame:
    """domains (domain) that are one of trusted (domain) or below one: suffixes meet trusted ones by equality."""
    labels = F.split("domain", r"\.")
    below = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = domains.select("domain", F.explode(below).alias("_suffix"))
    return keyed.join(trusted.select(T.canonical_domain(F.col("domain")).alias("_suffix")).distinct(), "_suffix").select("domain").distinct()


def borrowed_names(writers: DataFrame, people: DataFrame) -> DataFrame:
    """(name, domain, like) of writers (name, domain) whose name is within one edit of that of people (name, address) who all write from elsewhere.

    Names of fewer than five letters are not compared. Names meet by what is left
    when up to one character is dropped; like is the least of the addresses.
    """

    def keyed(df: DataFrame, c: str) -> DataFrame:
        v = F.col(c)
        cuts = F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))))
        return df.withColumn("_k", F.explode(F.array_distinct(F.concat(F.array(v), cuts))))

    fold = lambda c: F.regexp_replace(T.fold(F.trim(c)), r"\s+", " ")
    own = writers.select("name", "domain", fold(F.col("name")).alias("_n")).filter("length(_n) >= 5").distinct()
    known = people.select(fold(F.col("name")).alias("_m"), F.lower(F.trim("address")).alias("_a")).filter("length(_m) >= 5").distinct()
    near = keyed(own.select("_n").distinct(), "_n").join(keyed(known.select("_m").distinct(), "_m"), "_k").filter(F.levenshtein("_n", "_m") <= 1).select("_n", "_m").distinct()
    at = own.join(near, "_n").join(known, "_m")
    home = _domain(F.col("_a"))
    own_name = F.max(T.same_or_under(F.col("domain"), home) | T.same_or_under(home, F.col("domain")))
    return at.groupBy("name", "domain").agg(own_name.alias("_own"), F.min("_a").alias("like")).filter("not coalesce(_own, false)").select("name", "domain", "like")


def found(mail: DataFrame, people: DataFrame, trusted: DataFrame) -> DataFrame:
    """(id, found) of mail (id, at, subject, body, sender_name, sender, reply_to): found is an array of struct(signal, detail), in the order of ``ORDER``.

    people (name, address) are those whose names are known, trusted (domain) the
    domains trusted. Texts are read as rules read them, in one row each; the
    sender's own words are told from quoted ones. What concerns senders and
    domains is worked out once for each of them, and joined back. Nulls count as
    empty; ids are taken to be distinct. detail quotes the words found, or names
    whom the sender resembles.
    """
    plain = lambda c: T.plain_text(F.coalesce(F.col(c), F.lit("")))
    base = mail.select("id", "at", plain("subject").alias("_subject"), plain("body").alias("_body"), F.trim(plain("sender_name")).alias("name"), F.lower(F.trim("sender")).alias("sender"), F.lower(F.trim("reply_to")).alias("reply"))
    base = base.withColumn("domain", _domain(F.col("sender"))).withColumn("_reply", _domain(F.col("reply")))
    answer = F.col("_subject").rlike(r"(?i)^\s*(?:re|aw|fwd?|wg|tr)\s*:")
    own = F.concat_ws("\n", F.when(~answer, F.col("_subject")), T.own_words(F.col("_body")))
    read = base.select("id", "at", "name", "sender", "domain", "reply", "_reply", sentences(own).alias("_own"), sentences(F.concat_ws("\n", "_subject", "_body")).alias("_all"))
    said = read.select(
        "id", "at", "name", "sender", "domain", "reply", "_reply",
        *[_first(F.col("_own"), s).alias(s) for s in ASKS],
        _first(F.col("_all"), "bank_change").alias("_anywhere"),
        _matched(F.col("_own"), _ACCOUNT).alias("account_numbers"),
        _matched(F.col("_own"), _PRESSURE).alias("pressure"),
    )
    domains = said.select("domain").filter("domain is not null").distinct()
    safe = trusted_domains(domains, trusted)
    odd = domains.join(safe, "domain", "left_anti").filter(~F.col("domain").isin(*T.FREEMAIL))
    likes = look_alikes(odd, "domain", trusted.select(T.canonical_domain(F.col("domain")).alias("like")), "like").groupBy("domain").agg(F.min("like").alias("_like"))
    of_domain = domains.join(safe.withColumn("_safe", F.lit(True)), "domain", "left").join(likes, "domain", "left")
    first = mail.groupBy(F.lower(F.trim("sender")).alias("sender")).agg(F.min(F.struct("at", "id")).alias("_first"))
    names = borrowed_names(said.filter("domain is not null").select("name", "domain").distinct(), people).withColumnRenamed("like", "_borrowed")
    at = said.join(of_domain, "domain", "left").join(first, "sender", "left").join(names, ["name", "domain"], "left")

    safe_ = F.coalesce("_safe", F.lit(False))
    quoted = F.col("bank_change").isNull() & F.col("_anywhere").isNotNull()
    core = F.col("bank_change").isNotNull() | F.col("gift_cards").isNotNull()
    money = core | quoted | F.col("payment_request").isNotNull() | F.col("account_numbers").isNotNull()
    new = (F.col("_first.at") == F.col("at")) & (F.col("_first.id") == F.col("id"))
    shown = F.lower(F.regexp_extract("name", r"([\w.+-]+@[\w-]+(?:\.[\w-]+)+)", 1))
    other = (shown != "") & (shown != F.coalesce("sender", F.lit("")))
    elsewhere = ~T.same_or_under(F.col("_reply"), F.col("domain")) & ~T.same_or_under(F.col("domain"), F.col("_reply"))
    details = {
        "bank_change": F.col("bank_change"),
        "bank_change_quoted": F.when(quoted, F.col("_anywhere")),
        "gift_cards": F.col("gift_cards"),
        "account_numbers": F.col("account_numbers"),
        "payment_request": F.col("payment_request"),
        "pressure": F.col("pressure"),
        "freemail_request": F.when(F.col("domain").isin(*T.FREEMAIL) & money, F.col("domain")),
        "first_contact": F.when(new & core, F.col("sender")),
        "reply_to_mismatch": F.when(elsewhere, F.col("reply")),
        "lookalike_domain": F.col("_like"),
        "display_name_spoof": F.when(other, shown).when(~safe_, F.col("_borrowed")),
        "automated_sender": F.when(F.col("sender").rlike(r"^(?:no-?reply|do-?not-?reply|notifications?)\b") & (~new | safe_) & F.col("bank_change").isNull() & ~quoted, F.col("sender")),
        "trusted_domain": F.when(safe_ & ~F.coalesce(elsewhere, F.lit(False)), F.col("domain")),
    }
    return at.select("id", F.array_compact(F.array(*[F.when(details[s].isNotNull(), F.struct(F.lit(s).alias("signal"), details[s].alias("detail"))) for s in ORDER])).alias("found"))
