"""Classes, scores, trust and corrections, over messages made of the test tables' columns."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import scoring as S
from ..registry import query

_KINDS = list(S.RULES)
_TEXT = ["invoice amount due remit to bill to", "please approve", "bank statement", "new bank details", "hello there", "trial balance and lead sheet", "fyi", "newsletter unsubscribe", "payslip", "agenda", "The first of each machine: reach the auditorium swiftly", "IRS: Form 1099, ACH", "pay-roll or (payroll)?"]
_NAME = ["", "invoice_2024.pdf", "policy number.txt", "Invoices-each.pdf"]


def _sql_rules() -> str:
    """Texts are held as their words with a space on each side, so that phrases are found between spaces."""
    parts = []
    for i, (kind, (weight, words)) in enumerate(S.RULES.items()):
        found = " + ".join(f"(contains(wx, ' {w} ') OR contains(wf, ' {w} '))::INT" for w in words)
        named = " OR ".join(f"contains(wf, ' {w} ')" for w in words)
        parts.append(f"SELECT id, '{kind}' AS kind, {i} AS place, {weight} + CASE WHEN {named} THEN 25 ELSE 0 END + 5 * least(4, greatest(0, n - 3)) AS points FROM (SELECT *, {found} AS n FROM spaced) WHERE n > 0")
    return " UNION ALL ".join(parts)


def _pick(values: list[str], key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _picked(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


_MESSAGES = f"m AS (SELECT o_orderkey AS id, {_pick(_TEXT, 'o_orderkey')} || CASE WHEN o_custkey % 4 = 0 THEN ' due date net 30' ELSE '' END AS x, {_pick(_NAME, 'o_custkey')} AS f FROM orders), spaced AS (SELECT *, ' ' || array_to_string(regexp_extract_all(lower(x), '[a-z0-9]+'), ' ') || ' ' AS wx, ' ' || array_to_string(regexp_extract_all(lower(f), '[a-z]+'), ' ') || ' ' AS wf FROM m)"


@query("rk07_classes", f"WITH {_MESSAGES}, p AS ({_sql_rules()}), b AS (SELECT id, max(points) AS points, arg_min(kind, place - 100 * points) AS kind FROM p GROUP BY id) SELECT id, kind, round(CASE WHEN f <> '' THEN least(0.98, 0.35 + points / 180) ELSE least(0.9, 0.3 + points / 180) END, 4) AS confidence FROM b JOIN m USING (id)")
def _(t):
    text = F.concat(_picked(_TEXT, F.col("o_orderkey")), F.when(F.col("o_custkey") % 4 == 0, " due date net 30").otherwise(""))
    name = _picked(_NAME, F.col("o_custkey"))
    c = S.classify(text, name, name != "")
    # an exploded class is worked out once; a filter on it would be moved below and work it out again
    told = t.orders.select(F.col("o_orderkey").alias("id"), F.explode(F.array_compact(F.array(c))).alias("c"))
    return told.select("id", "c.kind", F.round("c.confidence", 4).alias("confidence"))


@query(
    "rk08_rule_weights",
    f"WITH {_MESSAGES}, p AS ({_sql_rules()}), b AS (SELECT id, arg_min(kind, place - 100 * points) AS kind FROM p GROUP BY id) SELECT v.kind, weight, words, count(id) AS messages FROM (VALUES "
    + ", ".join(f"('{k}', {w}, {len(words)}::BIGINT)" for k, (w, words) in S.RULES.items()) + ") AS v(kind, weight, words) LEFT JOIN b ON b.kind = v.kind GROUP BY ALL",
)
def _(t):
    """The classes with their weights, and how many messages each of them gets. Messages of the same words are counted first and told a class once."""
    text = F.concat(_picked(_TEXT, F.col("o_orderkey")), F.when(F.col("o_custkey") % 4 == 0, " due date net 30").otherwise(""))
    name = _picked(_NAME, F.col("o_custkey"))
    messages = t.orders.select(text.alias("text"), name.alias("name")).groupBy("text", "name").agg(F.count("*").alias("n"))
    # exploded, as in rk07_classes: the join's filter on the class would work it out again
    told = messages.select(F.explode(F.array_compact(F.array(S.classify(F.col("text"), F.col("name"), F.col("name") != "")))).alias("c"), "n")
    counts = told.groupBy(F.col("c.kind").alias("_kind")).agg(F.sum("n").alias("_n"))
    rules = t.spark.createDataFrame([(k, w, len(words)) for k, (w, words) in S.RULES.items()], "kind string, weight int, words bigint")
    return rules.join(counts, F.col("kind") == F.col("_kind"), "left").select("kind", "weight", "words", F.coalesce("_n", F.lit(0)).alias("messages"))


_CLASS_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {p}" for k, p in S.CLASS_POINTS.items()) + " ELSE 0 END"


@query("rk09_importance_levels", f"WITH m AS (SELECT o_orderkey AS id, {_pick(_KINDS, 'o_orderkey')} AS kind, o_totalprice AS amount, date_diff('day', DATE '1996-05-28', o_orderdate::DATE) AS days, o_orderkey % 5 = 0 AS missing, o_custkey % 6 = 0 AS duplicate, o_orderpriority = '1-URGENT' AS urgent, o_custkey % 50 = 0 AS fraud FROM orders), s AS (SELECT id, CASE WHEN fraud OR kind = 'payment_change' THEN 100 ELSE greatest(0, least(99, 30 + {_CLASS_SQL} + missing::INT * 15 + duplicate::INT * 20 + urgent::INT * 8 + (amount >= 50000)::INT * 18 + (amount >= 250000)::INT * 10 + CASE WHEN days < 0 THEN 25 WHEN days = 0 THEN 22 WHEN days <= 3 THEN 16 WHEN days <= 7 THEN 10 ELSE 0 END + CASE WHEN kind IN ('bank_statement', 'bank_reconciliation', 'workpaper', 'ap_invoice', 'payroll') THEN 12 ELSE 0 END)) END AS score FROM m) SELECT id, score, CASE WHEN score >= 85 THEN 'critical' WHEN score >= 62 THEN 'high' WHEN score >= 38 THEN 'medium' ELSE 'low' END AS level FROM s")
def _(t):
    o, no = t.orders, F.lit(False)
    i = S.importance(_picked(_KINDS, F.col("o_orderkey")), F.col("o_totalprice"), F.to_date("o_orderdate"), F.lit("1996-05-28").cast("date"), missing=F.col("o_orderkey") % 5 == 0, duplicate=F.col("o_custkey") % 6 == 0, high=no, vip=no, urgent=F.col("o_orderpriority") == "1-URGENT", fraud=F.col("o_custkey") % 50 == 0)
    return o.select(F.col("o_orderkey").alias("id"), i.alias("i")).select("id", "i.score", "i.level")


_SIGNS = [("bank_change", "o_orderkey % 13 = 0"), ("bank_change_quoted", "o_orderkey % 7 = 0"), ("lookalike_domain", "o_custkey % 9 = 0"), ("payment_request", "o_orderkey % 2 = 0"), ("pressure", "o_custkey % 4 = 0"), ("trusted_domain", "o_custkey % 5 = 0"), ("first_contact", "o_custkey % 3 = 0"), ("reported", "o_custkey % 41 = 0")]
_POINTS_SQL = " + ".join(f"CASE WHEN {c} THEN {S.SIGNALS[k] if S.SIGNALS[k] < 0 else f'round({S.SIGNALS[k]} * ' + {'pressure': '1.3', 'bank_change': '1.2'}.get(k, '1.0') + ')'} ELSE 0 END" for k, c in _SIGNS)
_HAS = dict(_SIGNS)


@query("rk10_fraud_levels", f"WITH s AS (SELECT *, greatest(0, {_POINTS_SQL})::INT AS score, CASE WHEN o_orderkey % 29 = 0 THEN 'safe' WHEN o_orderkey % 31 = 0 THEN 'fraud' ELSE '' END AS verdict FROM orders) SELECT o_orderkey AS id, score, CASE WHEN verdict = 'fraud' OR {_HAS['reported']} THEN 'high' WHEN verdict = 'safe' AND ({_HAS['bank_change']} OR {_HAS['bank_change_quoted']}) THEN 'caution' WHEN verdict = 'safe' THEN 'none' WHEN {_HAS['bank_change']} THEN CASE WHEN NOT {_HAS['trusted_domain']} OR score >= 50 THEN 'high' ELSE 'caution' END WHEN {_HAS['bank_change_quoted']} AND score >= 60 THEN 'high' WHEN score >= 20 AND ({_HAS['bank_change_quoted']} OR {_HAS['payment_request']} OR {_HAS['lookalike_domain']}) THEN 'caution' WHEN {_HAS['bank_change_quoted']} THEN 'caution' ELSE 'none' END AS level FROM s")
def _(t):
    signals = F.array_compact(F.array(*[F.when(F.expr(c), k) for k, c in _SIGNS]))
    weights = F.create_map(F.lit("pressure"), F.lit(1.3), F.lit("bank_change"), F.lit(1.2))
    verdict = F.when(F.col("o_orderkey") % 29 == 0, "safe").when(F.col("o_orderkey") % 31 == 0, "fraud").otherwise("")
    return t.orders.select(F.col("o_orderkey").alias("id"), S.fraud(signals, weights, verdict).alias("f")).select("id", "f.score", "f.level")


@query("rk11_folders", f"SELECT id, CASE WHEN fl = 'high' THEN 'Held' WHEN fl = 'caution' THEN 'Check first' WHEN kind IN ('ap_invoice', 'credit_memo', 'purchase_order', 'packing') THEN 'Payables' WHEN kind IN ('remittance', 'bank_statement', 'bank_reconciliation', 'wire') THEN 'Bank' WHEN kind IN ('tax', 'audit', 'workpaper') THEN 'Close' WHEN level IN ('critical', 'high') THEN 'Today' WHEN kind IN ('newsletter', 'notification', 'fyi') THEN 'Later' ELSE 'Inbox' END AS folder FROM (SELECT o_orderkey AS id, {_pick(_KINDS, 'o_orderkey')} AS kind, CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END AS level, CASE WHEN o_custkey % 17 = 0 THEN 'high' WHEN o_custkey % 19 = 0 THEN 'caution' ELSE 'none' END AS fl FROM orders)")
def _(t):
    level, held = F.when(F.col("o_totalprice") > 200000, "high").otherwise("low"), F.when(F.col("o_custkey") % 17 == 0, "high").when(F.col("o_custkey") % 19 == 0, "caution").otherwise("none")
    return t.orders.select(F.col("o_orderkey").alias("id"), S.folder(_picked(_KINDS, F.col("o_orderkey")), level, held).alias("folder"))


@query("ag30_signal_weights", "WITH e AS (SELECT unnest(['pressure', CASE WHEN o_custkey % 3 = 0 THEN 'bank_change' ELSE 'first_contact' END, 'reported']) AS signal, o_orderkey % 2 = 0 AS fraud FROM orders), n AS (SELECT signal, sum(CASE WHEN fraud THEN 1 ELSE -1 END) AS n FROM e WHERE signal <> 'reported' GROUP BY signal) SELECT signal, round(greatest(CASE WHEN signal = 'bank_change' THEN 1.0 ELSE 0.5 END, least(1.6, 1 + 0.15 * n)), 2) AS weight FROM n")
def _(t):
    signals = F.array(F.lit("pressure"), F.when(F.col("o_custkey") % 3 == 0, "bank_change").otherwise("first_contact"), F.lit("reported"))
    return S.learned_weights(t.orders.select(signals.alias("signals"), (F.col("o_orderkey") % 2 == 0).alias("fraud")))


@query("ex07_rescored_senders", "WITH v AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 97 = 0) SELECT o_orderkey AS id, CASE WHEN v.o_custkey IS NULL THEN 10 ELSE 70 END AS score FROM orders o LEFT JOIN v USING (o_custkey)")
def _(t):
    marked = t.orders.filter("o_orderkey % 97 = 0").select("o_custkey").distinct().withColumn("reported", F.lit(True))
    at = t.orders.join(marked, "o_custkey", "left")
    signals = F.array_compact(F.array(F.lit("first_contact"), F.when(F.col("reported"), "reported")))
    return at.select(F.col("o_orderkey").alias("id"), S.fraud(signals, F.create_map(F.lit("x"), F.lit(1.0)), F.lit(""))["score"].alias("score"))


@query("ex08_trust", "WITH s AS (SELECT 'd' || (o_custkey % 60) AS domain, count(*) FILTER (WHERE o_orderkey % 10 <> 0) AS mails FROM orders GROUP BY 1), v AS (SELECT 'd' || (s_suppkey % 80) AS domain, arg_max(s_nationkey % 2 = 0, s_suppkey) AS fraud FROM supplier GROUP BY 1) SELECT coalesce(s.domain, v.domain) AS domain, coalesce(mails, 0) AS mails, coalesce(mails, 0) >= 3 AS frequent, coalesce(NOT fraud, false) AS trusted, coalesce(fraud, false) AS reported FROM s FULL JOIN v ON s.domain = v.domain")
def _(t):
    mail = t.orders.select(F.concat(F.lit("d"), F.col("o_custkey") % 60).alias("domain"), (F.col("o_orderkey") % 10 == 0).alias("held"))
    verdicts = t.supplier.select(F.concat(F.lit("d"), F.col("s_suppkey") % 80).alias("domain"), (F.col("s_nationkey") % 2 == 0).alias("fraud"), F.col("s_suppkey").alias("at"))
    return S.trust(mail, verdicts)


@query("ex09_verdict_spread", "SELECT c_custkey, max(s_nationkey % 2 = 0) AS fraud FROM customer JOIN (SELECT arg_max(s_nationkey, s_suppkey) AS s_nationkey, s_suppkey % 10 AS k FROM supplier GROUP BY k) ON c_custkey % 20 = k GROUP BY c_custkey")
def _(t):
    said = t.supplier.groupBy((F.col("s_suppkey") % 10).alias("k")).agg(F.max_by("s_nationkey", "s_suppkey").alias("n"))
    return t.customer.join(said, F.col("c_custkey") % 20 == F.col("k")).select("c_custkey", (F.col("n") % 2 == 0).alias("fraud"))


@query("ex10_gift_cards", "SELECT c_custkey, c_custkey % 3 = 0 AS asks FROM customer")
def _(t):
    notice = "This notice is about gift cards: never buy them for anyone. "
    said = F.concat(F.lit(notice), F.when(F.col("c_custkey") % 3 == 0, "Please buy five gift cards today. ").otherwise("Thanks for the report. "), "c_name")
    own = F.filter(F.split(said, r"(?<=[.!?])\s+"), lambda s: ~s.rlike(r"(?i)\bnever\b|\bnotice\b"))
    return t.customer.select("c_custkey", F.array_join(own, " ").rlike(r"(?i)\b(buy|get|send)\b.{0,40}\bgift cards?\b").alias("asks"))


@query("ex11_neighbours_of_held", "WITH h AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 50 = 0) SELECT o_orderkey AS id FROM orders JOIN h USING (o_custkey) WHERE o_orderkey % 50 <> 0")
def _(t):
    held = t.orders.filter("o_orderkey % 50 = 0").select("o_custkey")
    return t.orders.filter("o_orderkey % 50 <> 0").join(held, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("id"))


@query("ex12_corrections", "WITH c AS (SELECT CASE WHEN l_linenumber = 1 THEN l_orderkey END AS id, l_suppkey AS sender, l_returnflag AS k, l_orderkey * 10 + l_linenumber AS stamp FROM lineitem WHERE l_linenumber IN (1, 2) AND l_orderkey % 5 = 0), own AS (SELECT id, arg_max(k, (stamp, k)) AS k FROM c WHERE id IS NOT NULL GROUP BY id), s AS (SELECT sender, arg_max(k, (stamp, k)) AS k FROM c GROUP BY sender) SELECT o_orderkey AS id, o_custkey AS sender, coalesce(own.k, s.k, o_orderstatus) AS kind, CASE WHEN coalesce(own.k, s.k) IS NULL THEN 0.5 ELSE 0.99 END AS confidence, 'caution' AS fraud_level FROM orders LEFT JOIN own ON o_orderkey = own.id LEFT JOIN s ON o_custkey = s.sender")
def _(t):
    lines = t.lineitem.filter("l_linenumber in (1, 2) and l_orderkey % 5 = 0")
    fixes = lines.groupBy("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").count().select(F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")).alias("id"), F.col("l_suppkey").alias("sender"), F.col("l_returnflag").alias("to_kind"), F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_returnflag").alias("at"))
    mail = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sender"), F.col("o_orderstatus").alias("kind"), F.lit(0.5).alias("confidence"), F.lit("caution").alias("fraud_level"))
    return S.corrected(mail, fixes)


@query("ex36_due_priorities", "SELECT o_orderkey AS id, greatest(CASE WHEN o_orderpriority = '1-URGENT' THEN 2 WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END, CASE WHEN d <= 2 THEN 2 WHEN d <= 7 THEN 1 ELSE 0 END) AS priority FROM (SELECT *, date_diff('day', DATE '1996-05-15', o_orderdate::DATE) AS d FROM orders)")
def _(t):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 2).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0)
    return t.orders.select(F.col("o_orderkey").alias("id"), S.due_priority(rank, F.date_diff(F.to_date("o_orderdate"), F.lit("1996-05-15").cast("date"))).alias("priority"))


@query("rk13_cost_codes", "WITH m AS (SELECT o_orderkey AS id, o_custkey AS sender, CASE WHEN o_orderkey % 3 = 0 THEN 'charge to c' || (o_orderkey % 50 + 1) ELSE 'for a red widget part' END AS x FROM orders), codes AS (SELECT 'c' || p_size AS code, min(p_name) AS d FROM part GROUP BY p_size), last AS (SELECT l_suppkey AS sender, arg_max('c' || l_partkey, l_orderkey * 10 + l_linenumber) AS code FROM (SELECT DISTINCT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_linenumber ORDER BY l_partkey) = 1) GROUP BY l_suppkey), p AS (SELECT id, min(code) AS c FROM m JOIN codes ON list_contains(regexp_extract_all(x, '\\w+'), code) GROUP BY id), n AS (SELECT id, code, len(list_intersect(list_distinct(regexp_extract_all(x, '\\w+')), list_distinct(regexp_extract_all(lower(d), '\\w+')))) AS n FROM m, codes), b AS (SELECT id, arg_min(code, -n * 1000000 + rank) AS c FROM (SELECT *, row_number() OVER (ORDER BY code) AS rank FROM n WHERE n >= 2) GROUP BY id) SELECT m.id, coalesce(p.c, last.code, b.c) AS code, CASE WHEN p.c IS NOT NULL THEN 'printed' WHEN last.code IS NOT NULL THEN 'confirmed' WHEN b.c IS NOT NULL THEN 'described' END AS why FROM m LEFT JOIN p USING (id) LEFT JOIN last USING (sender) LEFT JOIN b USING (id)")
def _(t):
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("charge to c"), F.col("o_orderkey") % 50 + 1)).otherwise("for a red widget part")
    mail = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sender"), said.alias("text"))
    codes = t.part.groupBy("p_size").agg(F.min("p_name").alias("description")).select(F.concat(F.lit("c"), "p_size").alias("code"), "description")
    used = t.lineitem.groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    confirmed = used.select(F.col("l_suppkey").alias("sender"), F.concat(F.lit("c"), "p").alias("code"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return S.cost_codes(mail, codes, confirmed)


@query("ex13_uncoded_by_signature", "SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1 AND md5(l_orderkey || '') = md5(o_orderkey || ''))")
def _(t):
    done = t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.md5(F.col("l_orderkey").cast("string").cast("binary")).alias("signature"))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("signature")).join(done, ["id", "signature"], "left_anti").select("id")


@query("rk05_own_vectors_of_held", "WITH v AS (SELECT label, vec_id, embedding[1]::DOUBLE AS s, label % 2 = 0 AS held FROM embeddings) SELECT label, round(max(CASE WHEN NOT held OR vec_id % 3 = 0 THEN s END), 5) AS best FROM v GROUP BY label")
def _(t):
    held, own = F.col("label") % 2 == 0, F.col("vec_id") % 3 == 0
    return t.embeddings.groupBy("label").agg(F.round(F.max(F.when(~held | own, F.col("embedding")[0].cast("double"))), 5).alias("best"))


@query("ex14_best_sections", "WITH s AS (SELECT label, vec_id, embedding[2]::DOUBLE AS s FROM embeddings WHERE vec_id % 5 <> 0), b AS (SELECT label, max(s) AS best FROM s GROUP BY label) SELECT label, round(best, 5) AS best FROM b ORDER BY best DESC, label LIMIT 4")
def _(t):
    best = t.embeddings.filter("vec_id % 5 <> 0").groupBy("label").agg(F.max(F.col("embedding")[1].cast("double")).alias("b"))
    return best.orderBy(F.desc("b"), "label").limit(4).select("label", F.round("b", 5).alias("best"))


@query("rk17_record_identity", "WITH m AS (SELECT o_orderkey AS id, 'm' || (o_orderkey // 3) AS mid, o_custkey % 3 AS sender FROM orders), f AS (SELECT mid, min(id) AS first FROM m GROUP BY mid) SELECT m.id, CASE WHEN o.sender = m.sender THEN f.first ELSE m.id END AS record FROM m JOIN f USING (mid) JOIN m o ON o.id = f.first")
def _(t):
    mail = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("m"), F.floor(F.col("o_orderkey") / 3)).alias("mid"), (F.col("o_custkey") % 3).alias("sender"))
    first = mail.groupBy("mid").agg(F.min(F.struct("id", "sender")).alias("f"))
    return mail.join(first, "mid").select("id", F.when(F.col("f.sender") == F.col("sender"), F.col("f.id")).otherwise(F.col("id")).alias("record"))


@query("rk18_past_answers", "WITH p AS (SELECT conv_id * 1000 + turn AS id, text AS q, lead(text) OVER w AS a, role, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), s AS (SELECT id, list_distinct(regexp_extract_all(lower(q), '\\w+')) AS qw, list_distinct(regexp_extract_all(lower(a), '\\w+')) AS aw FROM p WHERE a IS NOT NULL), c AS (SELECT id, 2 * len(list_intersect(['the', 'how', 'then'], qw)) + len(list_intersect(['the', 'how', 'then'], aw)) AS score, len(list_intersect(['the', 'how', 'then'], list_concat(qw, aw))) AS n FROM s) SELECT id, score FROM c WHERE n >= 2 ORDER BY score DESC, id LIMIT 3")
def _(t):
    w = W.partitionBy("conv_id").orderBy("turn")
    pairs = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"), F.lead("text").over(w).alias("answer")).filter("answer is not null")
    return S.past_answers(pairs, ["the", "how", "then"])
