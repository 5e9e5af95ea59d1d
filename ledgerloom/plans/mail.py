"""Link keys, identities and written values, over texts made of the test tables' columns."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..operators import links as L
from ..registry import query


@query("sc01_fold", "SELECT doc_id, md5(replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's')) AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.fold(F.col("text")).cast("binary")).alias("folded"))


@query("sc03_number_keys", r"WITH n AS (SELECT o_orderkey, 'PO' || CASE WHEN o_orderkey % 2 = 0 THEN '-00' ELSE ' #' END || o_orderkey || '/' || lower(o_orderstatus) || '0' || (o_orderkey % 7) AS w FROM orders), k AS (SELECT o_orderkey, regexp_replace(upper(regexp_replace(w, '[^0-9A-Za-z]', '', 'g')), '(^|[^0-9])0+([0-9])', '\1\2', 'g') AS number_key FROM n) SELECT o_orderkey, number_key, regexp_replace(number_key, '^PO([0-9])', '\1') AS po_key FROM k")
def _(t):
    mark = F.when(F.col("o_orderkey") % 2 == 0, "-00").otherwise(" #")
    written = F.concat(F.lit("PO"), mark, "o_orderkey", F.lit("/"), F.lower("o_orderstatus"), F.lit("0"), F.col("o_orderkey") % 7)
    return t.orders.select("o_orderkey", T.number_key(written).alias("number_key"), T.po_key(written).alias("po_key"))


@query("sc04_message_ids", "SELECT page_id, [lower('M' || page_id || '@x.org')] || CASE WHEN page_id % 3 = 0 THEN ['m' || (page_id + 1) || '@x.org'] ELSE [] END AS ids, md5(url) AS conversation FROM pages")
def _(t):
    own = F.concat(F.lit("<M"), "page_id", F.lit("@X.org>"))
    header = F.when(F.col("page_id") % 3 == 0, F.concat(own, F.lit(" <m"), F.col("page_id") + 1, F.lit("@x.org>  "), own)).when(F.col("page_id") % 3 == 1, F.btrim(own, F.lit("<>"))).otherwise(own)
    index = F.base64(F.concat(F.unhex(F.lit("0101AABBCCDD")), F.unhex(F.md5("url")), F.unhex(F.lit("99"))))
    return t.pages.select("page_id", T.message_ids(header).alias("ids"), T.conversation_of(index).alias("conversation"))


@query("sc05_file_stems", "SELECT o_orderkey, 'order ' || lower(o_orderpriority[3:]) AS stem FROM orders")
def _(t):
    mark = F.element_at(F.array(*[F.lit(x) for x in (" v2.xlsx", "_final.pdf", " (3).docx", "_rev4.csv", " draft copy.txt")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t.orders.select("o_orderkey", T.file_stem(F.concat(F.lit("Order_"), F.substring("o_orderpriority", 3, 20), mark)).alias("stem"))


@query("sc06_canonical_domains", "SELECT s_suppkey, 's' || s_nationkey || '.example' AS domain, s_nationkey % 5 = 0 AS under FROM supplier")
def _(t):
    d = T.canonical_domain(F.concat(F.lit(" WWW.S"), "s_nationkey", F.lit(".Example. ")))
    host = F.concat(F.when(F.col("s_nationkey") % 5 == 0, "mail.corp.example").otherwise("notcorp.example"))
    return t.supplier.select("s_suppkey", d.alias("domain"), T.same_or_under(host, "corp.example").alias("under"))


@query("sc06_domains_in_letters", "SELECT domain, count(*) AS n FROM (SELECT CASE o_orderkey % 5 WHEN 3 THEN 'xn--99999999' WHEN 4 THEN 'plain' ELSE 'müller' END || (CASE WHEN o_orderkey % 5 < 3 THEN '.c' ELSE '.d' END) || (o_custkey % 50) || '.example' AS domain FROM orders) GROUP BY domain")
def _(t):
    k = F.col("o_orderkey") % 5
    label = F.when(k == 0, "www.XN--MLLER-KVA").when(k == 1, "MÜLLER").when(k == 2, "mu\u0308ller").when(k == 3, "xn--99999999").otherwise("plain")
    host = F.concat(label, F.when(k < 3, ".c").otherwise(".D"), F.col("o_custkey") % 50, F.lit(".Example."))
    return t.orders.select(T.unicode_domain(host).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


@query("sc08_cell_numbers", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 0.0 WHEN 1 THEN round(l_tax * 100, 1) WHEN 2 THEN NULL ELSE -round(l_extendedprice, 2) END AS value FROM lineitem")
def _(t):
    k = F.col("l_linenumber") % 4
    cell = F.when(k == 0, "—").when(k == 1, F.concat(F.format_number(F.round(F.col("l_tax") * 100, 1), 1), F.lit(" %"))).when(k == 2, " ").otherwise(F.concat(F.lit("("), F.format_number(F.round("l_extendedprice", 2), 2), F.lit(")")))
    return t.lineitem.select("l_orderkey", "l_linenumber", T.cell_number(cell).cast("double").alias("value"))


@query("sc09_money", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '(' || format('{:,.2f}', abs(round(c_acctbal, 2))) || ')' ELSE format('{:,.2f}', round(c_acctbal, 2)) END AS shown, CASE WHEN c_custkey % 2 = 0 THEN format('{:,}', c_custkey) ELSE format('{:,.2f}', c_custkey + 0.25) END AS average FROM customer")
def _(t):
    average = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("double")).otherwise(F.col("c_custkey") + 0.25)
    return t.customer.select("c_custkey", T.money(F.col("c_acctbal")).alias("shown"), T.averaged(average).alias("average"))


@query("sc11_date_spans", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN date_trunc('year', o_orderdate)::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE ELSE o_orderdate::DATE END AS low, CASE o_orderkey % 3 WHEN 0 THEN (date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE WHEN 1 THEN last_day(o_orderdate::DATE) ELSE o_orderdate::DATE END AS high FROM orders")
def _(t):
    k = F.col("o_orderkey") % 3
    span = T.date_span(F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "MMMM yyyy")).otherwise(F.date_format("o_orderdate", "M/d/yyyy")))
    return t.orders.select("o_orderkey", span["low"].alias("low"), span["high"].alias("high"))


@query("sc12_month_keys", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(t):
    written = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMM-yyyy")).otherwise(F.date_format("o_orderdate", "MMMM yyyy"))
    return t.orders.select("o_orderkey", T.month_key(written).alias("month"))


@query("sc17_tokens", r"SELECT p_partkey, len(regexp_extract_all(lower(p_name || ' ' || p_type), '\w+')) AS n, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '\w+'))::VARCHAR IS NOT NULL AS any FROM part")
def _(t):
    own = T.tokens(F.concat_ws(" ", "p_name", "p_type"))
    return t.part.select("p_partkey", F.size(own).cast("long").alias("n"), (F.size(F.array_distinct(own)) > 0).alias("any"))


@query("sc18_plain_text", "SELECT c_custkey, 'pay ' || c_name || ' now' AS plain FROM customer")
def _(t):
    disguised = F.concat(F.lit("p​аy <b>"), "c_name", F.lit("</b> <!-- x\ny -->n­ow"))
    return t.customer.select("c_custkey", T.plain_text(disguised).alias("plain"))


@query("sc19_own_words", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN '> only quoted ' || c_custkey ELSE 'Please check ' || c_name END AS own FROM customer")
def _(t):
    k = F.col("c_custkey") % 3
    mine, quoted = F.concat(F.lit("Please check "), "c_name"), F.lit("\nOn Monday, April 1, Ann wrote:\n> old\n\nmore")
    body = F.when(k == 0, F.concat(mine, quoted)).when(k == 1, F.concat(mine, F.lit("\r\n\r\nThis mail is confidential and so on."))).otherwise(F.concat(F.lit("> only quoted "), "c_custkey"))
    return t.customer.select("c_custkey", T.own_words(body).alias("own"))


@query("sc20_collapsed", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS collapsed FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")).cast("binary")).alias("collapsed"))


@query("sc21_redacted", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'card ****' ELSE 'account ****' END || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || ' due' AS text FROM customer")
def _(t):
    last, k = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.col("c_custkey") % 3
    said = F.when(k == 0, F.concat(F.lit("4111 1111-1111 "), last)).when(k == 1, F.concat(F.lit("Account no. 5550"), last)).otherwise(F.concat(F.lit("acct: 777"), last))
    return t.customer.select("c_custkey", T.redact(F.concat(said, F.lit(" due"))).alias("text"))


@query("sc22_fields", r"WITH m AS (SELECT o_orderkey, 'Invoice INV-' || o_orderkey || ' PO ' || o_custkey || ' of $' || format('{:.2f}', round(o_totalprice, 2)) || ' due ' || strftime(o_orderdate, '%Y-%m-%d') || ' acct 99' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS x FROM orders) SELECT o_orderkey, regexp_extract_all(x, 'INV-(\d+)', 1) AS invoices, regexp_extract_all(x, 'PO (\d+)', 1) AS pos, regexp_extract_all(x, '\$(\d+\.\d\d)', 1) AS amounts, regexp_extract_all(x, 'due (\d{4}-\d\d-\d\d)', 1) AS due, regexp_extract_all(x, 'acct \d+(\d{4})', 1) AS last4 FROM m")
def _(t):
    said = F.concat(F.lit("Invoice INV-"), "o_orderkey", F.lit(" PO "), "o_custkey", F.lit(" of $"), F.format_string("%.2f", F.round("o_totalprice", 2)), F.lit(" due "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" acct 99"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"))
    return t.orders.select("o_orderkey", *[L.extracted(said)[k].alias(k) for k in ("invoices", "pos", "amounts", "due", "last4")])


@query("sc23_due_dates", "WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders) SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN d WHEN 1 THEN d + 1 WHEN 2 THEN (d + (CASE WHEN (5 - isodow(d) + 7) % 7 = 0 THEN 7 ELSE (5 - isodow(d) + 7) % 7 END)::INT)::DATE ELSE d END AS due FROM o")
def _(t):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    said = F.when(k == 0, "EOD").when(k == 1, "Tomorrow").when(k == 2, "friday").otherwise(F.date_format(d, "MMMM d, yyyy"))
    return t.orders.select("o_orderkey", T.due_date(said, d).alias("due"))


@query("sc24_total_labels", "SELECT n_nationkey, n_nationkey % 4 < 3 AS total FROM nation")
def _(t):
    label = F.element_at(F.array(*[F.lit(x) for x in ("Grand Total", "subtotal 2024", "Freight total", "Totally other")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return t.nation.select("n_nationkey", T.is_total_label(label).alias("total"))


@query("sc26_calculated", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) / nullif(l_quantity, 0) * 0.70710678::DOUBLE, 3) AS unit, (l_shipdate::DATE + 14)::DATE AS due FROM lineitem")
def _(t):
    at = t.lineitem.withColumn("day", F.to_date("l_shipdate"))
    return at.select("l_orderkey", "l_linenumber", F.round(T.calculate("l_extendedprice * (1 - l_discount) / l_quantity * 0.70710678", {"l_extendedprice", "l_discount", "l_quantity"}), 3).alias("unit"), T.calculate("day + 2 weeks", {"day"}).alias("due"))


@query("sc27_zone_times", "SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS local, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events")
def _(t):
    return t.events.select("event_id", F.date_format(F.from_utc_timestamp("ts", "-05:00"), "yyyy-MM-dd HH:mm").alias("local"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"))


@query("sc29_look_alikes", "SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'rnicro' ELSE 'mlcro' END || c_nationkey || '.example' AS domain, 'micro.example' AS like FROM customer WHERE c_nationkey % 3 <> 2")
def _(t):
    name = F.when(F.col("c_nationkey") % 3 == 0, "rnicro").when(F.col("c_nationkey") % 3 == 1, "mlcro").otherwise("unlike")
    asked = t.customer.select("c_custkey", F.concat(name, "c_nationkey", F.lit(".example")).alias("domain"))
    known = t.spark.createDataFrame([("micro.example",), ("other.example",)], "like string")
    return L.look_alikes(asked, "domain", known, "like").select("c_custkey", "domain", "like")


@query("sc32_unit_vectors", "WITH v AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x / n) * (x / n))), 4) AS norm, round(embedding[1] / n, 4) AS first FROM v")
def _(t):
    from ..operators.search import unit

    u = unit(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm"), F.round(u[0], 4).alias("first"))


@query("sc33_ungrounded", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN [l_orderkey::DOUBLE + 0.5] ELSE [] END AS missing FROM lineitem")
def _(t):
    price = F.format_string("%.2f", F.round("l_extendedprice", 2))
    source = F.concat(F.lit("Paid $"), F.format_number(F.round("l_extendedprice", 2), 2), F.lit(" on order "), "l_orderkey")
    answer = F.concat(F.lit("The price was "), price, F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(", fee "), "l_orderkey", F.lit(".5"))).otherwise(""))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.transform(T.ungrounded(answer, source), lambda x: x["value"]).alias("missing"))


@query("sc34_json", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, json_valid(props) AS valid, 1::BIGINT AS members FROM events")
def _(t):
    at = t.events.withColumn("p", F.from_json("props", "map<string,string>"))
    return at.select("event_id", F.col("p")["k"].cast("int").alias("k"), F.col("p").isNotNull().alias("valid"), F.json_array_length(F.to_json(F.map_keys("p"))).cast("long").alias("members"))


@query("sc35_json_lists", "SELECT o_custkey, len(list_distinct(list(o_orderstatus))) AS n FROM orders GROUP BY o_custkey")
def _(t):
    listed = t.orders.groupBy("o_custkey").agg(F.to_json(F.collect_set("o_orderstatus")).alias("j"))
    return listed.select("o_custkey", F.explode(F.from_json("j", "array<string>")).alias("x")).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("sc36_parts", "SELECT doc_id, greatest(1, ceil(length(text) / 500.0))::BIGINT AS parts, md5(text) AS whole FROM documents")
def _(t):
    parts = T.split_parts(F.col("text"), 500)
    whole = F.array_join(F.transform(parts, lambda p: p["text"]), "")
    return t.documents.select("doc_id", F.size(parts).cast("long").alias("parts"), F.md5(whole.cast("binary")).alias("whole"))


@query("ex01_link_keys", "WITH m AS (SELECT o_orderkey AS id, 'd' || (o_custkey % 9) || '.example' AS dom, o_orderkey % 7 = 0 AS held, CASE WHEN o_orderkey % 2 = 0 THEN 'INV-' || (o_orderkey % 50) ELSE 'AB' || o_orderkey END AS inv, (90000 + o_custkey)::VARCHAR AS po FROM orders), k AS (SELECT id, 'invoice' AS kind, CASE WHEN inv LIKE 'INV-%' THEN dom || '|' || inv[5:] ELSE inv END AS value FROM m WHERE NOT held UNION ALL SELECT id, 'po', po FROM m WHERE NOT held UNION ALL SELECT id, 'stem', dom || '|price list' FROM m WHERE NOT held UNION ALL SELECT id, 'thread', 'mid:' || (id - 1) || '@x' FROM m UNION ALL SELECT id, 'msg', 'mid:' || id || '@x' FROM m) SELECT id, kind, value FROM k")
def _(t):
    mail = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("a@D"), F.col("o_custkey") % 9, F.lit(".example")).alias("sender"),
        (F.col("o_orderkey") % 7 == 0).alias("held"),
        F.array(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("INV-"), F.col("o_orderkey") % 50)).otherwise(F.concat(F.lit("AB"), "o_orderkey"))).alias("invoices"),
        F.array(F.concat(F.lit("PO "), F.col("o_custkey") + 90000)).alias("pos"),
        F.array(F.lit("Price_list v2.xlsx")).alias("files"),
        F.concat(F.lit("<"), "o_orderkey", F.lit("@X>")).alias("message_id"),
        F.concat(F.lit("<"), F.col("o_orderkey") - 1, F.lit("@x>")).alias("in_reply_to"),
        F.lit("no numbers here").alias("body"),
    )
    return L.link_keys(mail)


@query("ex03_changed_payment_lines", "WITH l AS (SELECT l_orderkey AS k, l_linenumber <= 3 AS old, l_partkey FROM lineitem) SELECT k, len(list(DISTINCT l_partkey) FILTER (WHERE old)) AS before, len(list(DISTINCT l_partkey) FILTER (WHERE NOT old)) AS after FROM l GROUP BY k HAVING count(DISTINCT l_partkey) FILTER (WHERE old) > 0 AND count(DISTINCT l_partkey) FILTER (WHERE NOT old) > 0 AND list_sort(list(DISTINCT l_partkey) FILTER (WHERE old)) <> list_sort(list(DISTINCT l_partkey) FILTER (WHERE NOT old))")
def _(t):
    at = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_partkey"))).alias("a"), F.collect_set(F.when(F.col("l_linenumber") > 3, F.col("l_partkey"))).alias("b"))
    changed = at.filter((F.size("a") > 0) & (F.size("b") > 0) & ((F.size(F.array_except("a", "b")) > 0) | (F.size(F.array_except("b", "a")) > 0)))
    return changed.select(F.col("l_orderkey").alias("k"), F.size("a").cast("long").alias("before"), F.size("b").cast("long").alias("after"))


@query("ex04_real_files", "SELECT page_id FROM pages WHERE octet_length(encode(html)) >= 1024 AND page_id % 4 NOT IN (1, 3) OR octet_length(encode(html)) >= 200000 AND page_id % 4 = 1 OR page_id % 4 = 2 AND octet_length(encode(html)) < 1024")
def _(t):
    k = F.col("page_id") % 4
    name = F.when(k == 1, "logo.png").when(k == 3, "winmail.dat").when(k == 2, "list.csv").otherwise("Scan_0001.pdf")
    files = t.pages.select("page_id", name.alias("name"), F.octet_length("html").alias("size"))
    return files.filter(L.real_file(F.col("name"), F.col("size"))).select("page_id")


@query("ex40_by_domain", "SELECT c_custkey FROM customer WHERE c_nationkey % 3 <> 2")
def _(t):
    host = F.element_at(F.array(F.lit("A@corp.example"), F.lit("a@eu.corp.example"), F.lit("a@xcorp.example")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return t.customer.filter(T.same_or_under(T.sender_domain(host), "corp.example")).select("c_custkey")


@query("ex46_unique_names", "SELECT o_orderkey, CASE WHEN r = 1 THEN n ELSE n || ' (' || r || ')' END || '.pdf' AS name FROM (SELECT o_orderkey, o_orderpriority[3:] AS n, row_number() OVER (PARTITION BY lower(o_orderpriority[3:]), o_custkey ORDER BY o_orderkey) AS r FROM orders)")
def _(t):
    named = t.orders.withColumn("name", F.concat(F.regexp_replace(F.substring("o_orderpriority", 3, 20), r"[\\/:*?\"<>|]", "_"), F.lit(".pdf")))
    return L.unique_names(named, "name", ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "name")


@query("ag35_newcomers", "SELECT o_orderkey AS id, k % 5 = 3 AS newcomer FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders)")
def _(t):
    k = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    at = t.orders.withColumn("k", k)
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    mail = at.select(
        F.col("o_custkey").alias("conversation"),
        F.col("o_orderkey").alias("id"),
        F.col("k").cast("long").alias("arrival"),
        F.concat(F.lit("m"), "o_orderkey").alias("message_id"),
        F.when(before.isNotNull(), F.concat(F.lit("m"), before)).alias("in_reply_to"),
        F.when(F.col("k") % 5 == 3, F.concat(F.lit("new"), "k", F.lit(".example"))).otherwise(F.concat(F.lit("p"), F.col("k") % 2, F.lit(".example"))).alias("party"),
        F.when(F.col("k") % 5 == 3, F.array(F.concat(F.lit("new"), F.col("k") + 5, F.lit(".example")))).otherwise(F.array(F.lit("p1.example"))).alias("to_parties"),
    )
    return L.newcomers(mail).select("id", "newcomer")


@query("ex02_newcomer_test", "SELECT o_orderkey AS id, false AS newcomer FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def _(t):
    mail = t.orders.select(F.col("o_custkey").alias("conversation"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("arrival"), F.concat(F.lit("m"), "o_orderkey").alias("message_id"), F.lit(None).cast("string").alias("in_reply_to"), F.lit("a.example").alias("party"), F.array(F.lit("b.example")).alias("to_parties"))
    first = mail.agg(F.min("id").alias("_first"))
    own = mail.join(first, F.col("id") == F.col("_first"), "left_semi")
    return L.newcomers(mail.join(own.select("conversation"), "conversation", "left_semi")).join(own.select("id"), "id", "left_semi").select("id", "newcomer")


@query(
    "ex05_duplicate_invoices",
    "WITH m AS (SELECT o_orderkey AS id, o_custkey % 40 AS inv, CASE WHEN o_custkey % 97 <> 0 THEN o_custkey % 7 END AS conv, o_orderdate AS sent, o_orderkey % 11 = 0 AS held, o_orderkey % 13 = 0 AS cautioned, o_orderstatus = 'F' AS replying, o_orderpriority = '5-LOW' AS file, o_orderkey % 5 AS who, o_custkey % 3 AS whom FROM orders), "
    "p AS (SELECT a.id, a.sent, a.conv, b.conv IS NOT NULL AND a.conv IS NOT DISTINCT FROM b.conv AS inside, a.held OR a.cautioned AS doubtful, a.replying AND NOT a.file AS talk, a.replying AS replying, b.held AS b_held, b.replying AND NOT b.file AS b_talk, b.replying AS b_replying, b.sent AS b_sent, "
    "CASE WHEN a.who = 0 THEN b.who = 0 WHEN a.who = 4 THEN b.who = 4 ELSE b.who = a.who OR b.whom = a.who END AS from_side FROM m a JOIN m b ON a.inv = b.inv AND a.id <> b.id), "
    "q AS (SELECT id, talk AND NOT doubtful AS asks, from_side, CASE WHEN inside AND b_talk THEN false WHEN doubtful THEN true WHEN b_held THEN false WHEN talk THEN inside WHEN NOT replying THEN NOT (inside AND b_replying AND b_sent > sent) ELSE true END AS copy FROM p) "
    "SELECT id, count(*) AS others FROM q WHERE copy GROUP BY id HAVING NOT bool_or(asks AND from_side)",
)
def _(t):
    who, whom = F.col("o_orderkey") % 5, F.col("o_custkey") % 3
    # 0 writes from a free mail service, 4 through a service that asks answers to go elsewhere, 1 to 3 from their companies
    sender = F.when(who == 0, "Clerk0@gmail.com").when(who == 4, "bills@sender.example").otherwise(F.concat(F.lit("u"), F.col("o_orderkey") % 9, F.lit("@Co"), who, F.lit(".example")))
    reply_to = F.when(who == 4, "desk@co9.example")
    mail = t.orders.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 40).alias("invoice"),
        F.when(F.col("o_custkey") % 97 != 0, F.col("o_custkey") % 7).alias("conversation"),
        F.col("o_orderdate").alias("sent"),
        (F.col("o_orderkey") % 11 == 0).alias("held"),
        (F.col("o_orderkey") % 13 == 0).alias("cautioned"),
        (F.col("o_orderstatus") == "F").alias("replying"),
        (F.col("o_orderpriority") == "5-LOW").alias("file"),
        L.side_names(sender).alias("names"),
        L.sides(sender, reply_to, F.array(F.concat(F.lit("ap@co"), whom, F.lit(".example")))).alias("sides"),
    )
    return L.duplicate_invoices(mail)


@query("ex06_entered_elsewhere", "WITH m AS (SELECT o_orderkey AS id, o_custkey AS conv, o_orderpriority AS inv, o_orderdate AS at, o_orderstatus = 'O' AS talk FROM orders) SELECT id FROM m WHERE talk AND EXISTS (SELECT 1 FROM m o WHERE NOT o.talk AND o.conv = m.conv AND o.inv = m.inv AND o.at <= m.at)")
def _(t):
    mail = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("conversation"), F.col("o_orderpriority").alias("invoice"), F.col("o_orderdate").alias("sent"), (F.col("o_orderstatus") == "O").alias("talk"))
    return L.entered_elsewhere(mail)
