"""Filters and scalar functions over the test tables."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..registry import query


@query("fl01_optional_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 50000")
def _(t):
    given = {"o_orderstatus": "O", "o_orderpriority": None}
    return t.orders.filter(R.all_of([F.col(c) == v if v else None for c, v in given.items()] + [F.col("o_totalprice") >= 50000])).select("o_orderkey")


@query("fl02_half_open_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
def _(t):
    day = lambda d: F.lit(d).cast("timestamp")
    return t.events.filter((F.col("ts") >= day("2024-01-05")) & (F.col("ts") < day("2024-01-06"))).select("event_id")


@query("fl03_words_in_places", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(source), 'the')) AND (contains(lower(text), 'src1') OR contains(lower(source), 'src1'))")
def _(t):
    return t.documents.filter(R.words_in_places(["the", "SRC1"], [F.col("text"), F.col("source")])).select("doc_id")


@query("fl04_literal_contains", "SELECT doc_id FROM documents WHERE contains(lower(text), '%')")
def _(t):
    return t.documents.filter(R.words_in_places(["%"], [F.col("text")])).select("doc_id")


@query("fl05_list_membership", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def _(t):
    return t.events.filter(F.array_contains(F.map_values(F.from_json("props", "map<string,string>")), "7")).select("event_id")


@query("fl06_held_and_cleared", "SELECT doc_id FROM labels WHERE (toxic = 1 OR quality = 0) AND doc_id % 2 = 1")
def _(t):
    held = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return t.labels.filter(held & ~(F.col("doc_id") % 2 == 0)).select("doc_id")


@query("fl08_percent_limit", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE round(l_discount * 100, 6) > 5")
def _(t):
    return t.lineitem.filter(F.round(F.when(F.abs("l_discount") <= 1, F.col("l_discount") * 100).otherwise(F.col("l_discount")), 6) > 5).select("l_orderkey", "l_linenumber")


@query("fl09_date_spans", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) = 3")
def _(t):
    return t.orders.filter(F.to_date("o_orderdate").between(F.lit("1996-03-01").cast("date"), F.lit("1996-03-31").cast("date"))).select("o_orderkey")


@query("fl10_row_naming_score", "SELECT p_partkey, len(list_intersect(list_distinct(string_split(lower(p_name), ' ')), list_distinct(string_split(lower(p_name) || ' ' || lower(p_type), ' ')))) AS score FROM part")
def _(t):
    own, asked = F.split(F.lower("p_name"), " "), F.split(F.concat_ws(" ", F.lower("p_name"), F.lower("p_type")), " ")
    return t.part.select("p_partkey", F.size(F.array_intersect(own, asked)).cast("long").alias("score"))


@query("fl14_unpivot", "SELECT l_orderkey, l_linenumber, name, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_discount FROM lineitem) ON l_quantity, l_tax, l_discount INTO NAME name VALUE value)")
def _(t):
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax", "l_discount"], "name", "value")


@query("fl16_codes_not_listed", "SELECT DISTINCT json_extract_string(props, '$.k') AS code FROM events WHERE json_extract_string(props, '$.k') NOT IN (SELECT p_size::VARCHAR FROM part)")
def _(t):
    code = t.events.select(F.explode(F.regexp_extract_all("props", F.lit(r"(\d+)"), 1)).alias("code")).distinct()
    return code.join(t.part, F.col("code") == F.col("p_size").cast("string"), "left_anti")


@query("fl17_due_windows", "SELECT o_orderkey, CASE WHEN d < DATE '1996-05-15' THEN 'overdue' WHEN d = DATE '1996-05-15' THEN 'today' WHEN d = DATE '1996-05-16' THEN 'tomorrow' WHEN d <= DATE '1996-05-19' THEN 'this week' WHEN d <= DATE '1996-05-26' THEN 'next week' WHEN d <= DATE '1996-05-31' THEN 'this month' ELSE 'later' END AS due FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def _(t):
    today, d = F.lit("1996-05-15").cast("date"), F.to_date("o_orderdate")
    sunday = F.next_day(F.date_sub(today, 1), "Sun")
    due = F.when(d < today, "overdue").when(d == today, "today").when(d == F.date_add(today, 1), "tomorrow").when(d <= sunday, "this week").when(d <= F.date_add(sunday, 7), "next week").when(d <= F.last_day(today), "this month").otherwise("later")
    return t.orders.select("o_orderkey", due.alias("due"))


@query("sc02_invoice_key", "SELECT o_orderkey, regexp_replace(regexp_replace(lower(trim('INV-' || o_orderkey || '/' || o_orderstatus)), '^(invoice|inv|no|number)[\\s.:#-]*', ''), '[^a-z0-9]+', '', 'g') AS key FROM orders")
def _(t):
    return t.orders.select("o_orderkey", T.invoice_key(F.concat(F.lit("INV-"), "o_orderkey", F.lit("/"), "o_orderstatus")).alias("key"))


@query("sc06_domains", "SELECT c_custkey, lower('user' || c_custkey || '@Mail' || c_nationkey || '.example')[length('user' || c_custkey) + 2:] AS domain FROM customer")
def _(t):
    address = F.concat(F.lit("user"), "c_custkey", F.lit("@Mail"), "c_nationkey", F.lit(".example"))
    return t.customer.select("c_custkey", T.sender_domain(address).alias("domain"))


@query("sc07_amounts", "SELECT c_custkey, round(c_acctbal, 2) AS amount FROM customer")
def _(t):
    written = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), F.format_number(-F.col("c_acctbal"), 2), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number("c_acctbal", 2)))
    return t.customer.select("c_custkey", F.round(T.parse_amount(written).cast("double"), 2).alias("amount"))


@query("sc10_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def _(t):
    k = F.col("o_orderkey") % 3
    written = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "MMM d, yyyy"))
    return t.orders.select("o_orderkey", T.cell_date(written).alias("d"))


@query("sc12_months", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(t):
    written = F.when(F.year("o_orderdate") >= 2000, F.date_format("o_orderdate", "MMM-yy")).otherwise(F.date_format("o_orderdate", "MMM-yyyy"))
    return t.orders.select("o_orderkey", T.month_key(written).alias("month"))


@query("sc20_collapse", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")).alias("text"))


@query("sc22_extracted_fields", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS mails, len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents")
def _(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+")).cast("long").alias("mails"), F.regexp_count("text", F.lit(r"[0-9]+")).cast("long").alias("numbers"))


@query("sc30_hashes", "SELECT doc_id, sha256(text) AS sha FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"))


@query("sc31_csv_guard", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '''' ELSE '' END || round(c_acctbal, 0)::BIGINT AS cell FROM customer")
def _(t):
    return t.customer.select("c_custkey", T.csv_safe(F.round("c_acctbal", 0).cast("long").cast("string"), F.col("c_acctbal") < 0).alias("cell"))


@query("sc_sqlite_min_max", "SELECT l_orderkey, l_linenumber, least(l_tax, l_discount) AS low, greatest(l_tax, l_discount) AS high FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", T.sqlite_min(F.col("l_tax"), F.col("l_discount")).alias("low"), T.sqlite_max(F.col("l_tax"), F.col("l_discount")).alias("high"))


@query("src10_html_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS text FROM pages")
def _(t):
    return t.pages.select("page_id", T.html_text(F.col("html")).alias("text"))
