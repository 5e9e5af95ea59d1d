"""Sources and sinks that a query can show: what is written is read back."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import calendar as C
from ..operators import relational as R
from ..registry import query
from ..streaming import arrivals as A
from ..sources import sinks, text_tables


@query("src04_quoted_lines", "SELECT c_custkey, c_name AS name, round(c_acctbal, 2) AS amount FROM customer")
def _(t):
    inner = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"'), "c_name", F.lit('"'))).otherwise(F.concat(F.lit('5" '), "c_name"))
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(";"), inner, F.lit(";"), F.format_string("%.2f", F.round("c_acctbal", 2)))
    lines = t.customer.select(line.alias("value"))
    repaired = F.when(text_tables.stray_quotes(F.col("value"), ";"), F.regexp_replace("value", '"', "")).otherwise(F.col("value"))
    rows = lines.select(F.from_csv(repaired, "c_custkey bigint, name string, amount double", {"sep": ";"}).alias("r")).select("r.*")
    return rows.select("c_custkey", F.regexp_replace("name", "^5 ", "").alias("name"), "amount")


@query("src05_stray_quotes", "SELECT n_nationkey, n_nationkey % 3 <> 0 AS stray FROM nation")
def _(t):
    k = F.col("n_nationkey") % 3
    line = F.when(k == 0, F.concat(F.lit('"a, b",'), "n_name")).when(k == 1, F.concat(F.lit('5" pipe,'), "n_name")).otherwise(F.concat(F.lit('"a" b,"'), "n_name", F.lit('"')))
    return t.nation.select("n_nationkey", text_tables.stray_quotes(line, ",").alias("stray"))


@query(
    "src09_html_tables",
    "WITH c(tab, r, c, rs, cs, what) AS (VALUES (0, 0, 0, 1, 1, 'Key'), (0, 0, 1, 1, 2, 'Name'), (0, 1, 0, 2, 1, 'key'), (0, 1, 1, 1, 1, 'name'), (0, 1, 2, 1, 1, ''), (0, 2, 0, 1, 1, 'last'), (1, 0, 0, 1, 1, 'inner'), (1, 0, 1, 1, 1, 'key'), (2, 0, 0, 1, 1, 'open')) "
    "SELECT n_nationkey, tab AS \"table\", r AS \"row\", c AS col, rs AS rowspan, cs AS colspan, CASE what WHEN 'key' THEN n_nationkey::VARCHAR WHEN 'name' THEN n_name || ' & co' ELSE what END AS text FROM nation, c",
)
def _(t):
    """Cells and rows left open, spans, a table in a cell, and a page that ends in a cell."""
    html = F.concat(
        F.lit("<p>x</p><table><tr><th>Key<th colspan=2>Name<tr><td rowspan='2'> "), "n_nationkey", F.lit("</td><td><b>"), "n_name", F.lit("</b>\n&amp; co<td><table><td>inner<td>"), "n_nationkey",
        F.lit("</table></td></tr><tr><td>last</tr></table><p>between</p><table><tr><td>open"),
    )
    return text_tables.html_cells(t.nation.select("n_nationkey", html.alias("html")), "n_nationkey", "html")


@query(
    "src18_batches",
    "WITH f AS (SELECT DISTINCT 'in/' || o_custkey % 7 || '/f' || o_orderkey % 100 AS b, o_orderkey % 3 AS k FROM orders), n AS (SELECT b, count(*) AS n, max(k) AS k FROM f GROUP BY b) SELECT b AS batch, b || CASE k WHEN 0 THEN '.meta.json' WHEN 1 THEN '.txt' ELSE '.pdf' END AS main, n - 1 AS sidecars FROM n",
)
def _(t):
    """Equal stems in different folders are different batches."""
    kind = F.element_at(F.array(F.lit(".meta.json"), F.lit(".txt"), F.lit(".pdf")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    files = t.orders.select(F.concat(F.lit("in/"), F.col("o_custkey") % 7, F.lit("/f"), F.col("o_orderkey") % 100, kind).alias("path"), (F.col("o_orderkey") % 3).alias("length")).distinct()
    return text_tables.batches(files).select(F.concat("folder", F.lit("/"), "batch").alias("batch"), "main", F.size("sidecars").cast("long").alias("sidecars"))


@query(
    "src19_settled_files",
    "WITH l AS (SELECT user_id || '/' || event_type AS path, day(ts) // 2 AS length, date_trunc('month', ts) AS modified, ts AS seen FROM events), "
    "m AS (SELECT *, coalesce((length IS DISTINCT FROM lag(length) OVER w OR modified IS DISTINCT FROM lag(modified) OVER w)::INT, 1) AS n FROM l WINDOW w AS (PARTITION BY path ORDER BY seen, length, modified)), "
    "g AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY seen, length, modified) AS g FROM m), "
    "i AS (SELECT *, min(seen) OVER (PARTITION BY path, g) AS since FROM g) "
    "SELECT path, length, modified, min(seen) AS seen FROM i WHERE epoch_us(seen) - epoch_us(since) >= 7200000000 GROUP BY path, length, modified, g",
)
def _(t):
    """Every event is a look at a file of its user and type, which grows every other day; two hours of rest are asked for."""
    path, grown = F.concat(F.col("user_id"), F.lit("/"), F.col("event_type")), F.floor(F.dayofmonth("ts") / 2)
    return A.stood_still(t.events.select(path.alias("path"), grown.alias("length"), F.date_trunc("month", "ts").alias("modified"), F.col("ts").alias("seen")), 7200)


@query("src21_sync_kinds", "WITH b AS (SELECT o_orderkey AS id, 'in' AS folder, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 <> 0), a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'done' ELSE 'in' END AS folder, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'removed' WHEN a.folder <> b.folder THEN 'moved' ELSE 'updated' END AS kind FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.folder <> b.folder OR a.s <> b.s")
def _(t):
    k = F.col("o_orderkey")
    before = t.orders.filter(k % 7 != 0).select(k.alias("id"), F.lit("in").alias("folder"), F.col("o_orderstatus").alias("s"))
    after = t.orders.filter(k % 11 != 0).select(k.alias("id"), F.when(k % 5 == 0, "done").otherwise("in").alias("folder"), F.when(k % 3 == 0, "x").otherwise(F.col("o_orderstatus")).alias("s"))
    return R.synced(before, after, "id", "folder", ["s"])


@query("snk01_replaced_children", "SELECT l_orderkey AS parent, l_linenumber AS line, l_returnflag AS flag FROM lineitem WHERE l_orderkey % 3 <> 0 OR l_returnflag = 'R' UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderkey % 3 = 0")
def _(t):
    stored = R.dealt(t.lineitem, "l_orderkey").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_returnflag").alias("flag"))
    new = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("parent"), F.lit(0).alias("line"), F.lit("new").alias("flag"))
    return sinks.replace_children(stored, new, "parent", "flag = 'R'")


@query("snk04_guarded_cells", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '''=1+1' WHEN 1 THEN '''@x' WHEN 2 THEN c_name ELSE '''-5' END AS cell FROM customer")
def _(t):
    said = F.element_at(F.array(F.lit("=1+1"), F.lit("@x"), F.col("c_name"), F.lit("-5")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return t.customer.select("c_custkey", T.csv_safe(said).alias("cell"))


@query("sm04_refiled_after_invoice", "WITH m AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderdate AS sent, o_orderstatus = 'F' AS invoice FROM orders), f AS (SELECT k, min(sent) AS first FROM m WHERE invoice GROUP BY k) SELECT id FROM m JOIN f USING (k) WHERE NOT invoice AND sent >= first")
def _(t):
    """The orders arrive in three batches, invoices mostly last."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("sent"), (F.col("o_orderstatus") == "F").alias("invoice"))
    batch = F.when(F.col("invoice"), F.pmod(F.xxhash64("id"), F.lit(2)) + 1).otherwise(F.pmod(F.xxhash64("id"), F.lit(3)))
    filing = A.Refiling(t.spark, R.shared_folder(t.spark))
    for k in range(3):
        filing(rows.filter(batch == k), k)
    return filing.filed().select("id")


@query("ex38_bulk_deletes", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    gone = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(gone, "o_custkey", "left_anti").select("o_orderkey")


@query("ex39_latest_corrections", "SELECT l_suppkey, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_returnflag)) AS correction FROM lineitem GROUP BY l_suppkey")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.max_by("l_returnflag", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")).alias("correction"))


@query("ex41_digest_cards", "SELECT o_orderkey, o_orderpriority || ': ' || o_orderstatus || ' ' || format('{:,.2f}', round(o_totalprice, 2)) AS card FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.concat("o_orderpriority", F.lit(": "), "o_orderstatus", F.lit(" "), F.format_number(F.round("o_totalprice", 2), 2)).alias("card"))


@query("ex44_window_working_days", "SELECT event_id, (CASE isodow(d) WHEN 1 THEN d - 3 WHEN 7 THEN d - 2 ELSE d - 1 END)::DATE AS since FROM (SELECT event_id, ts::DATE AS d FROM events)")
def _(t):
    return t.events.select("event_id", C.working_window(F.to_date("ts")).alias("since"))
