"""Questions over tables, and tables read from texts."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import lookup as L
from ..operators import relational as R
from ..operators import tables as O
from ..registry import query


@query("ag13_without_total_rows", "SELECT l_orderkey, sum(round(l_extendedprice, 2)::DECIMAL(18,2))::DOUBLE AS total, max(round(l_quantity, 0))::DOUBLE AS most FROM lineitem GROUP BY l_orderkey")
def _(t):
    lines = t.lineitem.select("l_orderkey", F.concat(F.lit("part "), "l_partkey").alias("label"), F.round("l_extendedprice", 2).cast("decimal(18,2)").alias("v"), F.round("l_quantity", 0).alias("q"))
    printed = lines.groupBy("l_orderkey").agg(F.lit("Total").alias("label"), F.sum("v").cast("decimal(18,2)").alias("v"), F.lit(None).cast("double").alias("q"))
    from ..functions.text import is_total_label

    rows = lines.unionByName(printed).filter(~is_total_label(F.col("label")))
    return rows.groupBy("l_orderkey").agg(F.sum("v").cast("double").alias("total"), F.max("q").alias("most"))


@query("ag17_filled_groups", "SELECT l_shipmode AS g, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 4) AS average, count(*) AS n FROM (SELECT l_orderkey, l_quantity, first_value(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS l_shipmode FROM lineitem) GROUP BY 1")
def _(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    r = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order))
    rows = t.lineitem.withColumn("g", F.when(r == 1, F.col("l_returnflag")).otherwise(" "))
    return L.group_totals(rows, "g", "l_quantity", order, ["l_orderkey"])


@query("ag19_row_difference", "SELECT round(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) - sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal END), 2) AS difference FROM customer")
def _(t):
    return L.difference(t.customer, "c_mktsegment", "BUILDING", "MACHINERY", "c_acctbal").select(F.round("difference", 2).alias("difference"))


@query("ag20_change_of_rows", "WITH y AS (SELECT o_custkey, round(sum(CASE WHEN year(o_orderdate) <= 1995 THEN o_totalprice END), 2) AS a, round(sum(CASE WHEN year(o_orderdate) > 1995 THEN o_totalprice END), 2) AS b FROM orders GROUP BY 1) SELECT o_custkey, round(b - a, 2) AS change, round(100 * (b - a) / nullif(abs(a), 0), 2) AS percent FROM y")
def _(t):
    early = F.year("o_orderdate") <= 1995
    y = t.orders.groupBy("o_custkey").agg(F.round(F.sum(F.when(early, F.col("o_totalprice"))), 2).alias("a"), F.round(F.sum(F.when(~early, F.col("o_totalprice"))), 2).alias("b"))
    return L.change(y, "o_custkey", ["a", "b"])


@query("ag21_found_budget_pair", "SELECT p_brand, round(sum(p_size), 2) AS \"Actual units\", round(avg(p_size) * 7, 2) AS \"Budget units\", round(round(sum(p_size), 2) - round(avg(p_size) * 7, 2), 2) AS gap FROM part GROUP BY p_brand HAVING round(sum(p_size), 2) > round(avg(p_size) * 7, 2)")
def _(t):
    rows = t.part.groupBy("p_brand").agg(F.round(F.sum(F.col("p_size").cast("double")), 2).alias("Actual units"), F.round(F.avg("p_size") * 7, 2).alias("Budget units"))
    return L.over_under(rows, "over")


_TOTALS = "WITH l AS (SELECT l_orderkey, l_linenumber::BIGINT AS at, round(l_extendedprice, 2) AS v, round(l_quantity, 2) AS q FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1)"


@query("ag23_totals_by_arithmetic", f"{_TOTALS} SELECT l_orderkey, l_orderkey % 3 <> 0 AND count(*) >= 2 OR l_orderkey % 6 = 0 AS is_total FROM l GROUP BY l_orderkey")
def _(t):
    r = F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    lines = R.dealt(t.lineitem, "l_orderkey").withColumn("r", r).filter("r = 1").select("l_orderkey", F.col("l_linenumber").cast("long").alias("at"), F.lit("item").alias("label"), F.round("l_extendedprice", 2).alias("v"), F.round("l_quantity", 2).alias("q"))
    wrong = F.when(F.col("l_orderkey") % 3 == 0, 5.0).otherwise(0.0)
    label = F.when(F.col("l_orderkey") % 6 == 0, "Total").otherwise("")
    last = lines.groupBy("l_orderkey").agg(F.lit(99).cast("long").alias("at"), F.round(F.sum("v"), 2).alias("v"), F.round(F.sum("q"), 2).alias("q"))
    last = last.select("l_orderkey", "at", label.alias("label"), (F.col("v") + wrong).alias("v"), "q")
    told = L.settle_totals(lines.unionByName(last), "label", ["v", "q"], ["at"], ["l_orderkey"])
    return told.filter("at = 99").select("l_orderkey", "is_total")


@query("ag22_wrong_subtotals", "SELECT l_orderkey, l_orderkey % 4 <> 0 AS holds FROM lineitem GROUP BY l_orderkey")
def _(t):
    lines = R.dealt(t.lineitem, "l_orderkey").select("l_orderkey", F.col("l_linenumber").cast("long").alias("at"), F.round("l_extendedprice", 2).alias("v"), F.lit(False).alias("total"))
    sums = lines.groupBy("l_orderkey").agg(F.lit(1 << 40).cast("long").alias("at"), (F.round(F.sum("v"), 2) + F.when(F.col("l_orderkey") % 4 == 0, 3.5).otherwise(0.0)).alias("v"), F.lit(True).alias("total"))
    return O.subtotals(lines.unionByName(sums), "v", F.col("total"), ["at", "v"], ["l_orderkey"]).select("l_orderkey", "holds")


_SUMS = "SELECT round(l_extendedprice, 2) AS net, round(l_extendedprice * (l_tax + 0.01), 2) AS tax, round(l_quantity, 2) AS fee, round(l_extendedprice, 2) + round(l_extendedprice * (l_tax + 0.01), 2) + CASE WHEN l_partkey % 20 = 0 THEN 1 ELSE 0 END AS total FROM lineitem"


@query("ag24_neighbour_sums", f"WITH r AS ({_SUMS}), x AS (SELECT count_if(abs(net + tax - total) <= 0.045) / count(*) AS h FROM r) SELECT 'total' AS target, '+ net + tax' AS formula, round(h, 6) AS held FROM x WHERE h >= 0.9")
def _(t):
    net, tax = F.round("l_extendedprice", 2), F.round(F.col("l_extendedprice") * (F.col("l_tax") + 0.01), 2)
    total = net + tax + F.when(F.col("l_partkey") % 20 == 0, 1).otherwise(0)
    rows = t.lineitem.select(F.round("l_quantity", 2).alias("fee"), net.alias("net"), tax.alias("tax"), total.alias("total"))
    found = O.identities(rows, ["fee", "net", "tax", "total"])
    return t.spark.createDataFrame([(a, f"+ {b}", round(h, 6)) for a, b, h in found], "target string, formula string, held double")


@query("ag26_profiled_columns", "SELECT 'c_acctbal' AS \"column\", count(c_acctbal) AS filled, count_if(c_acctbal < 0) AS below_zero, 'decimal' AS style, []::VARCHAR[] AS samples FROM customer UNION ALL SELECT 'c_custkey', count(*), 0, 'whole', [] FROM customer UNION ALL SELECT 'c_mktsegment', count(*), 0, 'text', list_slice(list_sort(list(DISTINCT c_mktsegment)), 1, 3) FROM customer")
def _(t):
    return L.profile(t.customer, ["c_mktsegment"], ["c_acctbal", "c_custkey"])


@query("ag27_families", "WITH c AS (SELECT DISTINCT s_nationkey % 5 AS sheet, s_suppkey % 6 AS month, s_suppkey % 12 AS value FROM supplier), m AS (SELECT a.sheet AS a, b.sheet AS b, count(DISTINCT a.month) AS n FROM c a JOIN c b ON a.month = b.month AND a.sheet < b.sheet GROUP BY 1, 2 HAVING n >= 3), v AS (SELECT DISTINCT sheet, value FROM c), i AS (SELECT a.sheet AS a, b.sheet AS b, count(*) AS k FROM v a JOIN v b ON a.value = b.value AND a.sheet < b.sheet GROUP BY 1, 2), s AS (SELECT sheet, count(*) AS n FROM v GROUP BY 1) SELECT m.a, m.b, round(k / (x.n + y.n - k), 6) AS jaccard FROM m JOIN i ON m.a = i.a AND m.b = i.b JOIN s x ON x.sheet = m.a JOIN s y ON y.sheet = m.b WHERE k / (x.n + y.n - k) >= 0.4")
def _(t):
    return L.families(t.supplier.select((F.col("s_nationkey") % 5).alias("sheet"), (F.col("s_suppkey") % 6).alias("month"), (F.col("s_suppkey") % 12).alias("value")))


@query("ag28_digest_measures", "SELECT o_orderdate::DATE AS day, count(*) AS mails, count_if(o_orderpriority = '1-URGENT') AS urgent, count_if(o_orderpriority = '2-HIGH') AS high, count_if(o_orderpriority = '3-MEDIUM') AS medium, count_if(o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS low, count_if(o_orderstatus = 'O') AS open, count_if(o_orderstatus = 'F') AS done, count_if(o_orderstatus = 'P') AS waiting, count_if(o_totalprice >= 50000) AS large, count_if(o_totalprice >= 250000) AS very_large, round(sum(o_totalprice), 2) AS amount, round(max(o_totalprice), 2) AS largest, count(DISTINCT o_custkey) AS senders, count_if(o_orderkey % 20 = 0) AS held FROM orders GROUP BY 1")
def _(t):
    p, s, v = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    is_ = {"urgent": p == "1-URGENT", "high": p == "2-HIGH", "medium": p == "3-MEDIUM", "low": ~p.isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "open": s == "O", "done": s == "F", "waiting": s == "P", "large": v >= 50000, "very_large": v >= 250000, "held": F.col("o_orderkey") % 20 == 0}
    return t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("mails"), *[F.count_if(c).alias(k) for k, c in is_.items()], F.round(F.sum(v), 2).alias("amount"), F.round(F.max(v), 2).alias("largest"), F.countDistinct("o_custkey").alias("senders"))


@query("ag28_category_history", "SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderstatus AS category, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t):
    return t.orders.groupBy(F.trunc("o_orderdate", "month").alias("month"), F.col("o_orderstatus").alias("category")).agg(F.count("*").alias("n"))


@query("ag33_ordered_union", "WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS place FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY place) AS types, arg_min(event_type, place) AS first FROM f GROUP BY user_id")
def _(t):
    firsts = t.events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    ordered = firsts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_type"))).alias("x"))
    return ordered.select("user_id", F.array_join(F.col("x.event_type"), ",").alias("types"), F.col("x")[0]["event_type"].alias("first"))


@query("ag37_cautious_totals", "WITH r AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS r FROM lineitem) SELECT l_suppkey, round(sum(v) FILTER (WHERE r <= 50), 2) AS total, greatest(0, count(*) - 50)::BIGINT AS left_out, count(*) <= 50 AS exact FROM r GROUP BY l_suppkey")
def _(t):
    rows = t.lineitem.withColumn("at", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    return L.cautious_total(rows, "l_suppkey", "l_extendedprice", 50, rows.groupBy("l_suppkey").agg(F.count("*").alias("rows")))


@query("fl05_quoted_members", "SELECT c_custkey FROM customer WHERE c_nationkey = 7 OR c_custkey % 10 = 3")
def _(t):
    listed = F.to_json(F.array(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("k"), F.col("c_custkey") % 10)))
    members = F.from_json(listed, "array<string>")
    return t.customer.filter(F.array_contains(members, "n7") | F.array_contains(members, "k3")).select("c_custkey")


@query("fl07_not_flagged", "SELECT doc_id FROM labels WHERE NOT (toxic = 1 AND doc_id % 3 <> 0)")
def _(t):
    cleared = F.col("doc_id") % 3 == 0
    return t.labels.filter(~((F.col("toxic") == 1) & ~cleared)).select("doc_id")


@query("fl08_scaled_limits", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE round(l_discount * 100, 9) > 5 AND l_extendedprice >= 1200")
def _(t):
    return t.lineitem.filter(L.limit(F.col("l_discount"), ">", "5%") & L.limit(F.col("l_extendedprice"), ">=", "1.2k")).select("l_orderkey", "l_linenumber")


@query("fl09_date_limits", "SELECT o_orderkey, d < DATE '1995-01-01' AS before, d > DATE '1996-03-31' AS after, d BETWEEN DATE '1996-03-01' AND DATE '1997-12-31' AS between_ FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def _(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", L.date_limit(d, "before", "1995").alias("before"), L.date_limit(d, "after", "March 1996").alias("after"), L.date_limit(d, "between", "March 1996", "1997").alias("between_"))


@query("fl10_named_rows", "WITH s AS (SELECT p_partkey, 1.0 * contains(' ' || lower(p_name || ' ' || p_type) || ' ', ' ring ')::INT + 1.0 * contains(' ' || lower(p_name || ' ' || p_type) || ' ', ' small ')::INT + 2.0 * (p_size = 15)::INT AS score FROM part), x AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 AND score > 0 THEN score - 0.5 ELSE score END AS score FROM s) SELECT p_partkey, score FROM x WHERE score = (SELECT max(score) FROM x) AND score > 0")
def _(t):
    score = L.row_score([F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string")], ["ring", "small", "15"], F.col("p_partkey") % 10 == 0)
    return L.best_rows(t.part, score).select("p_partkey", "score")


@query("fl12_by_column", "SELECT p_partkey FROM part WHERE list_contains(regexp_extract_all(lower(p_type), '\\w+'), 'economy') AND list_contains(regexp_extract_all(lower(p_name), '\\w+'), 'ring')")
def _(t):
    return L.by_column(t.part, {"p_type": "economy", "p_name": "ring"}).select("p_partkey")


@query("fl18_working_days", "SELECT o_orderkey, (CASE isodow(d) WHEN 1 THEN d - 3 WHEN 7 THEN d - 2 ELSE d - 1 END)::DATE AS since FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def _(t):
    d = F.to_date("o_orderdate")
    back = F.when(F.weekday(d) == 0, 3).when(F.weekday(d) == 6, 2).otherwise(1)
    return t.orders.select("o_orderkey", F.date_sub(d, back).alias("since"))


@query("fl19_visible_meetings", "WITH c AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), h AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 33 = 0) SELECT o_orderkey FROM orders o WHERE o_orderstatus <> 'P' AND (o_custkey IN (SELECT * FROM c) OR o_totalprice > 100000) AND o_custkey NOT IN (SELECT * FROM h)")
def _(t):
    confirmed = t.orders.filter("o_orderstatus = 'F'").select("o_custkey").distinct().withColumn("confirmed", F.lit(True))
    held = t.orders.filter("o_orderkey % 33 = 0").select("o_custkey").distinct()
    rows = t.orders.filter("o_orderstatus <> 'P'").join(confirmed, "o_custkey", "left").join(held, "o_custkey", "left_anti")
    return rows.filter(F.coalesce("confirmed", F.lit(False)) | (F.col("o_totalprice") > 100000)).select("o_orderkey")


@query("src23_tables_in_text", "SELECT l_orderkey, 1 AS \"table\", r::INT AS \"row\", label, value FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, l_partkey::VARCHAR AS Part, CASE WHEN l_linenumber % 3 = 0 AND row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) > 1 THEN NULL ELSE l_returnflag END AS Flag, l_suppkey::VARCHAR AS Supp FROM lineitem) x, LATERAL (SELECT unnest(['Part', 'Supp', 'Flag']) AS label, unnest([Part, Supp, Flag]) AS value)")
def _(t):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    at = R.dealt(t.lineitem, "l_orderkey").withColumn("r", F.row_number().over(w))
    short = (F.col("l_linenumber") % 3 == 0) & (F.col("r") > 1)
    line = F.concat(F.lit("Part: "), "l_partkey", F.lit(" | Supp: "), "l_suppkey", F.when(short, "").otherwise(F.concat(F.lit(" | Flag: "), "l_returnflag")))
    texts = at.select("l_orderkey", "r", line.alias("line")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("x"))
    texts = texts.select("l_orderkey", F.concat(F.lit("Heading\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n\nEnd")).alias("text"))
    return L.table_lines(texts, "l_orderkey", "text")


@query("src24_facts", "SELECT o_orderkey, 'Status' AS name, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'Due', strftime(o_orderdate, '%Y-%m-%d') FROM orders")
def _(t):
    text = F.concat(F.lit("Status: "), "o_orderstatus", F.lit("\nItem: a | Price: 2\nprose goes: on\nDue:  "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return L.facts(t.orders.select("o_orderkey", text.alias("text")), "o_orderkey", "text")


@query("src25_cell_range", "SELECT l_orderkey AS \"row\", l_linenumber AS col, count(*) AS n FROM lineitem WHERE l_orderkey BETWEEN 2 AND 200 AND l_linenumber BETWEEN 2 AND 4 GROUP BY 1, 2")
def _(t):
    cells = t.lineitem.groupBy(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col")).agg(F.count("*").alias("n"))
    return L.cell_range(cells, "B2:D200")


@query("ex22_row_parts", "SELECT p_partkey, 'R' || p_partkey AS cell, p_name AS label, p_size::DOUBLE AS value FROM part")
def _(t):
    line = F.concat(F.lit("R"), "p_partkey", F.lit(" | "), "p_name", F.lit(" | "), F.format_string("%.2f", F.col("p_size").cast("double")))
    parts = F.split(line, r" \| ")
    return t.part.select("p_partkey", parts[0].alias("cell"), parts[1].alias("label"), parts[2].cast("double").alias("value"))


@query("ex23_key_column", "SELECT 'p_partkey' AS key")
def _(t):
    return t.spark.createDataFrame([(L.key_column(t.part, ["p_brand", "p_type", "p_partkey"]),)], "key string")


@query("ex24_closed_sections", "SELECT o_orderkey, coalesce(max((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS after_total FROM orders")
def _(t):
    return L.closed_sections(t.orders, "o_custkey", F.col("o_orderstatus") == "F", ["o_orderkey"]).select("o_orderkey", "after_total")


@query("ex25_record_details", "WITH d AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS k FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(k / n, 6) AS distinctness, k >= 0.9 * n AS is_record FROM d")
def _(t):
    d = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("k"))
    return d.select("l_suppkey", F.round(F.col("k") / F.col("n"), 6).alias("distinctness"), (F.col("k") >= 0.9 * F.col("n")).alias("is_record"))


@query("ex26_answer_points", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 7")
def _(t):
    return t.customer.filter("c_mktsegment = 'BUILDING'").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(7).select("c_custkey", "c_name", "c_acctbal")


@query("ex30_typed_cells", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN format('{:,.2f}', round(l_extendedprice, 2)) ELSE format('{:.0f}', round(l_discount * 100, 0)) || '%' END AS shown FROM lineitem")
def _(t):
    k = F.col("l_linenumber") % 3
    shown = F.when(k == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).when(k == 1, F.format_number(F.round("l_extendedprice", 2), 2)).otherwise(F.concat(F.round(F.col("l_discount") * 100, 0).cast("int").cast("string"), F.lit("%")))
    return t.lineitem.select("l_orderkey", "l_linenumber", shown.alias("shown"))


@query("ex32_list_totals", "SELECT l_orderkey, round(sum(l_quantity), 2) AS said, l_orderkey % 5 <> 0 AS right_ FROM lineitem GROUP BY l_orderkey")
def _(t):
    sums = t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("said"))
    claimed = F.col("said") + F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0)
    return sums.select("l_orderkey", "said", (F.abs(claimed - F.col("said")) <= 0.005).alias("right_"))


@query("ex33_unsupported_amounts", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS missing FROM orders")
def _(t):
    from ..functions.text import ungrounded

    price = F.format_string("%.2f", F.round("o_totalprice", 2))
    summary = F.concat(F.lit("Pays "), price, F.when(F.col("o_orderkey") % 4 == 0, " plus 77777.25").otherwise(""))
    return t.orders.select("o_orderkey", F.size(ungrounded(summary, F.concat(F.lit("the order of "), price, F.lit(" in all")))).cast("long").alias("missing"))


@query("ex34_lead_sentences", "SELECT doc_id, md5(regexp_extract(text, '^[^.!?\\n]*[.!?]?', 0)) AS lead FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(F.regexp_extract("text", r"^[^.!?\n]*[.!?]?", 0).cast("binary")).alias("lead"))


@query("ex35_validated_overlay", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE ELSE DATE '1995-01-01' END AS due, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice, 2) ELSE -1 END AS amount FROM orders")
def _(t):
    from ..functions.text import cell_date, parse_amount

    read_day = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("some day")
    read_amount = F.when(F.col("o_orderkey") % 2 == 0, F.format_string("$%.2f", F.round("o_totalprice", 2))).otherwise("n/a")
    return t.orders.select("o_orderkey", F.coalesce(cell_date(read_day), F.lit("1995-01-01").cast("date")).alias("due"), F.coalesce(parse_amount(read_amount).cast("double"), F.lit(-1.0)).alias("amount"))


@query("ex42_effective_text", "SELECT d.doc_id, md5(CASE WHEN l.quality = 0 THEN 'page reading ' || d.doc_id ELSE text END) AS text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    own = t.labels.select(F.col("doc_id").alias("_l"), "quality")
    read = F.when(F.col("quality") == 0, F.concat(F.lit("page reading "), "doc_id"))
    return t.documents.join(own, F.col("doc_id") == F.col("_l"), "left").select("doc_id", F.md5(F.coalesce(read, "text").cast("binary")).alias("text"))
