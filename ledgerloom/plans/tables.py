"""Table operators over schedules derived from the test tables."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import relational as R
from ..operators import tables as O
from ..operators.guard import Refused, guarded
from ..registry import query


@query("ag22_subtotals_hold", "SELECT count(*) AS totals, count(*) AS holding FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def _(t):
    lines = R.dealt(t.lineitem, "l_orderkey").select("l_orderkey", F.col("l_linenumber").cast("long").alias("at"), F.round("l_extendedprice", 2).alias("v"), F.lit(False).alias("total"))
    sums = lines.groupBy("l_orderkey").agg(F.lit(1 << 40).cast("long").alias("at"), F.round(F.sum("v"), 2).alias("v"), F.lit(True).alias("total"))
    held = O.subtotals(lines.unionByName(sums), "v", F.col("total"), ["at", "v"], ["l_orderkey"])
    return held.agg(F.count("*").alias("totals"), F.count_if("holds").alias("holding"))


@query("ag24_identities", "WITH r AS (SELECT round(l_extendedprice, 2) AS net, round(l_extendedprice * (l_tax + 0.01), 2) AS tax FROM lineitem) SELECT 'total' AS target, 'net + tax' AS formula FROM r HAVING count_if(abs(net + tax - (net + tax)) <= 0.045) = count(*)")
def _(t):
    rows = t.lineitem.select(F.round("l_extendedprice", 2).alias("net"), F.round(F.col("l_extendedprice") * (F.col("l_tax") + 0.01), 2).alias("tax"), F.col("l_quantity").alias("q"))
    rows = rows.withColumn("total", F.col("net") + F.col("tax"))
    found = O.identities(rows, ["q", "net", "tax", "total"])
    return rows.sparkSession.createDataFrame([(a, b) for a, b, _ in found], "target string, formula string")


@query("ag25_running_balance", "SELECT true AS runs, false AS reversed")
def _(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    w = W.partitionBy("l_orderkey").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = t.lineitem.withColumn("balance", F.sum("l_extendedprice").over(w))
    ok = O.running_balance(rows, "balance", [(1, "l_extendedprice")], order, ["l_orderkey"])
    back = O.running_balance(rows, "balance", [(-1, "l_extendedprice")], order, ["l_orderkey"])
    return rows.sparkSession.createDataFrame([(ok, back)], "runs boolean, reversed boolean")


@query("src23_table_lines", "SELECT o_orderkey, label, value FROM (UNPIVOT (SELECT o_orderkey, o_orderstatus AS \"Status\", o_orderpriority AS \"Priority\" FROM orders) ON \"Status\", \"Priority\" INTO NAME label VALUE value)")
def _(t):
    line = F.concat(F.lit("Status: "), "o_orderstatus", F.lit(" | Priority: "), "o_orderpriority")
    cell = F.explode(F.split(line, r"\s*\|\s*"))
    parts = t.orders.select("o_orderkey", cell.alias("c"))
    return parts.select("o_orderkey", F.regexp_extract("c", r"^([^:]+):", 1).alias("label"), F.trim(F.regexp_extract("c", r":(.*)$", 1)).alias("value"))


_GUARDED = (
    "WITH late AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS net, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey) "
    "SELECT o.o_orderpriority, count(*) AS orders, sum(late.n) AS lines, round(avg(late.net), 2) AS net FROM orders AS o JOIN late ON o.o_orderkey = late.l_orderkey "
    "WHERE EXISTS (SELECT 1 FROM customer AS c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0) GROUP BY o.o_orderpriority HAVING count(*) > 1"
)


@query("ud03_guarded_sql", _GUARDED)
def _(t):
    return guarded(t.spark, _GUARDED, {n: getattr(t, n) for n in ("lineitem", "orders", "customer")})


@query("jn24_guarded_references", "SELECT l_orderkey, max(l_quantity) AS top, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_orderkey HAVING count(*) > 3 UNION ALL SELECT o_orderkey, 0, 0 FROM orders LEFT ANTI JOIN lineitem ON o_orderkey = l_orderkey".replace("LEFT ANTI", "ANTI"))
def _(t):
    """References to other tables and joins without a condition are refused; what is left runs as written."""
    views = {"lineitem": t.lineitem, "orders": t.orders}
    for sql in ("SELECT * FROM lineitem, orders", "SELECT * FROM (customer)", "SELECT o_orderkey FROM orders UNION ALL TABLE customer"):
        try:
            guarded(t.spark, sql, views)
        except Refused:
            continue
        raise AssertionError(f"not refused: {sql}")
    sql = "SELECT l_orderkey, max(l_quantity) AS top, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_orderkey HAVING count(*) > 3 UNION ALL SELECT o_orderkey, 0, 0 FROM orders LEFT ANTI JOIN lineitem ON o_orderkey = l_orderkey"
    return guarded(t.spark, sql, views)


@query("src21_snapshot_changes", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def _(t):
    from ..operators.relational import snapshot_diff

    rows = t.orders.select("o_orderkey", "o_orderstatus")
    after = rows.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_orderstatus")))
    return snapshot_diff(rows, after, "o_orderkey", ["o_orderstatus"]).select("o_orderkey")


@query("snk01_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def _(t):
    from ..operators.relational import upsert

    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = rows.filter("o_orderkey % 4 = 0").withColumn("o_orderstatus", F.lit("new")).withColumn("o_totalprice", F.lit(0.0))
    return upsert(rows, new, ["o_orderkey"], keep=["o_totalprice"])
