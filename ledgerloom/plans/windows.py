"""Window, order, paging and set operators over the test tables."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import relational as R
from ..registry import query
from ..streaming.windows import sessions


@query("wn01_latest_row", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", "ts", "event_id")).alias("event_id"))


@query(
    "wn02_series_and_occurrence",
    "WITH s AS (SELECT user_id, max(event_id) AS sid FROM events GROUP BY user_id), o AS (SELECT user_id, event_type, max(event_id) AS oid FROM events GROUP BY user_id, event_type) SELECT o.user_id, event_type, CASE WHEN oid >= sid THEN oid ELSE sid END AS winner FROM o JOIN s ON o.user_id = s.user_id",
)
def _(t):
    series = t.events.groupBy("user_id").agg(F.max("event_id").alias("sid"))
    single = t.events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("oid"))
    return single.join(series, "user_id").select("user_id", "event_type", F.when(F.col("oid") >= F.col("sid"), F.col("oid")).otherwise(F.col("sid")).alias("winner"))


@query("wn03_previous_row", "SELECT l_orderkey, l_linenumber, round(l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice), 2) AS step FROM lineitem")
def _(t):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") - F.lag("l_quantity").over(w), 2).alias("step"))


@query("wn04_version_pairs", "SELECT a, b FROM (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, o_orderkey AS b FROM orders) WHERE a IS NOT NULL")
def _(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(F.lag("o_orderkey").over(w).alias("a"), F.col("o_orderkey").alias("b")).filter("a is not null")


@query("wn05_question_answer", "SELECT conv_id, turn, answer FROM (SELECT conv_id, turn, role, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'")
def _(t):
    w = W.partitionBy("conv_id").orderBy("turn")
    pairs = t.conversations.select("conv_id", "turn", "role", F.lead("role").over(w).alias("_r"), F.lead("text").over(w).alias("answer"))
    return pairs.filter("role = 'user' and _r = 'assistant'").select("conv_id", "turn", "answer")


@query(
    "wn06_sums_since_mark",
    "WITH m AS (SELECT *, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS g FROM lineitem) SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey, g ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING), 2) AS run FROM m",
)
def _(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    marked = t.lineitem.withColumn("g", F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).over(W.partitionBy("l_orderkey").orderBy(*order)))
    run = F.sum("l_quantity").over(W.partitionBy("l_orderkey", "g").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return marked.select("l_orderkey", "l_linenumber", F.round(run, 2).alias("run"))


@query("wn07_rank_and_count", "SELECT user_id, event_id, r, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r <= 7")
def _(t):
    r = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    top = t.events.select("user_id", "event_id", r.alias("r")).filter("r <= 7")
    return top.join(t.events.groupBy("user_id").agg(F.count("*").alias("n")), "user_id").select("user_id", "event_id", "r", "n")


@query("wn08_fill_down", "SELECT event_id, last_value(CASE WHEN value > 80 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS label FROM events")
def _(t):
    blank = t.events.withColumn("label", F.when(F.col("value") > 80, F.col("event_type")))
    return R.fill_down(blank, "label", ["ts", "event_id"], ["user_id"]).select("event_id", "label")


@query("wn09_keep_first", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(t):
    return t.documents.groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("wn10_round_robin", "SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY depth, source, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS depth FROM documents) WHERE depth <= 5) WHERE used <= 50000")
def _(t):
    deep = t.documents.select("doc_id", "source", "n_chars", F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("depth")).filter("depth <= 5")
    rounds = deep.groupBy("depth").agg(F.sum("n_chars").alias("whole"))
    earlier = rounds.alias("r").join(rounds.alias("e"), F.col("e.depth") < F.col("r.depth"), "left").groupBy(F.col("r.depth").alias("depth")).agg(F.coalesce(F.sum("e.whole"), F.lit(0)).alias("before"))
    within = F.sum("n_chars").over(W.partitionBy("depth").orderBy("source", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    open_rounds = deep.join(earlier.filter("before <= 50000"), "depth")
    return open_rounds.withColumn("used", F.col("before") + within).filter("used <= 50000").select("doc_id")


for _name, _order, _cols in (
    ("newest", "o_orderdate DESC, o_orderkey", lambda: [F.desc("o_orderdate"), "o_orderkey"]),
    ("oldest", "o_orderdate, o_orderkey", lambda: ["o_orderdate", "o_orderkey"]),
    ("score", "o_totalprice DESC, o_orderkey", lambda: [F.desc("o_totalprice"), "o_orderkey"]),
    ("queue", "o_orderpriority, o_orderdate, o_orderkey", lambda: ["o_orderpriority", "o_orderdate", "o_orderkey"]),
):
    query(f"so01_page_{_name}", f"SELECT o_orderkey FROM orders ORDER BY {_order} LIMIT 20 OFFSET 40")(lambda t, c=_cols: R.page(t.orders, c(), 20, 40).select("o_orderkey"))


@query("so02_enum_rank", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey LIMIT 60")
def _(t):
    return t.orders.orderBy(R.ranked_value(F.col("o_orderstatus"), ["P", "O"]), "o_orderkey").limit(60).select("o_orderkey")


@query("so03_nulls_last", "SELECT c_custkey, last_date FROM (SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last_date FROM customer) ORDER BY last_date NULLS LAST, c_custkey LIMIT 120")
def _(t):
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_date"))
    return t.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").orderBy(F.asc_nulls_last("last_date"), "c_custkey").limit(120).select("c_custkey", "last_date")


@query("so04_total_of_page", "SELECT count(*) AS n FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000")
def _(t):
    return t.orders.filter("o_totalprice between 1000 and 200000").agg(F.count("*").alias("n"))


@query("so05_keyset", "SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 25")
def _(t):
    return R.keyset_page(t.orders, "o_orderkey", 500, 25).select("o_orderkey")


@query("so06_protected_subset", "SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE o_orderstatus = 'P' OR r <= 100")
def _(t):
    guarded = t.orders.filter("o_orderstatus = 'P'").select("o_orderkey")
    first = t.orders.orderBy(F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey")
    return guarded.union(first).distinct()


@query("so07_two_stage_top", "SELECT event_id FROM (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 40) ORDER BY ts DESC, event_id LIMIT 10")
def _(t):
    return t.events.orderBy(F.desc("value"), "event_id").limit(40).orderBy(F.desc("ts"), "event_id").limit(10).select("event_id")


@query("so09_one_more", "SELECT count(*) > 25 AS more FROM (SELECT 1 FROM customer LIMIT 26)")
def _(t):
    return t.customer.limit(26).agg((F.count("*") > 25).alias("more"))


@query("st01_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("st02_difference", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).subtract(t.supplier.select("s_nationkey"))


@query("st03_bag_difference", "SELECT l_linenumber AS n FROM lineitem WHERE l_quantity > 25 EXCEPT ALL SELECT l_linenumber FROM lineitem WHERE l_quantity <= 25")
def _(t):
    n = F.col("l_linenumber").alias("n")
    return t.lineitem.filter("l_quantity > 25").select(n).exceptAll(t.lineitem.filter("l_quantity <= 25").select(n))


@query(
    "st04_cell_diff",
    "WITH a AS (SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 7 <> 0) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v",
)
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v"))
    after = rows.filter("k % 7 <> 0").withColumn("v", F.when(F.expr("k % 5 = 0"), "x").otherwise(F.col("v")))
    return R.snapshot_diff(rows.filter("k % 3 <> 0"), after, "k", ["v"])


@query("st05_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("st06_value_overlap", "WITH s AS (SELECT list(DISTINCT c_nationkey) AS a FROM customer), p AS (SELECT list(DISTINCT s_nationkey) AS b FROM supplier) SELECT round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM s, p")
def _(t):
    a = t.customer.select(F.col("c_nationkey").alias("k"), F.lit(1).alias("side")).distinct()
    b = t.supplier.select(F.col("s_nationkey").alias("k"), F.lit(2).alias("side")).distinct()
    sides = a.union(b).groupBy("k").agg(F.sum("side").alias("s"))
    return sides.agg(F.round(F.avg((F.col("s") == 3).cast("double")), 6).alias("jaccard"))


@query("sm_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(t):
    from ..streaming.windows import tumbling

    return tumbling(t.events, "ts", "1 day", ["event_type"], "value")


@query("sm01_sessions", "WITH g AS (SELECT user_id, ts, value, CASE WHEN date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) >= 7200 THEN 1 ELSE 0 END AS cut FROM events), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def _(t):
    return sessions(t.events, "user_id", "ts", 7200)
