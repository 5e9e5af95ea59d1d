"""Aggregations over the test tables."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import relational as R
from ..registry import query


def _money(c, places=2):
    return F.round(F.sum(c), places)


@query("ag01_counters", "SELECT count(*) AS n, count_if(o_orderstatus = 'F') AS done, count_if(o_orderstatus = 'O') AS open, count_if(o_totalprice > 300000) AS large, count_if(o_orderpriority = '1-URGENT') AS urgent, coalesce(count_if(o_orderstatus = 'none'), 0) AS none FROM orders")
def _(t):
    c = lambda x: F.coalesce(F.count_if(F.expr(x)), F.lit(0))
    return t.orders.agg(F.count("*").alias("n"), c("o_orderstatus = 'F'").alias("done"), c("o_orderstatus = 'O'").alias("open"), c("o_totalprice > 300000").alias("large"), c("o_orderpriority = '1-URGENT'").alias("urgent"), c("o_orderstatus = 'none'").alias("none"))


@query("ag02_count_by_status", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("ag03_count_by_type", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("ag04_top_domains", "SELECT lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY host ORDER BY n DESC, host LIMIT 10")
def _(t):
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("host")
    return t.pages.groupBy(host).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(10)


@query("ag05_history_count", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) - 1 AS others FROM orders WHERE o_orderstatus <> 'P'")
def _(t):
    own = t.orders.filter("o_orderstatus <> 'P'")
    return own.join(own.groupBy("o_custkey").agg((F.count("*") - 1).alias("others")), "o_custkey").select("o_orderkey", "others")


@query("ag06_rare_keys", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) <= 25")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).filter("n <= 25")


@query("ag07_latest_by_group", "SELECT user_id, event_type, max(event_id) AS last_id, min(event_id) AS first_id FROM events GROUP BY user_id, event_type")
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("last_id"), F.min("event_id").alias("first_id"))


@query("ag08_least_by_key_page", "SELECT l_orderkey, min(l_quantity) AS least FROM lineitem WHERE l_orderkey > 100 GROUP BY l_orderkey ORDER BY l_orderkey LIMIT 50")
def _(t):
    return t.lineitem.filter("l_orderkey > 100").groupBy("l_orderkey").agg(F.min("l_quantity").alias("least")).orderBy("l_orderkey").limit(50)


@query("ag09_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("ag10_counts_beside", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
def _(t):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("ag11_index_version", "SELECT count(*) AS n, max(vec_id) AS last_id FROM embeddings")
def _(t):
    return t.embeddings.agg(F.count("*").alias("n"), F.max("vec_id").alias("last_id"))


@query("ag12_coverage", "SELECT count(DISTINCT l.doc_id) AS covered, count(DISTINCT d.doc_id) AS total FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    own = t.labels.select(F.col("doc_id").alias("l"))
    return t.documents.join(own, F.col("doc_id") == F.col("l"), "left").agg(F.countDistinct("l").alias("covered"), F.countDistinct("doc_id").alias("total"))


@query("ag13_exact_sum_average", "SELECT sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total, round(avg(l_quantity), 2) AS average FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    r = t.lineitem.filter("l_returnflag = 'R'")
    return r.agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"), F.round(F.avg("l_quantity"), 2).alias("average"))


@query("ag14_count_nonzero", "SELECT count(*) AS n FROM lineitem WHERE l_discount <> 0")
def _(t):
    return t.lineitem.filter("l_discount <> 0").agg(F.count("*").alias("n"))


@query("ag15_max_with_runners_up", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 4")
def _(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(4).select("o_orderkey", "o_totalprice")


@query("ag16_first_last_by_date", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders WHERE o_orderdate IS NOT NULL GROUP BY o_custkey")
def _(t):
    at = F.struct("o_orderdate", "o_orderkey")
    return t.orders.filter("o_orderdate is not null").groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first_key"), F.max_by("o_orderkey", at).alias("last_key"))


@query(
    "ag17_group_totals",
    "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total, round(avg(l_quantity), 4) AS average, count(*) AS n FROM lineitem WHERE l_quantity <= 40 AND l_shipdate < TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 1",
)
def _(t):
    rows = t.lineitem.filter((F.col("l_quantity") <= 40) & (F.col("l_shipdate") < F.lit("1998-09-02").cast("timestamp")))
    g = rows.groupBy("l_returnflag", "l_linestatus")
    return g.agg(_money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total"), F.round(F.avg("l_quantity"), 4).alias("average"), F.count("*").alias("n")).filter("n > 1")


@query("ag18_total_over_columns", "SELECT round(sum(l_extendedprice + l_tax + l_discount), 2) AS total FROM lineitem")
def _(t):
    return t.lineitem.agg(_money(F.col("l_extendedprice") + F.col("l_tax") + F.col("l_discount")).alias("total"))


@query("ag19_difference_of_rows", "SELECT round(max(CASE WHEN r_name = 'ASIA' THEN s END) - max(CASE WHEN r_name = 'EUROPE' THEN s END), 2) AS difference FROM (SELECT r_name, sum(c_acctbal) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)")
def _(t):
    s = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    p = s.groupBy().pivot("r_name", ["ASIA", "EUROPE"]).agg(F.sum("c_acctbal"))
    return p.select(F.round(F.col("ASIA") - F.col("EUROPE"), 2).alias("difference"))


@query("ag20_change_by_period", "WITH y AS (SELECT year(o_orderdate)::INT AS y, sum(o_totalprice) AS s FROM orders GROUP BY 1), c AS (SELECT y, s, lag(s) OVER (ORDER BY y) AS p FROM y) SELECT y, round(s - p, 2) AS change, round(100 * (s - p) / nullif(p, 0), 2) AS percent FROM c")
def _(t):
    y = t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("s")).withColumn("p", F.lag("s").over(W.orderBy("y")))
    return y.select("y", F.round(F.col("s") - F.col("p"), 2).alias("change"), F.round(F.try_divide(100 * (F.col("s") - F.col("p")), F.col("p")), 2).alias("percent"))


@query("ag21_over_budget", "SELECT p_partkey, round(avg(l_extendedprice / l_quantity), 2) AS actual, p_retailprice AS budget FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_retailprice HAVING avg(l_extendedprice / l_quantity) > p_retailprice")
def _(t):
    g = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey", "p_retailprice").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("a"))
    return g.filter(F.col("a") > F.col("p_retailprice")).select("p_partkey", F.round("a", 2).alias("actual"), F.col("p_retailprice").alias("budget"))


@query("ag26_column_profile", "SELECT count(*) AS n, count_if(c_acctbal < 0) AS below_zero, min(c_acctbal) AS least, max(c_acctbal) AS most, count(DISTINCT c_mktsegment) AS segments FROM customer")
def _(t):
    return t.customer.agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("below_zero"), F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"), F.countDistinct("c_mktsegment").alias("segments"))


@query(
    "ag28_daily_digest",
    "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users, count_if(value > 90) AS high, round(sum(value), 2) AS total FROM events GROUP BY 1",
)
def _(t):
    g = t.events.groupBy(F.to_date("ts").alias("day"))
    return g.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 90).alias("high"), _money("value").alias("total"))


@query("ag29_best_reason", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def _(t):
    best = t.events.groupBy("user_id").agg(F.min(F.struct(-F.col("value"), "event_id", "value")).alias("b"))
    return best.select("user_id", "b.event_id", "b.value")


@query("ag30_learned_weights", "SELECT source, least(1.6, greatest(0.5, 1 + 0.15 * (sum(toxic) - count_if(toxic = 0)))) AS weight FROM labels JOIN documents USING (doc_id) GROUP BY source")
def _(t):
    g = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg((F.sum("toxic") - F.count_if(F.col("toxic") == 0)).alias("v"))
    return g.select("source", F.least(F.lit(1.6), F.greatest(F.lit(0.5), 1 + 0.15 * F.col("v"))).alias("weight"))


@query("ag31_mean_and_spread", "SELECT label, round(avg(embedding[1]), 5) AS mean, round(stddev_pop(embedding[1]), 5) AS spread FROM embeddings GROUP BY label")
def _(t):
    x = F.col("embedding")[0].cast("double")
    return t.embeddings.groupBy("label").agg(F.round(F.avg(x), 5).alias("mean"), F.round(F.stddev_pop(x), 5).alias("spread"))


@query("ag33_merged_sets", "SELECT user_id, list_sort(list_distinct(list(event_type))) AS types FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("types"))


@query("ag34_column_comparison", "SELECT l_orderkey, l_linenumber, round(l_tax - l_discount, 4) AS difference FROM lineitem ORDER BY difference DESC, l_orderkey, l_linenumber LIMIT 50")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_tax") - F.col("l_discount"), 4).alias("difference"))
    return d.orderBy(F.desc("difference"), "l_orderkey", "l_linenumber").limit(50)


@query("ag36_middle", "SELECT event_type, round(median(value), 4) AS middle FROM events GROUP BY event_type")
def _(t):
    return R.medians(t.events, ["event_type"], "value").select("event_type", F.round("middle", 4).alias("middle"))


@query("ag_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
