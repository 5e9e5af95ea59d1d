"""Questions put to many tables, and figures of answers held against their sources."""

from pyspark.sql import functions as F

from ..operators import grounding as G
from ..operators import questions as Q
from ..registry import query

#: A document for each region; a table of customers for each nation, and a hidden one of suppliers for nations with even keys.
_RK15 = r"""
WITH q AS (SELECT s_suppkey AS question, n_regionkey AS doc,
             'What is the account balance of ' || ['AUTOMOBILE', 'building', 'FURNITURE', 'HOUSEHOLD', 'machinery'][s_suppkey % 5 + 1] || ' Customer#' || lpad((s_suppkey * 13)::VARCHAR, 9, '0')
             || CASE s_suppkey % 3 WHEN 0 THEN ' in ' || n_name WHEN 1 THEN ' or Supplier#' || lpad(s_suppkey::VARCHAR, 9, '0') ELSE '' END || CASE WHEN s_suppkey % 4 = 0 THEN ' over 1,000?' ELSE '?' END AS text
           FROM supplier JOIN nation ON s_nationkey = n_nationkey),
t AS (SELECT n_regionkey AS doc, n_nationkey * 2 AS tab, lower(n_name) AS title, false AS hidden, ['account', 'balance'] AS h1, ['account', 'name'] AS h2, ['segment'] AS h3 FROM nation
      UNION ALL SELECT n_regionkey, n_nationkey * 2 + 1, 'suppliers', true, ['balance'], ['supplier'], ['country'] FROM nation WHERE n_nationkey % 2 = 0),
r AS (SELECT c_nationkey * 2 AS tab, ['customer', split_part(c_name, '#', 2)] AS name, [lower(c_mktsegment)] AS other FROM customer
      UNION ALL SELECT s_nationkey * 2 + 1, ['supplier', split_part(s_name, '#', 2)], [lower(n_name)] FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 2 = 0),
w AS (SELECT question, doc, text, list_distinct(regexp_extract_all(lower(text), '\w+')) AS w FROM q),
fit AS (SELECT w.*, t.tab, list_contains(w, title) AS says, hidden, h1, h2, h3 FROM w JOIN t USING (doc)),
open AS (SELECT * FROM fit WHERE CASE WHEN (SELECT bool_or(f.says) FROM fit AS f WHERE f.question = fit.question) THEN says ELSE NOT hidden END),
rows_ AS (SELECT question, open.tab, w, list_intersect(w, name || other) AS hits, h1, h2, h3 FROM open JOIN r USING (tab)),
best AS (SELECT question, tab, max(len(hits) + len(list_filter(hits, lambda x: regexp_matches(x, '[0-9]')))) AS score, len(list_distinct(flatten(list(hits)))) AS named FROM rows_ GROUP BY question, tab),
cols AS (SELECT question, tab, text, list_filter([list_intersect(w, h1), list_intersect(w, h2), list_intersect(w, h3)], lambda x, i: 2 * len(x) >= len([h1, h2, h3][i]) AND len(x) > 0) AS c FROM open),
kept AS (SELECT question, tab, text, len(list_filter(c, lambda x: len(list_filter(c, lambda y: len(y) > len(x) AND list_has_all(y, x))) = 0)) AS n FROM cols),
ranked AS (SELECT k.question, k.tab, coalesce(named, 0) AS named, 2.0 * n + coalesce(score, 0) + regexp_matches(text, 'over 1,000')::INT AS weight FROM kept k LEFT JOIN best USING (question, tab) WHERE n > 0 OR named > 0)
SELECT question, arg_min(tab, (-named, -weight, tab)) AS "table", max(named)::INT AS named, arg_min(weight, (-named, -weight, tab)) AS weight FROM ranked GROUP BY question
"""


@query("rk15_answer_tables", _RK15)
def _(t):
    nations = t.nation.select("n_nationkey", "n_regionkey", "n_name")
    people = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    traders = t.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    even = F.col("n_nationkey") % 2 == 0
    segment = F.element_at(F.array(*[F.lit(s) for s in ("AUTOMOBILE", "building", "FURNITURE", "HOUSEHOLD", "machinery")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    number = lambda c: F.lpad(c.cast("string"), 9, "0")
    more = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" in "), "n_name")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit(" or Supplier#"), number(F.col("s_suppkey")))).otherwise("")
    text = F.concat(F.lit("What is the account balance of "), segment, F.lit(" Customer#"), number(F.col("s_suppkey") * 13), more, F.when(F.col("s_suppkey") % 4 == 0, " over 1,000?").otherwise("?"))
    questions = traders.select(F.col("s_suppkey").alias("question"), F.col("n_regionkey").alias("doc"), text.alias("text"))
    own = lambda frame, at, hidden, title: frame.select(F.col("n_regionkey").alias("doc"), at.alias("table"), title.alias("title"), F.lit(hidden).alias("hidden"))
    tables = own(nations, F.col("n_nationkey") * 2, False, F.concat("n_name", F.lit(" sheet"))).unionByName(own(nations.filter(even), F.col("n_nationkey") * 2 + 1, True, F.lit("Suppliers")))
    heads = lambda frame, at, names: frame.select(F.col("n_regionkey").alias("doc"), at.alias("table"), F.explode(F.array(*[F.lit(n) for n in names])).alias("heading"))
    headings = heads(nations, F.col("n_nationkey") * 2, ["Account balance 2024", "Account name", "Segment"]).unionByName(heads(nations.filter(even), F.col("n_nationkey") * 2 + 1, ["Balance", "Supplier", "Country"]))
    cell = lambda frame, at, row, columns: frame.select(F.col("n_regionkey").alias("doc"), at.alias("table"), row.cast("long").alias("row"), F.lit(False).alias("is_total"), F.explode(F.array(*columns)).alias("value"))
    cells = cell(people, F.col("n_nationkey") * 2, F.col("c_custkey"), ["c_name", "c_mktsegment", F.lit("-")]).unionByName(cell(traders.filter(even), F.col("n_nationkey") * 2 + 1, F.col("s_suppkey"), ["s_name", "n_name", F.lit("-")]))
    return Q.best_tables(questions, tables, headings, cells)


_EX32 = r"""
WITH l AS (SELECT l_orderkey AS k, round(l_extendedprice, 2)::DECIMAL(18, 2) AS v FROM lineitem),
g AS (SELECT k, min(v) AS a, max(v) AS z, count(DISTINCT v) AS n FROM l GROUP BY k),
c AS (SELECT k, kind, CASE kind WHEN 0 THEN a WHEN 1 THEN a + z WHEN 2 THEN z - a WHEN 3 THEN a + z + 1 ELSE 2 * z + 123456.78 END AS figure FROM g, (SELECT unnest(range(5)) AS kind) WHERE k % 5 = kind AND n > 1),
s AS (SELECT DISTINCT k, v FROM l)
SELECT c.k AS answer, c.figure::DOUBLE AS figure,
       CASE WHEN EXISTS (FROM s WHERE s.k = c.k AND abs(s.v - figure) <= 0.005) THEN 'stated'
            WHEN EXISTS (FROM s AS x, s AS y WHERE x.k = c.k AND y.k = c.k AND x.v <> y.v AND (abs(x.v + y.v - figure) <= 0.005 OR abs(x.v - y.v - figure) <= 0.005)) THEN 'worked out' ELSE 'unsupported' END AS support
FROM c
"""


@query("ex32_worked_out_figures", _EX32)
def _(t):
    """The source is the order's lines as text; the answer says one figure of them, a sum, a difference, or something else."""
    shown = lambda c: F.format_number(c, 2)
    price = F.round("l_extendedprice", 2).cast("decimal(18,2)")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("Line of $"), shown(price)))), "\n").alias("source"), F.min(price).alias("a"), F.max(price).alias("z"), F.countDistinct(price).alias("n"))
    kind = F.col("k") % 5
    figure = F.when(kind == 0, F.col("a")).when(kind == 1, F.col("a") + F.col("z")).when(kind == 2, F.col("z") - F.col("a")).when(kind == 3, F.col("a") + F.col("z") + 1).otherwise(2 * F.col("z") + F.lit("123456.78").cast("decimal(18,2)"))
    texts = lines.filter("n > 1").select(F.col("k").alias("answer"), F.concat(F.lit("In all that is $"), shown(figure), F.lit(".")).alias("text"), "source")
    return G.supported(texts.select("answer", "text"), texts.select("answer", "source"))
