import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import guard as G


@pytest.fixture(scope="module")
def views(spark):
    frame = spark.createDataFrame([(1, 10.0, "p", 5.0), (2, 20.0, "q", 6.0), (3, 30.0, None, 7.0)], "x int, y double, name string, balance double")
    return {"a": frame, "b": frame, "x": frame}


REFUSED = [
    "DELETE FROM x",
    "SELECT 1; SELECT 2",
    "SELECT * FROM a, b",
    "SELECT * FROM a CROSS JOIN b",
    "SELECT * FROM a NATURAL JOIN b",
    "SELECT randomblob(9)",
    "SELECT `reflect`('java.lang.System','getProperty','user.home') FROM a",
    "SELECT `java_method`('java.lang.System','getenv') FROM a",
    "SELECT * FROM parquet.`/etc`",
    "SELECT * FROM other",
    "SELECT * FROM a JOIN `text`.`/etc/passwd` ON true",
    "SELECT * FROM range(10)",
    "SELECT transform(x) USING 'cat' FROM a",
    "SELECT x FROM a WHERE x = \x00",
    "SELECT * FROM (secret)",
    "SELECT * FROM (text.`/etc/hostname`)",
    "SELECT x FROM a UNION ALL TABLE secret",
    "SELECT x FROM a UNION ALL (TABLE secret)",
    "SELECT x, (SELECT max(x) FROM (secret)) FROM a",
    "SELECT x FROM a WHERE x IN (SELECT x FROM secret)",
    "SELECT x FROM a WHERE EXISTS (SELECT 1 FROM secret WHERE secret.x = a.x)",
    "WITH c AS (SELECT * FROM secret) SELECT * FROM c",
    "SELECT * FROM (WITH secret AS (SELECT x FROM a) SELECT * FROM secret) UNION ALL SELECT x FROM secret",
    "SELECT * FROM VALUES (1), (2)",
    "SELECT * FROM a, LATERAL (SELECT * FROM b WHERE b.x = a.x)",
    "SELECT explode(array(1, 2)) FROM a",
    "SELECT * FROM a LATERAL VIEW explode(array(1)) AS e",
    "SELECT * FROM a TABLESAMPLE (10 PERCENT)",
    "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 9) SELECT * FROM r",
    "SELECT system.builtin.reflect('java.lang.System', 'getenv') FROM a",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getenv') FROM a",
    "SELECT * FROM IDENTIFIER('secret')",
    "INSERT INTO a SELECT * FROM b",
    "CREATE TABLE t AS SELECT * FROM a",
    "EXPLAIN SELECT * FROM a",
    "SET spark.sql.ansi.enabled = false",
    "SELECT * FROM (DESCRIBE a)",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, views, sql):
    with pytest.raises(G.Refused):
        G.guarded(spark, sql, views)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT sum(balance) FROM x",
        "SELECT sum(a.balance*1) FROM a",
        "SELECT avg(b) FROM (SELECT balance AS b FROM a) AS s",
        "WITH c AS (SELECT x, balance + y AS z FROM a) SELECT x, sum(z) OVER (ORDER BY x) FROM c",
        "SELECT sum(v) FROM (SELECT y AS v FROM a UNION ALL SELECT balance FROM b)",
        "SELECT sum((SELECT max(balance) FROM b)) FROM a",
        "SELECT stddev(m) FROM (SELECT name, max(balance) AS m FROM a GROUP BY name)",
        "SELECT median(balance) FROM a",
    ],
)
def test_running_balances_are_not_added_up(spark, views, sql):
    with pytest.raises(G.Refused, match="running balance"):
        G.guarded(spark, sql, views, ["Balance"])


ALLOWED = {
    "SELECT count(*) FROM a JOIN b ON a.x = b.x": [(3,)],
    "WITH c AS (SELECT 1 AS x) SELECT max(x) FROM c": [(1,)],
    "SELECT max(balance), count(balance), min(y) FROM a": [(7.0, 3, 10.0)],
    "SELECT sum(n) FROM (SELECT count(balance) AS n FROM a)": [(3,)],
    "SELECT x FROM a WHERE x IN (1, 2) ORDER BY 1 DESC": [(2,), (1,)],
    "SELECT `x`, 'it''s (fine), or; not' AS t -- FROM z\nFROM `a` /* , b */ WHERE x IS DISTINCT FROM 3": [(1, "it's (fine), or; not"), (2, "it's (fine), or; not")],
    "SELECT name, sum(y) AS s FROM a GROUP BY name HAVING sum(y) > 15 ORDER BY s": [("q", 20.0), (None, 30.0)],
    "SELECT x, rank() OVER (ORDER BY y DESC) FROM A WHERE name LIKE 'p%' OR y BETWEEN 25 AND 99": [(3, 1), (1, 2)],
    "SELECT CASE WHEN x = 1 THEN upper(name) ELSE name || '!' END FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.x = a.x AND b.y < 25)": [("P",), ("q!",)],
    "SELECT x FROM a EXCEPT SELECT x FROM b WHERE x > 1": [(1,)],
    "WITH c AS (SELECT x FROM a), d AS (SELECT x + 1 AS x FROM c) SELECT c.x FROM c LEFT ANTI JOIN d ON c.x = d.x": [(1,)],
    "SELECT sum(y) OVER w FROM a WINDOW w AS (ORDER BY x ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)": [(10.0,), (30.0,), (50.0,)],
    "SELECT year(DATE '2024-02-01') + month(DATE '2024-02-01'), CAST('7' AS INT)": [(2026, 7)],
}


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, views, sql):
    got = [tuple(r) for r in G.guarded(spark, sql, views, ["balance"]).collect()]
    assert sorted(got, key=repr) == sorted(ALLOWED[sql], key=repr)


@pytest.mark.parametrize("on", ["ON true", "ON a.x = a.x", "ON 1 = 1"])
def test_joins_need_a_condition_that_holds_them_together(spark, views, on):
    with pytest.raises(Exception, match="(?i)cartesian|cross"):
        G.run(spark, f"SELECT a.x FROM a JOIN b {on}", views)


def test_the_session_of_the_caller_stays_as_it_was(spark, views):
    views["a"].limit(1).createOrReplaceTempView("a")
    spark.sparkContext.setJobGroup("mine", "my work")
    rows, more = G.run(spark, "SELECT id FROM a ORDER BY id", {"a": spark.range(40)}, most=5)
    assert [r[0] for r in rows] == [0, 1, 2, 3, 4] and more
    assert spark.table("a").count() == 1 and spark.conf.get("spark.sql.crossJoin.enabled") == "true"
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "mine"
    spark.catalog.dropTempView("a")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_refused_queries_touch_no_file(spark, views, tmp_path):
    """A missing path would be an error of the analysis; the guard has refused before."""
    with pytest.raises(G.Refused, match="not one of the tables"):
        G.guarded(spark, f"SELECT * FROM parquet.`{tmp_path}/none`", views)


def test_a_long_query_is_cancelled(spark):
    big = spark.range(1 << 34).select((F.col("id") % 7).alias("x"), "id")
    with pytest.raises(Exception, match="(?i)cancel"):
        G.run(spark, "SELECT x, sum(id) FROM a GROUP BY x", {"a": big}, seconds=1.0)
