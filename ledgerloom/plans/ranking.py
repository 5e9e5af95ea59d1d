"""Search, ranking and scoring over the test tables."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import relational as R
from ..operators import search as S
from ..registry import query


@query("rk02_tf_idf", "WITH c AS (SELECT doc_id, (length(text) - length(replace(lower(text), 'inge', ''))) / 4 AS a, (length(text) - length(replace(lower(text), 'tion', ''))) / 4 AS b FROM documents), s AS (SELECT count(*) AS n, count_if(a > 0) AS da, count_if(b > 0) AS db FROM c) SELECT doc_id, round(CASE WHEN a > 0 THEN (1 + ln(a)) * ln(1 + n / da) ELSE 0 END + CASE WHEN b > 0 THEN (1 + ln(b)) * ln(1 + n / db) ELSE 0 END, 5) AS score FROM c, s WHERE a > 0 OR b > 0")
def _(t):
    return S.tf_idf(t.documents, "text", ["inge", "tion"]).select("doc_id", F.round("score", 5).alias("score"))


_DOT = "list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 3)), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


@query("rk03_vector_search", f"WITH b AS (SELECT vec_id, {_DOT} AS score FROM embeddings), s AS (SELECT avg(score) AS m, stddev_pop(score) AS d, count(*) AS n, max(score) AS top FROM b) SELECT vec_id, round(score, 4) AS score FROM b, s WHERE score >= 0.6 AND score >= top - 0.08 AND (d = 0 OR (score - m) / d >= least(2.5, 0.75 * sqrt(n - 1)))")
def _(t):
    asked = t.embeddings.filter("vec_id = 3").first()["embedding"]
    return S.vector_search(t.embeddings, "vec_id", "embedding", asked).select("vec_id", F.round("score", 4).alias("score"))


@query("ag32_best_per_owner", f"SELECT label, round(max({_DOT}), 4) AS score FROM embeddings GROUP BY label")
def _(t):
    asked = t.embeddings.filter("vec_id = 3").first()["embedding"]
    q = F.array(*[F.lit(float(x)) for x in asked])
    return t.embeddings.groupBy("label").agg(F.round(F.max(S.dot(F.col("embedding"), q)), 4).alias("score"))


_HAS = lambda c, t: f"regexp_matches({c}, '(?i)(^|[^\\w]){t}(s|es)?([^\\w]|$)')"


@query("rk01_keyword_search", f"WITH h AS (SELECT doc_id, coalesce(source, '') AS h, coalesce(text, '') AS r, 3 * contains(lower(coalesce(source, '')), 'then')::INT + contains(lower(coalesce(text, '')), 'then')::INT + 3 * contains(lower(coalesce(source, '')), 'on')::INT + contains(lower(coalesce(text, '')), 'on')::INT AS hits FROM documents), f AS (SELECT * FROM h WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 80), w AS (SELECT doc_id, hits, CASE WHEN {_HAS('h', 'then')} THEN 4 WHEN {_HAS('r', 'then')} THEN 1 ELSE 0 END + CASE WHEN {_HAS('h', 'on')} THEN 4 WHEN {_HAS('r', 'on')} THEN 1 ELSE 0 END AS whole FROM f) SELECT doc_id, hits, whole FROM w WHERE whole > 0 OR (SELECT max(whole) FROM w) = 0 ORDER BY whole DESC, hits DESC, doc_id LIMIT 20")
def _(t):
    return S.keyword_search(t.documents, {"source": 3, "text": 1}, ["then", "on"], ["source"], [F.asc("doc_id")]).select("doc_id", "hits", "whole")


@query("rk04_hybrid")
def _(t):
    terms, limit = ["then", "on"], 25
    found = S.keyword_search(t.documents, {"source": 3, "text": 1}, terms, ["source"], [F.asc("doc_id")], limit)
    every = R.words_in_places(terms, [F.col("source"), F.col("text")])
    words = found.select("doc_id", F.coalesce(every, F.lit(False)).alias("every"), F.row_number().over(W.orderBy(F.desc("whole"), F.desc("hits"), "doc_id")).alias("rank"))
    asked = t.embeddings.filter("vec_id = 3").first()["embedding"]
    near = S.vector_search(t.embeddings, "vec_id", "embedding", asked).orderBy(F.desc("score"), "vec_id").limit(limit)
    meaning = near.select(F.col("vec_id").alias("doc_id"), F.row_number().over(W.orderBy(F.desc("score"), "vec_id")).alias("rank"))
    return S.fuse(words, meaning, "doc_id", limit)


@query(
    "rk06_index_changes",
    "WITH d AS (SELECT doc_id, trim(text, ' ') <> '' AS filled FROM documents), l AS (SELECT d.doc_id, filled, quality, toxic FROM d JOIN labels USING (doc_id)) SELECT doc_id AS owner, 'text' AS key, CASE WHEN quality = 1 THEN 'current' ELSE 'todo' END AS state FROM l WHERE filled "
    "UNION ALL SELECT doc_id, 'text', 'todo' FROM d WHERE filled AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'text', 'stale' FROM l WHERE filled IS NOT TRUE UNION ALL SELECT doc_id, 'file', 'stale' FROM l WHERE toxic = 1",
)
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("owner"), F.lit("text").alias("key"), "text")
    # an index as labels knew the documents: poor ones had another text, toxic ones a file more; other owners stay out of it
    known = docs.join(t.labels.select(F.col("doc_id").alias("owner"), "quality", "toxic"), "owner")
    was = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat(F.lit("was: "), F.coalesce("text", F.lit(""))))
    stored = known.select("owner", "key", S.text_hash(was).alias("hash"))
    files = known.filter("toxic = 1").select("owner", F.lit("file").alias("key"), F.lit("x").alias("hash"))
    others = known.filter("toxic = 1").select((F.col("owner") + 10**9).alias("owner"), "key", F.lit("x").alias("hash"))
    return S.index_changes(docs, stored.unionByName(files).unionByName(others))


_RULES = [("urgent", r"!!", 90), ("table", r" \| ", 70), ("key", r"(?:token|secret) = ", 85), ("licence", r"[Ll]icensed under", 60)]


@query("rk07_rule_classes", "WITH h AS (SELECT doc_id, unnest([CASE WHEN regexp_matches(text, '!!') THEN {'k': 'urgent', 'w': 90} END, CASE WHEN regexp_matches(text, ' \\| ') THEN {'k': 'table', 'w': 70} END, CASE WHEN regexp_matches(text, '(?:token|secret) = ') THEN {'k': 'key', 'w': 85} END, CASE WHEN regexp_matches(text, '[Ll]icensed under') THEN {'k': 'licence', 'w': 60} END]) AS x FROM documents) SELECT doc_id, arg_max(x.k, x.w) AS kind, round(least(0.98, 0.35 + max(x.w) / 180), 4) AS confidence FROM h WHERE x IS NOT NULL GROUP BY doc_id")
def _(t):
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(w).alias("w"), F.lit(k).alias("k"))) for k, p, w in _RULES]))
    best = t.documents.select("doc_id", F.array_max(hits).alias("b")).filter("b is not null")
    return best.select("doc_id", F.col("b.k").alias("kind"), F.round(F.least(F.lit(0.98), 0.35 + F.col("b.w") / 180), 4).alias("confidence"))


@query("rk09_importance", "SELECT o_orderkey, least(99, greatest(0, 30 + CASE WHEN o_orderpriority = '1-URGENT' THEN 40 WHEN o_orderpriority = '2-HIGH' THEN 24 ELSE 0 END + CASE WHEN o_totalprice >= 250000 THEN 28 WHEN o_totalprice >= 50000 THEN 18 ELSE 0 END)) AS score FROM orders")
def _(t):
    p, v = F.col("o_orderpriority"), F.col("o_totalprice")
    score = 30 + F.when(p == "1-URGENT", 40).when(p == "2-HIGH", 24).otherwise(0) + F.when(v >= 250000, 28).when(v >= 50000, 18).otherwise(0)
    return t.orders.select("o_orderkey", F.least(F.lit(99), F.greatest(F.lit(0), score)).alias("score"))


@query("rk12_focus", "WITH s AS (SELECT o_custkey, o_orderkey, CASE WHEN d < 0 THEN 500 + least(-d, 30) WHEN d = 0 THEN 400 WHEN d <= 3 THEN 300 WHEN d <= 7 THEN 200 ELSE 100 END AS score FROM (SELECT *, date_diff('day', DATE '1996-05-15', CAST(o_orderdate AS DATE)) AS d FROM orders)), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS r FROM s) SELECT o_custkey, o_orderkey, score FROM b WHERE r = 1 ORDER BY score DESC, o_orderkey LIMIT 7")
def _(t):
    d = F.date_diff(F.to_date("o_orderdate"), F.lit("1996-05-15").cast("date"))
    score = F.when(d < 0, 500 + F.least(-d, F.lit(30))).when(d == 0, 400).when(d <= 3, 300).when(d <= 7, 200).otherwise(100)
    s = t.orders.withColumn("score", score)
    best = s.withColumn("r", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("score"), "o_orderkey"))).filter("r = 1")
    return best.orderBy(F.desc("score"), "o_orderkey").limit(7).select("o_custkey", "o_orderkey", "score")


@query("rk16_skim", "WITH l AS (SELECT doc_id, regexp_replace(line, '[0-9]+', '#', 'g') AS shape FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)), c AS (SELECT doc_id, shape, count(*) AS n FROM l GROUP BY doc_id, shape) SELECT doc_id, sum(n)::BIGINT AS lines FROM c WHERE n < 3 GROUP BY doc_id")
def _(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    shapes = lines.groupBy("doc_id", F.regexp_replace("line", "[0-9]+", "#").alias("shape")).agg(F.count("*").alias("n"))
    return shapes.filter("n < 3").groupBy("doc_id").agg(F.sum("n").alias("lines"))


@query("rk14_tasks", "SELECT o_orderkey, task FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'approve' END, CASE WHEN o_totalprice > 300000 THEN 'review' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'answer' END], lambda x: x IS NOT NULL)) AS task FROM orders)")
def _(t):
    tasks = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "P", "approve"), F.when(F.col("o_totalprice") > 300000, "review"), F.when(F.col("o_orderpriority") == "1-URGENT", "answer")))
    return t.orders.select("o_orderkey", F.explode(tasks).alias("task"))
