"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import decontam, jaccard, kdtree, language_model, licenses, mixing, packing, periodic, quality_model, quality_rules, secrets, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "own_failed")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(_read(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"]))), ",")
    spans = F.array_join(F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    best = F.round(F.coalesce(F.array_max(F.transform("licenses", lambda m: m["dice"])), F.lit(0.0)), 6)
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), names.alias("licenses"), spans.alias("spans"), best.alias("best_dice"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    out = quality_model.held_out("doc_id", 5, 0)
    net = toxicity.train(docs, labels.filter(~out))
    scored = docs.select("doc_id", "lang", out.alias("held_out"), toxicity.score(net, F.col("text"), spark).alias("score"))
    flagged = F.col("score") >= toxicity.threshold(net, F.col("lang"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), flagged.alias("flagged"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    sha = F.sha2(secrets.joined(F.col("secrets"), True).cast("binary"), 256)
    counts = [count(k).alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts[:3], sha.alias("base_sha256"), secrets.joined(F.col("secrets"), False).alias("spans"), counts[3])


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_read(spark, sf_dir, "documents"), join=jaccard.Join(k=3, t=90))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_read(spark, sf_dir, "pages"))
    return warc.read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    out = quality_model.held_out("doc_id", 3, 1)
    model = quality_model.train(docs, labels.filter(~out))
    scored = docs.select("doc_id", out.alias("held_out"), quality_model.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    ids = F.transform("leaks", lambda m: m["item_id"])
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), ids.alias("item_ids"), F.array_min(F.transform("leaks", lambda m: m["distance"])).alias("least_distance"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_model.held_out("doc_id", 5, 1)
    keys = {"doc_id": F.col("doc_id"), "held_out": out}
    return language_model.score_texts(_read(spark, sf_dir, "documents"), F.col("text"), ~out, keys)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every tenth document, by its hash, the words from a place on are first replaced by repeats of the words there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), g.alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = docs.withColumn("words", words).withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    w, n, a, p = (F.col(c) for c in ("words", "n", "a", "p"))
    part = lambda start, length: F.slice(w, (start + 1).cast("int"), length.cast("int"))
    planted = F.concat(part(F.lit(0), a), F.flatten(F.array_repeat(part(a, p), F.floor((n - a) / p).cast("int"))), part(a, (n - a) % p))
    text = F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text"))
    found = docs.select("doc_id", periodic.periodic(text).alias("found"))
    runs = F.col("found")["runs"]
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("length"), r["start"], r["period"])))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), best["start"].alias("start"), (-best["length"]).alias("length"), best["period"].alias("period"),
        F.floor(-best["length"] * 1000 / best["period"]).alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("found")["collapsed"]).alias("collapsed_sha256"),
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    found = kdtree.Clusters(_read(spark, sf_dir, "embeddings"), vec_id, kdtree.integers(F.col("embedding"), 64), F.sha2(F.concat(F.lit("1:"), vec_id.cast("string")).cast("binary"), 256))
    inertia = found.totals()[2]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    of = lambda values, kind: F.lit(values or None).cast(f"array<{kind}>")[F.col("cluster")]
    rows = found.assigned().withColumnRenamed("id", "vec_id")
    return rows.withColumns({"cluster_inertia": of(inertia, "bigint"), "inertia": F.lit(sum(inertia)).cast("long"), "centroid_sha256": of(shas, "string")})


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_license_scans, op3_toxicity, op4_mixing, op5_secret_scans, op6_ngram_jaccard_join, op7_warc, op8_token_packing, op9_quality_classifier, op10_decontamination, op11_language_model, op12_periodic_runs, op13_centroid_clustering)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def _kmeans_sql(k: int, rounds: int) -> str:
    steps = [f"""
v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS f FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), f) - 1 AS c, f AS g FROM v ORDER BY sha256('1:' || vec_id), f LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS (SELECT r, c, list_sum(list_transform(list_zip(f, g), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far FROM v, c{i}),
a{i} AS (SELECT r, min(far) AS far, arg_min(c, far * {k} + c) AS c FROM d{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(f) AS x, unnest(range(64)) AS j FROM a{i} JOIN v USING (r)) GROUP BY c, j),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS g FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(m{i}.g, c{i}.g) AS g FROM c{i} LEFT JOIN m{i} USING (c))""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, c::INT AS cluster, far AS distance, (sum(far) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(far) OVER ())::BIGINT AS inertia, sha256(array_to_string(g, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)"""


ORACLE_SQL = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
pos AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
win AS (SELECT r, i, x, lead(x) OVER (PARTITION BY r ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY r ORDER BY i) AS z FROM pos),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS c FROM win WHERE z IS NOT NULL) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY r),
chars AS (SELECT r, sum(length(x)) AS n FROM pos GROUP BY r),
lines AS (SELECT r, l FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
nl AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM lines GROUP BY r),
m AS (SELECT d.r, doc_id, source, len(w) AS n_words, coalesce(chars.n, 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(nl.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(nl.n, 0) AS n_lines
      FROM d LEFT JOIN rep USING (r) LEFT JOIN chars USING (r) LEFT JOIN nl USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
o AS (SELECT *, base_failed OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 60 * n_lines OR word_chars > 15 * n_words AS own_failed FROM f),
h AS (SELECT source, count(*) AS n, sum(own_failed::INT) AS k FROM o GROUP BY source),
p AS (SELECT sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2 - (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * count(*) / sum(n) AS v FROM h),
s AS (SELECT mean, CASE WHEN v > 0 THEN least(1e4, greatest(1, mean * (1 - mean) / v - 1)) ELSE 1e4 END AS strength FROM p),
verdict AS (SELECT source, (k + mean * strength) / (n + strength) > 0.5 AS rejected FROM h, s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT own_failed AND NOT rejected AS kept, own_failed
FROM o JOIN verdict ON o.source IS NOT DISTINCT FROM verdict.source
""",
    "op12_periodic_runs": rf"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w,
             xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) AS h FROM documents),
d AS (SELECT r, doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM raw),
e AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d),
t AS (SELECT r, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS x, n FROM (SELECT *, unnest(range(n)) AS i FROM e)),
same AS (SELECT t.r, t.i, u.i - t.i AS q FROM t JOIN t AS u ON t.r = u.r AND t.x = u.x AND u.i > t.i AND 4 * (u.i - t.i) <= t.n),
isle AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same),
c AS (SELECT r, min(i) AS s, count(*) + q AS l, q FROM isle GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM c WHERE NOT EXISTS (FROM c AS o WHERE o.r = c.r AND o.q < c.q AND o.s <= c.s AND o.s + o.l >= c.s + c.l)),
best AS (SELECT r, count(*) AS n_runs, arg_min({{'s': s, 'l': l, 'q': q}}, {{'l': -l, 's': s, 'q': q}}) AS b, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
short AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS text FROM t ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(short.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN short USING (r)
""",
    "op13_centroid_clustering": _kmeans_sql(16, 3),
}
