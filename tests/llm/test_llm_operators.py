import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, jaccard, licenses, mixing, packing, quality_model, quality_rules, queries, secrets, store, toxicity, warc
from ledgerloom.llm.text import PLAIN, chunks
from oracle import connection, same

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1_sql(spark):
    name = "op1_quality_rules"
    same(spark, connection(SF), SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_quality_rules_odd_rows(odd, none):
    got = {(r["doc_id"], r["n_words"], r["base_failed"]) for r in quality_rules.judge(odd).collect()}
    assert (2, 0, True) in got and (3, 0, True) in got and (6, 60_000, False) in got
    assert quality_rules.judge(none).count() == quality_rules.keep(none).count() == 0
    kept = quality_rules.keep(odd)
    assert kept.columns == odd.columns and kept.count() == 0  # most documents of its host fail, so 6 goes with them


def test_bad_hosts_lose_good_documents(spark):
    good = [(i, i % 10 == 0, "bad") for i in range(200)] + [(i, i % 10 != 0, "good") for i in range(200)]
    rows = spark.createDataFrame([(h, not ok) for _, ok, h in good], "_host string, _failed boolean")
    got = {r["_host"]: r["host_rejected"] for r in quality_rules.host_verdicts(rows, "_host").collect()}
    assert got == {"bad": True, "good": False}


def test_licenses(odd, none, spark):
    assert licenses.find_licenses(odd).filter("size(licenses) > 0").count() == 0 and licenses.find_licenses(none).count() == 0
    text = "Prose é before.\nReleased under the MIT License.\n\nPermission is hereby granted\n\n" + licenses.TEMPLATES["ISC"].replace("software", "SOFTWARE, ")
    found = licenses.Scanner(licenses.TEMPLATES, 0.8).scan(pa.array([text]))[0]
    assert [f["license"] for f in found] == ["MIT-line", "ISC"]
    assert text[found[0]["start"] : found[0]["end"]] == "Released under the MIT License."


def test_license_dice_is_that_of_counters():
    rng = random.Random(3)
    words = licenses.TEMPLATES["GPL-3.0-notice"].split()
    for _ in range(50):
        mine = [w for w in words if rng.random() > 0.15]
        norm = lambda s: re.sub(r"[^a-z0-9]+", " ", s.lower()).split()
        a, b = (Counter(zip(x, x[1:])) for x in (norm(" ".join(mine)), norm(" ".join(words))))
        d = 2 * sum((a & b).values()) / (a.total() + b.total())
        found = licenses.Scanner({"t": " ".join(words)}, 0.8).scan(pa.array([" ".join(mine)]))[0]
        assert (d >= 0.8) == bool(found) and (not found or abs(found[0]["dice"] - d) < 1e-12)


def test_licenses_of_several_paragraphs_or_inside_a_line():
    scan = lambda x: [(f["license"], x[f["start"] : f["end"]]) for f in licenses.Scanner(licenses.TEMPLATES, 0.8).scan(pa.array([x]))[0]]
    prose = " ".join(f"é{i}" for i in range(600))
    for name in ("MIT", "GPL-3.0-notice", "GPL-2.0-notice", "BSD-3-Clause", "Zlib"):
        whole = licenses.TEMPLATES[name]
        words = whole.split()
        cut = len(words) // 3
        split = " ".join(words[:cut]) + "\n#\n# " + " ".join(words[cut : 2 * cut]) + "\n\n" + " ".join(words[2 * cut :])
        for text in (f"{prose}\n\n{split}\n\n{prose}", f"{prose} {whole} {prose}"):
            found = scan(text)
            assert [f[0] for f in found] == [name] and found[0][1].split()[0] == words[0]
    mit = licenses.TEMPLATES["MIT"]
    assert [f[0] for f in scan(f"{prose} {mit} {prose} {mit} {prose} {licenses.TEMPLATES['ISC']} {prose}")] == ["MIT", "MIT", "ISC"]
    assert scan(f"{prose} released under the MIT license. {prose}") == [("MIT-line", "released under the MIT license")]


def test_license_windows_are_those_of_brute_force():
    rng, template = random.Random(5), "a b c d a b e f".split()
    bag = Counter(zip(template, template[1:]))
    for _ in range(300):
        w = [rng.choice("abcdefx") if rng.random() < 0.4 else template[i % 8] for i in range(rng.randint(0, 24))]
        best = 0.0
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                b = Counter(zip(w[i:j], w[i + 1 : j]))
                best = max(best, 2 * (b & bag).total() / (b.total() + bag.total()))
        found = licenses.Scanner({"t": " ".join(template)}, 0.8).scan(pa.array([f"{'x ' * 40}{' '.join(w)}{' x' * 40}"]))[0]
        assert max((f["dice"] for f in found), default=0.0) == pytest.approx(best if best >= 0.8 else 0.0)


def test_toxicity_held_out(spark, odd, none):
    got = queries.op3_toxicity(spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.8 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1)], "doc_id bigint, toxic int")
    net = toxicity.train(odd, labels)
    assert odd.select(toxicity.score(net, F.col("text"), spark).alias("s")).filter("s between 0 and 1").count() == odd.count()
    bare = toxicity.train(none, labels)
    assert none.select(toxicity.score(bare, F.col("text"), spark)).count() == 0 and bare.score(pa.array(["a"]))[0] == 0.5


def test_mixing_targets_and_limits(spark, odd, none):
    rows = queries.op4_mixing(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text"), "doc_id").collect()
    assert all(r["size"] == len(WORD.findall(r["text"])) and r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    size, left, share = Counter(), None, {}
    for r in rows:
        size[r["source"]] += r["size"]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    free, left = set(size), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            share |= {s: level * weight[s] for s in free}
            break
        share |= {s: 2.0 * size[s] for s in over}
        left, free = left - sum(2 * size[s] for s in over), free - over
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert abs(r["target"] - share[r["source"]]) < 0.01
    longest = {s: max(r["size"] for r in rows if r["source"] == s) for s in size}
    assert all(abs(taken[s] - share[s]) < longest[s] for s in size)
    assert mixing.mix(none).count() == mixing.expand(none).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.filter("size = 0 and taken > 0").count() == 0
    assert mixing.expand(odd).count() == mixed.agg(F.sum("copies")).first()[0] and mixing.expand(odd).columns == odd.columns


def test_secrets_are_those_of_the_patterns(spark, odd, none):
    def brute(text):
        found = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
        found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
        return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))

    texts = texts_of(spark)
    for r in queries.op5_secret_scans(spark, SF).collect():
        want = brute(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]
    assert secrets.find_secrets(odd).filter("size(secrets) > 0").count() == 0 and secrets.find_secrets(none).count() == 0
    model = secrets.MarkovPair(secrets.labelled_samples())
    assert [k for k, _, _ in secrets.scan("é x9Kq2LmZ7pTr4WvB8nYd1 payment_order_history_2024", model, 0.0)] == ["markov"]


def test_keys_behind_words_of_a_path():
    rng = random.Random(8)
    model = secrets.MarkovPair(secrets.labelled_samples())
    threshold = model.threshold(secrets.labelled_samples())
    key = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=22)) + "47"
    path = "callback/payment/order/customer/history/"
    found = 0
    for _ in range(100):
        a, b = key(), key()
        text = f"é {path}{a}/{path}{b}/{path}"
        found += [text[x:z] for _, x, z in secrets.scan(text, model, threshold)] == [a, b]
    assert found >= 95
    plain = [x for x, random_one in secrets.labelled_samples(seed=9) if not random_one]
    assert sum(bool(secrets.scan(x, model, threshold)) for x in plain) <= 0.002 * len(plain)


def components(sets, t):
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= t * len(a | b):
                p, q = find(ids[x]), find(ids[y])
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def shingles(text, k):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k, t, cap", [(3, 90, 16), (5, 80, 2)])
def test_jaccard_components(spark, k, t, cap):
    rng = random.Random(k)
    base = [" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 40)}" for _ in range(n)) for n in (1, 2, 4, 12, 40, 90, 200)]
    rows, passage = [], " ".join(f"passage{i}" for i in range(30))
    for i in range(160):
        w = base[i % 7].split()
        for _ in range(rng.choice((0, 0, 1, 2, len(w) // 12))):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 5)}"
        rows.append((i, " ".join(w) + (f" {passage}" if i % 3 == 0 else "")))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(spark.createDataFrame(rows, "doc_id bigint, text string"), join=jaccard.Join(k=k, t=t, cap=cap)).collect()}
    sets = {i: shingles(x, k) for i, x in rows}
    assert got == {i: (len(sets[i]), c) for i, c in components(sets, t).items()}


def test_jaccard_odd_rows(odd, none):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard.link(odd, join=jaccard.Join(k=3, t=90)).collect())
    assert (2, 0, 2) in got and (3, 0, 3) in got and got.count((5, 9, 1)) == 2 and (6, 59_998, 6) in got and got[0][2] == -1
    kept = jaccard.keep_one(odd, join=jaccard.Join(k=3, t=90))
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 7]
    assert jaccard.link(none).count() == 0


def test_jaccard_keeps_texts_of_null_and_repeated_ids(spark):
    text = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, ""), (None, None), (1, text("c")), (1, text("d")), (2, text("e")), (3, text("f")), (3, text("e") + " new"), (None, text("f"))]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [(None, text("a")), (None, text("b")), (None, ""), (None, None), (1, text("c")), (1, text("d")), (2, text("e")), (3, text("f"))]
    assert Counter(map(tuple, kept)) == Counter(want)


def workers_of(df):
    """The most Python workers that one task of a plan has at once: Python nodes below each other without an exchange between."""
    most, above = 0, []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(re.match(r"[\s:+|*()0-9-]*", line)[0])
        above = [(d, n) for d, n in above if d < depth]
        n = above[-1][1] if above else 0
        n = 0 if "Exchange" in line.split("[")[0] else n + bool(re.search(r"ArrowEvalPython|InArrow|InPandas|BatchEvalPython", line.split("[")[0]))
        above.append((depth, n))
        most = max(most, n)
    return most


def test_jaccard_takes_one_python_worker_a_task(spark, monkeypatch):
    """Executors keep all workers that once ran together, so two for each task are twice the memory."""
    rows = [(i, " ".join(f"w{i // 3}x{j}" for j in range(40)) + f" end{i % 3 % 2}") for i in range(60)]
    seen, write = [], store._write
    monkeypatch.setattr(store, "_write", lambda df, *how: seen.append(workers_of(df)) or write(df, *how))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = jaccard.keep_one(docs, join=jaccard.Join(k=5, t=80))
    assert [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == list(range(0, 60, 3))
    assert max(seen + [workers_of(kept)]) == 1
    twice = F.arrow_udf(lambda x: x, "string")
    assert workers_of(docs.select(twice("text").alias("t")).filter("t is not null").withColumn("u", twice(F.upper("t")))) > 1


def test_marked_rows_alone_are_worked_on(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("text"))
    marks = store.Marks(rows.filter("id % 10 = 0").select(F.xxhash64("id").alias("h")), "h")
    made = rows.coalesce(2).select("id", marks.having(F.xxhash64("id"), F.col("text"), "string", lambda texts: pc.binary_join_element_wise(texts, "!", "")).alias("s")).collect()
    assert [(r["s"]["marked"], r["s"]["value"]) for r in made] == [(r["id"] % 10 == 0, f"{r['id']}!" if r["id"] % 10 == 0 and r["id"] % 7 else None) for r in made]
    none = store.Marks(rows.filter("id < 0").select(F.xxhash64("id").alias("h")), "h")
    got = rows.select(none.having(F.xxhash64("id"), F.col("text"), "struct<node:bigint,body:binary>", jaccard._bodies(jaccard.Join())).alias("s"))
    assert got.filter("s.marked or s.value is not null").count() == 0 and got.count() == 100


def test_warc_round_trip_over_any_split(spark):
    rng = random.Random(1)
    same_page = "x" * 1500
    pages = [(i, f"http://h/{i} {i}", rng.choice([None, "", "short", same_page, "".join(rng.choices("abc\n é", k=3000))])) for i in range(60)] + [(61, None, same_page), (61, None, same_page), (None, "u", same_page)]
    archives = warc.write(spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(2))
    for split in (700, 5000, 1 << 22):
        got = sorted((-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(archives, split).collect())
        body = lambda h: (h or "").encode()
        want = sorted((i if i is not None else -1, len(body(h)), hashlib.sha1(body(h)).hexdigest(), *(("revisit", 61) if h == same_page and i != 61 else ("response", None))) for i, _, h in pages)
        assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want]


def test_warc_of_nothing(spark):
    archives = warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"))
    assert warc.read(archives).count() == 0


def test_packing_round_trip(spark, odd, none):
    packed = packing.pack(odd, seq_len=256)
    ids = defaultdict(list)
    for r in packing.read_ids(packed, 256).collect():
        ids[r["doc_id"]].append((r["piece"], r["ids"], r["n_pieces"]))
    encode = packing.Vocabulary().load().encode_ordinary
    long = sum((x for _, x, _ in sorted(ids[6])), [])
    assert long == encode(odd.filter("doc_id = 6").first()["text"]) + [50256] and ids[3] == ids[2] == [(0, [50256], 1)]
    assert packing.pack(none).count() == 0
    spans = packed.select("file", "row", "start", (F.col("start") + F.col("length")).alias("end")).collect()
    assert all(s["end"] <= 256 for s in spans)


def test_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = rng.integers(1, 65, 80)
        rooms, want = [], []
        for i in np.argsort(-n, kind="stable"):
            fits = [r for r in rooms if r[0] >= n[i]]
            if fits:
                min(fits, key=lambda r: r[0])[0] -= n[i]
            else:
                rooms.append([64 - n[i]])
        got = packing.best_fit(n, 64)
        assert sorted(x for r in got for x in r) == list(range(80)) and sorted(64 - n[r].sum() for r in got) == sorted(r[0] for r in rooms), want


def test_quality_classifier_held_out(spark, odd, none):
    rows = queries.op9_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.8 * len(rows)
    model = quality_model.train(odd, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r[0] for r in odd.select(quality_model.score(model, F.col("text"))).collect()} == {0.5}
    assert none.select(quality_model.score(model, F.col("text"))).count() == 0


def test_leaks_are_those_of_brute_force(spark, odd, none):
    rng = random.Random(4)
    items = [(i, " ".join(f"{rng.choice('stuv')}{rng.randint(0, 300)}" for _ in range(rng.randint(3, 40)))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for i in range(150):
        w = items[i % 12][1].split()
        for _ in range(rng.randint(0, len(w) // 3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(([], ["new"]))
        docs.append((i, " ".join([*(f"a{rng.randint(0, 99)}" for _ in range(20)), *w, *(f"b{rng.randint(0, 99)}" for _ in range(20))])))

    def nearest(item, text):
        line = [0] * (len(text) + 1)
        for i, a in enumerate(item):
            new = [i + 1]
            for j, b in enumerate(text):
                new.append(min(line[j] + (a != b), line[j + 1] + 1, new[-1] + 1))
            line = new
        return min(line)

    want = {(d, i) for d, x in docs for i, y in items if y and nearest(y.split(), x.split()) <= int(0.2 * len(y.split()))}
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], m["item_id"]) for r in decontam.find_leaks(*frames).collect() for m in r["leaks"]}
    assert got <= want and len(got) >= 0.95 * len(want)
    blocks = {(r["doc_id"], m["item_id"]) for r in decontam.find_leaks(*frames, block=5).collect() for m in r["leaks"]}
    assert blocks <= want and len(blocks) >= 0.95 * len(want)
    assert decontam.find_leaks(odd, frames[1]).filter("size(leaks) > 0").count() == 0
    assert decontam.clean(none, frames[1]).count() == 0 and decontam.clean(odd, frames[1].limit(0)).count() == odd.count()


def test_long_items_are_all_found():
    rng = random.Random(6)
    hashed = lambda x: next(chunks(pa.array([x]), PLAIN))
    word = lambda: f"w{rng.randint(0, 2000)}"
    items, texts = [], []
    for i, n in enumerate([150, 300, 600, 1000] * 5):
        items.append(" ".join(word() for _ in range(n)))
        w = items[-1].split()
        for _ in range(int(0.2 * n)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(([], [word()]))
        texts.append(" ".join([*(f"a{rng.randint(0, 99)}" for _ in range(50)), *w, *(f"b{rng.randint(0, 99)}" for _ in range(50))]))
    rows = [(i, hashed(x).word_hashes(), hashed(x).ends - hashed(x).starts) for i, x in enumerate(items)]
    for settings in (decontam.Settings(), decontam.Settings(samples=8, most_repetitions=4)):  # the second never reaches its recall by walks
        got = decontam.Matcher(rows, settings).find(pa.array([None, *texts, ""]))
        assert [[m["item_id"] for m in g] for g in got] == [[], *([i] for i in range(len(items))), []]
    assert all(m["distance"] <= 0.2 * len(rows[m["item_id"]][1]) and abs(m["start_word"] - 50) < 25 for g in got for m in g)


def test_distances_from_each_start():
    rng = np.random.default_rng(1)
    for _ in range(20):
        item, words = rng.integers(0, 4, 5).astype(np.uint64), rng.integers(0, 4, 12).astype(np.uint64)
        want = [decontam.distances(item[None], words[None, i:], np.array([12 - i]))[0] for i in range(12)]
        assert decontam.start_distances(item, words).tolist() == want


def test_pipeline_keeps_to_its_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.quality(spark, docs, SF)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in quality_rules.judge(docs).filter("kept").select("doc_id").collect()}
    one = P.near_duplicates(spark, kept, SF)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    comp = components({i: shingles(x, 5) for i, x in texts.items()}, 80)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(comp.values()))


def test_words_of_chunks():
    texts = ["a b", None, "", " x\ty\n", "é ü", "\x0b\x0cz"]
    got = [w for c in chunks(pa.array(texts), limit=4) for w in c.words().to_pylist()]
    assert got == ["a", "b", "x", "y", "é", "ü", "z"] and len(PLAIN) == 256
