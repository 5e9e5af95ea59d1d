"""Operators 11 to 13 against brute force: language model, periodic runs, centroid clustering."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import kdtree, language_model, periodic, queries
from plain import words

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# ---------------------------------------------------------------- periodic runs


def plain_runs(w, least=6, times=4):
    found = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and j > i:
                part = w[i : j + q]
                if not any(all(part[x] == part[x + p] for x in range(len(part) - p)) for p in range(1, q)):
                    found.add((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts_with_runs(seed):
    rng, out = random.Random(seed), []
    for _ in range(60):
        w = []
        while len(w) < rng.choice((0, 5, 40, 150)):
            part = [rng.choice("abcdefgh"[: rng.choice((1, 2, 8))]) for _ in range(rng.randint(1, 12))]
            w += part * rng.choice((1, 1, 2, 4, 5)) + part[: rng.randrange(len(part))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("least, times", [(6, 4), (3, 2), (10, 3)])
def test_runs_and_collapsed_texts_are_those_of_brute_force(spark, least, times):
    rows = texts_with_runs(least)
    assert sum(bool(plain_runs(words(t), least, times)) for t in rows) > 10
    got = spark.createDataFrame([(t,) for t in rows], "text string").select("text", periodic.periodic(F.col("text"), least, times).alias("p")).collect()
    for r in got:
        w = words(r.text)
        want = plain_runs(w, least, times)
        assert [tuple(x) for x in r.p.runs] == want and r.p.collapsed == plain_collapse(w, want) and r.p.n_words == len(w)


def test_runs_of_odd_rows(odd, none):
    for r in odd.select("*", periodic.periodic(F.col("text")).alias("_p")).collect():
        w = words(r["text"])
        if len(w) < 1000:
            assert [tuple(x) for x in r["_p"].runs] == plain_runs(w)
        else:
            assert r["_p"].runs == [] and r["_p"].collapsed == r["text"]
        assert r["size"] == "x" and r["_p"].n_words == len(w)
    assert none.select(periodic.periodic(F.col("text")).alias("p")).count() == 0


def test_long_periods_in_a_long_text():
    numbers = np.concatenate([np.arange(5000), np.tile(np.arange(700), 6)[:3000], [9999], np.zeros(50_000, int), np.arange(100)])
    runs = periodic.find(numbers)
    assert (5000, 3000, 700) in runs and (8001, 50_001, 1) in runs and len(runs) == 2


def plain_periodic(doc_id, text):
    w, h = words(text), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(plain_collapse(w, runs)))


def test_periodic_query_is_that_of_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts_with_runs(1) + [None, "", " \t", "x " * 9])] + [(None, "y " * 12), (3, "y " * 12), (3, "y " * 12)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_periodic(*r)) for r in rows)


# ---------------------------------------------------------------- centroid clustering


def plain_clusters(vectors, start, k, rounds):
    order = sorted(range(len(vectors)), key=lambda i: (start[i] is None, start[i] or "", vectors[i]))
    centroids = [list(vectors[i]) for i in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        to = [nearest(v) for v in vectors]
        for c in range(len(centroids)):
            mine = [v for v, t in zip(vectors, to) if t == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    to = [nearest(v) for v in vectors]
    return centroids, [(c, far(v, centroids[c])) for v, c in zip(vectors, to)]


@pytest.mark.parametrize("dim, k, scale, block, leaf", [(2, 5, 50, 64, 4), (3, 16, 3, 1000, 2), (8, 4, 1 << 25, 37, 8), (64, 16, 60, 8192, 32)])
def test_clusters_are_those_of_brute_force(spark, dim, k, scale, block, leaf):
    rng = random.Random(dim)
    vectors = [[rng.randint(-scale, scale) + (i % 3) * scale // 4 for _ in range(dim)] for i in range(300)] + [[0] * dim] * 40
    start = [None if i % 50 == 0 else hashlib.md5(str(i).encode()).hexdigest() for i in range(len(vectors))]
    frame = spark.createDataFrame([(i, v, s) for i, (v, s) in enumerate(zip(vectors, start))], "id bigint, v array<bigint>, s string").repartition(4)
    found = kdtree.Clusters(frame, F.col("id"), F.col("v"), F.col("s"), k=k, rounds=3, dim=dim, block=block, leaf=leaf)
    centroids, want = plain_clusters(vectors, start, k, 3)
    assert found.centroids.tolist() == centroids
    assert {r.id: (r.cluster, r.distance) for r in found.assigned().collect()} == dict(enumerate(want))
    sums, counts, inertia = found.totals()
    for c in range(k):
        mine = [i for i, w in enumerate(want) if w[0] == c]
        assert counts[c] == len(mine) and inertia[c] == sum(want[i][1] for i in mine) and sums[c] == [sum(vectors[i][j] for i in mine) for j in range(dim)]


def test_nodes_are_assigned_whole_and_ties_stay():
    """Far clusters need no leaf; centroids that tie with the best one are never pruned."""
    points = np.concatenate([np.random.default_rng(c).integers(0, 9, (64, 2)) + 1000 * c for c in range(4)])
    order = kdtree.Tree.order(points, 8)
    tree = kdtree.Tree.read(points[order], 8)
    whole, leaves, _ = tree.filtered(np.array([[1000 * c, 1000 * c] for c in range(4)]))
    assert not len(leaves) and sum(int(n[2].sum()) for _, n in whole) == len(points)
    twins = np.array([[5, 5], [5, 5], [900, 900]])
    assert set(tree.assigned(twins)[0].tolist()) <= {0, 2}
    live = kdtree.undominated(np.array([[0, 0]]), np.array([[2, 2]]), np.array([[0, 1], [2, 1], [9, 9]]), np.ones((1, 3), bool))
    assert live.tolist() == [[True, True, False]]


def test_odd_vectors(spark):
    good = [0.5] * 64
    rows = [(1, good), (1, good), (None, good), (2, None), (3, []), (4, good[:63]), (5, [None] + good[1:]), (6, [float("nan")] + good[1:]), (7, [float("inf")] + good[1:]), (8, [-0.01] * 64)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"cluster": F.lit("x"), "_id": F.lit("y"), "distance": F.lit(0)})
    make = lambda f: kdtree.Clusters(f, F.col("vec_id"), kdtree.integers(F.col("embedding"), 64), F.col("vec_id").cast("string"))
    got = sorted(map(tuple, make(frame).assigned().collect()), key=repr)
    assert len(make(frame).centroids) == 4 and got == sorted([(1, 0, 0), (1, 0, 0), (None, 0, 0), (8, 2, 0)], key=repr)
    empty = make(frame.limit(0))
    assert empty.assigned().collect() == [] and len(empty.centroids) == 0
    with pytest.raises(Exception, match="can't be clustered"):
        make(spark.createDataFrame([(1, [2e6] * 64)], "vec_id bigint, embedding array<double>")).assigned().collect()


def test_cluster_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op13_centroid_clustering(spark, str(tmp_path))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and out.count() == 0


# ---------------------------------------------------------------- language model

SMALL = language_model.Settings(table=40, vocabulary=20, classes=4, hidden=6, window=4, lanes=5, rounds=2)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_log10(w, bounds, ids, hidden):
    """Token by token, with plain formulas and the full product of both softmaxes."""
    h, before, total = np.zeros(hidden), 0, 0.0
    for t in ids:
        x, u = w.inputs[before].astype(float), h @ w.state.astype(float)
        z, r = sigmoid(x[:hidden] + u[:hidden]), sigmoid(x[hidden : 2 * hidden] + u[hidden : 2 * hidden])
        fresh = np.tanh(x[2 * hidden :] + r * (u[2 * hidden :] + w.shift))
        h = (1 - z) * h + z * fresh
        c = int(np.searchsorted(bounds, t, side="right")) - 1
        classes = h @ w.to_class.astype(float) + w.of_class
        inside = w.to_word[bounds[c] : bounds[c + 1]].astype(float) @ h + w.of_word[bounds[c] : bounds[c + 1]]
        total += classes[c] - np.log(np.exp(classes).sum()) + inside[t - bounds[c]] - np.log(np.exp(inside).sum())
        before = t
    return total / math.log(10)


def random_network(seed):
    rng = np.random.default_rng(seed)
    counts = np.array([7.0, 30, *sorted(rng.integers(1, 50, 20), reverse=True)])
    w = language_model.begin(counts, SMALL)
    w = language_model.Weights(*[(a + rng.normal(0, 0.5, a.shape)).astype(np.float32) for a in w.arrays()])
    texts = [np.append(rng.integers(1, 22, n), 0).astype("<u2") for n in (0, 1, 3, 17, 40, 2, 2, 9)]
    return w, language_model.class_bounds(counts, SMALL.classes), texts


def test_lanes_give_the_probability_of_each_text():
    w, bounds, texts = random_network(1)
    got = language_model.Network(w, bounds, SMALL).log_probabilities(texts)
    assert np.allclose(got, [plain_log10(w, bounds, t.tolist(), SMALL.hidden) for t in texts], rtol=1e-4)
    assert language_model.Network(w, bounds, SMALL).log_probabilities([]).tolist() == []


def test_a_fresh_model_is_the_unigram_distribution():
    counts = np.array([4.0, 10, 8, 5, 5, 2, 1])
    bounds = language_model.class_bounds(counts, SMALL.classes)
    got = language_model.Network(language_model.begin(counts, SMALL), bounds, SMALL).log_probabilities([np.array([i], "<u2") for i in range(7)])
    assert np.allclose(got, np.log10((counts + 0.5) / (counts + 0.5).sum()), atol=1e-5)


def test_gradients_are_numerical_gradients():
    """Within a window, whose first state is given: the cut of truncated back-propagation."""
    w, bounds, texts = random_network(2)
    w = language_model.Weights(*[a.astype(np.float64) for a in w.arrays()])
    lanes = language_model.Lanes(texts, 3)
    at, active = next(lanes.windows(12))
    h = np.zeros((3, SMALL.hidden))

    def loss(weights):
        net = language_model.Network(weights, bounds, SMALL)
        t = net.states(lanes, at, active, h)
        return -net.output(t["after"], lanes.target[at], False)[0].mean()

    g, _, logp = language_model.Network(w, bounds, SMALL).gradients(lanes, at, active, h)
    assert math.isclose(loss(w), -logp.mean(), rel_tol=1e-5)
    rng = np.random.default_rng(3)
    for k, (a, d) in enumerate(zip(w.arrays(), g.arrays())):
        for _ in range(12):
            i = tuple(int(rng.integers(n)) for n in a.shape)
            sides = []
            for step in (1e-2, -1e-2):
                moved = [x.copy() for x in w.arrays()]
                moved[k][i] += step
                sides.append(loss(language_model.Weights(*moved)))
            assert math.isclose((sides[0] - sides[1]) / 2e-2, d[i], rel_tol=2e-2, abs_tol=2e-4), (k, i)


def test_learning_finds_what_follows_what():
    """Texts in which each word is followed by one other: nearly all of their entropy goes."""
    rng = random.Random(4)
    counts = np.array([200.0, 0, *[500] * 20])
    bounds, s = language_model.class_bounds(counts, 4), language_model.replace(SMALL, hidden=16, window=8, lanes=16, rate=0.02)
    texts = [np.array([2 + (first + i) % 20 for i in range(50)] + [0], "<u2") for first in (rng.randrange(20) for _ in range(200))]
    w, tokens = language_model.learn(language_model.begin(counts, s), bounds, iter([texts] * 6), s)
    assert tokens == 6 * 51 * 200
    score = lambda w: language_model.Network(w, bounds, s).log_probabilities(texts[:20]).sum() / (51 * 20)
    assert score(language_model.begin(counts, s)) < -1.2 and score(w) > -0.3


def base(rows):
    c, ends = Counter(), 0
    for text, train in rows:
        if train:
            c.update(words((text or "").translate(FOLD)))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    log = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    out = []
    for text, _ in rows:
        w = words((text or "").translate(FOLD))
        out.append((len(w) + 1, sum(c[x] > 0 for x in w) + (ends > 0), n, sum(log(c[x]) for x in w) + log(ends)))
    return out


@pytest.mark.parametrize("table", [21, 100_000])
def test_counts_and_base_scores_are_those_of_brute_force(spark, odd, table):
    """With a table of few words, most counts come by the join; long words always do."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["The", "the", "cat", "sat", "ON", "é", "x" * 100, f"rare{rng.randrange(400)}"]) for _ in range(rng.randrange(80))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "  "])] + [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    frame = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "k int, doc_id bigint, text string").withColumns({"row": F.lit("x"), "word": F.lit("y"), "score": F.lit(1), "part": F.lit(None)})
    train = F.col("k") % 5 != 1
    s = language_model.replace(SMALL, table=table)
    out = language_model.score_texts(frame, F.col("text"), train, {"k": F.col("k"), "row": F.col("row")}, s)
    assert out.columns == ["k", "row", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = {r.k: r for r in out.collect()}
    assert len(got) == len(rows)
    for k, (n, known, total, score) in enumerate(base([(t, k % 5 != 1) for k, (_, t) in enumerate(rows)])):
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and math.isclose(r.base_score, score, rel_tol=1e-9) and r.score < 0 and r.row == "x"


def test_scores_do_not_depend_on_where_counts_are_looked_up(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(60))) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    a, b = ({r.doc_id: r.score for r in language_model.score_texts(frame, F.col("text"), F.lit(True), {"doc_id": F.col("doc_id")}, language_model.replace(SMALL, table=t)).collect()} for t in (40, 100_000))
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-4) for i in a)


def test_without_training_texts_and_rows(spark, none):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    keys = {"doc_id": F.col("doc_id")}
    got = {r.doc_id: r for r in language_model.score_texts(frame, F.col("text"), F.lit(None).cast("boolean"), keys, SMALL).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[1].base_score) == (3, 0, 0, 0.0) and math.isclose(got[2].score, math.log10(0.5), rel_tol=1e-5)
    assert language_model.score_texts(none, F.col("text"), F.lit(True), keys, SMALL).count() == 0


def test_model_beats_the_unigram_on_held_out_texts(spark):
    rows = queries.op11_language_model(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.1
    assert re.fullmatch(r"\d+", str(rows[0].train_tokens))


# ---------------------------------------------------------------- bounds of earlier operators


def test_a_long_labelled_text_does_not_displace_the_others_of_its_label(spark):
    """The text that is first by hash and doesn't fit is passed over; the rest is learnt."""
    from ledgerloom.llm import toxicity

    first = spark.range(400).orderBy(F.xxhash64("id"), "id").first()[0]
    rows = [(i, "bad words here " * 3 if i % 2 else "good words there " * 3, i % 2) for i in range(400) if i != first] + [(first, "long " * 6000, first % 2)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    labels = frame.select("doc_id", F.col("y").alias("toxic"), F.lit(0).alias("quality"))
    net = toxicity.train(frame.withColumn("lang", F.lit("en")), labels, max_words=8000)
    got = {r["doc_id"]: r["s"] for r in frame.select("doc_id", toxicity.score(net, F.col("text"), spark).alias("s")).collect()}
    assert all((got[i] > 0.5) == bool(y) for i, _, y in rows if i != first)


def test_items_of_one_id_count_once_over_blocks(spark):
    from ledgerloom.llm import decontam

    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")
    items = spark.createDataFrame([(3, "never seen at all"), (4, " ".join(words[5:20])), (4, " ".join(words[30:50])), (9, " ".join(words[20:32])), (None, " ".join(words[40:55])), (None, " ".join(words[0:12]))], "item_id bigint, text string")
    found = [[m["item_id"] for m in decontam.find_leaks(docs, items, block=block).first()["leaks"]] for block in (1, 2, 3, 100)]
    assert all(sorted(f, key=str) == [4, 9, None] for f in found)
