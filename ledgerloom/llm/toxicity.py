"""Toxicity: a convolutional text classifier in numpy.

A word (letters and digits, A-Z folded) is embedded by the sum of two rows, each
from a table of its own hash, so that two words share their embedding only if
both hashes agree. Filters of several widths slide over the whole text, each
keeps its largest value, and a logistic layer reads these. One row dimension
starts as the smoothed log odds of the label among texts that hold the bucket.

For scoring, embedding and filters are multiplied out into tables per hash and
offset; a text is scored by adding up table rows, with no Python step per word.

All labelled texts are learnt. Marks of their ids keep the others out of the one
shuffle that deals texts and labels by id; they are stored once, as bucket pairs, in parts of
about ``part_rows`` texts whose number grows with the table. The log odds come from
exact counts over all parts. A table of one part is fitted by the task that holds
it; with several parts, in each of ``rounds`` every task starts from the same
network, goes once through its part, in pools of ``max_words`` words, and gives
back what it changed, and the mean of the changes, by texts, makes the next
network. A first network is fitted without a fifth of the texts (by a hash of the
id), and on all of that fifth a decision threshold per language is set for the best F1,
to a ten-thousandth of the score; languages with too few labels there use the
threshold of all. The network that scores is then fitted to all texts. Texts of
the rarer label weigh more. Neither language nor any other column is an input of the
score.

Defined cases: null and empty texts are scored as a text without words; with no
labels, or labels of one class, the score is the constant share of label 1
(0.5 without any); repeated ids are learnt once; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Marks, Scratch, tidy
from .text import PLAIN, chunks

BITS = 18
BUCKETS = 1 << BITS
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)


def buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per chunk: int array (2, words) of the two buckets of each word, and the texts' word bounds."""
    for chunk in chunks(texts, PLAIN):
        h = chunk.word_hashes()
        yield np.stack([h & np.uint64(BUCKETS - 1), (h >> np.uint64(BITS)) & np.uint64(BUCKETS - 1)]).astype(np.int64), chunk.word_bounds


def _inside(bounds: np.ndarray, offset: int) -> np.ndarray:
    """True for windows whose word at this offset is still in the text."""
    return np.arange(bounds[-1]) + offset < np.repeat(bounds[1:], np.diff(bounds))


@dataclass
class Network:
    embedding: np.ndarray = None  # (2, BUCKETS, DIM)
    filters: list[np.ndarray] = field(default_factory=list)  # (width, DIM, FILTERS) each
    shift: np.ndarray = None  # bias of each filter
    out: np.ndarray = None
    bias: float = 0.0
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def tables(self) -> list[np.ndarray]:
        """Per offset, (2, BUCKETS, filters that reach it)."""
        out = []
        for j in range(max(WIDTHS)):
            reach = [w[j] for w in self.filters if len(w) > j]
            out.append(np.empty((2, BUCKETS, FILTERS * len(reach)), np.float32))
            for k, w in enumerate(reach):
                for h in range(2):  # filled in place: all in doubles at once would be six times the memory
                    out[-1][h, :, k * FILTERS : (k + 1) * FILTERS] = self.embedding[h] @ w
        return out

    def pooled(self, tables: list[np.ndarray], ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(texts, filters): the largest value of each filter, at least 0."""
        n, total = int(bounds[-1]), FILTERS * len(WIDTHS)
        pool = np.zeros((len(bounds) - 1, total), np.float32)
        full = np.flatnonzero(np.diff(bounds))
        if not n:
            return pool
        z = tables[0][0][ids[0]]
        z += tables[0][1][ids[1]]
        for j in range(1, max(WIDTHS)):
            here = _inside(bounds, j)[: n - j] if n > j else np.zeros(0, bool)
            if len(here):
                add = tables[j][0][ids[0][j:]]
                add += tables[j][1][ids[1][j:]]
                add *= here[:, None]
                z[: n - j, FILTERS * j :] += add
        pool[full] = np.maximum.reduceat(z, bounds[full], axis=0)
        return np.maximum(pool + self.shift, 0)

    def score(self, texts: pa.Array, tables: list[np.ndarray] | None = None) -> np.ndarray:
        if self.embedding is None:
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        tables = tables or self.tables()
        parts = [self.pooled(tables, i, b) @ self.out + self.bias for i, b in buckets(texts)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *parts]), -30, 30)))


class _Adam:
    def __init__(self, shape, rate):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, g):
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def held(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """(hashes, labels, BUCKETS): how many texts of each label hold a bucket."""
    out = np.zeros((2, 2, BUCKETS))
    for t, label in zip(texts, y):
        for k in range(2):
            out[k, int(label), np.unique(t[k])] += 1
    return out


def constant(n: tuple[float, float]) -> Network:
    """The network of a table without both labels, of which there are n."""
    share = (n[1] + 0.5) / (n[0] + n[1] + 1)
    return Network(bias=float(np.log(share / (1 - share))))


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 6, steps: int = 400, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Network:
    """texts: (2, words) bucket arrays. The texts are gone through ``epochs`` times, and until there are so many steps."""
    y = np.asarray(labels, float)
    n = (float((y == 0).sum()), float((y == 1).sum()))
    if not min(n):
        return constant(n)
    rng = np.random.default_rng(seed)
    return learn(begin(held(texts, y), n, rng), texts, y, n, max(epochs, -(-steps * batch // len(texts))), rng, batch, rate)


def begin(held: np.ndarray, n: tuple[float, float], rng: np.random.Generator) -> Network:
    """A network before any step; n: texts of each label."""
    share = (n[1] + 0.5) / (n[0] + n[1] + 1)
    odds = np.log((held[:, 1] + 3 * share) / (held[:, 0] + 3 * (1 - share)) * (1 - share) / share).astype(np.float32)
    embedding = rng.normal(0, 0.05, (2, BUCKETS, DIM)).astype(np.float32)
    embedding[:, :, 0] = np.clip(odds, -4, 4) / 4
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)) for w in WIDTHS]
    for w in filters:
        w[:, 0, :] = np.abs(w[:, 0, :]) + 0.5 / len(w)
    total = FILTERS * len(WIDTHS)
    return Network(embedding, filters, np.zeros(total), rng.normal(0, 0.1, total), 0.0)


def learn(net: Network, texts: list[np.ndarray], y: np.ndarray, n: tuple[float, float], epochs: int, rng: np.random.Generator, batch: int = 64, rate: float = 0.02) -> Network:
    """The network after so many passes over the texts, changed in place; n: texts of each label in the whole table."""
    share = (n[1] + 0.5) / (n[0] + n[1] + 1)
    embedding, filters, total = net.embedding, net.filters, FILTERS * len(WIDTHS)
    weight = min(4.0, max(1.0, ((1 - share) / share) ** 0.5))  # of texts of label 1
    dense = [_Adam(w.shape, rate) for w in filters] + [_Adam(total, rate), _Adam(total, rate), _Adam((), rate)]
    scale = np.full((2, BUCKETS, 1), 1e-8, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            ids = np.concatenate([texts[i] for i in part], axis=1).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum([texts[i].shape[1] for i in part])])
            n = int(bounds[-1])
            e = embedding[0][ids[0]] + embedding[1][ids[1]]
            e = np.concatenate([e, np.zeros((max(WIDTHS), DIM), np.float32)])
            windows = [e[:n]] + [e[j : n + j] * _inside(bounds, j)[:, None] for j in range(1, max(WIDTHS))]
            pool, top = np.zeros((len(part), total)), np.zeros((len(part), total), np.int64)
            for k, w in enumerate(filters):
                z = sum(windows[j] @ w[j] for j in range(len(w)))
                for d in range(len(part)):
                    a, b = bounds[d], bounds[d + 1]
                    if b > a:
                        best = z[a:b].argmax(axis=0)
                        top[d, k * FILTERS : (k + 1) * FILTERS] = a + best
                        pool[d, k * FILTERS : (k + 1) * FILTERS] = z[a + best, np.arange(FILTERS)]
            hidden = np.maximum(pool + net.shift, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.bias, -30, 30)))
            g = (p - y[part]) * np.where(y[part] == 1, weight, 1.0) / len(part)
            gh = g[:, None] * net.out * (hidden > 0)
            gh[np.diff(bounds) == 0] = 0
            ge = np.zeros((n, DIM), np.float32)
            for k, w in enumerate(filters):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                gz, tz, gw = gh[:, cols], top[:, cols], np.zeros_like(w)
                for j in range(len(w)):
                    x = windows[j][tz] if n else np.zeros((*tz.shape, DIM))
                    gw[j] = np.einsum("bf,bfd->df", gz, x)
                    held = (tz + j < bounds[1:][:, None]) & (gz != 0)
                    np.add.at(ge, (tz + j)[held], gz[held][:, None] * w[j].T[np.nonzero(held)[1]])
                filters[k] = w - dense[k].step(gw)
            net.filters = filters
            net.out = net.out - dense[-2].step(g @ hidden + 1e-4 * net.out)
            net.shift = net.shift - dense[-3].step(gh.sum(axis=0))
            net.bias = float(net.bias - dense[-1].step(g.sum()))
            used = np.flatnonzero(np.abs(ge).sum(axis=1))
            for k in range(2):
                rows = ids[k][used]
                np.add.at(scale[k], rows, (ge[used] ** 2).mean(axis=1, keepdims=True))
                np.add.at(embedding[k], rows, -0.1 * rate * ge[used] / np.sqrt(scale[k][rows]))
    return net


def best_threshold(bins: list[tuple[int, int, float, float]]) -> float:
    """The threshold of the best F1 for bins of scores (texts, texts of label 1, lowest and highest score), halfway to the next score below; 0.5 without both labels."""
    bins = sorted(bins, key=lambda b: -b[2])
    n, hits = np.cumsum([b[0] for b in bins]), np.cumsum([b[1] for b in bins])
    if not len(bins) or hits[-1] in (0, n[-1]):
        return 0.5
    k = int((2 * hits / (n + hits[-1])).argmax())
    return float((bins[k][2] + (bins[k + 1][3] if k + 1 < len(bins) else 0.0)) / 2)


def _sums(width: int) -> list[str]:
    return [f"d{i}" for i in range(width)]


def _rows(at: np.ndarray, n: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    columns = [np.ascontiguousarray(c, np.float32) for c in (n, *values.T)]
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *map(pa.array, columns)], ["at", "n", *_sums(values.shape[1])])


def _summed(texts: DataFrame, found: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What all tasks found, added up by place: at most one row for each bucket and dense parameter, whatever the table; its shuffle files go at once."""
    names = ["n", *_sums(width)]
    with tidy(texts.sparkSession):
        parts = texts.mapInArrow(found, "at int, " + ", ".join(f"{c} float" for c in names))
        got = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    return got["at"].to_numpy(), got["n"].to_numpy(), np.stack([got[d].to_numpy() for d in names[1:]], axis=1)


def pack(ids: np.ndarray) -> bytes:
    """The two buckets of each word side by side, so that a word that comes again is eight equal bytes to the file's codec."""
    return np.ascontiguousarray(ids.T, np.uint32).tobytes()


def unpacked(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(data.as_py(), np.uint32).reshape(-1, 2).T


def _pools(batches: Iterator[pa.RecordBatch], max_words: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Texts and labels of a part, so many words at a time; a longer text is a pool of its own."""
    texts, y, words = [], [], 0
    for batch in batches:
        for data, label in zip(batch.column("words"), batch.column("_label")):
            t = unpacked(data)
            if texts and words + t.shape[1] > max_words:
                yield texts, np.array(y, float)
                texts, y, words = [], [], 0
            texts.append(t)
            y.append(label.as_py())
            words += t.shape[1]
    if texts:
        yield texts, np.array(y, float)


def _dense(net: Network) -> np.ndarray:
    return np.concatenate([*[w.ravel() for w in net.filters], net.shift, net.out, [net.bias]])


def _with_dense(embedding: np.ndarray, values: np.ndarray) -> Network:
    sizes = [w * DIM * FILTERS for w in WIDTHS] + [FILTERS * len(WIDTHS)] * 2
    *filters, shift, out, bias = np.split(values, np.cumsum(sizes))
    return Network(embedding, [f.reshape(w, DIM, FILTERS).copy() for f, w in zip(filters, WIDTHS)], shift.copy(), out.copy(), float(bias[0]))


def fit_parts(texts: DataFrame, parts: int, max_words: int, rounds: int = 3, seed: int = 5) -> Network:
    """The network of a stored table (words, _label) in so many parts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((2, 2, BUCKETS)), np.zeros(2)
        for pool, y in _pools(batches, max_words):
            both += held(pool, y)
            n += [(y == 0).sum(), (y == 1).sum()]
        flat = both.transpose(1, 0, 2).reshape(2, -1)
        at = np.flatnonzero(flat.any(axis=0))
        yield _rows(np.append(at, -1), np.append(flat[0, at], n[0]), np.append(flat[1, at], n[1])[:, None])

    at, first, rest = _summed(texts, counted, 1)
    both = np.zeros((2, 2 * BUCKETS))
    both[:, at[at >= 0]] = first[at >= 0], rest[at >= 0, 0]
    n = (float(first[at < 0].sum()), float(rest[at < 0, 0].sum()))
    if not min(n):
        return constant(n)
    net = begin(both.reshape(2, 2, BUCKETS).transpose(1, 0, 2), n, np.random.default_rng(seed))
    once = max(6, -(-400 * 64 // int(sum(n))))
    for turn in range(rounds if parts > 1 else 1):
        shipped = texts.sparkSession.sparkContext.broadcast(net)

        def learnt(batches: Iterator[pa.RecordBatch], shipped=shipped, turn=turn) -> Iterator[pa.RecordBatch]:
            start = shipped.value
            mine, rng, count = _with_dense(start.embedding.copy(), _dense(start)), np.random.default_rng(seed + 1 + turn), 0
            for pool, y in _pools(batches, max_words):
                mine = learn(mine, pool, y, n, 1 if parts > 1 else once, rng)
                count += len(pool)
            if count:
                change = (mine.embedding - start.embedding).reshape(-1, DIM)
                at = np.flatnonzero(change.any(axis=1))
                yield _rows(at, np.full(len(at), count), change[at] * float(count))
                dense = np.zeros((len(_dense(mine)), DIM))
                dense[:, 0] = _dense(mine) * count
                yield _rows(-1 - np.arange(len(dense)), np.full(len(dense), count), dense)

        at, weight, sums = _summed(texts, learnt, DIM)
        shipped.destroy()
        up, dense = at >= 0, np.zeros((at < 0).sum())
        dense[-1 - at[~up]] = sums[~up, 0] / weight[~up]
        embedding = net.embedding.copy().reshape(-1, DIM)
        embedding[at[up]] += (sums[up] / weight[up, None]).astype(np.float32)
        net = _with_dense(embedding.reshape(2, BUCKETS, DIM), dense)
    return net


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang", part_rows: int = 10_000, max_words: int = 6_000_000, min_lang_rows: int = 20
) -> Network:
    """Learns from all labelled texts, in parts of about ``part_rows`` texts and pools of ``max_words`` words."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    one = rows.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    with tidy(docs.sparkSession):
        parts = max(1, -(-one.count() // part_rows))
        marks = Marks(one.select(F.xxhash64("_id").alias("h")), "h")
    lang = F.col(f"`{lang_col}`") if lang_col else F.lit(None).cast("string")

    def packed(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            found = [i[:, a:b] for i, bounds in buckets(texts) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.array([pack(f) for f in found], pa.binary())

    got = docs.select(F.col(f"`{id_col}`").alias("_id"), F.struct(F.col(f"`{text_col}`").alias("_text"), lang.alias("_lang")).alias("_x"))
    if got.schema["_id"].dataType == one.schema["_id"].dataType:  # else equal ids may differ in their hashes
        got = got.filter(marks.has(F.xxhash64("_id")))
    # texts and labels are dealt together: a join ahead of the deal into parts would deal the texts twice
    got = got.unionByName(one, allowMissingColumns=True).repartition(parts, "_id").groupBy("_id").agg(F.max("_label").alias("_label"), F.max("_x").alias("_x"))
    got = got.filter("_id is not null and _label is not null and _x is not null")
    scratch = Scratch(docs.sparkSession)
    texts = scratch(got.select((F.pmod(F.xxhash64("_id"), F.lit(5)) == 0).alias("_aside"), "_label", F.col("_x._lang").alias("_lang"), F.arrow_udf(packed, "binary")(F.col("_x._text")).alias("words")), "zstd")
    found = _thresholds(fit_parts(texts.filter("not _aside").select("words", "_label"), parts, max_words), texts.filter("_aside"), min_lang_rows)
    net = replace(fit_parts(texts.select("words", "_label"), parts, max_words), thresholds=found)
    scratch.clear()
    return net


def _thresholds(net: Network, texts: DataFrame, min_rows: int) -> dict[str | None, float]:
    """Per language, and for None over all, the threshold of the best F1 on all texts that were not fitted; scores are counted in bins."""
    if net.embedding is None:
        return {}
    shipped = texts.sparkSession.sparkContext.broadcast(net)

    def told(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shipped.value
        tables = model.tables()
        for batch in it:
            each = [unpacked(data).astype(np.int64) for data in batch]
            z = [float((model.pooled(tables, t, np.array([0, t.shape[1]])) @ model.out + model.bias)[0]) for t in each]
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())

    s = texts.select("_lang", "_label", F.arrow_udf(told, "double")(F.col("words")).alias("s"))
    with tidy(texts.sparkSession):
        bins = s.groupBy("_lang", F.floor(F.col("s") * 10_000).alias("b")).agg(F.count("*").alias("n"), F.sum("_label").alias("hits"), F.min("s").alias("low"), F.max("s").alias("high")).collect()
    every = {}
    for r in bins:
        n, hits, low, high = every.get(r["b"], (0, 0, 1.0, 0.0))
        every[r["b"]] = (n + r["n"], hits + r["hits"], min(low, r["low"]), max(high, r["high"]))
    out = {None: best_threshold(list(every.values()))} if bins else {}
    for name in sorted({r["_lang"] for r in bins if r["_lang"] is not None}):
        own = [(r["n"], r["hits"], r["low"], r["high"]) for r in bins if r["_lang"] == name]
        n, hits = sum(b[0] for b in own), sum(b[1] for b in own)
        if n >= min_rows and 0 < hits < n:
            out[name] = best_threshold(own)
    return out


def score(net: Network, text: Column, spark) -> Column:
    """The network travels once to each executor, as a broadcast of fixed size."""
    shipped = spark.sparkContext.broadcast(net)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shipped.value
        tables = model.tables() if model.embedding is not None else None
        for texts in it:
            yield pa.array(model.score(texts, tables), pa.float64())

    return F.arrow_udf(run, "double")(text)


def threshold(net: Network, lang: Column) -> Column:
    """The calibrated threshold of a row's language."""
    out = F.lit(net.thresholds.get(None, 0.5))
    for name, t in net.thresholds.items():
        if name is not None:
            out = F.when(lang == name, F.lit(t)).otherwise(out)
    return out
