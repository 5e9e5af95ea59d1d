"""Scores of whole texts by a gated recurrent language model, fitted in numpy by the tasks that hold the texts.

Tokens are words (A-Z folded) and one end for each text. All training texts
count: their words are counted exactly, and the model passes over each once.

* **Words.** The counts of all words are a stored table. Words of at most
  ``longest`` bytes in the most frequent count classes (quarter octaves), as many
  whole classes as hold ``table`` words at most, travel by broadcast; all others
  meet their counts in a join. This decides only where a count is looked up.
* **Model.** The ``vocabulary`` most frequent of the words in the broadcast, the
  end, and one token for all other words. Its output is factored: a class, then
  the word within its class; classes have equal shares of the square roots of the
  counts. The output starts as the unigram distribution. A word outside of the
  vocabulary takes the probability of that token times its add-half share among
  all such training words, so that every text has a probability.
* **Training.** Rounds of ever other training texts (by a hash of the text). In a
  round each task starts from the broadcast weights, goes once through its texts
  in lanes, by windows of ``window`` steps with gradients cut at the window's
  start and the state carried on, and gives back its weights; their mean, by
  tokens, is added up in a tree of tasks and starts the next round.
* **Scoring.** Lanes again: a lane holds whole texts one after another, the state
  starts anew with each text and is carried through all its windows.

Defined cases: null and empty texts have one token, the end; without training
texts every count is 0 and the model is uniform; null and repeated ids are rows
like any; an empty table gives an empty table. Results stand beside each other in
a new table of the key columns asked for, so that names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .store import Scratch
from .text import FOLD, chunks

END, OTHER = 0, 1


@dataclass(frozen=True)
class Settings:
    table: int = 1 << 18
    vocabulary: int = 2048
    longest: int = 64
    classes: int = 20
    hidden: int = 12
    window: int = 24
    lanes: int = 512  # in training; in scoring twice as many
    rounds: int = 2
    rate: float = 0.01
    clip: float = 1.0
    pool: int = 3 << 20  # tokens laid out in lanes at once, about 60 bytes each: many, as the longest text sets the number of steps
    seed: int = 17


# ---------------------------------------------------------------- words


def _word_lists(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Per chunk of two megabytes: its words, and how many each text has."""
    for chunk in chunks(texts, FOLD, 1 << 21):
        yield chunk.words(), chunk.n_words


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all texts of a one-column table."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            held = []
            for words, _ in _word_lists(batch.column(0)):
                c = pc.value_counts(words)
                held.append(pa.table({"word": c.field(0), "n": c.field(1)}))
            if held:
                for out in pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches():
                    yield pa.RecordBatch.from_arrays([out["word"].cast(pa.string()), out["n"]], ["word", "n"])

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """What is known of the training tokens, and the words that travel with the model."""

    head: pa.Array  # words by falling count, then by word
    counts: np.ndarray
    tokens: int
    distinct: int
    other_tokens: int  # training tokens outside of the vocabulary, and their distinct words
    other_distinct: int
    texts: int

    @classmethod
    def of(cls, counts: DataFrame, texts: int, s: Settings) -> Words:
        short = F.length(F.col("word").cast("binary")) <= s.longest
        level = F.floor(4 * F.log2("n")).cast("int")
        found = counts.groupBy(F.when(short, level).alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
        tokens, distinct = sum(r["n"] for r in found) + texts, sum(r["words"] for r in found) + (texts > 0)
        least, held = None, 0
        for r in sorted((r for r in found if r["level"] is not None), key=lambda r: -r["level"]):
            held += r["words"]
            if held > s.table:
                break
            least = r["level"]
        head = counts.filter(short & (level >= least)).toArrow() if least is not None else pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        head = head.sort_by([("n", "descending"), ("word", "ascending")])
        n = head["n"].to_numpy().astype(np.int64)
        known = n[: s.vocabulary].sum()
        return cls(head["word"].combine_chunks().cast(pa.large_string()) if len(head) else pa.array([], pa.large_string()), n, int(tokens), int(distinct), int(tokens - texts - known), int(distinct - (texts > 0) - min(s.vocabulary, len(n))), int(texts))

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the add-half share of words with these counts among all tokens."""
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def among_others(self, counts: np.ndarray) -> np.ndarray:
        """log10 of their add-half share among the words outside of the vocabulary."""
        return np.log10((counts + 0.5) / (self.other_tokens + 0.5 * (self.other_distinct + 1)))

    def vocabulary_counts(self, s: Settings) -> np.ndarray:
        """Of the model's tokens: the end, other words, then the vocabulary."""
        return np.concatenate([[self.texts, self.other_tokens], self.counts[: s.vocabulary]]).astype(np.float64)


ENCODED = "n_tokens bigint, known bigint, base double, others double, ids binary, rest array<struct<word:string,n:bigint>>"


def encode(texts: pa.Array, words: Words, s: Settings) -> pa.StructArray:
    """The token numbers of each text (16 bits each), what the broadcast words add to its scores, and the words still to be looked up."""
    base, others = words.base(words.counts), words.among_others(words.counts)
    others[: s.vocabulary] = 0.0
    end = float(words.base(np.array(words.texts)))
    columns = [[] for _ in range(6)]
    for strings, n in _word_lists(texts):
        d = pc.dictionary_encode(strings)
        code = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = pc.fill_null(pc.index_in(d.dictionary, value_set=words.head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = place[code] if len(code) else code
        known, text, bounds = at >= 0, np.repeat(np.arange(len(n)), n), np.concatenate([[0], np.cumsum(n)])
        columns[0].append(n + 1)
        columns[1].append(np.bincount(text, known, len(n)).astype(np.int64) + (words.texts > 0))
        columns[2].append(np.bincount(text, np.append(base, 0.0)[at], len(n)) + end)
        columns[3].append(np.bincount(text, np.append(others, 0.0)[at], len(n)))
        numbers = np.where(known & (at < s.vocabulary), at + 2, OTHER).astype("<u2")
        raw = np.insert(numbers, bounds[1:], END)
        columns[4].append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(2 * (bounds + np.arange(len(n) + 1))), pa.py_buffer(raw)]).cast(pa.binary()))
        key, times = np.unique(text[~known] * len(d.dictionary) + code[~known], return_counts=True) if len(code) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        of = np.searchsorted(key, np.arange(len(n) + 1) * max(1, len(d.dictionary)))
        rest = pa.StructArray.from_arrays([d.dictionary.take(pa.array(key % max(1, len(d.dictionary)))).cast(pa.string()), pa.array(times.astype(np.int64))], ["word", "n"])
        columns[5].append(pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), rest))
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
    arrays = [pa.concat_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in c]) if c else pa.array([], k) for c, k in zip(columns, kinds)]
    none = pa.array([], pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))
    return pa.StructArray.from_arrays([*arrays, pa.concat_arrays(columns[5]) if columns[5] else none], ["n_tokens", "known", "base", "others", "ids", "rest"])


# ---------------------------------------------------------------- the network


@dataclass
class Weights:
    """The parameters. ``inputs`` has a row for each token: its embedding times the input weights of the gates."""

    inputs: np.ndarray  # (tokens, 3 * hidden)
    state: np.ndarray  # (hidden, 3 * hidden)
    shift: np.ndarray  # (hidden,) of the candidate's share of the state
    to_class: np.ndarray  # (hidden, classes)
    of_class: np.ndarray
    to_word: np.ndarray  # (tokens, hidden)
    of_word: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def bound(self) -> None:
        """Keeps the output's logits within 75 of 0, as states are within 1."""
        for weight, shift in ((self.to_class, self.of_class), (self.to_word, self.of_word)):
            np.clip(weight, -50 / len(self.state), 50 / len(self.state), out=weight)
            np.clip(shift, -25, 25, out=shift)

    @classmethod
    def flat(cls, like: Weights, values: np.ndarray) -> Weights:
        out, at = [], 0
        for a in like.arrays():
            out.append(values[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return cls(*out)

    def flattened(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()]).astype(np.float64)


def class_bounds(counts: np.ndarray, classes: int) -> np.ndarray:
    """Tokens 0 and 1 are classes of their own; the others are cut, in their order, at equal shares of the square roots of their counts."""
    if len(counts) <= 2:
        return np.arange(len(counts) + 1)
    share = np.cumsum(np.sqrt(counts[2:]))
    cuts = np.searchsorted(share, share[-1] * np.arange(1, classes) / classes, side="left") + 3
    return np.unique(np.concatenate([[0, 1, 2], cuts, [len(counts)]]))


def begin(counts: np.ndarray, s: Settings) -> Weights:
    """Weights whose output is the add-half unigram distribution."""
    rng = np.random.default_rng(s.seed)
    bounds, n, h = class_bounds(counts, s.classes), len(counts), s.hidden
    smooth = counts + 0.5
    mass = np.add.reduceat(smooth, bounds[:-1])
    small = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(h)).astype(np.float32)
    return Weights(
        small(n, 3 * h), small(h, 3 * h), np.zeros(h, np.float32), np.zeros((h, len(mass)), np.float32), np.log(mass / mass.sum()).astype(np.float32),
        np.zeros((n, h), np.float32), np.log(smooth / np.repeat(mass, np.diff(bounds))).astype(np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Lanes:
    """Texts laid out in lanes: whole texts one after another, the longest lane first, read step by step."""

    def __init__(self, ids: list[np.ndarray], lanes: int):
        length = np.array([len(x) for x in ids], np.int64)
        lane, place, load = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64), np.zeros(max(1, min(lanes, len(ids))), np.int64)
        for i in np.argsort(-length, kind="stable").tolist():
            lane[i] = k = int(load.argmin())
            place[i] = load[k]
            load[k] += length[i]
        rank = np.empty(len(load), np.int64)
        rank[np.argsort(-load, kind="stable")] = np.arange(len(load))
        text = np.repeat(np.arange(len(ids), dtype=np.int32), length)
        inside = np.arange(length.sum()) - (np.cumsum(length) - length)[text]
        step = inside + place[text]
        order = np.argsort(step * len(load) + rank[lane][text], kind="stable")
        target = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        before = np.where(inside == 0, END, np.concatenate([[END], target[:-1]])[: len(target)]).astype(np.int32)
        self.text, self.target, self.before, self.keep = text[order], target[order], before[order], (inside[order] > 0).astype(np.float32)
        self.active = np.bincount(step) if len(step) else np.zeros(0, np.int64)

    def windows(self, steps: int) -> Iterator[tuple[slice, np.ndarray]]:
        at = 0
        for t in range(0, len(self.active), steps):
            active = self.active[t : t + steps]
            yield slice(at, at + int(active.sum())), active
            at += int(active.sum())


class Network:
    """Forward and backward passes over the windows of lanes."""

    def __init__(self, weights: Weights, bounds: np.ndarray, s: Settings):
        self.w, self.bounds, self.s = weights, bounds, s
        self.class_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def states(self, lanes: Lanes, at: slice, active: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
        """Of each token of a window: the state it is told from, the gates, and the state after its input. h: the lanes' states before the window."""
        w, size = self.w, self.s.hidden
        x, keep = w.inputs[lanes.before[at]], lanes.keep[at, None]
        n = len(x)
        past, gates, inner, fresh, after = (np.empty((n, k), np.float32) for k in (size, 2 * size, size, size, size))
        i = 0
        for a in active.tolist():
            j = i + a
            prior = h[:a] * keep[i:j]
            u = prior @ w.state
            g = _sigmoid(x[i:j, : 2 * size] + u[:, : 2 * size])
            c = u[:, 2 * size :] + w.shift
            f = np.tanh(x[i:j, 2 * size :] + g[:, size:] * c)
            h = prior + g[:, :size] * (f - prior)
            past[i:j], gates[i:j], inner[i:j], fresh[i:j], after[i:j] = prior, g, c, f, h
            i = j
        return {"past": past, "gates": gates, "inner": inner, "fresh": fresh, "after": after, "last": h}

    def output(self, after: np.ndarray, target: np.ndarray, learn: bool) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Natural log probability of each target; with learn, the gradients of its mean's negative."""
        w, of = self.w, self.class_of[target]
        order = np.argsort(of.astype(np.int16), kind="stable")  # tokens of a class stand together
        of, target, here = of[order], target[order], after[order]
        cuts = np.searchsorted(of, np.arange(len(self.bounds)))
        rows, scale = np.arange(len(target)), np.float32(1 / max(1, len(target)))

        def softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
            """The log probability of the column picked in each row; with learn, z becomes the gradient. Weights are bounded, so that no exponential overflows."""
            picked = z[rows[: len(z)], at]
            np.exp(z, out=z)
            total = z @ np.ones(z.shape[1], z.dtype)
            if learn:
                z *= (scale / total)[:, None]
                z[rows[: len(z)], at] -= scale
            return picked - np.log(total)

        z = here @ w.to_class
        z += w.of_class
        told = softmax(z, of)
        g: dict[str, np.ndarray] = {}
        if learn:
            back = z @ w.to_class.T
            g = {"to_class": here.T @ z, "of_class": z.sum(0), "to_word": np.zeros_like(w.to_word), "of_word": np.zeros_like(w.of_word)}
        for c in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(self.bounds) > 1)).tolist():
            a, b, i, j = cuts[c], cuts[c + 1], self.bounds[c], self.bounds[c + 1]
            z = here[a:b] @ w.to_word[i:j].T
            z += w.of_word[i:j]
            told[a:b] += softmax(z, target[a:b] - i)
            if learn:
                g["to_word"][i:j], g["of_word"][i:j] = z.T @ here[a:b], z.sum(0)
                back[a:b] += z @ w.to_word[i:j]
        logp = np.empty_like(told)
        logp[order] = told
        if learn:
            g["after"] = np.empty_like(back)
            g["after"][order] = back
        return logp, g

    def gradients(self, lanes: Lanes, at: slice, active: np.ndarray, h: np.ndarray) -> tuple[Weights, np.ndarray, np.ndarray]:
        """Gradients of a window's mean negative log probability, the lanes' states after it, and the log probabilities."""
        w, size, keep = self.w, self.s.hidden, lanes.keep[at, None]
        t = self.states(lanes, at, active, h)
        logp, g = self.output(t["after"], lanes.target[at], True)
        inputs, state = np.empty((len(logp), 3 * size), np.float32), np.empty((len(logp), 3 * size), np.float32)
        back = np.zeros((0, size), np.float32)
        j = len(logp)
        for a in active[::-1].tolist():
            i = j - a
            d = g["after"][i:j]
            d[: len(back)] += back
            u, r = t["gates"][i:j, :size], t["gates"][i:j, size:]
            past, fresh, inner = t["past"][i:j], t["fresh"][i:j], t["inner"][i:j]
            df = d * u * (1 - fresh * fresh)
            du = d * (fresh - past) * u * (1 - u)
            dr = df * inner * r * (1 - r)
            inputs[i:j, :size], inputs[i:j, size : 2 * size], inputs[i:j, 2 * size :] = du, dr, df
            state[i:j, : 2 * size], state[i:j, 2 * size :] = inputs[i:j, : 2 * size], df * r
            back = (d * (1 - u) + state[i:j] @ w.state.T) * keep[i:j]
            j = i
        order = np.argsort(lanes.before[at], kind="stable")
        word = lanes.before[at][order]
        firsts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        to_inputs = np.zeros_like(w.inputs)
        to_inputs[word[firsts]] = np.add.reduceat(inputs[order], firsts)
        return Weights(to_inputs, t["past"].T @ state, state[:, 2 * size :].sum(0), g["to_class"], g["of_class"], g["to_word"], g["of_word"]), t["last"], logp

    def log_probabilities(self, ids: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text, the state carried through its windows."""
        lanes, out = Lanes(ids, 2 * self.s.lanes), np.zeros(len(ids))
        h = np.zeros((len(ids) and int(lanes.active[0]), self.s.hidden), np.float32)
        for at, active in lanes.windows(self.s.window):
            t = self.states(lanes, at, active, h)
            logp, _ = self.output(t["after"], lanes.target[at], False)
            out += np.bincount(lanes.text[at], logp.astype(np.float64), len(ids))
            h = t["last"]
        return out / np.log(10)


def learn(weights: Weights, bounds: np.ndarray, pools: Iterator[list[np.ndarray]], s: Settings) -> tuple[Weights, int]:
    """One pass over the texts by Adam; the weights after it, and how many tokens there were."""
    w = Weights(*[a.copy() for a in weights.arrays()])
    first, second = [np.zeros_like(a) for a in w.arrays()], [np.zeros_like(a) for a in w.arrays()]
    net, step, tokens = Network(w, bounds, s), 0, 0
    for ids in pools:
        total = sum(map(len, ids))
        lanes = Lanes(ids, int(np.clip(total // (64 * s.window), 16, s.lanes)))
        h = np.zeros((len(ids) and int(lanes.active[0]), s.hidden), np.float32)
        for at, active in lanes.windows(s.window):
            g, h, _ = net.gradients(lanes, at, active, h)
            step += 1
            norm = np.sqrt(sum(float(np.vdot(x, x)) for x in g.arrays()))
            scale = np.float32(min(1.0, s.clip / max(norm, 1e-12)))
            rate = np.float32(s.rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
            for a, x, m, v in zip(w.arrays(), g.arrays(), first, second):
                x *= scale
                m += np.float32(0.1) * (x - m)
                v += np.float32(0.001) * (x * x - v)
                a -= rate * m / (np.sqrt(v) + np.float32(1e-8))
            w.bound()
        tokens += total
    return w, tokens


# ---------------------------------------------------------------- on tables


def _pools(ids: Iterator[pa.Array], s: Settings) -> Iterator[list[np.ndarray]]:
    held, total = [], 0
    for array in ids:
        for value in array:
            held.append(np.frombuffer(value.as_buffer(), "<u2"))
            total += len(held[-1])
            if total >= s.pool:
                yield held
                held, total = [], 0
    if held:
        yield held


def train(encoded: DataFrame, words: Words, s: Settings) -> tuple[Weights, np.ndarray]:
    """Fits the model to the ``ids`` of all rows, in rounds of rows with the same ``part``."""
    counts = words.vocabulary_counts(s)
    weights, bounds = begin(counts, s), class_bounds(counts, s.classes)
    if not words.texts:
        return weights, bounds
    sc = encoded.sparkSession.sparkContext
    for k in range(s.rounds):
        sent = sc.broadcast(weights)

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            start = sent.value
            fitted, tokens = learn(start, bounds, _pools((b.column(0) for b in it), s), s)
            if tokens:
                sums = (fitted.flattened() - start.flattened()) * tokens
                yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([sums.tobytes()], pa.binary())], ["tokens", "sums"])

        parts = encoded.filter(F.col("part") == k).select("ids").mapInArrow(run, "tokens bigint, sums binary")
        pairs = parts.rdd.map(lambda r: (r[0], np.frombuffer(r[1], np.float64)))
        tokens, moved = pairs.treeAggregate((0, 0.0), _added, _added, depth=3)
        if tokens:
            weights = Weights.flat(weights, weights.flattened() + moved / tokens)
        sent.unpersist()
    return weights, bounds


def _told(net: Network, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with a log10 probability in place of the token numbers."""
    told, at = net.log_probabilities([np.frombuffer(v.as_buffer(), "<u2") for b in batches for v in b["ids"]]), 0
    for b in batches:
        names = [n for n in b.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays([*[b[n] for n in names], pa.array(told[at : at + b.num_rows])], [*names, "told"])
        at += b.num_rows


def _added(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


def score_texts(docs: DataFrame, text: Column, training: Column, keys: dict[str, Column], settings: Settings = Settings()) -> DataFrame:
    """For each row its keys, n_tokens, n_known, train_tokens, base_score and score (log10).

    training: true for the rows to learn from; null counts as false.
    """
    s = settings
    if not (0 < s.vocabulary <= min(s.table, (1 << 16) - 2) and s.hidden > 0 and s.classes > 0 and s.window > 0 and s.lanes > 0 and s.rounds > 0):
        raise ValueError("sizes are positive, and a vocabulary has at most 65,534 words, all in the table")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    taken = F.coalesce(training, F.lit(False))
    texts = docs.filter(taken).select(text.alias("text"))
    counts = scratch(word_counts(texts))
    words = Words.of(counts, texts.count(), s)
    shipped = spark.sparkContext.broadcast(words)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in it:
            yield encode(batch, shipped.value, s)

    part = F.when(taken, F.pmod(F.xxhash64(text), F.lit(s.rounds)).cast("int"))
    rows = docs.select(*[c.alias(f"key{i}") for i, c in enumerate(keys.values())], part.alias("part"), F.arrow_udf(run, ENCODED)(text).alias("e"))
    rows = scratch(rows.select(*[f"key{i}" for i in range(len(keys))], "part", "e.*", F.monotonically_increasing_id().alias("row")))
    weights, bounds = train(rows, words, s)

    rest = rows.filter(F.size("rest") > 0).select("row", F.explode("rest").alias("w")).select("row", "w.*").withColumnRenamed("n", "times")
    met = rest.join(counts, "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    log = lambda total, distinct: F.log10((F.col("n") + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    met = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("met_known"),
        F.sum(F.col("times") * log(words.tokens, words.distinct)).alias("met_base"),
        F.sum(F.col("times") * log(words.other_tokens, words.other_distinct)).alias("met_others"),
    )
    model = spark.sparkContext.broadcast(weights)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, held, tokens = Network(model.value, bounds, s), [], 0
        for batch in it:
            held.append(batch)
            tokens += batch["ids"].nbytes // 2
            if tokens >= s.pool:
                yield from _told(net, held)
                held, tokens = [], 0
        yield from _told(net, held)

    sums = lambda own, more: F.col(own) + F.coalesce(more, F.lit(0))
    asked = rows.select(*[f"key{i}" for i in range(len(keys))], "row", "n_tokens", "known", "base", "others", "ids")
    scored = asked.mapInArrow(score, StructType([*asked.drop("ids").schema.fields, StructField("told", DoubleType())]))
    return scored.join(met, "row", "left").select(
        *[F.col(f"key{i}").alias(name) for i, name in enumerate(keys)],
        "n_tokens", sums("known", "met_known").alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"), sums("base", "met_base").alias("base_score"),
        (F.col("told") + sums("others", "met_others")).alias("score"),
    )
