"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is lower-cased and cut into words; each word enters as the embedding of the word itself (of those that occur in
several training texts) beside the mean of embeddings of its hashed character n-grams, with its borders. Windows of
``WINDOW`` words that overlap by half are read in both directions by gated recurrent units; attention pools the states
of a window, and a logistic unit gives its score. A document's score is its highest window's: every window of the
whole text counts, and documents of any length are scored alike.

Training is by multiple instances: a document's label is that of its highest window, which each epoch picks anew (by the
log-odds of words at first). It takes a bounded sample of labelled documents, at most ``MOST_TOXIC`` and ``MOST_CLEAN`` of
at most ``MOST_CHARS`` characters each, those with the least hash of the id; clean ones are weighted by how many stand
behind the sample.

Defined cases: a null text is empty; a text without words has the score of a window without words; repeated rows give
equal scores; of texts with one id the one with the least hash is learned from, and of labels of one id the toxic one; ties
between windows go to the first; without any toxic or any clean training text every score is the smoothed share of toxic
labels; labels that are null or of null ids are left out; an empty table gives an empty table. Other columns are neither read
nor changed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_steps, tuned, worker_memory

WINDOW = 32
STRIDE = 16
HIDDEN = 12
EMBED = 16
ATTEND = 8
VOCABULARY = 20_000
BUCKETS = 8192
GRAMS = (3, 4, 6)
#: Longer words are cut into words of this length.
LONGEST = 24
MOST_TOXIC = 2500
MOST_CLEAN = 5000
MOST_CHARS = 20_000
#: Rounds over the sample; more, if a small sample gives fewer steps.
EPOCHS = 6
LEAST_STEPS = 300
BATCH = 128
RATE = 0.01
#: Of the embeddings.
DECAY = 1e-3
THRESHOLD = 0.3
#: Words whose input a worker remembers: 288 bytes each.
REMEMBERED = 100_000
STEP = 500_000
#: Windows that are read at once.
SLAB = 512

WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    found = WORD.findall(text.lower())
    if max(map(len, found), default=0) > LONGEST:
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words, grams) hash buckets of the character n-grams with borders, and which of them are there."""
    marked = [f"\x02{w}\x03" for w in words]
    width = max(map(len, marked), default=2)
    chars = np.array(marked, f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)
    lengths = np.array([len(m) for m in marked])
    buckets, there = [], []
    for n in GRAMS:
        if width < n:
            continue
        h = np.full((len(words), width - n + 1), n, np.uint64)
        for i in range(n):
            h = (h ^ chars[:, i : i + h.shape[1]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        buckets.append((h % np.uint64(BUCKETS)).astype(np.int32))
        there.append(np.arange(h.shape[1])[None, :] + n <= lengths[:, None])
    if not buckets:
        return np.zeros((len(words), 1), np.int32), np.zeros((len(words), 1), bool)
    return np.concatenate(buckets, 1), np.concatenate(there, 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """The parameters; ``words`` numbers the vocabulary from 1, and 0 is any other word."""

    words: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None  # the only score, where there was nothing to learn from

    @staticmethod
    def begin(words: dict[str, int], seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        normal = lambda *shape: (r.standard_normal(shape) * 0.15).astype(np.float32)
        p = {"word": normal(len(words) + 1, EMBED), "gram": normal(BUCKETS, EMBED), "attend": normal(2 * HIDDEN, ATTEND), "attend_v": normal(ATTEND), "out": normal(2 * HIDDEN), "out_b": np.full(1, -2, np.float32)}
        for d in "fb":
            p |= {f"in_{d}": normal(2 * EMBED, 3 * HIDDEN), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32), f"state_{d}": normal(HIDDEN, 3 * HIDDEN)}
        p["word"][0] = 0
        return Network(words, p)

    def vectors(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(input, vocabulary index, buckets, weights of the buckets) of words."""
        index = np.array([self.words.get(w, 0) for w in words])
        buckets, there = gram_buckets(words)
        weight = there / np.maximum(there.sum(1, keepdims=True), 1).astype(np.float32)
        chars = np.einsum("wg,wge->we", weight.astype(np.float32), self.p["gram"][buckets])
        return np.concatenate([self.p["word"][index], chars], 1), index, buckets, weight

    def inputs(self, words: list[str]) -> np.ndarray:
        """What the gates of both directions take from words: (words, 6 x HIDDEN)."""
        out = np.empty((len(words), 6 * HIDDEN), np.float32)
        for i in range(0, len(words), 4096):
            x = self.vectors(words[i : i + 4096])[0]
            out[i : i + 4096, : 3 * HIDDEN] = x @ self.p["in_f"] + self.p["bias_f"]
            out[i : i + 4096, 3 * HIDDEN :] = x @ self.p["in_b"] + self.p["bias_b"]
        return out

    def read(self, gates: np.ndarray, mask: np.ndarray, direction: str, keep: list | None = None) -> np.ndarray:
        """The states (time, windows, HIDDEN) of one direction, from its gates' inputs (time, windows, 3 x HIDDEN)."""
        u = self.p[f"state_{direction}"]
        h = np.zeros((gates.shape[1], HIDDEN), np.float32)
        states = np.empty((*gates.shape[:2], HIDDEN), np.float32)
        whole = mask.all(1)
        for t in range(len(gates)) if direction == "f" else reversed(range(len(gates))):
            rec = h @ u
            # The logistic function by tanh, in place.
            zr = gates[t, :, : 2 * HIDDEN] + rec[:, : 2 * HIDDEN]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = r * rec[:, 2 * HIDDEN :]
            n += gates[t, :, 2 * HIDDEN :]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            if keep is not None:
                keep.append((t, h, z, r, n, rec[:, 2 * HIDDEN :]))
            h = new if whole[t] else np.where(mask[t, :, None], new, h)
            states[t] = h
        return states

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(logits, attention, pooled states, attention's hidden layer)."""
        hidden = np.tanh(states @ self.p["attend"])
        weight = hidden @ self.p["attend_v"] + np.where(mask, 0, -1e4).astype(np.float32)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tw,twh->wh", weight, states)
        return pooled @ self.p["out"] + self.p["out_b"], weight, pooled, hidden

    def logits(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of windows (windows, time) of rows of ``table``; some at a time, so that memory stays bounded."""
        out = np.empty(len(index), np.float32)
        for i in range(0, len(index), SLAB):
            m = mask[i : i + SLAB].T
            gates = table[index[i : i + SLAB].T]
            states = np.concatenate([self.read(gates[:, :, : 3 * HIDDEN], m, "f"), self.read(gates[:, :, 3 * HIDDEN :], m, "b")], 2)
            out[i : i + SLAB] = self.pool(states, m)[0]
        return out


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, index into the joined words, mask) of all windows; a text without words has one without words."""
    each = np.maximum(-(-(lengths - WINDOW) // STRIDE), 0) + 1
    doc = np.repeat(np.arange(len(lengths)), each)
    nth = (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)).astype(np.int32)
    first = (np.cumsum(lengths) - lengths).astype(np.int32)
    within = nth[:, None] * np.int32(STRIDE) + np.arange(WINDOW, dtype=np.int32)
    mask = within < lengths.astype(np.int32)[doc][:, None]
    within += first[doc][:, None]
    within *= mask
    return doc, within, mask


class Scorer:
    """Scores of texts; remembers the inputs of words met before."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.at: dict[str, int] = {}
        self.table = np.empty((0, 6 * HIDDEN), np.float32)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.network.constant is not None:
            return np.full(len(texts), self.network.constant)
        out = np.zeros(len(texts))
        for start, step in text_steps(texts, STEP):
            if len(self.at) > REMEMBERED:
                self.at, self.table = {}, self.table[:0]
            split = [words_of(t) for t in step]
            fresh = list(set().union(*split).difference(self.at))
            if fresh:
                self.at.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh)), strict=True))
                self.table = np.concatenate([self.table, self.network.inputs(fresh)])
            joined = list(map(self.at.__getitem__, chain.from_iterable(split)))
            doc, index, mask = windows(np.array([len(s) for s in split]))
            table = self.table if len(self.table) else np.zeros((1, 6 * HIDDEN), np.float32)
            rows = np.array(joined or [0])[index]
            best = np.full(len(step), -np.inf)
            np.maximum.at(best, doc, self.network.logits(table, rows, mask))
            out[start : start + len(step)] = sigmoid(best)
        return out


def _gradients(net: Network, chosen: list[list[str]], label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted cross-entropy of a batch of windows, each a list of words."""
    p = net.p
    vocabulary: dict[str, int] = {}
    index = np.zeros((WINDOW, len(chosen)), np.int64)
    mask = np.zeros((WINDOW, len(chosen)), bool)
    for w, words in enumerate(chosen):
        index[: len(words), w] = [vocabulary.setdefault(x, len(vocabulary)) for x in words]
        mask[: len(words), w] = True
    x, word, buckets, share = net.vectors(list(vocabulary) or [""])
    g = {}
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([net.read((x @ p[f"in_{d}"] + p[f"bias_{d}"])[index], mask, d, kept[d]) for d in "fb"], 2)
    logit, attention, pooled, hidden = net.pool(states, mask)
    d_logit = ((sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
    g["out"], g["out_b"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
    d_pooled = d_logit[:, None] * p["out"]
    d_states = attention[:, :, None] * d_pooled
    d_attention = np.einsum("wh,twh->tw", d_pooled, states)
    d_score = attention * (d_attention - (attention * d_attention).sum(0))
    g["attend_v"] = np.einsum("tw,twa->a", d_score, hidden)
    d_hidden = d_score[:, :, None] * p["attend_v"] * (1 - hidden**2)
    g["attend"] = np.einsum("twh,twa->ha", states, d_hidden)
    d_states = d_states + d_hidden @ p["attend"].T
    d_x = np.zeros_like(x)
    for k, d in enumerate("fb"):
        u = p[f"state_{d}"]
        d_gates = np.zeros((WINDOW, len(chosen), 3 * HIDDEN), np.float32)
        d_u = np.zeros_like(u)
        d_h = np.zeros((len(chosen), HIDDEN), np.float32)
        for t, h, z, r, n, rec in reversed(kept[d]):
            d_h = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            on = mask[t, :, None]
            d_new = np.where(on, d_h, 0)
            d_n = d_new * (1 - z) * (1 - n**2)
            d_z = d_new * (h - n) * z * (1 - z)
            d_r = d_n * rec * r * (1 - r)
            d_gates[t] = np.concatenate([d_z, d_r, d_n], 1)
            d_rec = np.concatenate([d_z, d_r, d_n * r], 1)
            d_u += h.T @ d_rec
            d_h = np.where(on, d_new * z, d_h) + d_rec @ u.T
        flat = np.zeros((len(x), 3 * HIDDEN), np.float32)
        np.add.at(flat, index[mask], d_gates[mask])
        g[f"state_{d}"], g[f"bias_{d}"], g[f"in_{d}"] = d_u, flat.sum(0), x.T @ flat
        d_x += flat @ p[f"in_{d}"].T
    g["word"] = np.zeros_like(p["word"])
    np.add.at(g["word"], word, d_x[:, :EMBED])
    g["word"][0] = 0
    g["gram"] = np.zeros_like(p["gram"])
    at = np.nonzero(share)
    np.add.at(g["gram"], buckets[at], share[at][:, None].astype(np.float32) * d_x[at[0], EMBED:])
    return g


def fit(texts: Iterable[str], toxic: list[int], clean_weight: float = 1.0, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network from labelled texts, which are gone through once; each clean one counts ``clean_weight`` times."""
    label = np.array(toxic, np.float32)
    positive = int(label.sum())
    if not positive or positive == len(label):
        total = positive + (len(label) - positive) * clean_weight
        return Network({}, constant=(positive + 1) / (total + 10))
    # Words are numbers from here on: the texts of a full sample have millions.
    vocabulary: dict[str, int] = {}
    number = vocabulary.setdefault
    docs = [np.array([number(w, len(vocabulary)) for w in words_of(t)], np.int32) for t in texts]
    words = list(vocabulary) or [""]
    seen, bad = np.zeros(len(words)), np.zeros(len(words))
    for d, y in zip(docs, toxic, strict=True):
        own = np.unique(d)
        seen[own] += 1
        bad[own] += y
    common = sorted(np.flatnonzero(seen > 1).tolist(), key=lambda k: (-seen[k], words[k]))[:VOCABULARY]
    net = Network.begin({words[k]: i for i, k in enumerate(common, 1)}, seed)
    odds = np.log((bad + 0.1) / (positive + 0.2)) - np.log((seen - bad + 0.5) / (len(docs) - positive + 1))
    # The log-odds enter as a first guess, shrunk for words of few texts.
    net.p["word"][1:, 0] = np.clip(odds[common], -3, 3) / 2 * seen[common] / (seen[common] + 5)

    lengths = np.array([len(d) for d in docs])
    doc, index, mask = windows(lengths)
    rows = np.append(np.concatenate(docs), np.int32(0))[index]
    del index
    # A word of one text says nothing of itself; those of several texts pick the first windows.
    guess = (odds * np.clip(seen - 1, 0, 5)).astype(np.float32)
    level = np.concatenate([np.where(mask[i : i + 16384], guess[rows[i : i + 16384]], -np.inf).max(1) for i in range(0, len(rows), 16384)])
    r = np.random.default_rng(seed)
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    starts = np.searchsorted(doc, np.arange(len(docs)))
    counts = np.diff(np.append(starts, len(doc)))
    batch = int(np.clip((len(docs) + (label == 0).sum()) // 16, 16, BATCH))
    each = -(-int(len(docs) + (label == 0).sum()) // batch)
    epochs = max(epochs, -(-LEAST_STEPS // each))
    for epoch in range(epochs):
        if epoch:
            level = net.logits(net.inputs(words), rows, mask)
        order = np.lexsort((-level, doc))
        top = order[starts]
        # Clean texts also show a window at random: not only their most suspicious one is clean.
        clean = np.flatnonzero(label == 0)
        random = starts[clean] + r.integers(0, counts[clean])
        chosen = np.concatenate([top, random])
        weight = np.concatenate([np.where(label == 1, 1, clean_weight), np.full(len(clean), clean_weight * 0.3)]).astype(np.float32)
        chosen_label = np.concatenate([label, np.zeros(len(clean), np.float32)])
        mixed = r.permutation(len(chosen))
        for i in range(0, len(mixed), batch):
            some = mixed[i : i + batch]
            spans = [[words[j] for j in rows[k][mask[k]].tolist()] for k in chosen[some].tolist()]
            g = _gradients(net, spans, chosen_label[some], weight[some])
            step += 1
            rate = RATE * min(1, step / 20) * (1 if epoch < epochs * 2 // 3 else 0.3)
            for k, v in g.items():
                v = v + DECAY * net.p[k] if k in ("gram", "word") else v
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                net.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    """Rows from which no label is learned; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Network:
    """A network from the bounded sample of labelled documents that aren't held out."""
    known = labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("y")).where("l_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("l_id")))
    known = known.groupBy("l_id").agg(F.max("y").alias("y"))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t")).where(F.length("t") <= MOST_CHARS)
    # At most most_toxic + most_clean ids are sent, and as many texts come back; a repeated id's are reduced where they are.
    sample = rows.join(F.broadcast(some[0].union(some[1])), F.col("id") == F.col("l_id"))
    sample = sample.groupBy("l_id").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("m"), F.first("y").alias("y")).select("l_id", "m.t", "y").collect()
    sample.sort(key=lambda r: r.l_id, reverse=True)
    label = [r.y for r in reversed(sample)]
    toxic = sum(label)
    clean = len(sample) - toxic
    ratio = (totals.get(0, 0) / clean) / (totals.get(1, 0) / toxic) if clean and toxic else 1.0
    # Each text is let go once it has been read.
    return fit((sample.pop().t for _ in range(len(sample))), label, ratio)


def score(docs: DataFrame, network: Network, text_col: str = "text") -> Column:
    """A column of ``docs``: the score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((network.words, network.p, network.constant))
    tuned(docs.sparkSession)
    name = uuid.uuid4().hex

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        held = worker_memory(f"toxicity {name}")
        if "scorer" not in held:
            held["scorer"] = Scorer(Network(*sent.value))
        return pd.Series(held["scorer"]([t or "" for t in texts]))

    return scored(F.col(f"`{text_col}`").cast("string"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(docs, train(docs, labels)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
