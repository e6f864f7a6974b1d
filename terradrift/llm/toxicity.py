"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as its own hashed embedding beside the mean of its character-trigram embeddings. A text is read in
overlapping windows; the network scores each window and the text takes its worst one. Training knows labels of whole
documents only, so a toxic document is represented by its currently worst window, a clean one by its worst and a random one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from terradrift.llm.common import one_label, released, single_threaded, text_or_empty
from terradrift.session import save_table

WINDOW, STRIDE = 64, 52
WORDS, TRIGRAMS, WIDTH, HIDDEN = 32768, 4096, 8, 8
_EDGE = ".,;:!?\"'()[]{}«»-"
_KNOWN_WORDS = 200_000  # entries of a task's word cache before it starts anew


def split_words(text: str) -> list[str]:
    return [w.strip(_EDGE) for w in text.lower().split()]


def word_inputs(word: str) -> tuple[int, list[int]]:
    """Bucket of the word and buckets of its character trigrams; bucket 0 is kept for padding."""
    raw = f"^{word}$".encode()
    grams = [1 + zlib.crc32(raw[i : i + 3]) % (TRIGRAMS - 1) for i in range(len(raw) - 2)] or [0]
    return 1 + zlib.crc32(raw) % (WORDS - 1), grams


class Vocabulary:
    """Numbers words as they come and keeps their buckets. Number 0 is padding.

    Words outside the buckets ``known``, if given, have the word bucket 0 and speak through their trigrams alone.
    """

    def __init__(self, known: np.ndarray | None = None) -> None:
        self.known = known
        self.number: dict[str, int] = {"": 0}
        self.word, self.grams = [0], [[0]]

    def __call__(self, words: list[str]) -> list[int]:
        number = self.number
        out = []
        for w in words:
            i = number.get(w)
            if i is None:
                i = number[w] = len(self.word)
                a, b = word_inputs(w)
                self.word.append(a if self.known is None or self.known[a] else 0)
                self.grams.append(b)
            out.append(i)
        return out

    def flat(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets, concatenated trigram buckets and trigram counts of some numbers."""
        grams = [self.grams[i] for i in numbers]
        return np.array([self.word[i] for i in numbers]), np.concatenate([np.array(g) for g in grams]), np.array([len(g) for g in grams])


def windows_of(numbers: list[int]) -> np.ndarray:
    """All overlapping windows of a text, the last one padded; at least one, so an empty text has a score."""
    starts = range(0, max(len(numbers) - WINDOW + STRIDE, 1), STRIDE)
    out = np.zeros((len(starts), WINDOW), dtype=np.int64)
    for k, a in enumerate(starts):
        part = numbers[a : a + WINDOW]
        out[k, : len(part)] = part
    return out


class Network(NamedTuple):
    words: np.ndarray  # (WORDS, WIDTH); row 0 stands for words too rare to learn
    grams: np.ndarray  # (TRIGRAMS, WIDTH)
    w: np.ndarray  # (2, 2 * WIDTH, 3 * HIDDEN): update, reset and candidate gates of both directions
    u: np.ndarray  # (2, HIDDEN, 3 * HIDDEN)
    bias: np.ndarray  # (2, 1, 3 * HIDDEN)
    attend: np.ndarray  # (2 * HIDDEN,)
    out: np.ndarray  # (2 * HIDDEN,)
    out_bias: np.ndarray  # (1,)


def new_network(seed: int) -> Network:
    rng = np.random.default_rng(seed)

    def normal(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    return Network(
        normal(WORDS, WIDTH, scale=0.1), normal(TRIGRAMS, WIDTH, scale=0.1), normal(2, 2 * WIDTH, 3 * HIDDEN, scale=0.4),
        normal(2, HIDDEN, 3 * HIDDEN, scale=0.3), np.zeros((2, 1, 3 * HIDDEN), np.float32), normal(2 * HIDDEN, scale=0.3),
        normal(2 * HIDDEN, scale=0.3), np.zeros(1, np.float32))


def _embedded(net: Network, word: np.ndarray, grams: np.ndarray, count: np.ndarray) -> np.ndarray:
    starts = np.concatenate([[0], np.cumsum(count)[:-1]])
    return np.hstack([net.words[word], np.add.reduceat(net.grams[grams], starts, axis=0) / count[:, None].astype(np.float32)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def input_gates(net: Network, table: np.ndarray) -> np.ndarray:
    """Inputs of all gates in both directions, ``(2, words, 3 * HIDDEN)``, for input vectors ``table``."""
    return np.stack([table @ net.w[0], table @ net.w[1]]) + net.bias


def forward(net: Network, gates: np.ndarray, idx: np.ndarray, pad: np.ndarray, keep: bool = False):
    """Logits of windows ``idx`` (rows of ``gates``); ``pad`` marks filler words, which change no state."""
    n, steps = idx.shape
    h = np.zeros((2, n, HIDDEN), np.float32)
    states = np.empty((steps, n, 2 * HIDDEN), np.float32)
    live = (~pad).astype(np.float32)
    saved = []
    for t in range(steps):
        back = steps - 1 - t
        x = np.stack([gates[0][idx[:, t]], gates[1][idx[:, back]]])
        on = np.stack([live[:, t], live[:, back]])[:, :, None]
        hu = h @ net.u
        zr = _sigmoid(x[:, :, : 2 * HIDDEN] + hu[:, :, : 2 * HIDDEN])
        z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
        cand = np.tanh(x[:, :, 2 * HIDDEN :] + r * hu[:, :, 2 * HIDDEN :])
        step = on * (1 - z)
        if keep:
            saved.append((h, z, r, cand, hu[:, :, 2 * HIDDEN :], on))
        h = h + step * (cand - h)
        states[t, :, :HIDDEN], states[back, :, HIDDEN:] = h[0], h[1]
    score = states @ net.attend
    score = np.where(pad.T, np.float32(-1e9), score)
    weight = np.exp(score - score.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    logit = pooled @ net.out + net.out_bias[0]
    return (logit, states, weight, pooled, saved) if keep else logit


def gradients(net: Network, flat: tuple, idx: np.ndarray, pad: np.ndarray, y: np.ndarray) -> tuple[float, Network]:
    """Mean cross-entropy of windows and its gradient, by hand through attention, both recurrences and the embeddings."""
    word, grams, count = flat
    table = _embedded(net, word, grams, count)
    logit, states, weight, pooled, saved = forward(net, input_gates(net, table), idx, pad, keep=True)
    n, steps = idx.shape
    p = _sigmoid(logit)
    loss = float(-np.mean(np.where(y > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7))))
    d_logit = ((p - y) / n).astype(np.float32)
    d_out, d_bias_out = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
    d_pooled = d_logit[:, None] * net.out
    d_states = weight[:, :, None] * d_pooled
    d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    d_attend = np.einsum("tb,tbh->h", d_score, states)
    d_states += d_score[:, :, None] * net.attend
    d_u, d_w = np.zeros_like(net.u), np.zeros_like(net.w)
    d_bias, d_table = np.zeros_like(net.bias), np.zeros_like(table)
    d_h = np.zeros((2, n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        back = steps - 1 - t
        h, z, r, cand, hn, on = saved[t]
        d_new = d_h + np.stack([d_states[t, :, :HIDDEN], d_states[back, :, HIDDEN:]])
        d_cand = d_new * on * (1 - z) * (1 - cand**2)
        d_z = d_new * on * (h - cand) * z * (1 - z)
        d_r = d_cand * hn * r * (1 - r)
        d_gate = np.concatenate([d_z, d_r, d_cand], axis=2)  # of the inputs
        d_hu = np.concatenate([d_z, d_r, d_cand * r], axis=2)
        d_h = d_new * (1 - on * (1 - z)) + d_hu @ net.u.transpose(0, 2, 1)
        d_u += h.transpose(0, 2, 1) @ d_hu
        d_bias += d_gate.sum(1, keepdims=True)
        for k, at in ((0, t), (1, back)):
            x = table[idx[:, at]]
            d_w[k] += x.T @ d_gate[k]
            np.add.at(d_table, idx[:, at], d_gate[k] @ net.w[k].T)
    d_words, d_grams = np.zeros_like(net.words), np.zeros_like(net.grams)
    np.add.at(d_words, word, d_table[:, :WIDTH])
    np.add.at(d_grams, grams, np.repeat(d_table[:, WIDTH:] / count[:, None], count, axis=0))
    return loss, Network(d_words, d_grams, d_w, d_u, d_bias, d_attend, d_out, d_bias_out)


class _Adam:
    def __init__(self, net: Network, rate: float, decay: float = 0.1):
        self.rate, self.decay, self.t = rate, decay, 0
        self.m = [np.zeros_like(p) for p in net]
        self.v = [np.zeros_like(p) for p in net]

    def step(self, net: Network, grad: Network) -> None:
        self.t += 1
        size = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, g, m, v in zip(net, grad, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p *= 1 - self.rate * self.decay
            p -= (size * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


class Scorer:
    """A network with the gate inputs of all words met so far, so that each word is embedded once."""

    def __init__(self, net: Network, vocabulary: Vocabulary):
        self.net, self.vocabulary, self.ready = net, vocabulary, 0
        self.gates = np.zeros((2, 1024, 3 * HIDDEN), np.float32)

    def _embed_new(self) -> None:
        size = len(self.vocabulary.word)
        if size > self.gates.shape[1]:
            grown = np.zeros((2, 2 * size, 3 * HIDDEN), np.float32)
            grown[:, : self.ready] = self.gates[:, : self.ready]
            self.gates = grown
        for a in range(self.ready, size, 4096):
            new = range(a, min(a + 4096, size))
            self.gates[:, new.start : new.stop] = input_gates(self.net, _embedded(self.net, *self.vocabulary.flat(new)))
        self.ready = size

    def logits(self, windows: np.ndarray, batch: int = 1024) -> np.ndarray:
        """Logits of any number of windows of word numbers."""
        self._embed_new()
        return np.concatenate([forward(self.net, self.gates, windows[a : a + batch], windows[a : a + batch] == 0) for a in range(0, len(windows), batch)])


def train(texts: list[str], labels: np.ndarray, epochs: int = 14, batch: int = 128, rate: float = 0.01, seed: int = 5,
          min_docs: int = 4) -> tuple[Network, np.ndarray, float]:
    """Network, known word buckets and decision offset from labelled documents; deterministic for given inputs.

    A word counts as known if ``min_docs`` training documents have it: rarer ones would only be learnt by heart.
    """
    rng, net = np.random.default_rng(seed), new_network(seed)
    words = [split_words(t) for t in texts]
    docs_with = np.zeros(WORDS, dtype=np.int64)
    for w in words:
        np.add.at(docs_with, list({word_inputs(x)[0] for x in set(w)}), 1)
    known = docs_with >= min_docs
    vocabulary = Vocabulary(known)
    each = [windows_of(vocabulary(w)) for w in words]
    owner = np.repeat(np.arange(len(each)), [len(w) for w in each])
    windows, first = np.concatenate(each), np.concatenate([[0], np.cumsum([len(w) for w in each])[:-1]])
    count = np.array([len(w) for w in each])
    adam = _Adam(net, rate)
    worst = first + rng.integers(0, count)
    for epoch in range(epochs):
        if epoch < 6:  # before the network can point at a window, short documents teach most
            chosen = np.flatnonzero((count <= 3)[owner] | ~labels.astype(bool)[owner] & (rng.random(len(owner)) < 0.1))
        else:
            if epoch % 3 == 0:
                logit = Scorer(net, vocabulary).logits(windows)
                order = np.lexsort((logit, owner))
                worst = order[first + count - 1]
            clean = np.flatnonzero(labels == 0)
            chosen = np.concatenate([worst, (first + rng.integers(0, count))[clean]])
        chosen = rng.permutation(chosen)
        for a in range(0, len(chosen), batch):
            part = windows[chosen[a : a + batch]]
            numbers, idx = np.unique(part, return_inverse=True)
            word, grams, of_word = vocabulary.flat(numbers)
            word = np.where(rng.random(len(word)) < 0.15, 0, word)  # some words must be told by their letters
            _, grad = gradients(net, (word, grams, of_word), idx.reshape(part.shape), part == 0, labels[owner[chosen[a : a + batch]]].astype(np.float32))
            adam.step(net, grad)
    top = np.maximum.reduceat(Scorer(net, vocabulary).logits(windows), first)
    cuts = np.unique(np.concatenate([top, [0.0]]))
    cuts = np.concatenate([(cuts[1:] + cuts[:-1]) / 2, [0.0]]) if len(cuts) > 1 else np.zeros(1)
    right = [((top[labels == 1] >= c).mean() + (top[labels == 0] < c).mean(), -abs(c), c) for c in cuts]
    return net, known, float(max(right)[2])


class Model(NamedTuple):
    net: Network | None
    known: np.ndarray | None
    offset: float
    constant: float

    def scorer(self) -> Scorer | None:
        return None if self.net is None else Scorer(self.net, Vocabulary(self.known))

    def scores(self, texts: list[str], scorer: Scorer | None) -> np.ndarray:
        """Score of each whole text: its worst window."""
        if scorer is None:
            return np.full(len(texts), self.constant)
        each = [windows_of(scorer.vocabulary(split_words(t))) for t in texts]
        first = np.concatenate([[0], np.cumsum([len(w) for w in each])[:-1]])
        logit = scorer.logits(np.concatenate(each)).astype(np.float64)
        return _sigmoid(np.maximum.reduceat(logit, first) - self.offset)


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, key: str = "doc_id", text: str = "text",
        max_per_class: int = 800, seed: int = 5) -> Model:
    """Train on at most ``max_per_class`` documents of each label for which ``learn`` (over ``doc_id``) holds.

    The bound keeps the training set, whole texts of those with the smallest seeded hashes, in the driver's memory.
    With labels of one kind only, every text scores that kind's value; without any label, 0.
    """
    known = one_label(labels, label, key).filter(learn).withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy("h", "doc_id").limit(max_per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked = save_table(picked.select("doc_id", "y", "h"), "toxic-sample")
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("body")).join(F.broadcast(picked), "doc_id")
    sample = rows.groupBy("doc_id").agg(F.min("body").alias("body"), F.first("y").alias("y"), F.first("h").alias("h")).toPandas()
    sample = sample.sort_values(["h", "doc_id"])
    y = sample["y"].to_numpy(dtype=int)
    if not len(y) or y.min() == y.max():
        return Model(None, None, 0.0, float(y[0]) if len(y) else 0.0)
    return Model(*train(sample["body"].tolist(), y, seed=seed), 0.0)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)``: one row per row of ``docs``, all windows of whole texts, no shuffle.

    Null and empty texts are one window of filler and get its score. Null keys and repeated rows are kept; other columns
    are not read.
    """
    rows = docs.select(text_or_empty(text).alias("body"), F.col(key).alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        scorer = model.scorer()
        for batch in released(batches):
            scores = []
            for at in range(0, batch.num_rows, 128):
                if scorer is not None and len(scorer.vocabulary.word) > _KNOWN_WORDS:
                    scorer = model.scorer()
                scores.append(model.scores(batch.column(0).slice(at, 128).to_pylist(), scorer))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.concatenate(scores), pa.float64())], names=["doc_id", "score"])

    out = rows.mapInArrow(run, StructType([rows.schema["doc_id"], StructField("score", DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
