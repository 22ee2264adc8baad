"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every word has a sparse ternary index vector drawn from its 64-bit hash. The
words of a bounded labelled sample that at least LEAST_TEXTS of its texts have
are its vocabulary: their vectors add the index vectors of the words around
them, over all places in the sample (random indexing); any other word is its
index vector. A word's form (case, first and last characters, length, whether
it just occurred) is a second word beside it, of one of FORMS classes, with
contexts of its own. A document is the means of its words' and its forms'
vectors, side by side, the former as if SHRINK words without a vector were
added, since few words tell little; a tanh layer and a logistic unit score it, and a
temperature fitted on held-back sample rows calibrates the probability.

Defined results: texts without a word (null, empty, white space) score 0;
repeated rows score alike; extra columns are ignored; an empty table gives an
empty result; without both labels in the sample the score is their mean (0.5
without any). Very long texts are pooled whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textkernel as K
from ledgerloom.llm.common import need, sampled_ids, with_text_columns

#: Classes of forms (a hash of a form's traits), texts of the sample that a word of the vocabulary is in at least, and words of the vocabulary at most (those in most texts).
FORMS, LEAST_TEXTS, VOCABULARY = 4096, 3, 30_000
#: Non-zero components of an index vector, and how far around a word its context goes.
NONZERO, REACH = 6, 2
SHRINK = 30

_CLASS = np.full(256, 4, np.uint64)  # other
_CLASS[48:58] = 0
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 3
_MARK = np.where(np.isin(_CLASS, (0, 4)), np.arange(256), 0).astype(np.uint64)


def word_forms(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The form class of each word; recency never looks across texts."""
    n = len(hashes)
    length = np.minimum(ends - starts, 15).astype(np.uint64)
    recent = np.zeros(n, bool)
    inside = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    for lag in range(1, 7):
        if n > lag:
            recent[lag:] |= (hashes[lag:] == hashes[:-lag]) & (inside[lag:] >= lag)
    last, before = buf[ends - 1], buf[np.maximum(ends - 2, starts)]
    form = _CLASS[buf[starts]] + np.uint64(8) * _CLASS[buf[np.minimum(starts + 1, ends - 1)]] + np.uint64(64) * _CLASS[before]
    form = form + np.uint64(512) * length + np.uint64(8192) * recent + np.uint64(16384) * _MARK[last] + np.uint64(1 << 22) * _MARK[before] + np.uint64(1 << 30) * _CLASS[last]
    return (K.mix(form) % np.uint64(FORMS)).astype(np.int64)


def parsed(texts: Sequence[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first index, word hashes, form classes, each text's first word) of batches of texts."""
    for at, buf, offsets in K.batches(texts, 1 << 18):
        starts, ends, hashes = K.words_of(buf)
        bounds = K.word_bounds(starts, offsets)
        yield at, hashes, word_forms(buf, starts, ends, hashes, bounds), bounds


def index_parts(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero components of the index vectors of 64-bit keys, NONZERO each."""
    drawn = K.mix(key[:, None] * np.uint64(NONZERO) + np.arange(NONZERO, dtype=np.uint64) ^ np.uint64(0x51A2C6E3B7D94F08))
    return ((drawn >> np.uint64(1)) % np.uint64(size)).astype(np.int64), 1 - 2 * (drawn & np.uint64(1)).astype(np.float32)


def index_vectors(key: np.ndarray, size: int) -> np.ndarray:
    """The index vectors themselves, at length 1."""
    spots, signs = index_parts(key, size)
    out = np.bincount((np.arange(len(key))[:, None] * size + spots).ravel(), signs.ravel(), len(key) * size).reshape(len(key), size).astype(np.float32)
    return out / np.linalg.norm(out, axis=1, keepdims=True).clip(1)


class Vectors:
    """Vectors of the vocabulary's words (``keys``: their hashes, in order) and of all forms."""

    def __init__(self, keys: np.ndarray, size: int):
        self.keys, self.size = keys, size
        self.words, self.forms = index_vectors(keys, size), index_vectors(np.arange(FORMS, dtype=np.uint64), size)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Which word of the vocabulary each hash is, -1 if none."""
        at = np.searchsorted(self.keys, hashes)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == hashes, at, -1) if len(self.keys) else np.full(len(hashes), -1)

    def learn(self, texts: Sequence[bytes | None]) -> None:
        """Adds the normalised sums of the index vectors around each word and form, over all their places."""
        form_keys = np.arange(FORMS, dtype=np.uint64)
        sums = [np.zeros(len(self.keys) * self.size), np.zeros(FORMS * self.size)]
        for _, hashes, forms, bounds in parsed(texts):
            inside = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))
            for own, keys, total in ((self.place(hashes), hashes, sums[0]), (forms, form_keys[forms], sums[1])):
                spots, signs = index_parts(keys, self.size)
                for lag in range(1, REACH + 1):
                    later = np.flatnonzero(inside >= lag)
                    for word, near in ((later, later - lag), (later - lag, later)):
                        known = own[word] >= 0
                        word, near = word[known], near[known]
                        total += np.bincount((own[word][:, None] * self.size + spots[near]).ravel(), signs[near].ravel(), len(total))
        for vectors, total in zip((self.words, self.forms), sums, strict=True):
            context = total.reshape(vectors.shape)
            vectors += (context / np.linalg.norm(context, axis=1, keepdims=True).clip(1e-9)).astype(np.float32)

    def pooled(self, texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Means of the words' and of the forms' vectors of each text, side by side, and its number of words."""
        out, n = np.zeros((len(texts), 2 * self.size), np.float32), np.zeros(len(texts), np.int64)
        for at, hashes, forms, bounds in parsed(texts):
            count = np.diff(bounds)
            end = at + len(count)
            n[at:end] = count
            some = np.flatnonzero(count)
            if not len(some):
                continue
            kind, of = np.unique(hashes, return_inverse=True)
            place = self.place(kind)
            vectors = index_vectors(kind, self.size)
            vectors[place >= 0] = self.words[place[place >= 0]]
            for column, sums, extra in ((0, vectors[of], SHRINK), (self.size, self.forms[forms], 0)):
                out[at + some, column : column + self.size] = np.add.reduceat(sums, bounds[some], axis=0) / (count[some][:, None] + extra)
        return out, n


def vocabulary(texts: Sequence[bytes | None]) -> np.ndarray:
    """Hashes of the words that at least LEAST_TEXTS of the texts have, at most VOCABULARY of them, in order."""
    found = [K.mix(np.zeros(0, np.uint64))]
    for _, hashes, _, bounds in parsed(texts):
        owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        found.append(h[np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))] if len(h) else h)
    key, texts_with = np.unique(np.concatenate(found), return_counts=True)
    most = np.lexsort((key, -texts_with))[:VOCABULARY]
    return np.sort(key[most[texts_with[most] >= LEAST_TEXTS]])


@dataclass
class QualityModel:
    vectors: Vectors
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        x = (pooled - self.mean) / self.scale
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, texts: Sequence[bytes | None]) -> np.ndarray:
        pooled, words = self.vectors.pooled(texts)
        return np.where(words > 0, 1 / (1 + np.exp(-np.clip(self.logits(pooled) / self.temperature, -30, 30))), 0.0)


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 3000, rate: float = 0.01, decay: float = 3e-3, seed: int = 5) -> tuple:
    """Weights of a tanh layer and a logistic unit by Adam on mini-batches, and the temperature from a fifth held back."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    hold, fit = order[: len(y) // 5], order[len(y) // 5 :]
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        own = rng.choice(fit, min(256, len(fit)))
        a = np.tanh(x[own] @ p[0] + p[1])
        err = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - y[own]) / len(own)
        back = err[:, None] * p[2] * (1 - a * a)
        grads = [x[own].T @ back + decay * p[0], back.sum(0), a.T @ err + decay * p[2], np.array([err.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (1 - t / (steps + 1)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    logit = np.tanh(x[hold] @ p[0] + p[1]) @ p[2] + p[3]

    def loss(temperature: float) -> float:
        z = logit / temperature
        return float(np.mean(np.logaddexp(0, z) - y[hold] * z)) if len(hold) else 0.0

    return *p[:3], float(p[3][0]), min(np.geomspace(0.5, 8, 61), key=lambda c: (loss(c), abs(np.log(c))))


def fit_quality_classifier(docs: DataFrame, labels: DataFrame, most: int = 6000, longest: int = 200_000, size: int = 96) -> QualityModel:
    """A model of labels.quality from at most ``most`` labelled texts of at most ``longest`` characters.

    docs: doc_id, text; labels: doc_id, quality. Rows to hold out must be
    taken from ``labels`` before.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "quality")
    ids = sampled_ids(labels, most, "quality").select(F.col("doc_id").alias("labelled_id"), "quality")
    own = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id"))
    rows = own.where(F.col("text").isNotNull() & (F.length("text") <= longest)).orderBy("doc_id", "text").limit(most).collect()  # of few ids already
    texts, y = [r["text"].encode() for r in rows], np.array([float(r["quality"] > 0) for r in rows])
    del rows
    return fit_model(texts, y, size)


def fit_model(texts: Sequence[bytes], y: np.ndarray, size: int = 96) -> QualityModel:
    """The model of labelled texts."""
    vectors = Vectors(vocabulary(texts), size)
    if len(y) < 10 or y.min() == y.max():
        mean = y.mean() if len(y) else 0.5
        flat = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
        return QualityModel(vectors, np.zeros(2 * size), np.ones(2 * size), np.zeros((2 * size, 1)), np.zeros(1), np.zeros(1), flat, 1.0)
    vectors.learn(texts)
    pooled = vectors.pooled(texts)[0].astype(float)
    mean, scale = pooled.mean(0), pooled.std(0) + 1e-6
    return QualityModel(vectors, mean, scale, *fit_network((pooled - mean) / scale, y))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """docs (doc_id, text and any others) with score and predicted (1 where score >= threshold) of each row."""
    return with_text_columns(docs, "score double, predicted int", _Scorer(model, threshold))


class _Scorer:
    def __init__(self, model: QualityModel, threshold: float):
        self.model, self.threshold = model, threshold

    def __call__(self, texts: Sequence[bytes | None]) -> list:
        score = self.model.score(texts)
        return [score, (score >= self.threshold).astype(np.int32)]
