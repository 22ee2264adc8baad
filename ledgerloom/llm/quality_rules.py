"""Quality rules: gradient-boosted trees over document statistics.

Trees are fitted on the driver from a bounded labelled sample of statistics
(never of texts), flattened into node arrays and evaluated batch-wise with
numpy. Features named in MONOTONE may only lower the verdict as they grow.

Defined results: null and empty texts count 0 everywhere and fail the base
rules; repeated rows are scored alike; extra columns of the input are ignored;
an empty table gives an empty result; without usable labels the trees are
constant and only the base rules decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textkernel as K
from ledgerloom.llm.common import need, sampled_ids, small_batches

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "exclaims", "digits", "pipes", "punctuation", "distinct", "lines"]
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "pipes": -1, "exclaims": -1}

SYMBOLS = b"#*$%&|<>"
_is = lambda chars: np.isin(np.arange(256), list(chars)).astype(np.int8)
_KINDS = {
    "symbols": _is(SYMBOLS),
    "chars": ((~K.SPACE) & ((np.arange(256) & 0xC0) != 0x80)).astype(np.int8),
    "capitals": _is(range(65, 91)),
    "exclaims": _is(b"!?"),
    "digits": _is(range(48, 58)),
    "pipes": _is(b"|"),
    "punctuation": _is(b".,;:"),
    "newlines": _is(b"\n"),
}
_BLANK = b" \t\n\r\x0b\x0c"


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines)), len(lines)


def statistics(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (n, 5: COUNTS) and features (n, len(FEATURES)) of whole texts."""
    counts = np.zeros((len(texts), len(COUNTS)), np.int64)
    feats = np.zeros((len(texts), len(FEATURES)))
    for at, buf, offsets in K.batches(texts):
        n = len(offsets) - 1
        starts, _, hashes = K.words_of(buf)
        bounds = K.word_bounds(starts, offsets)
        words = np.diff(bounds)
        per = {k: np.add.reduceat(v[buf], offsets[:-1], dtype=np.int64) for k, v in _KINDS.items()}
        # Positions covered by a three-word window that the text has twice or more.
        win, owner = K.windows(hashes, bounds, 3)
        keys = K.mix(win ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        lost = np.minimum(words, 2)  # words of a text at which no window begins
        first = np.arange(len(win)) + (np.cumsum(lost) - lost)[owner]
        covered = np.zeros(len(hashes) + 3, bool)
        for j in range(3):
            covered[first[twice] + j] = True
        cum = np.concatenate(([0], np.cumsum(covered[: len(hashes)])))
        repeats = cum[bounds[1:]] - cum[bounds[:-1]]
        own = np.repeat(np.arange(n), words)
        kinds = np.unique(K.mix(hashes ^ (own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), return_index=True)[1]
        distinct = np.bincount(own[kinds], minlength=n)
        dup = np.array([duplicate_lines(t or b"") for t in texts[at : at + n]], np.int64).reshape(n, 2)
        counts[at : at + n] = np.stack([words, per["chars"], per["symbols"], dup[:, 0], repeats], 1)
        w, c = np.maximum(words, 1), np.maximum(per["chars"], 1)
        feats[at : at + n] = np.stack(
            [np.log1p(words), c / w, per["symbols"] / w, dup[:, 0] / np.maximum(dup[:, 1], 1), repeats / w]
            + [per["capitals"] / c, per["exclaims"] / w, per["digits"] / c, per["pipes"] / w, per["punctuation"] / w]
            + [distinct / w, dup[:, 1] / w],
            1,
        )
    return counts, feats


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Fewer than 50 words, or over half of the words in repeated three-word windows."""
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


@dataclass
class Trees:
    """Full binary trees of one depth, flattened: node i has children 2i+1 and 2i+2."""

    depth: int
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    base: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches, plus the base."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, penalty: float = 1.0, signs: dict[str, int] | None = None) -> Trees:
    """Newton boosting on the logistic loss with binned cuts.

    A cut on a constrained feature must keep the children's values in order, and
    the middle of the two then bounds all that lies below (so no later cut in
    the tree breaks the order).
    """
    signs = MONOTONE if signs is None else signs
    model = Trees(depth)
    if len(y) == 0 or y.min() == y.max():
        model.base = 2.0 if len(y) == 0 or y.min() == 1 else -2.0
        return model
    rate_of_ones = y.mean()
    model.base = math.log(rate_of_ones / (1 - rate_of_ones))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: x <= edges[b]
    sign = np.array([signs.get(f, 0) for f in FEATURES[: x.shape[1]]] + [0] * max(0, x.shape[1] - len(FEATURES)))
    inner, leaves = 2**depth - 1, 2**depth
    margin = np.full(len(y), model.base)
    all_f, all_c, all_l = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int32), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        bound = {0: (-np.inf, np.inf)}
        for i in range(inner):
            low, high = bound[i]
            own = node == i
            gs, hs = g[own], h[own]
            value = lambda a, b, low=low, high=high: np.clip(-a / (b + penalty), low, high)
            gain_of = lambda v, a, b: -(a * v + 0.5 * (b + penalty) * v * v)
            whole = gain_of(value(gs.sum(), hs.sum()), gs.sum(), hs.sum())
            best = (1e-6, 0, np.inf, None)
            for j, e in enumerate(edges):
                if not len(e) or not len(gs):
                    continue
                gl = np.cumsum(np.bincount(binned[own, j], gs, len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[own, j], hs, len(e) + 1))[:-1]
                gr, hr = gs.sum() - gl, hs.sum() - hl
                vl, vr = value(gl, hl), value(gr, hr)
                gain = gain_of(vl, gl, hl) + gain_of(vr, gr, hr) - whole
                gain[(hl < 1) | (hr < 1) | ((vr - vl) * sign[j] < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], j, e[k], (vl[k] + vr[k]) / 2)
            _, feature[i], cut[i], middle = best
            left, right = (low, high), (low, high)
            if middle is not None and sign[feature[i]]:
                left, right = ((low, middle), (middle, high)) if sign[feature[i]] > 0 else ((middle, high), (low, middle))
            bound[2 * i + 1], bound[2 * i + 2] = left, right
            node[own] = 2 * i + 1 + (x[own, feature[i]] > cut[i])
        at = node - inner
        leaf = -np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + penalty)
        leaf = rate * np.array([np.clip(v, *bound[inner + i]) for i, v in enumerate(leaf)])
        margin += leaf[at]
        all_f.append(feature), all_c.append(cut), all_l.append(leaf)
    model.feature, model.cut, model.leaf = np.array(all_f), np.array(all_c), np.array(all_l)
    return model


_STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the COUNTS and the features array of each row of docs (doc_id, text)."""

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            counts, feats = statistics(K.utf8_list(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), *(pa.array(counts[:, j]) for j in range(len(COUNTS))), pa.array(list(feats), pa.list_(pa.float64()))],
                ["doc_id", *COUNTS, "features"],
            )

    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _STATS)


def fit_quality_rules(docs: DataFrame, labels: DataFrame, most: int = 12000, **options) -> Trees:
    """Trees for labels.quality from the statistics of at most ``most`` labelled documents (a fixed choice by hash of the id)."""
    need(labels, "doc_id", "quality")
    ids = sampled_ids(labels, most, "quality").withColumnRenamed("doc_id", "labelled_id")
    own = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id"), "left_semi")
    stats = document_statistics(own).select("doc_id", "features").orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(most)
    marks = dict(ids.select("labelled_id", "quality").collect())
    rows = sorted((r["doc_id"], tuple(r["features"])) for r in stats.collect())
    x = np.array([f for _, f in rows]).reshape(-1, len(FEATURES))
    y = np.array([float(marks[i]) for i, _ in rows])
    return fit_trees(x, y, **options)


def apply_quality_rules(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base statistics, base_failed, score and kept of each row of docs (doc_id, text).

    kept: the base rules hold and the trees' probability is at least ``threshold``.
    """
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            counts, feats = statistics(K.utf8_list(part.column(1)))
            failed, score = base_failed(counts), model.probability(feats)
            columns = [pa.array(counts[:, j]) for j in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), *columns, pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))],
                ["doc_id", *COUNTS, "base_failed", "score", "kept"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
