"""Language identification with string kernels.

A text's features are which n-grams (n = 1, 2, 3, blended) of its letters and
word gaps it has; the kernel of two texts is the number they share, normalised.
Landmark texts span the Nyström approximation, one ridge regression a language
against the rest is solved on a bounded labelled sample, and new texts are
scored in batches: (presence x landmarks) x weights. Long texts go through in
pieces of PIECE letters and gaps, whose scores are averaged, so that presence
does not saturate. Letters beyond a-z share 37 codes by a hash of the code point,
so scripts of many letters are told apart by which of those occur together.

Defined results: null texts and texts without a letter are ``und`` with score
0; repeated rows are predicted alike; clashing columns lang_pred and score are
replaced, others kept; an empty table gives an empty result; without a usable
sample every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import labelled_sample, need, with_text_columns

PIECE = 4000
SPACE_OF_CODES = 64 + 64**2 + 64**3

_letters: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """For each code point: 0 if not a letter, 1..26 for a-z in either case, else 27..63 by a hash."""
    if not _letters:
        out = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                out[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 % (1 << 32) >> 7) % 37
        _letters.append(out)
    return _letters[0]


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """Numbers of the 1-, 2- and 3-grams of a sequence of letter codes."""
    c = codes.astype(np.int32)
    two = c[:-1] * 64 + c[1:]
    return [c, 64 + two, 64 + 64**2 + two[:-1] * 64 + c[2:]]


def coded(text: bytes | None) -> np.ndarray:
    """Letter codes of a text; runs of other characters are one gap; empty if it has no letter."""
    if not text:
        return np.zeros(0, np.uint8)
    c = letter_codes()[np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    keep = c > 0
    if not keep.any():
        return np.zeros(0, np.uint8)
    keep[1:] |= c[:-1] > 0
    c = c[keep]
    return np.concatenate(([0], c, [0])).astype(np.uint8)


def pieces(codes: np.ndarray) -> list[np.ndarray]:
    """Cuts that cover the whole sequence, about PIECE each."""
    n = max(1, round(len(codes) / PIECE))
    edges = np.linspace(0, len(codes), n + 1).astype(int)
    return [codes[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def spread(texts: list[list[np.ndarray]], most: int) -> list[np.ndarray]:
    """At most ``most`` pieces: one of each text, at changing places, before a second one of any."""
    rounds = max(map(len, texts), default=0)
    return [own[(i + k) % len(own)] for k in range(rounds) for i, own in enumerate(texts) if k < len(own)][:most]


@dataclass
class LanguageModel:
    languages: list[str]
    column: np.ndarray  # of a gram's number; 0 for those that no landmark has
    landmarks: np.ndarray  # presence, columns x landmarks, normalised
    weights: np.ndarray  # landmarks x languages

    def kernel(self, parts: list[np.ndarray]) -> np.ndarray:
        """Normalised kernel between pieces and landmarks."""
        width = len(self.landmarks)
        out = np.zeros((len(parts), self.landmarks.shape[1]), np.float32)
        for at in range(0, len(parts), 64):
            some = parts[at : at + 64]
            has = np.zeros(len(some) * width, np.float32)
            for i, codes in enumerate(some):
                for g in grams(codes):
                    has[i * width + self.column[g]] = 1
            has = has.reshape(len(some), width)
            has[:, 0] = 0
            norm = np.sqrt(has.sum(1, keepdims=True)).clip(1)
            out[at : at + len(some)] = (has @ self.landmarks) / norm
        return out

    def predict(self, texts: Sequence[bytes | None]) -> list:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return [names, scores]
        for at in range(0, len(texts), 128):
            parts, owner, lengths = [], [], []
            for i, text in enumerate(texts[at : at + 128]):
                if len(codes := coded(text)):
                    for p in pieces(codes):
                        parts.append(p), owner.append(i), lengths.append(len(p))
            if not parts:
                continue
            value = self.kernel(parts) @ self.weights * np.array(lengths)[:, None]
            own, first = np.unique(owner, return_index=True)
            value = np.add.reduceat(value, first, axis=0) / np.add.reduceat(np.array(lengths), first)[:, None]
            chance = np.exp(8 * (value - value.max(1, keepdims=True)))
            best = value.argmax(1)
            scores[at + own] = 1 / chance.sum(1)
            for i, b in zip(own, best, strict=True):
                names[at + i] = self.languages[b]
        return [names, scores]

    __call__ = predict


def fit_language_id(docs: DataFrame, most: int = 3000, landmarks: int = 160, longest: int = 100_000, ridge: float = 1e-3) -> LanguageModel:
    """A model of docs.lang from at most ``most`` labelled texts of at most ``longest`` characters.

    Rows to hold out must be taken from docs before. All pieces of a text are
    learned, each with its share of the text's length as weight. Landmarks are
    shared evenly among the languages of the sample and drawn from all places in
    the texts.
    """
    need(docs, "doc_id", "text", "lang")
    rows = [(coded(r["text"].encode()), r["lang"]) for r in labelled_sample(docs, most, longest, "lang")]
    texts = [(pieces(c), y) for c, y in rows if len(c)]
    languages = sorted({y for _, y in texts})
    if not languages:
        return LanguageModel([], np.zeros(0, np.int32), np.zeros((1, 1), np.float32), np.zeros((1, 1)))
    each = max(1, landmarks // len(languages))
    marks = [c for lang in languages for c in spread([own for own, y in texts if y == lang], each)]
    known = np.unique(np.concatenate([g for c in marks for g in grams(c)]))
    column = np.zeros(SPACE_OF_CODES, np.int32)
    column[known] = 1 + np.arange(len(known))
    has = np.zeros((1 + len(known), len(marks)), np.float32)
    for i, c in enumerate(marks):
        for g in grams(c):
            has[column[g], i] = 1
    has /= np.sqrt(has.sum(0, keepdims=True)).clip(1)
    model = LanguageModel(languages, column, has, np.zeros((len(marks), len(languages))))
    # Nyström features: K(x, landmarks) times the inverse root of K(landmarks, landmarks).
    among = (has.T @ has).astype(float)
    value, vector = np.linalg.eigh(among)
    root = vector / np.sqrt(np.maximum(value, 1e-6))
    phi = model.kernel([c for own, _ in texts for c in own]).astype(float) @ root
    y = np.array([[1.0 if lang == l else 0.0 for l in languages] for own, lang in texts for _ in own])  # noqa: E741
    share = np.array([len(c) / sum(map(len, own)) for own, _ in texts for c in own])[:, None]
    model.weights = root @ np.linalg.solve(phi.T @ (share * phi) + ridge * len(texts) * np.eye(phi.shape[1]), phi.T @ (share * y))
    return model


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs (doc_id, text and any others) with lang_pred and score (0 to 1) of each row."""
    return with_text_columns(docs, "lang_pred string, score double", model)
