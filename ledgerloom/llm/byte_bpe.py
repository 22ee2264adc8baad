"""Byte-level BPE ids of many texts at once.

Texts are cut into the pre-tokenizer's pieces by comparing character classes in
whole arrays; each different piece of a batch is encoded once, and the ids of
all pieces are gathered. No regular expression runs over the text, so neither
long runs of white space nor very long words cost more than others.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np

from ledgerloom.llm import textkernel as K

#: The pattern whose pieces these are (a fixed value).
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a batch, and different pieces remembered, at most (about).
BATCH, REMEMBERED = 1 << 20, 2_000_000
SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
#: Code points of the Unicode property White_Space (a fixed value).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_classes: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """The class of each code point; UNSURE where this Unicode version assigns none."""
    if not _classes:
        kinds = {"L": LETTER, "N": NUMBER}
        out = np.fromiter((UNSURE if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        out[WHITE] = SPACE
        _classes.append(out)
    return _classes[0]


def piece_starts(code: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin. code, kind: code points and their classes of texts in a row; first: where (non-empty) texts begin."""
    n = len(code)
    begins = np.zeros(n + 1, bool)
    begins[1:n] = kind[1:] != kind[:-1]
    begins[first] = True
    begins[n] = True
    new_text = np.zeros(n + 1, bool)
    new_text[first] = True
    new_text[n] = True
    run = np.flatnonzero(begins)
    at, end = run[:-1], run[1:]
    # White space before something else: its last character is on its own, and a blank belongs to what follows.
    white = (kind[at] == SPACE) & ~new_text[end]
    begins[end[white] - 1] = True
    begins[end[white & (code[end - 1] == 32)]] = False
    # An apostrophe that begins a piece takes s, t, m, d, re, ve or ll after it.
    quote = at[(end - at == 1) & (code[at] == 39) & begins[at] & ~new_text[end]]
    quote = quote[kind[quote + 1] == LETTER]
    one = np.isin(code[quote + 1], [ord(c) for c in "stmd"])
    two = np.zeros(len(quote), bool)
    wide = np.flatnonzero((quote + 2 < n) & ~new_text[np.minimum(quote + 2, n)])
    for a, b in ("re", "ve", "ll"):
        two[wide] |= (code[quote[wide] + 1] == ord(a)) & (code[quote[wide] + 2] == ord(b))
    begins[quote[one | two] + 1] = False
    begins[quote[one] + 2] = True
    begins[quote[two] + 3] = True
    return np.flatnonzero(begins[:n])


def chunks(text: str, most: int = BATCH) -> Iterator[str]:
    """Parts of a long text, cut before single blanks between other characters, where pieces begin."""
    at, cut = 0, re.compile(r"(?<=\w) (?=\w)")
    while len(text) - at > most and (m := cut.search(text, at + most)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class ByteBpe:
    """ids of texts, by a function that gives the ids of one piece's bytes."""

    def __init__(self, encode_piece):
        self.encode_piece = encode_piece
        self._forget()

    def _forget(self) -> None:
        # of the pieces known: hashes in order, where their ids begin in ``flat``, how many there are
        self.keys, self.offset, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.keys) > REMEMBERED:
            self._forget()
        made = list(map(self.encode_piece, pieces))
        count = np.fromiter(map(len, made), np.int64, len(made))
        offset = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(made), np.uint32, int(count.sum()))])
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")
        self.keys, self.offset, self.count = both[order], np.concatenate([self.offset, offset])[order], np.concatenate([self.count, count])[order]

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash would be among the keys, and whether it is there."""
        spot = np.searchsorted(self.keys, key)
        return spot, self.keys[np.minimum(spot, len(self.keys) - 1)] == key if len(self.keys) else np.zeros(len(key), bool)

    def _ids(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        lengths = np.array([len(t) for t in texts])
        whole = "".join(texts)
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(whole.encode(), np.uint8)
        ends = np.cumsum(lengths)
        first = (ends - lengths)[lengths > 0]
        starts = piece_starts(code, character_classes()[code], first)
        if len(data) > len(code):
            wide = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
            bytes_before = np.concatenate(([0], np.cumsum(wide, dtype=np.int64)))
        else:
            bytes_before = np.arange(len(code) + 1)
        edges = bytes_before[np.append(starts, len(code))]
        hashes = K.spans_hashed(data, edges[:-1], edges[1:])
        key, at, own = np.unique(hashes, return_index=True, return_inverse=True)
        spot, there = self._find(key)
        if not there.all():
            raw = data.tobytes()
            if len(self.keys) > REMEMBERED:
                there[:] = False
            new = np.flatnonzero(~there)
            self._learn(key[new], [raw[a:b] for a, b in zip(edges[at[new]].tolist(), edges[at[new] + 1].tolist(), strict=True)])
            spot, _ = self._find(key)
        n, offset = self.count[spot][own], self.offset[spot][own]
        before = np.cumsum(n) - n
        total = int(n.sum())
        ids = self.flat[np.repeat(offset - before, n) + np.arange(total)]
        upto = np.append(before, total)[np.searchsorted(starts, np.concatenate(([0], ends)))]
        return ids, np.diff(upto)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            ids, counts = self._ids([t for _, t in held])
            for (i, _), own in zip(held, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                out[i].append(own)
            held.clear()

        for i, text in enumerate(texts):
            for part in chunks(text):
                held.append((i, part))
                size += len(part)
                if size >= BATCH:
                    flush()
                    size = 0
        if held:
            flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def sure(text: str) -> bool:
    """Whether the classes of all its characters are known."""
    return text.isascii() or not (character_classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == UNSURE).any()
