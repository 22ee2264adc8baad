"""Vectorised word and n-gram hashing over UTF-8 buffers.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``. A word's hash is a
polynomial over a fixed random byte table modulo 2**64 followed by a finaliser,
so equal words hash alike wherever they stand. Collisions of 64-bit hashes are
the only approximation (about n*n / 2**65 for n distinct items in one document).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SEGMENT = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_MIXERS = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_WORD = (~SPACE).astype(np.int8)

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i in 0..n; kept up to one segment."""
    if len(_tables.get("p", ())) <= n:
        size = max(n, SEGMENT) + 1
        made = []
        for base in (_P, _P_INV):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            made.append(np.cumprod(a, dtype=np.uint64))
        if size > SEGMENT + 1:
            return made[0], made[1]
        _tables["p"], _tables["i"] = made
    return _tables["p"], _tables["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hashed(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Hashes of spans of a byte buffer: equal spans hash alike wherever they stand."""
    power, inverse = _powers(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(table[b] * power[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def _one_segment(b: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = _WORD[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    return starts, ends, spans_hashed(b, starts, ends, table)


def words_of(buf: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a byte buffer.

    Long buffers go through in segments cut at white space, so scratch memory
    stays bounded by one segment (or one longer word). ``fold``: A-Z count as a-z.
    """
    table = _FOLDED if fold else _BYTE
    if len(buf) <= SEGMENT:
        return _one_segment(buf, table)
    found, at = [], 0
    while at < len(buf):
        end = min(at + SEGMENT, len(buf))
        while end < len(buf) and not SPACE[buf[end]]:
            gaps = np.flatnonzero(SPACE[buf[end : end + SEGMENT]])
            end = end + int(gaps[0]) if len(gaps) else min(end + SEGMENT, len(buf))
        s, e, h = _one_segment(buf[at:end], table)
        found.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def batches(texts: Sequence[bytes | None], most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts joined by a newline: (index of the first, buffer, offsets).

    Text k of a batch is ``buf[offsets[k] : offsets[k + 1] - 1]``; null is empty.
    """
    at = 0
    while at < len(texts):
        part, size, end = [], 0, at
        while end < len(texts) and (end == at or size + len(texts[end] or b"") < most):
            part.append(texts[end] or b"")
            size += len(part[-1]) + 1
            end += 1
        buf = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        offsets = np.zeros(len(part) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in part], out=offsets[1:])
        yield at, buf, offsets
        at = end


def word_bounds(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of each text's first word, and their number at the end."""
    return np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every k-word window that lies inside one text."""
    n = len(hashes) - k + 1
    counts = np.diff(bounds)
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = hashes[:n] * _MIXERS[0]
    for j in range(1, k):
        acc += hashes[j : j + n] * _MIXERS[j % 16]
    owner = np.repeat(np.arange(len(counts)), counts)[:n]
    whole = np.arange(n) + k <= bounds[owner + 1]
    return mix(acc[whole]), owner[whole]


def shingle_sets(texts: Sequence[bytes | None], k: int, fold: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text, in order.

    Texts of 1..k-1 words have their whole sequence as one shingle; texts
    without a word (or null) have none.
    """
    for _, buf, offsets in batches(texts):
        starts, _, hashes = words_of(buf, fold)
        bounds = word_bounds(starts, offsets)
        shingles, owner = windows(hashes, bounds, k)
        cuts = np.searchsorted(owner, np.arange(len(bounds)))
        for i in range(len(bounds) - 1):
            n = bounds[i + 1] - bounds[i]
            if n >= k:
                yield np.unique(shingles[cuts[i] : cuts[i + 1]])
            elif n:
                own = hashes[bounds[i] : bounds[i + 1]]
                total = np.array([n], np.uint64)
                for j in range(n):
                    total = total * _MIXERS[15] + own[j]
                yield mix(total)
            else:
                yield np.zeros(0, np.uint64)


def utf8_list(column) -> list[bytes | None]:
    """An Arrow string column's values as bytes."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
