"""Vertical partitioning of n-gram sets: the global order cut into fragments.

The global order of n-grams is that of their hashes. Two sets whose Jaccard
similarity is at least P/Q differ in at most d = floor((Q-P) * (a+b) / (Q+P))
n-grams (a, b: their sizes). Sizes fall into levels of ratio Q/P; a set takes
part in its own level and the next, so two similar sets always share the level
of the larger one. A level cuts the order into d_max + needed + SPARE
fragments: needed + SPARE of them or more hold no difference, so the two sets
agree in that many whole fragments. At most SPARE of those are empty, unless
both sets have more than SPARE empty fragments; only such sets announce their
empty fragments, too. So two similar sets share ``needed`` announced fragments.
Larger sets' levels have 2 * may_drop fragments more: then each set may disregard any
``may_drop`` of its fragments (those of passages that many texts share), and
similar sets still share as many.

Levels at which sets can't differ at all announce nothing: similar sets of that
size are equal. So candidates are complete: no similar pair is missed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ledgerloom.llm.textkernel import mix

SPARE = 3
#: Sets that may differ in fewer n-grams than this have one needed fragment and may drop none: they are too small for few empty fragments.
SMALL = 8


def linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray, p: int, q: int) -> np.ndarray:
    """Whether q * |intersection| >= p * |union|, for sets that aren't empty."""
    return (q * shared >= p * (a + b - shared)) & (shared > 0)


@lru_cache(8)
def level_starts(p: int, q: int, most: int = 1 << 40) -> np.ndarray:
    """Least size of each level: sizes n and m <= n*q/p are in the same level or in neighbouring ones."""
    starts = [1]
    while starts[-1] < most:
        starts.append(max(starts[-1] + 1, starts[-1] * q // p + 1))
    return np.array(starts)


def differences(level: int | np.ndarray, p: int, q: int) -> int | np.ndarray:
    """In how many n-grams two similar sets of a level differ at most."""
    largest = level_starts(p, q)[level + 1] - 1
    return (q - p) * 2 * largest // (q + p)


def needed(d: int | np.ndarray) -> int | np.ndarray:
    """How many announced fragments similar sets are sure to share, after each has dropped may_drop(d): more, the larger they are."""
    return np.where(np.asarray(d) < SMALL, 1, np.maximum(4, np.asarray(d) // 64))


def may_drop(d: int | np.ndarray) -> int | np.ndarray:
    """How many fragments of a level each set may disregard."""
    return np.where(np.asarray(d) < SMALL, 0, np.maximum(3, np.asarray(d) // 32))


def droppable(n: int, p: int, q: int) -> tuple[int, int]:
    """How many fragments a set of n may disregard of its level whose number is even, and of the odd one."""
    own = int(level_of(np.array(n), p, q))
    even, odd = (int(may_drop(differences(level, p, q))) for level in (own + (own & 1), own + 1 - (own & 1)))
    return even, odd


def fragments_of_level(level: int, p: int, q: int) -> int:
    d = int(differences(level, p, q))
    return d + int(needed(d)) + SPARE + 2 * int(may_drop(d)) if d else 0


def level_of(n: np.ndarray, p: int, q: int) -> np.ndarray:
    """The own level of sets of these sizes."""
    return np.searchsorted(level_starts(p, q), n, "right") - 1


def meets_here(sig: np.ndarray, a: np.ndarray, b: np.ndarray, p: int, q: int) -> np.ndarray:
    """Whether a fragment's hash is of the level of the larger of two sets: similar sets agree in one there, so other levels needn't name the pair."""
    return (level_of(np.maximum(a, b), p, q) & 1) == (sig & 1)


def sure_to_share(a: np.ndarray, b: np.ndarray, p: int, q: int) -> np.ndarray:
    """How many fragments of the larger one's level two similar sets of these sizes share at least."""
    return needed(differences(level_of(np.maximum(a, b), p, q), p, q))


def signatures(shingles: np.ndarray, p: int, q: int) -> np.ndarray:
    """The hashes of a set's fragments at both its levels; the lowest bit is the level's. shingles: sorted distinct 64-bit hashes."""
    n = len(shingles)
    if not n:
        return np.zeros(0, np.uint64)
    own = int(level_of(np.array(n), p, q))
    high = shingles >> np.uint64(32)
    spread = mix(shingles ^ np.uint64(0xA0761D6478BD642F))
    out = []
    for level in (own, own + 1):
        pieces = fragments_of_level(level, p, q)
        if not pieces:
            continue
        at = ((high * np.uint64(pieces)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        total = np.add.reduceat(spread, first)
        number = at[first]
        if pieces - len(first) > SPARE:
            empty = np.setdiff1d(np.arange(pieces), number)
            number, total = np.concatenate([number, empty]), np.concatenate([total, np.zeros(len(empty), np.uint64)])
        out.append(mix(total ^ mix(number.astype(np.uint64) + np.uint64(level << 32))) & ~np.uint64(1) | np.uint64(level & 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
