"""Arithmetic of confidences, in double precision and a fixed order of summation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import lookups as L


def round3(x: Column) -> Column:
    """floor(1000 x + 1/2) / 1000, which differs from decimal rounding at ties."""
    return F.floor(x * F.lit(1000.0) + F.lit(0.5)) / F.lit(1000.0)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def decayed(start: Column, n: Column, step: float) -> Column:
    """start + step * DECAY**0 + step * DECAY**1 + ... for n - 1 terms, summed in that order."""
    terms = F.aggregate(F.sequence(F.lit(0), n - 2), start, lambda acc, i: acc + F.lit(step) * F.pow(F.lit(L.DECAY), i))
    return F.when(n > 1, terms).otherwise(start)


def scalar_confidence(trust: Column, agreed: Column, conflicted: Column) -> Column:
    bonus = decayed(F.lit(0.0), agreed, L.AGREEMENT)
    return round3(clamp01(trust + bonus - F.lit(L.CONFLICT) * conflicted))


def skill_confidence(best: Column, sources: Column) -> Column:
    return round3(F.least(F.lit(1.0), decayed(best, sources, L.SKILL_AGREEMENT)))


def recency_key(observed_at: Column) -> Column:
    """Sorts later texts first: 255 minus each UTF-16-like character code, so that a prefix precedes what it begins."""
    codes = F.transform(F.split(F.coalesce(observed_at, F.lit("")), ""), lambda c: F.lit(255) - F.ascii(c))
    return F.when(F.coalesce(F.length(observed_at), F.lit(0)) == 0, F.array().cast("array<int>")).otherwise(codes)
