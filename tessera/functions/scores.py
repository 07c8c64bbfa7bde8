"""Closed-form scores as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: the 97.5 % point of the normal distribution.
Z = 1.959963984540054
HALF_LIFE_DAYS, UNDATED = 180.0, 0.5
CHUNK_CEILING, VERSION_CEILING = 64, 12
WEIGHT_CHUNKS, WEIGHT_VERSIONS, WEIGHT_RECENCY = 0.30, 0.45, 0.25
RRF_K = 60


def wilson(successes: Column, n: Column, z: float = Z) -> Column:
    """M1: (rate, low, high) of a proportion; no trials give (0, 0, 1)."""
    k, m = successes.cast("double"), n.cast("double")
    p = k / m
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    pick = lambda some, none: F.when(n > 0, some).otherwise(F.lit(none))
    return F.struct(
        pick(p, 0.0).alias("rate"),
        pick(F.greatest(F.lit(0.0), centre - half), 0.0).alias("low"),
        pick(F.least(F.lit(1.0), centre + half), 1.0).alias("high"),
    )


def miscalibrated(stated: Column, interval: Column) -> Column:
    """M2: the stated probability lies outside the interval."""
    return (stated < interval["low"]) | (stated > interval["high"])


def pattern_confidence(support: Column, against: Column, least: int = 4) -> Column:
    """M3: share of support, damped until support is twice the least, at most 0.95; 0 without support."""
    s, c = support.cast("double"), against.cast("double")
    return F.when(s <= 0, 0.0).otherwise(F.least(F.lit(0.95), s / (s + c) * F.least(F.lit(1.0), s / (2.0 * least))))


def emittable(support: Column, against: Column, least: int = 4) -> Column:
    """M4: enough support, and more than against."""
    return (support >= least) & (support > against)


def support_needed(support: Column, against: Column, bar: float, least: int = 4, most: int = 200) -> Column:
    """M4: the smallest extra support that lifts the confidence to ``bar``; null if none up to ``most`` does."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda x: pattern_confidence(support + x, against, least) >= bar)
    return F.try_element_at(fits, F.lit(1))


def recency(at: Column, now: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Halves every half-life; 0.5 without a date; above 1 in the future."""
    days = (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400e6)
    return F.coalesce(F.pow(F.lit(2.0), -days / half_life), F.lit(UNDATED))


def importance(chunks: Column, versions: Column, recent: Column) -> Column:
    """Saturating counts of chunks and of edits, and recency, in [0, 1], rounded half to even at 4 places."""
    part = lambda c, top: F.log1p(F.least(F.greatest(c, F.lit(0)), F.lit(top)).cast("double")) / F.log1p(F.lit(float(top)))
    raw = WEIGHT_CHUNKS * part(chunks, CHUNK_CEILING) + WEIGHT_VERSIONS * part(versions - 1, VERSION_CEILING)
    raw = raw + WEIGHT_RECENCY * F.least(F.lit(1.0), recent)
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 4)


def rrf_term(rank: Column, weight: float | Column = 1.0, k: int = RRF_K) -> Column:
    """What one ranking adds to a candidate's score."""
    if k < 0:
        raise ValueError("k must not be negative")
    return (F.lit(weight) if isinstance(weight, (int, float)) else weight) / (F.lit(float(k)) + rank)


def strength(rank: Column) -> Column:
    """How strongly a signal ranked a result."""
    return F.when(rank <= 3, "strong").when(rank <= 10, "moderate").when(rank.isNotNull(), "weak")


def nearest_rank(values: Column, p: float) -> Column:
    """The element at round-half-even(p * (n - 1)) of the sorted values; null if there are none."""
    ordered = F.sort_array(F.filter(values, lambda x: x.isNotNull()))
    at = F.bround(F.lit(p) * (F.size(ordered) - 1).cast("double"), 0).cast("int")
    return F.when(F.size(ordered) > 0, F.get(ordered, at))
