"""Filters and the join, set, ranking and limit shapes that take more than one call."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class SearchFilters:
    """what a search may return. Both ends of the time range are inclusive; rows without a time fail a bound."""

    source_ids: Sequence[str] = ()
    kinds: Sequence[str] = ()
    occurred_after: str | None = None
    occurred_before: str | None = None
    include_deleted: bool = False
    tags: Sequence[str] = field(default=())

    def condition(self) -> Column:
        out = F.lit(True) if self.include_deleted else live()
        if self.source_ids:
            out &= F.col("source_id").isin(list(self.source_ids))
        if self.kinds:
            out &= F.col("kind").isin(list(self.kinds))
        if self.occurred_after:
            out &= F.col("occurred_at") >= F.lit(self.occurred_after).cast("timestamp")
        if self.occurred_before:
            out &= F.col("occurred_at") <= F.lit(self.occurred_before).cast("timestamp")
        return out


def live() -> Column:
    """current and not removed."""
    return F.col("is_current") & F.col("deleted_at").isNull()


def stale(column: str, wanted: str) -> Column:
    """IS DISTINCT FROM; a null is stale."""
    return ~F.col(column).eqNullSafe(F.lit(wanted))


def with_all(df: DataFrame, item: str, tag: str, wanted: Iterable[str]) -> DataFrame:
    """items that carry every wanted tag (relational division); with none wanted, every item."""
    names = sorted(set(wanted))
    if not names:
        return df.select(item).distinct()
    found = df.where(F.col(tag).isin(names)).groupBy(item).agg(F.countDistinct(tag).alias("_n"))
    return found.where(F.col("_n") == len(names)).select(item)


def glob_excluded(column: str, patterns: Iterable[str]) -> Column:
    """whether a glob matches the key, or its last part where the glob has no slash. Null matches nothing."""
    out = F.lit(False)
    for p in patterns:
        regex = re.sub(r"\(\?s:(.*)\)\\[Zz]", r"(?s)^(?:\1)$", fnmatch.translate(p))
        subject = F.col(column) if "/" in p else F.regexp_extract(column, r"[^/]*$", 0)
        out |= F.coalesce(subject.rlike(regex), F.lit(False))
    return out


def scoped(df: DataFrame, owner: str, current: str) -> DataFrame:
    """row-level security as a view: only rows of the current owner, null owners to nobody."""
    return df.where(F.col(owner) == F.lit(current))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """one page of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def natural_key_links(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows linked to right rows on a key that survives a rebuild; null keys link to nothing."""
    return left.join(right, keys, "inner")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, at: str, bucket_days: int = 30) -> DataFrame:
    """Pairs with start < at <= end. Time buckets make the range an equi-join, so no pair outside meets."""
    width = bucket_days * 86_400
    number = lambda c: F.floor(F.unix_seconds(c) / width)
    wide = left.where(F.col(end) > F.col(start)).withColumn("_b", F.explode(F.sequence(number(F.col(start)), number(F.col(end)))))
    return wide.join(right.withColumn("_b", number(F.col(at))), [*keys, "_b"]).where((F.col(at) > F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")


def spans_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open spans meet; a span of no width (an insertion) meets what holds its point or starts or ends there."""
    point = (a_start == a_end) & (b_start <= a_start) & (a_start <= b_end)
    return point | ((a_start < b_end) & (b_start < a_end))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: int = 64) -> DataFrame:
    """Pairs of a key whose spans meet (see :func:`spans_overlap`). Spans are filed under the stretches of
    ``width`` that they touch, and a pair is taken where the later start lies, so only near spans meet. Null ends meet nothing."""
    at = lambda c: F.floor(F.col(c) / width)
    wide = lambda df, s: df.where((F.col(s[0]) <= F.col(s[1]))).withColumn("_b", F.explode(F.sequence(at(s[0]), at(s[1]))))
    met = wide(left, a).join(wide(right, b), [*keys, "_b"])
    once = F.col("_b") == F.greatest(at(a[0]), at(b[0]))
    return met.where(once & spans_overlap(*map(F.col, (*a, *b)))).drop("_b")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 where both are empty, null where one is null."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), union), F.lit(0.0)))


def pairs_within(df: DataFrame, group: list[str], member: str, least: int, every: DataFrame | None = None, coverage: float = 0.5) -> DataFrame:
    """Unordered pairs of members met in at least ``least`` groups: a, b, n. Equal pairs of a group count once.

    Members of fewer groups are taken out before any pair is made. With ``every`` (one row
    per group there is) nothing is said unless at least ``coverage`` of them have a member.
    """
    d = df.select(*group, F.col(member).alias("m")).dropna().distinct()
    often = d.groupBy("m").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("m")
    if every is not None:
        known, all_ = d.select(*group).distinct().agg(F.count(F.lit(1)).alias("n")).scalar(), every.agg(F.count(F.lit(1)).alias("n")).scalar()
        d = d.where(known >= F.lit(coverage) * all_)
    d = d.join(often, "m", "left_semi")
    a, b = d.withColumnRenamed("m", "a"), d.withColumnRenamed("m", "b")
    return a.join(b, group).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def best_pairs(df: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """One row per unordered pair, the one of the highest score: a, b, score."""
    return df.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(score).alias("score"))


def top_per(df: DataFrame, by: list[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in a total order; ranked in part before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """L4: ``n`` rows drawn by a hash of key and seed: the same rows on every run and partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(n)
