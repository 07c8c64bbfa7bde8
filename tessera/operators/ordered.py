"""Order within a scope without holding a scope in one task.

Rows of a scope are compared inside buckets (hours of a time, stretches of a number);
what a bucket needs from the ones before it comes from one summary row per bucket. A
scope with a third of all rows is thus spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Seconds of a bucket of times, and numbers in a bucket of whole numbers.
HOUR, STRETCH = 3600, 65_536


def bucket(at: str | Column, seconds: int) -> Column:
    """Number of the bucket of ``seconds`` that a time lies in; null for null."""
    return F.floor(F.unix_micros(F.col(at) if isinstance(at, str) else at) / F.lit(seconds * 1_000_000))


def _bucketed(df: DataFrame, at: str, size: int | None) -> DataFrame:
    time = isinstance(df.schema[at].dataType, T.TimestampType)
    return df.withColumn("_b", bucket(at, size or HOUR) if time else F.floor(F.col(at) / F.lit(size or STRETCH)))


def _told(rows: DataFrame, ends: DataFrame, scope: list[str], carry: Column) -> DataFrame:
    """``rows`` with ``_carried``: what ``carry``, over the buckets of a scope in order, says for their bucket."""
    ends = ends.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(scope)], F.col("_b").alias("_sb"), carry.alias("_carried"))
    same = [rows[c].eqNullSafe(ends[f"_s{i}"]) for i, c in enumerate(scope)] + [rows["_b"].eqNullSafe(ends["_sb"])]
    return rows.join(ends, same).drop(*[f"_s{i}" for i in range(len(scope))], "_sb")


def with_previous(df: DataFrame, scope: list[str], at: str, tie: str, size: int | None = None, value: str | None = None, out: str = "previous") -> DataFrame:
    """Adds ``out``: ``value`` (``at``, if not given) of the row before in its scope, by (``at``, ``tie``); null for the first.

    ``at`` is a time or a whole number. Rows with a null ``at`` are left out: they
    have no place in the order. Null scopes form one scope. Repeated rows follow each
    other.
    """
    value = value or at
    rows = _bucketed(df.where(F.col(at).isNotNull()), at, size)
    last = F.struct(F.col(at).alias("a"), F.col(tie).alias("t"), F.col(value).alias("v"))
    ends = rows.groupBy(*scope, "_b").agg(F.max(last).alias("_end"))
    told = _told(rows, ends, scope, F.lag("_end").over(Window.partitionBy(*scope).orderBy("_b")))
    within = Window.partitionBy(*scope, "_b").orderBy(at, tie)
    first = F.row_number().over(within) == 1
    return told.withColumn(out, F.when(first, F.col("_carried.v")).otherwise(F.lag(value).over(within))).drop("_b", "_carried")


def running_sum(df: DataFrame, scope: list[str], at: str, tie: str, amount: str, out: str, size: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows up to and with this one in its scope."""
    rows = _bucketed(df, at, size)
    sums = rows.groupBy(*scope, "_b").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*scope).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    told = _told(rows, sums, scope, F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    within = Window.partitionBy(*scope, "_b").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    return told.withColumn(out, F.col("_carried") + F.sum(amount).over(within)).drop("_b", "_carried")


def carried_last(df: DataFrame, scope: list[str], at: str, tie: str, value: str, out: str, size: int | None = None) -> DataFrame:
    """Adds ``out``: the last ``value`` that is not null over the rows up to and with this one in its scope."""
    rows = _bucketed(df, at, size)
    some = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("a"), F.col(tie).alias("t"), F.col(value).alias("v")))
    ends = rows.groupBy(*scope, "_b").agg(F.max(some).alias("_end"))
    before = Window.partitionBy(*scope).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    told = _told(rows, ends, scope, F.last("_end.v", ignorenulls=True).over(before))
    within = Window.partitionBy(*scope, "_b").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    return told.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(within), F.col("_carried"))).drop("_b", "_carried")
