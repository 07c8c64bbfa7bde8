"""Bloom filters built and probed inside the JVM.

Spark ships a Bloom filter aggregate and its membership test for its own
runtime join filters but gives them no SQL name; both are reached through the
expression classes. The filter is one binary value of a size fixed beforehand,
which is what makes it safe to send to every executor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Upper bound of one filter: 2**26 bits are 8 MB, enough for this many keys at 16 bits each. More keys than one
#: filter holds are parted into ranges of their hash, each with a filter of its own (see :func:`ranges`).
MAX_BITS, KEYS = 1 << 26, 4_000_000


def _wrap(spark: SparkSession, expression) -> Column:
    from pyspark.sql.classic.column import Column as ClassicColumn

    return ClassicColumn(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def _expr(spark: SparkSession, column: Column):
    return spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(column._jc)


def filter_bits(keys: int, bits_per_key: int = 12, max_bits: int = MAX_BITS) -> int:
    """Bits for ``keys`` keys: ``bits_per_key`` each, a power of two, at most ``max_bits``.

    One filter never grows beyond the bound: callers with more than ``KEYS`` keys
    build one for each of :func:`ranges`.
    """
    wanted = max(1024, keys * bits_per_key)
    return min(max_bits, 1 << math.ceil(math.log2(wanted)))


def ranges(keys: int) -> int:
    """How many filters hold ``keys`` keys at the same rate of false answers."""
    return max(1, -(-keys // KEYS))


def range_of(key: Column, n: int) -> Column:
    """The range, of ``n``, that a key's hash falls into; independent of the hash inside the filters."""
    return F.pmod(F.hash(key), F.lit(n))


def build(df: DataFrame, key: Column, expected: int, max_bits: int = MAX_BITS) -> DataFrame:
    """One row with the filter over all non-null values of ``key``; null if there are none.

    Hashes are aggregated map-side, so a key that fills a third of the table
    costs no more than any other.
    """
    spark = df.sparkSession
    hashed = df.where(key.isNotNull()).select(F.xxhash64(key).alias("h"))
    aggregate = spark._jvm.org.apache.spark.sql.catalyst.expressions.aggregate.BloomFilterAggregate(
        _expr(spark, F.col("h")),
        _expr(spark, F.lit(max(1, min(expected, KEYS))).cast("bigint")),
        _expr(spark, F.lit(filter_bits(expected, max_bits=max_bits)).cast("bigint")),
    )
    return hashed.agg(_wrap(spark, aggregate.toAggregateExpression()).alias("filter"))


def might_contain(bloom: DataFrame, key: Column) -> Column:
    """False: ``key`` is certainly not among the filter's keys. True: it may be.

    ``bloom`` enters the plan as a scalar subquery: it runs once and its one
    value of bounded size goes to every executor with the tasks.
    """
    spark = bloom.sparkSession
    test = spark._jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(
        _expr(spark, bloom.scalar()), _expr(spark, F.xxhash64(key))
    )
    return F.coalesce(_wrap(spark, test), F.lit(False))
