"""What is missing from a body of reasoning, said only where it can be shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.analysis import STOP_WORDS, words
from tessera.functions.scores import pattern_confidence

LEAST = 2
QUIET_DAYS, OPEN_DAYS = 30, 30


def sayable(gaps: DataFrame, least: int = LEAST) -> DataFrame:
    """Gaps (kind, key, support, against, evidence) that meet the bar: support of two, more than against, confidence
    of two against none, two pieces of evidence."""
    conf = F.round(pattern_confidence(F.col("support"), F.col("against"), least), 6)
    bar = 0.5  # what support of 2 against 0 gives
    return gaps.withColumn("confidence", conf).where((F.col("support") >= least) & (F.col("support") > F.col("against")) & (F.col("confidence") >= bar) & (F.col("evidence") >= 2))


def orphaned_work(links: DataFrame, key: str, item: str, at: str, against) -> DataFrame:
    """Threads of two items or more that are quiet for 30 days against the newest of the corpus."""
    newest = links.agg(F.max(at)).scalar()
    per = links.groupBy(F.col(key).cast("string").alias("key")).agg(
        F.countDistinct(item).alias("support"), F.count_if(against).alias("against"), F.count(F.lit(1)).alias("evidence"), F.max(at).alias("_last")
    )
    quiet = F.unix_micros(newest) - F.unix_micros("_last") > QUIET_DAYS * 86_400_000_000
    return per.where((F.col("support") >= LEAST) & quiet).select(F.lit("orphaned_work").alias("kind"), "key", "support", "against", "evidence")


def unevaluated(assumptions: DataFrame, group: str, verdict: str, at: str, now: str) -> DataFrame:
    """Beliefs without a verdict for more than 30 days, by group; judged ones count against."""
    old = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at) > OPEN_DAYS * 86_400_000_000
    per = assumptions.groupBy(F.col(group).cast("string").alias("key")).agg(
        F.count_if(F.col(verdict).isNull() & old).alias("support"), F.count_if(F.col(verdict).isNotNull()).alias("against"), F.count(F.lit(1)).alias("evidence")
    )
    return per.where("support > 0").select(F.lit("unevaluated").alias("kind"), "key", "support", "against", "evidence")


def repeated(decisions: DataFrame, group: str, failed) -> DataFrame:
    """Groups of decisions that failed again and again."""
    per = decisions.groupBy(F.col(group).cast("string").alias("key")).agg(F.count_if(failed).alias("support"), F.count_if(~failed).alias("against"), F.count(F.lit(1)).alias("evidence"))
    return per.where("support > 0").select(F.lit("repeated").alias("kind"), "key", "support", "against", "evidence")


def topics(df: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct topic words of a text, stop words and words of three letters or fewer left out: key, term."""
    t = df.select(F.col(key).alias("key"), F.explode(F.array_distinct(words(text))).alias("term"))
    return t.where((F.length("term") > 3) & ~F.col("term").isin(STOP_WORDS))


def unstated(decisions: DataFrame, beliefs: DataFrame, key: str, text: str, belief: str, statement: str) -> DataFrame:
    """Decisions that share a topic with no recorded belief: kind, key. Terms meet by an equi-join of distinct words."""
    known = topics(beliefs, belief, statement).select("term").distinct()
    touched = topics(decisions, key, text).join(known, "term", "left_semi").select("key").distinct()
    return decisions.select(F.col(key).alias("key")).distinct().join(touched, "key", "left_anti").select(F.lit("unstated").alias("kind"), "key")
