"""Verdicts, rates, calibration and patterns: what the evidence supports, and silence where it supports nothing.

Inputs are long tables: ``decisions`` (decision_id, confidence, horizon,
decided_at) and ``outcomes`` (decision_id, verdict, observed_at, created_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.scores import emittable, miscalibrated, pattern_confidence, wilson

RESOLVED = ("worked", "failed", "mixed")


def latest_verdict(outcomes: DataFrame, key: str = "decision_id") -> DataFrame:
    """The verdict observed last per decision (then recorded last, then greatest); map-side combined."""
    return outcomes.groupBy(key).agg(F.max(F.struct("observed_at", "created_at", "verdict")).alias("_l")).select(
        key, F.col("_l.verdict").alias("verdict"), F.col("_l.observed_at").alias("observed_at")
    )


def success_rate(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Counts by latest verdict; the rate is over resolved ones only and null if there are none."""
    v = decisions.select("decision_id").join(latest_verdict(outcomes), "decision_id", "left").select("verdict")
    out = v.agg(
        *[F.count_if(F.col("verdict") == w).alias(w) for w in (*RESOLVED, "too_early")],
        F.count_if(F.col("verdict").isNull()).alias("undecided"),
    )
    return out.withColumn("rate", F.try_divide(F.col("worked").cast("double"), F.col("worked") + F.col("failed") + F.col("mixed")))


def group_rates(held: DataFrame, group: str, verdict: str) -> DataFrame:
    """A10, M5: per group held, broke (failed or partially), open; hold rate over judged members; recurring."""
    judged = F.count_if(F.col(verdict).isin("held", "failed", "partially"))
    return held.groupBy(group).agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if(F.col(verdict) == "held").alias("held"),
        F.count_if(F.col(verdict).isin("failed", "partially")).alias("broke"),
        F.try_divide(F.count_if(F.col(verdict) == "held").cast("double"), judged).alias("hold_rate"),
        (F.count(F.lit(1)) > 1).alias("recurring"),
    )


def group_patterns(held: DataFrame, group: str, verdict: str, least: int = 4) -> DataFrame:
    """M5, M9: groups whose assumptions break, where enough support and more than against: silent otherwise."""
    rates = group_rates(held, group, verdict).where(emittable(F.col("broke"), F.col("held"), least))
    return rates.select(group, F.col("broke").alias("support"), F.col("held").alias("against"), pattern_confidence(F.col("broke"), F.col("held"), least).alias("confidence"))


def timing_pattern(decisions: DataFrame, outcomes: DataFrame, days: int = 90) -> DataFrame:
    """M6: do outcomes show only after ``days``? Latest verdicts that are not too early and lie after the decision."""
    gap = F.unix_micros("observed_at") - F.unix_micros("decided_at")
    v = decisions.select("decision_id", "decided_at").join(latest_verdict(outcomes), "decision_id")
    v = v.where((F.col("verdict") != "too_early") & (gap > 0))
    late = gap > days * 86_400_000_000
    return v.agg(F.count_if(late).alias("support"), F.count_if(~late).alias("against"))


def choice_pattern(decisions: DataFrame) -> DataFrame:
    """M7: reversed decisions support, settled ones contradict."""
    return decisions.agg(F.count_if(F.col("status") == "reversed").alias("support"), F.count_if(F.col("status") == "settled").alias("against"))


def band(confidence: Column) -> Column:
    """M8: quarter of [0, 1] a confidence lies in, 0 to 3; the last holds 1 too."""
    return F.least(F.floor(confidence * 4), F.lit(3)).cast("int")


def calibration(rows: DataFrame, confidence: str, success: str) -> DataFrame:
    """M8: per band the mean stated confidence against the Wilson interval of what happened.

    Rows with a null confidence or outcome are not judged. support and against
    change sides when the stated confidence was too low.
    """
    per = rows.dropna(subset=[confidence, success]).groupBy(band(F.col(confidence)).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(success)).alias("worked"), F.avg(confidence).alias("stated")
    )
    per = per.withColumn("i", wilson(F.col("worked"), F.col("n")))
    under = F.col("stated") < F.col("i.low")
    failed = F.col("n") - F.col("worked")
    return per.select(
        "band", "n", "worked", "stated", F.col("i.rate").alias("rate"), F.col("i.low").alias("low"), F.col("i.high").alias("high"),
        miscalibrated(F.col("stated"), F.col("i")).alias("off"),
        F.when(under, F.col("worked")).otherwise(failed).alias("support"),
        F.when(under, failed).otherwise(F.col("worked")).alias("against"),
    )


def assess(facets: DataFrame, dimension: str, vocabulary: list[str], least: int = 3) -> DataFrame:
    """Every dimension with what is known of it, or why nothing is said."""
    known = facets.groupBy(dimension).agg(F.count(F.lit(1)).alias("n"))
    names = facets.sparkSession.createDataFrame([(v,) for v in vocabulary], f"{dimension} string")
    n = F.coalesce("n", F.lit(0))
    reason = F.when(n == 0, "nothing observed").when(n < least, "below support")
    return names.join(known, dimension, "left").select(dimension, n.alias("n"), reason.alias("reason"))


def facet_changes(versions: DataFrame, key: list[str], at: str, since: str, until: str) -> DataFrame:
    """Added, replaced and removed statements in the closed window; a replacement is not also an addition."""
    inside = F.col(at).between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp"))
    gone = F.col("deleted_at").between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp"))
    changes = versions.where(inside).select(*key, F.when(F.col("version") == 1, "added").otherwise("replaced").alias("change"), F.col(at).alias("at"))
    return changes.unionByName(versions.where(gone).select(*key, F.lit("removed").alias("change"), F.col("deleted_at").alias("at")))


def facet_stability(spans: DataFrame, dimension: str, start: str, end: str, now: str, vocabulary: list[str]) -> DataFrame:
    """Mean lifetime of closed and mean age of live statements, in days, per dimension, all dimensions kept."""
    days = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / F.lit(86_400e6)
    moment = F.lit(now).cast("timestamp")
    per = spans.groupBy(dimension).agg(
        F.count_if(F.col(end).isNotNull()).alias("changes"),
        F.avg(F.when(F.col(end).isNotNull(), days(F.col(start), F.col(end)))).alias("mean_lifetime"),
        F.avg(F.when(F.col(end).isNull(), days(F.col(start), moment))).alias("mean_age"),
        days(F.min(start), moment).alias("observed_days"),
    )
    names = spans.sparkSession.createDataFrame([(v,) for v in vocabulary], f"{dimension} string")
    return names.join(per, dimension, "left").withColumn("changes", F.coalesce("changes", F.lit(0)))
