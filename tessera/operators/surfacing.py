"""ST8 to ST10: whether a context is worth an interruption, and how feedback moves the bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.ordered import running_sum
from tessera.operators.relational import jaccard

# Fixed values of the bar: a single best route, its multiples, and the windows of suppression.
SINGLE_ROUTE = 1.0 / 61
BASE, STEP_DISMISSED, STEP_USEFUL, LEAST, MOST = 1.8, 0.6, 0.2, 1.0, 4.0
SIMILAR, REPEAT_HOURS, DISMISSED_DAYS = 0.6, 4, 30


def bar(dismissed: Column, useful: Column) -> Column:
    """ST9, ST10: the score a focus must exceed, after its feedback."""
    raw = F.lit(BASE) + STEP_DISMISSED * dismissed - STEP_USEFUL * useful
    return F.least(F.lit(MOST), F.greatest(F.lit(LEAST), raw)) * SINGLE_ROUTE


def thresholds(history: DataFrame, focus: str) -> DataFrame:
    """ST10: per focus the dismissals, the useful ones and the bar they give."""
    per = history.groupBy(focus).agg(F.count_if(F.col("dismissed_at").isNotNull()).alias("dismissed"), F.count_if(F.col("useful")).alias("useful"))
    return per.withColumn("bar", bar(F.col("dismissed"), F.col("useful")))


def gate(contexts: DataFrame, history: DataFrame, focus: str, context: str) -> DataFrame:
    """ST9: reason and verdict per context (focus, context, keys, score, at).

    ``history``: focus, keys, surfaced_at, dismissed_at, useful. In order: nothing
    to show, not above the bar, like one dismissed within 30 days, like one shown
    within 4 hours, else cleared. Only history before the context counts.
    """
    day = 86_400_000_000
    month = lambda c: F.floor(F.unix_micros(c) / (DISMISSED_DAYS * day))
    age = lambda c: F.unix_micros("at") - F.unix_micros(c)
    # likeness: only history of the last 30 days can suppress, so contexts meet two buckets of it
    recent = history.select(F.col(focus).alias("_f"), F.col("keys").alias("_keys"), "surfaced_at", "dismissed_at",
                            F.explode(F.array_distinct(F.array_compact(F.array(month("surfaced_at"), month("dismissed_at"))))).alias("_m"))
    asked = contexts.withColumn("_m", F.explode(F.array(month("at"), month("at") - 1)))
    near = asked.join(recent, (asked[focus] == recent["_f"]) & (asked["_m"] == recent["_m"]) & (recent["surfaced_at"] < asked["at"]))
    alike = F.coalesce(jaccard(F.col("keys"), F.col("_keys")) >= SIMILAR, F.lit(False))
    was = F.col("dismissed_at").isNotNull() & (F.col("dismissed_at") <= F.col("at"))
    found = near.groupBy(F.col("_f").alias(focus), context).agg(
        F.max(alike & was & (age("dismissed_at") < DISMISSED_DAYS * day)).alias("unwanted"),
        F.max(alike & (age("surfaced_at") < REPEAT_HOURS * 3_600_000_000)).alias("repeated"),
    )
    per = _with_feedback(contexts, history, focus).withColumn("n", F.size("keys")).join(found, [focus, context], "left")
    per = per.withColumn("bar", F.round(bar(F.col("dismissed"), F.col("useful")), 9))
    per = per.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("unwanted", "repeated")})
    reason = (
        F.when(F.col("score").isNull(), F.when(F.col("n") > 0, "nothing_new").otherwise("no_context"))
        .when(F.col("score") <= F.col("bar"), "below_threshold")
        .when(F.col("unwanted"), "dismissed")
        .when(F.col("repeated"), "already_surfaced")
        .otherwise("cleared")
    )
    return per.select(focus, context, "score", "bar", reason.alias("reason"))


def _with_feedback(contexts: DataFrame, history: DataFrame, focus: str) -> DataFrame:
    """Contexts with the dismissals and useful marks of their focus so far: running sums, no pairs."""
    h = history.where(F.col("surfaced_at").isNotNull())
    marks = h.where("dismissed_at IS NOT NULL").select(focus, F.greatest("dismissed_at", "surfaced_at").alias("at"), F.lit(0).alias("_tie"), F.lit(1).alias("_d"), F.lit(0).alias("_u"))
    marks = marks.unionByName(h.where("useful").select(focus, F.col("surfaced_at").alias("at"), F.lit(2).alias("_tie"), F.lit(0).alias("_d"), F.lit(1).alias("_u")))
    rows = contexts.withColumns({"_tie": F.lit(1), "_d": F.lit(0), "_u": F.lit(0)}).unionByName(marks, allowMissingColumns=True)
    rows = running_sum(rows, [focus], "at", "_tie", "_d", "dismissed")
    return running_sum(rows, [focus], "at", "_tie", "_u", "useful").where("_tie = 1").drop("_tie", "_d", "_u")


def precompute(events: DataFrame, kind: str) -> DataFrame:
    """ST8: what an event makes the system do: assemble a context, or only read the one there is."""
    return events.withColumn("action", F.when(F.col(kind).isin("editor_opened", "meeting_upcoming"), "assemble").when(F.col(kind) == "file_focused", "read").otherwise("none"))
