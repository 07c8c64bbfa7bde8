"""Time: calendar buckets, ranges, as-of, lag, gaps, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.ordered import running_sum, with_previous

PERIODS = ("day", "week", "month")


def truncate(period: str, at: str | Column) -> Column:
    """Start of the calendar day, week (from Monday) or month, in UTC."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}")
    return F.date_trunc(period, at)


def spine(bounds: DataFrame, period: str, start: str = "start", end: str = "end") -> DataFrame:
    """Every bucket from the one ``start`` lies in while before ``end``; none if end <= start or either is null."""
    step = F.expr(f"INTERVAL 1 {period}")
    first = truncate(period, start)
    last = F.greatest(first, F.col(end) - F.expr("INTERVAL 1 MICROSECOND"))
    bounds = bounds.where(F.col(end) > F.col(start))
    return bounds.select(F.explode(F.sequence(first, last, step)).alias("bucket"))


def activity_by_period(df: DataFrame, at: str, period: str, kind: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows per bucket and kind, every bucket of the range present: bucket, kind, n.

    Without bounds the range is that of the data. A bucket without rows has one
    row with a null kind and n = 0. Rows without a time are not counted.
    """
    dated = df.where(F.col(at).isNotNull())
    if start and end:
        bounds = df.sparkSession.sql(f"SELECT timestamp'{start}' AS start, timestamp'{end}' AS end")
        dated = in_range(dated, at, start, end)
    else:
        bounds = dated.agg(F.min(at).alias("start"), (F.max(at) + F.expr("INTERVAL 1 MICROSECOND")).alias("end"))
    counts = dated.groupBy(truncate(period, at).alias("bucket"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return spine(bounds, period).join(counts, "bucket", "left").select("bucket", "kind", F.coalesce("n", F.lit(0)).alias("n"))


def in_range(df: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Rows with start <= time < end; rows without a time are outside."""
    return df.where((F.col(at) >= F.lit(start).cast("timestamp")) & (F.col(at) < F.lit(end).cast("timestamp")))


def as_of(df: DataFrame, keys: list[str], at: str, since: str = "ingested_at", order: str = "version", until: str = "deleted_at") -> DataFrame:
    """Per key the row that stood at ``at``, all its columns.

    Of the rows known by then (``since`` <= at) the latest by (since, order), if it
    was not removed by then (``until`` null or later). One aggregate with
    map-side combine, no sort of a hot key. Rows with a null ``since`` were never
    known. Equal rows give one.
    """
    moment = F.lit(at).cast("timestamp")
    rest = [c for c in df.columns if c not in keys]
    picked = (
        df.where(F.col(since) <= moment)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(since, order, *[c for c in rest if c not in (since, order)])).alias("_r"))
    )
    rows = picked.select(*keys, "_r.*").where(F.col(until).isNull() | (F.col(until) > moment))
    return rows.select(*df.columns)


def out_of_order(df: DataFrame, occurred: str, ingested: str, threshold_seconds: int) -> DataFrame:
    """Rows learned of more than the threshold after they occurred, with ``lag_us``; nulls have no lag."""
    lag = F.unix_micros(ingested) - F.unix_micros(occurred)
    return df.withColumn("lag_us", lag).where(F.col("lag_us") > threshold_seconds * 1_000_000)


def find_gaps(df: DataFrame, scope: list[str], at: str, tie: str, min_seconds: int) -> DataFrame:
    """Consecutive rows of a scope at least ``min_seconds`` apart: scope, gap_start, gap_end, gap_us."""
    if min_seconds <= 0:
        raise ValueError("the least gap must be above 0")
    gap = F.unix_micros(at) - F.unix_micros("previous")
    rows = with_previous(df.select(*scope, at, tie), scope, at, tie).withColumn("gap_us", gap)
    return rows.where(F.col("gap_us") >= min_seconds * 1_000_000).select(
        *scope, F.col("previous").alias("gap_start"), F.col(at).alias("gap_end"), "gap_us"
    )


def sessionize(df: DataFrame, scope: list[str], at: str, tie: str, gap_seconds: int = 1800) -> DataFrame:
    """W6, ST5: adds ``session``, from 1 in each scope; a pause of exactly the gap already opens a new one."""
    rows = with_previous(df, scope, at, tie)
    apart = F.unix_micros(at) - F.unix_micros("previous")
    opens = (F.col("previous").isNull() | (apart >= gap_seconds * 1_000_000)).cast("bigint")
    return running_sum(rows.withColumn("_opens", opens), scope, at, tie, "_opens", "session").drop("_opens", "previous")


def provenance_profile(df: DataFrame, provenance: str, at: str) -> DataFrame:
    """A4: count, first and last time per provenance; ``unknown`` present even at 0. Null counts as unknown."""
    word = F.coalesce(F.col(provenance), F.lit("unknown"))
    counts = df.groupBy(word.alias("provenance")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    always = df.sparkSession.createDataFrame([("unknown",)], "provenance string")
    named = counts.select("provenance").union(always).distinct()
    return named.join(counts, "provenance", "left").select("provenance", F.coalesce("n", F.lit(0)).alias("n"), "first_at", "last_at")


def observed_bounds(df: DataFrame, at: str) -> DataFrame:
    """A5: first and last time; nulls for an empty table."""
    return df.agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def confidence_horizon(confidence: Column, provenance: Column, decided: Column, recorded: Column, outcome_seen: Column) -> Column:
    """Whether a stated confidence was foresight; unknown without one."""
    late = F.unix_micros(recorded) - F.unix_micros(decided) > 86_400_000_000
    return (
        F.when(confidence.isNull(), "unknown")
        .when(outcome_seen | (provenance != "declared") | late, "hindsight")
        .otherwise("foresight")
    )


def outcome_window_days(confidence: Column) -> Column:
    """30 to 180 days by confidence, 90 without one."""
    return F.coalesce(F.lit(30.0) + F.lit(150.0) * confidence, F.lit(90.0))
