"""Rebuilding conversations from message rows.

Rows are sessionized by channel and put in order, and sessions that are empty,
broken or without reciprocal replies are dropped. Where the channel is a session id
with ordinals (:func:`session_verdicts`, :func:`conversations`), the order is the
ordinal, roles are read from the column and times play no part. Where a channel
holds many sessions (:func:`rebuilt_sessions`), rows are sorted by time, the channel
is split at an inactivity gap read off the data, roles that are missing are inferred
from their neighbours, and sessions in which only one side speaks are dropped.

No step holds a whole session in one task: order is checked inside ranges of
ordinals (or days), each range leaves one summary row, and only the summaries of
a session meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.changefeed import plain
from tessera.operators.ordered import carried_last, running_sum, with_previous
from tessera.session import cut

#: Ordinals per range.
RANGE = 4096
#: Everything that shows nothing: white space, separators, controls, format characters and fillers.
_BLANK = (
    r"\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}"
    r"\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}"
)


def visible(column: str | Column) -> Column:
    """Whether a text holds at least one character with something to see; false for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).rlike(f"[^{_BLANK}]")


def _ordered_turns(messages: DataFrame) -> DataFrame:
    """One row per session and ordinal: role, whether it is sound, its number within its range. Texts stay behind: only digests move."""
    digest = F.when(F.col("content").isNull(), "-").otherwise(F.sha2("content", 256))
    rows = messages.where(F.col("session_id").isNotNull()).select(
        "session_id",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.floor(F.col("ordinal") / F.lit(RANGE)).alias("_range"),
        F.coalesce(plain("role"), F.lit("")).alias("role"),
        digest.alias("_digest"),
        visible("content").alias("_visible"),
    )
    turns = rows.groupBy("session_id", "_range", "ordinal").agg(
        F.min(F.struct("role", "_digest")).alias("_low"),
        F.max(F.struct("role", "_digest")).alias("_high"),
        F.min("_visible").alias("_visible"),
    )
    sound = (
        F.col("ordinal").isNotNull()
        & (F.col("_low") == F.col("_high"))
        & F.col("_visible")
        & F.col("_low.role").isin("user", "assistant")
    )
    within = Window.partitionBy("session_id", "_range").orderBy("ordinal")
    return turns.select(
        "session_id", "_range", "ordinal", F.col("_low.role").alias("role"),
        (sound & ~F.coalesce(F.lag("_low.role").over(within) == F.col("_low.role"), F.lit(False))).alias("_sound"),
        F.row_number().over(within).alias("_n"),
    )


def _ranges(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id", "_range").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_sound").alias("sound"),
        F.min_by("role", "ordinal").alias("first"),
        F.max_by("role", "ordinal").alias("last"),
    )


def session_verdicts(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per distinct session id of ``sessions``: turns, and why it is dropped (null: kept).

    ``empty``: no message row. ``broken``: a turn without ordinal, without user
    or assistant role (read without case and surrounding white space), without
    visible content, two different turns at one ordinal, or roles that do not
    alternate. ``no_reply``: it does not start with user and end with assistant.
    Repeated deliveries of a turn are one turn. Message rows without a session id
    or of unlisted sessions are ignored, as are null session ids of ``sessions``.
    """
    return _verdicts(_ranges(_ordered_turns(messages)), sessions)


def _verdicts(ranges: DataFrame, sessions: DataFrame) -> DataFrame:
    before = Window.partitionBy("session_id").orderBy("_range")
    joined = ranges.withColumn("joins", ~F.coalesce(F.lag("last").over(before) == F.col("first"), F.lit(False)))
    whole = joined.groupBy("session_id").agg(
        F.sum("n").alias("turns"),
        F.min(F.col("sound") & F.col("joins")).alias("sound"),
        F.min_by("first", "_range").alias("first"),
        F.max_by("last", "_range").alias("last"),
    )
    ids = sessions.select("session_id").dropna().distinct()
    return ids.join(whole, "session_id", "left").select(
        "session_id",
        F.coalesce("turns", F.lit(0)).alias("turns"),
        F.when(F.col("turns").isNull(), "empty")
        .when(~F.col("sound"), "broken")
        .when((F.col("first") != "user") | (F.col("last") != "assistant"), "no_reply")
        .alias("dropped"),
    )


def conversations(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """The kept conversations, one row per turn: session_id, turn (from 0), ordinal, role, content.

    A conversation stays a set of rows rather than one nested value, because a
    session has no length limit. Sort by session_id, turn to read it.
    """
    turns = cut(_ordered_turns(messages), "turns")
    ranges = _ranges(turns)
    kept = _verdicts(ranges, sessions).where("dropped IS NULL").select("session_id")
    before = Window.partitionBy("session_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.join(kept, "session_id", "left_semi").select("session_id", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    numbered = turns.join(starts, ["session_id", "_range"]).select("session_id", "ordinal", "role", (F.col("_start") + F.col("_n") - 1).alias("turn"))
    # every delivery of a kept turn has the same text
    texts = messages.select("session_id", F.col("ordinal").cast("bigint").alias("ordinal"), "content").dropna(subset=["session_id", "ordinal"])
    texts = texts.groupBy("session_id", "ordinal").agg(F.first("content").alias("content"))
    return numbered.join(texts, ["session_id", "ordinal"]).select("session_id", "turn", "ordinal", "role", "content")


def _gaps(messages: DataFrame, channel: str, time: str, key: str) -> DataFrame:
    """Adds ``_gap``: seconds since the message before in the channel."""
    rows = with_previous(messages.where(F.col(channel).isNotNull()), [channel], time, key)
    return rows.withColumn("_gap", (F.unix_micros(time) - F.unix_micros("previous")) / F.lit(1e6)).drop("previous")


def calibrated_gap(messages: DataFrame, channel: str, time: str, key: str) -> float | None:
    """The inactivity gap, in seconds, that best parts pauses within sessions from those between.

    A histogram of the logarithms of all gaps (eight bins a doubling, so some
    hundreds of rows whatever the input) is cut where the variance between the
    two sides is largest. ``None`` if there are not two different gaps.
    """
    bins = (
        _gaps(messages, channel, time, key)
        .where("_gap > 0")
        .groupBy(F.floor(F.log2("_gap") * 8).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("b")
        .collect()
    )
    if len(bins) < 2:
        return None
    total, mass = sum(r.n for r in bins), sum(r.n * r.b for r in bins)
    best, at, n, m = -1.0, None, 0, 0
    for r, following in zip(bins, bins[1:]):
        n, m = n + r.n, m + r.n * r.b
        spread = (m / n - (mass - m) / (total - n)) ** 2 * n * (total - n)
        if spread > best:
            best, at = spread, (r.b + 1 + following.b) / 2
    return math.pow(2.0, at / 8)


def split_at_gaps(messages: DataFrame, channel: str, time: str, key: str, gap: float) -> DataFrame:
    """Adds ``part``: the number, from 0, of the session within its channel.

    A message opens a new part if ``gap`` seconds or more passed since the one
    before (by time, then ``key``). Rows without channel or time are left out:
    they cannot be placed.
    """
    opens = F.coalesce(F.col("_gap") >= gap, F.lit(False)).cast("bigint")
    rows = _gaps(messages, channel, time, key).withColumn("_new", opens)
    return running_sum(rows, [channel], time, key, "_new", "part").drop("_new", "_gap")


def rebuilt_sessions(messages: DataFrame, channel: str, time: str, key: str, role: str, content: str, hint: Column | None = None, gap: float | None = None) -> DataFrame:
    """Sessions of channels that hold many: channel, part, turn (from 0), role, inferred, time, key, content.

    Deliveries of one channel that are equal in role (without case and surrounding white
    space) and content and come at one time are one turn. Rows without channel, time or
    visible content are left out: they cannot be placed or say nothing. A channel is split
    where ``gap`` seconds (calibrated on the data if not given; without two different gaps
    nothing is split) passed without a message. A role that is neither user nor assistant is
    read from ``hint``, then inferred by taking turns from the last known one before, then
    from the first known one of the part; a part without any opens with the user. Parts
    in which not both speak are dropped.
    """
    read = F.when(plain(role).isin("user", "assistant"), plain(role))
    kind = F.coalesce(read, hint) if hint is not None else read
    rows = messages.where(F.col(channel).isNotNull() & F.col(time).isNotNull() & visible(content))
    turns = rows.groupBy(channel, time, F.coalesce(plain(role), F.lit("")).alias("_spelled"), content).agg(F.min(key).alias(key), F.max(kind).alias("_known"), F.max(read).alias("_read"))
    turns = cut(turns.drop("_spelled"), "turns")
    gap = calibrated_gap(turns, channel, time, key) if gap is None else gap
    parts = split_at_gaps(turns, channel, time, key, gap) if gap is not None else turns.withColumn("part", F.lit(0).cast("bigint"))
    scope = [channel, "part"]
    placed = running_sum(parts.withColumn("_one", F.lit(1).cast("bigint")), scope, time, key, "_one", "_n").drop("_one")
    placed = placed.withColumn("turn", F.col("_n") - 1).drop("_n")
    # user at even places: 0, at odd ones: 1; null where the role is not known
    phase = F.when(F.col("_known").isNotNull(), (F.col("turn") + (F.col("_known") == "assistant").cast("bigint")) % 2)
    placed = cut(carried_last(placed.withColumn("_own", phase), scope, time, key, "_own", "_phase"), "placed")
    first = placed.groupBy(*scope).agg(F.min_by("_own", F.when(F.col("_own").isNotNull(), F.col("turn"))).alias("_first"))
    said = placed.join(first, scope).withColumn("_phase", F.coalesce("_phase", "_first", F.lit(0)))
    said = said.withColumn("role", F.coalesce("_known", F.when((F.col("turn") + F.col("_phase")) % 2 == 0, "user").otherwise("assistant")))
    said = said.withColumn("inferred", F.col("_read").isNull())
    both = said.groupBy(*scope).agg(F.min("role").alias("a"), F.max("role").alias("b")).where("a < b").select(*scope)
    return said.join(both, scope, "left_semi").select(channel, "part", "turn", "role", "inferred", time, key, content)
