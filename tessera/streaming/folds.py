"""Decisions that depend on the decisions before: a fold over sorted rows, in bounded memory.

Keys are first cut into stretches that cannot influence each other (a pause as
long as the window resets every rule here), so a hot key is not one task either.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.operators.ordered import running_sum, with_previous


def stretches(df: DataFrame, scope: list[str], at: str, tie: str, seconds: float) -> DataFrame:
    """Adds ``stretch``: a new one begins after a pause of at least ``seconds``."""
    rows = with_previous(df, scope, at, tie)
    pause = F.unix_micros(at) - F.unix_micros("previous")
    opens = (F.col("previous").isNull() | (pause >= int(seconds * 1_000_000))).cast("bigint")
    return running_sum(rows.withColumn("_o", opens), scope, at, tie, "_o", "stretch").drop("_o", "previous")


def fold(df: DataFrame, scope: list[str], at: str, tie: str, out: str, start: Callable[[], Callable[[int], bool]]) -> DataFrame:
    """Adds boolean ``out``: what ``start()`` says, called with the microseconds of each row in order.

    Rows come sorted and batch by batch; only the state of the current key is held.
    """
    by = [*scope, "stretch"]
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BooleanType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, decide = None, None
        for f in frames:
            said = []
            for k, t in zip(f[by].itertuples(index=False, name=None), f["_us"].tolist()):
                k = tuple(None if pd.isna(x) else x for x in k)
                if k != key:
                    key, decide = k, start()
                said.append(decide(t))
            yield f.drop(columns="_us").assign(**{out: said})

    ready = df.withColumn("_us", F.unix_micros(at)).repartition(*by).sortWithinPartitions(*by, at, tie)
    return ready.mapInPandas(run, schema)


def debounce(df: DataFrame, key: str, at: str, tie: str, seconds: float = 30) -> DataFrame:
    """ST4: adds ``emit``: true for the first event of a burst. Suppressed events do not lengthen the window."""
    width = int(seconds * 1_000_000)

    def start() -> Callable[[int], bool]:
        last: list[int] = []

        def decide(t: int) -> bool:
            if last and t - last[0] < width:
                return False
            last[:] = [t]
            return True

        return decide

    return fold(stretches(df, [key], at, tie, seconds), [key], at, tie, "emit", start).drop("stretch")


def rate_limit(df: DataFrame, key: str, at: str, tie: str, most: int = 60, seconds: float = 60) -> DataFrame:
    """ST3: adds ``accepted``: false while ``most`` accepted events lie less than ``seconds`` back. Rejected ones do not count."""
    width = int(seconds * 1_000_000)

    def start() -> Callable[[int], bool]:
        held: deque[int] = deque()

        def decide(t: int) -> bool:
            while held and t - held[0] >= width:
                held.popleft()
            if len(held) >= most:
                return False
            held.append(t)
            return True

        return decide

    return fold(stretches(df, [key], at, tie, seconds), [key], at, tie, "accepted", start).drop("stretch")


def trailing_count(df: DataFrame, key: str, at: str, seconds: float = 60) -> DataFrame:
    """ST3: adds ``in_window``: events of the key in the trailing window, this one and its peers included; null without a time.

    What has come up to a time less what had come before its window, both read off
    one running sum in buckets, so a hot key is no task of its own.
    """
    known = df.where(F.col(at).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(at).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.timestamp_micros(F.unix_micros("_at") - int(seconds * 1_000_000) - 1)
    asked = known.select("_k", before.alias("_x"), F.lit(0).cast("bigint").alias("_n"), F.lit(1).alias("_kind"), "_at")
    points = known.select("_k", F.col("_at").alias("_x"), "_n", F.lit(0).alias("_kind"), "_at").unionByName(asked)
    summed = running_sum(points, ["_k"], "_x", "_kind", "_n", "_c")
    both = summed.groupBy("_k", "_at").agg(F.sum(F.when(F.col("_kind") == 0, F.col("_c")).otherwise(-F.col("_c"))).alias("in_window"))
    return df.join(both, df[key].eqNullSafe(both["_k"]) & (df[at] == both["_at"]), "left").drop("_k", "_at")
