"""The event operators on unbounded input."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.session import remove_at_exit, shared_folder


def read_stream(spark: SparkSession, folder: str, name: str, files: int | None = None) -> DataFrame:
    """A table's files as a stream, the timestamps cast as in batch.

    ``files`` bounds a micro-batch, and with it what the stateful operators sort at
    once; without it all files there are make one batch.
    """
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern, because the file source takes a plain path for a folder
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    df = reader.parquet(f"{folder}/{name}.parque[t]")
    casts = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df


def run_available(df: DataFrame, mode: str, each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all input there is and returns what it wrote.

    ``complete`` and ``update`` results are kept as one folder per batch; of
    ``complete`` the last counts. Batches are written by number, so a batch that is
    run again after a failure replaces itself.
    """
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/tessera/stream-{uuid.uuid4().hex}"
    remove_at_exit(spark, base)

    def write(batch: DataFrame, n: int) -> None:
        (each(batch, n) if each else batch).write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).scalar())
    return out.drop("batch")


def tumbling(df: DataFrame, at: str, key: str, width: str, late: str = "1 day") -> DataFrame:
    """ST14: counts per window and key, rows later than ``late`` given up."""
    w = F.window(at, width)
    return df.withWatermark(at, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sliding(df: DataFrame, at: str, key: str, width: str, step: str, late: str = "1 day") -> DataFrame:
    """ST14: as :func:`tumbling`, a window beginning every ``step``."""
    w = F.window(at, width, step)
    return df.withWatermark(at, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def session_counts(df: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """ST5, ST14: Spark's session windows. Events exactly the gap apart stay together here, unlike :func:`sessionize`."""
    w = F.session_window(at, gap)
    return df.withWatermark(at, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def pending_dedupe(df: DataFrame, key: list[str], event: str, processed: str) -> DataFrame:
    """ST2: each event with the one it stands for: itself, or the pending one of its key.

    A row with ``processed`` true closes the pending event of its key, whose state then
    goes. Rows of a key are taken in the order of ``event`` within a micro-batch, two
    columns of which are held; ``maxFilesPerTrigger`` of the source bounds it.
    """
    kinds = dict(df.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = state.get[0] if state.exists else -1
        rows = pd.concat([f[[event, processed]] for f in frames]).sort_values(event)
        stands = []
        for e, done in zip(rows[event].tolist(), rows[processed].tolist()):
            if done:
                stands.append(pending if pending >= 0 else e)
                pending = -1
            else:
                pending = e if pending < 0 else pending
                stands.append(pending)
        if pending >= 0:
            state.update((pending,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({event: rows[event].to_numpy(), "stands_for": stands})

    return df.groupBy(*key).applyInPandasWithState(step, f"{event} {kinds[event]}, stands_for long", "pending long", "append", GroupStateTimeout.NoTimeout)


def debounce_stream(df: DataFrame, key: str, event: str, at: str, seconds: float = 30) -> DataFrame:
    """ST4 on a stream: events that may be emitted; per key only the time of the last emission is kept."""
    kinds, width = dict(df.dtypes), int(seconds * 1_000_000)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat([f[["_us", event]] for f in frames]).sort_values(["_us", event])
        out = []
        for e, t in zip(rows[event].tolist(), rows["_us"].tolist()):
            if last is None or t - last >= width:
                out.append(e)
                last = t
        state.update((last,))
        yield pd.DataFrame({event: pd.Series(out, dtype="int64")})

    timed = df.where(F.col(at).isNotNull()).withColumn("_us", F.unix_micros(at))
    return timed.groupBy(key).applyInPandasWithState(step, f"{event} {kinds[event]}", "last long", "append", GroupStateTimeout.NoTimeout)


def dispatch(events: DataFrame, handlers: DataFrame, kind: str, event: str) -> DataFrame:
    """ST7: one job per subscribed handler, with its key for deduplication. ``handlers``: kind, handler."""
    h = handlers.select(F.col("kind").alias(kind), "handler")
    return events.join(h, kind).select(event, "handler", F.concat(F.col(event).cast("string"), F.lit(":"), "handler").alias("dedupe_key"))


def stream_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, within: str, late: str = "1 day") -> DataFrame:
    """ST14: rows of two streams of one key, the right at most ``within`` after the left; state ends with the watermark."""
    a = left.withWatermark(left_at, late)
    b = right.withWatermark(right_at, late).withColumnRenamed(key, "_k")
    near = (F.col(key) == F.col("_k")) & (F.col(right_at) >= F.col(left_at)) & (F.col(right_at) <= F.col(left_at) + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).drop("_k")
