"""Versions: folding a log into items with history, comparing, repairing and removing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.changefeed import plain
from tessera.operators.ordered import running_sum, with_previous


def fold_versions(log: DataFrame, keys: list[str], seq: str, content: str, kind: Column | None = None, recorded: str = "recorded_at") -> DataFrame:
    """W2, replay: observations by ``seq`` are versions 1..n of their item, the last is current.

    Rows of one seq are one change. An item with a purge anywhere has no version;
    a deletion stamps ``deleted_at`` on the version current at that moment, the
    first deletion after a version counting. Output: keys, version, content,
    is_current, ingested_at, deleted_at.
    """
    kind = plain("event_type") if kind is None else kind
    rows = log.select(*keys, F.col(seq).alias("_seq"), kind.alias("_kind"), F.col(content).alias(content), F.col(recorded).alias("_at"))
    purged = rows.where("_kind = 'item_purged'").select(*keys).distinct()
    rows = rows.where("_seq IS NOT NULL AND _kind IN ('artifact_observed', 'item_deleted')").join(purged, keys, "left_anti")
    once = rows.groupBy(*keys, "_seq").agg(F.min("_kind").alias("_kind"), F.min(content).alias(content), F.min("_at").alias("_at"))
    observed = once.withColumn("_o", (F.col("_kind") == "artifact_observed").cast("bigint"))
    numbered = running_sum(observed, keys, "_seq", "_kind", "_o", "version")  # stretches of seq, so no item is one task
    per = numbered.where("version > 0").groupBy(*keys, "version").agg(
        F.min(F.when(F.col("_kind") == "artifact_observed", F.struct("_seq", content, "_at"))).alias("v"),
        F.min(F.when(F.col("_kind") == "item_deleted", F.struct("_seq", "_at"))).alias("d"),
    )
    newest = observed.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.sum("_o").alias("_newest"))
    both = per.join(newest, [per[k].eqNullSafe(newest[f"_{i}"]) for i, k in enumerate(keys)])
    return both.select(
        *keys, F.col("version").cast("int").alias("version"), F.col(f"v.{content}").alias(content),
        (F.col("version") == F.col("_newest")).alias("is_current"),
        F.col("v._at").alias("ingested_at"), F.col("d._at").alias("deleted_at"),
    )


def version_changes(versions: DataFrame, keys: list[str], text_hash: str, bytes_hash: str) -> DataFrame:
    """text_changed, bytes_changed against the version before (null for the first); adopted: same text, other bytes."""
    both = versions.withColumn("_now", F.struct(F.col(text_hash).alias("text"), F.col(bytes_hash).alias("bytes")))
    both = with_previous(both, keys, "version", text_hash, value="_now", out="_before")
    known = F.col("_before").isNotNull()
    out = both.withColumns(
        {
            "text_changed": F.when(known, ~F.col("_before.text").eqNullSafe(F.col(text_hash))),
            "bytes_changed": F.when(known, ~F.col("_before.bytes").eqNullSafe(F.col(bytes_hash))),
        }
    ).drop("_now", "_before")
    return out.withColumn("adopted", ~F.col("text_changed") & F.col("bytes_changed"))


def keyed_diff(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys that are missing, unexpected or changed between two tables: keys, difference.

    Keys are unique on each side and may be null; values compare null-safe.
    """
    e = expected.select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_ev"))
    a = actual.select(*[F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_av"))
    on = [F.col(f"_e{i}").eqNullSafe(F.col(f"_a{i}")) for i in range(len(keys))]
    both = e.join(a, on, "full_outer")
    label = (
        F.when(F.col("_av").isNull(), "missing")
        .when(F.col("_ev").isNull(), "unexpected")
        .when(~F.col("_ev").eqNullSafe(F.col("_av")), "changed")
    )
    return both.select(*[F.coalesce(f"_e{i}", f"_a{i}").alias(k) for i, k in enumerate(keys)], label.alias("difference")).where("difference IS NOT NULL")


def follow_chain(links: DataFrame, key: str, target: str, max_hops: int = 8) -> DataFrame:
    """Where following ``target`` from each key ends: key, final, hops; final is null if still open after ``max_hops``.

    ``links`` has one row per key; a null or unknown target ends the chain. A
    fixed number of self-joins, so cycles end too.
    """
    step = links.select(F.col(key).alias("_k"), F.col(target).alias("_t")).where("_t IS NOT NULL")
    out = links.select(F.col(key).alias("key"), F.col(key).alias("final"), F.lit(0).alias("hops"), F.col(target).isNotNull().alias("_open"))
    for _ in range(max_hops):
        out = out.join(step, out["final"] == step["_k"], "left").select(
            "key", F.coalesce("_t", "final").alias("final"), (F.col("hops") + F.col("_t").isNotNull().cast("int")).alias("hops"), F.col("_t").isNotNull().alias("_open")
        )
    still = step.select(F.col("_k").alias("_o"))
    return out.join(still, out["final"] == still["_o"], "left").select("key", F.when(F.col("_o").isNull(), F.col("final")).alias("final"), "hops")
