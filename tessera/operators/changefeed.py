"""Applying a stream of inserts, updates and deletes.

Every change is a function from the state of a row to its next state. Such
functions are kept as *patches*, small records that compose associatively, so a
feed can be reduced in any grouping: first within ranges of the sequence number,
even inside one hot key, then over the ranges of a key. The one patch left per
key is applied to the base table.

A patch holds, per key: whether the key was purged; the last change that set or
removed the whole row; and for every value column the last change that wrote it.
Each part is a maximum by sequence number, hence associative, commutative and
idempotent: repeated and out-of-order rows change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Kinds of change: replace the row, write its non-null columns, remove it, remove it for ever.
PUT, MERGE, DROP, PURGE = "put", "merge", "drop", "purge"


def change_patches(
    feed: DataFrame, keys: list[str], seq: str, kind: Column, values: list[str], chunk: int = 1 << 20
) -> DataFrame:
    """One patch per key: ``keys`` and ``_purged``, ``_row``, ``_cells``.

    ``kind`` gives PUT, MERGE, DROP, PURGE or null per row. A row without a
    sequence number or kind is a repeat or no change and is ignored, except that
    a purge counts wherever it stands. Rows of one sequence number are the same
    change; should they differ after all, the larger value wins. Keys may be
    null: nulls are equal to each other here. ``chunk`` is the length of the
    ranges of sequence numbers that are reduced first.
    """
    written = F.col("_kind").isin(PUT, MERGE)
    rows = feed.select(
        *[F.col(k) for k in keys], F.col(seq).cast("bigint").alias("_seq"), kind.alias("_kind"),
        *[F.col(v).alias(f"_v_{v}") for v in values],
    ).where((F.col("_kind") == PURGE) | (F.col("_seq").isNotNull() & F.col("_kind").isNotNull()))
    whole = F.when(F.col("_kind").isin(PUT, DROP), F.struct(F.col("_seq").alias("seq"), (F.col("_kind") == PUT).alias("put")))
    cells = {
        f"_c_{v}": F.max(
            F.when(
                (F.col("_kind") == PUT) | (written & F.col(f"_v_{v}").isNotNull()),
                F.struct(F.col("_seq").alias("seq"), F.col(f"_v_{v}").alias("value")),
            )
        )
        for v in values
    }
    step = rows.groupBy(*keys, F.floor(F.col("_seq") / F.lit(chunk)).alias("_range")).agg(
        F.max(F.col("_kind") == PURGE).alias("_purged"),
        F.max(whole).alias("_row"),
        *[c.alias(n) for n, c in cells.items()],
    )
    return step.groupBy(*keys).agg(
        F.max("_purged").alias("_purged"), F.max("_row").alias("_row"), *[F.max(n).alias(n) for n in cells]
    )


def apply_patches(patches: DataFrame, keys: list[str], values: list[str], base: DataFrame | None = None) -> DataFrame:
    """The rows in view after the patches: ``keys`` and ``values``.

    Without ``base`` the table starts empty, and MERGE of a row that is not there
    has nothing to change. With it, keys that no patch names keep their row. A
    base key must be unique.
    """
    p = patches
    if base is not None:
        held = base.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.struct(*values).alias("_base"))
        same = [p[k].eqNullSafe(held[f"_b_{k}"]) for k in keys]
        p = p.join(held, same, "full_outer").select(
            *[F.coalesce(F.col(k), F.col(f"_b_{k}")).alias(k) for k in keys],
            "_purged", "_row", *[f"_c_{v}" for v in values], "_base",
        )
    there = F.col("_row.put") if base is None else F.coalesce(F.col("_row.put"), F.col("_base").isNotNull())
    out = p.where(~F.coalesce(F.col("_purged"), F.lit(False)) & F.coalesce(there, F.lit(False)))

    def value(v: str) -> Column:
        cell = F.col(f"_c_{v}")
        reset = F.col("_row.seq")
        now = F.when(cell["seq"] >= reset, cell["value"])
        if base is None:
            return now
        return F.when(reset.isNotNull(), now).otherwise(F.coalesce(cell["value"], F.col(f"_base.{v}")))

    return out.select(*keys, *[value(v).alias(v) for v in values])


def apply_changes(
    feed: DataFrame, keys: list[str], seq: str, kind: Column, values: list[str],
    base: DataFrame | None = None, chunk: int = 1 << 20,
) -> DataFrame:
    """The current state of the table after every change of ``feed``; see the two steps above."""
    return apply_patches(change_patches(feed, keys, seq, kind, values, chunk), keys, values, base)


def plain(column: str) -> Column:
    """A word without letter case and surrounding white space of any kind."""
    return F.lower(F.regexp_replace(F.col(column), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def item_log_kind() -> Column:
    """Kinds of the item log: an observation with ``deleted_at`` filled takes the item out of view."""
    word = plain("event_type")
    return (
        F.when(word == "artifact_observed", F.when(F.col("deleted_at").isNull(), PUT).otherwise(DROP))
        .when(word == "item_deleted", DROP)
        .when(word == "item_purged", PURGE)
    )


def items_in_view(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Items in view at the end of the log: source_name, external_key, version, content_hash."""
    return apply_changes(
        log, ["source_name", "external_key"], "seq", item_log_kind(), ["version", "content_hash"], base
    )
