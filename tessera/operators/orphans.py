"""References to records that do not exist.

A reference holds if its key has a parent row that was known at the time of the
reference and not yet removed. Orphans get one of three states:

``missing``  no parent row has the key at all;
``late``     every parent row of the key became known after the reference;
``deleted``  the latest parent row known by then had already been removed.

Method: a Bloom filter over the parent keys, of a size fixed beforehand, goes to
every executor and proves definite orphans without a shuffle. Where the keys are
more than one filter holds, keys and references are parted by ranges of the key's
hash and each range has its own filter, so the share proved does not fall with the
number of keys. Only references that pass are joined exactly, against one
pre-aggregated row per key, and only those that fall between two versions of their
key need the as-of step, which works in buckets of time so that no key is ever held
by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import bloom
from tessera.session import cut

def _beginning() -> Column:
    return F.lit("0001-01-01").cast("timestamp")


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    on: dict[str, str],
    carry: list[str],
    at: str | None = None,
    since: str | None = None,
    until: str | None = None,
    order: str | None = None,
    expected_keys: int | None = None,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """The rows of ``refs`` whose reference does not hold: ``carry`` and ``state``.

    ``on`` maps reference columns to parent columns. ``at`` is the time of the
    reference; ``since`` and ``until`` say when a parent row became known and
    when it was removed; ``order`` breaks ties of ``since``. Without ``since``
    only ``missing`` can occur.

    A null in any reference column is no reference and gives no row; a parent
    row with a null key column answers nothing; a null ``since`` means known from
    the beginning; with a null ``at`` nothing is late, the latest parent row
    counts and any ``until`` makes the reference ``deleted``. Repeated rows give
    repeated results (deduplicate the output if ids repeat); an empty parent
    table makes every reference ``missing``. Other columns of either side,
    whatever their names, are ignored.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    r = refs.select(
        *[F.col(c).alias(k) for k, c in zip(keys, on)],
        (F.col(at) if at else F.lit(None)).cast("timestamp").alias("_t"),
        F.struct(*carry).alias("_ref"),
    ).dropna(subset=keys)
    p = parents.select(
        *[F.col(c).alias(k) for k, c in zip(keys, on.values())],
        F.struct(
            (F.coalesce(F.col(since), _beginning()) if since else _beginning()).alias("since"),
            (F.col(order) if order else F.lit(0)).alias("order"),
            (F.col(until) if until else F.lit(None)).cast("timestamp").alias("until"),
        ).alias("_v"),
    ).dropna(subset=keys)

    size = parents.count() if expected_keys is None else expected_keys
    packed = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    r = _tested(r, p, packed, size)
    certain = r.where(~F.col("_maybe")).select("_ref.*", F.lit("missing").alias("state"))

    per_key = p.groupBy(*keys).agg(F.min("_v.since").alias("_first"), F.max("_v").alias("_last"))
    joined = r.where("_maybe").drop("_maybe").join(per_key, keys, "left")
    t, last = F.col("_t"), F.col("_last")
    joined = joined.withColumn(
        "state",
        F.when(last.isNull(), "missing")
        .when(t.isNull(), F.when(last["until"].isNotNull(), "deleted"))
        .when(F.col("_first") > t, "late")
        .when(last["since"] <= t, F.when(last["until"] <= t, "deleted"))
        .otherwise("between"),
    )
    if since is None:
        return certain.unionByName(joined.where("state IS NOT NULL").select("_ref.*", "state"))
    # read several times below, and only these rows: written once
    judged = cut(joined.where("state IS NOT NULL").select(*keys, "_t", "_ref", "state"), "judged")
    settled = judged.where("state <> 'between'").select("_ref.*", "state")
    between = judged.where("state = 'between'").drop("state")
    return certain.unionByName(settled).unionByName(_as_of(between, p, keys, bucket_seconds))


def _tested(refs: DataFrame, parents: DataFrame, key: Column, size: int) -> DataFrame:
    """``refs`` with ``_maybe``: false only if no parent has the key.

    With several ranges both sides are written once in a folder per range, without
    a shuffle, and every filter meets only the references of its own range; a key
    that fills a third of them stays spread over the files of its folder.
    """
    n = bloom.ranges(size)
    if n == 1:
        return refs.withColumn("_maybe", bloom.might_contain(bloom.build(parents, key, size), key))
    r = cut(refs.withColumn("_range", bloom.range_of(key, n)), "references", by=["_range"])
    p = cut(parents.select(key.alias("_key"), bloom.range_of(key, n).alias("_range")), "parents", by=["_range"])
    out = None
    for i in range(n):
        known = bloom.build(p.where(F.col("_range") == i), F.col("_key"), bloom.KEYS)
        part = r.where(F.col("_range") == i).drop("_range").withColumn("_maybe", bloom.might_contain(known, key))
        out = part if out is None else out.unionByName(part)
    return out


def _bucket(t: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(t) / F.lit(seconds))


def _as_of(refs: DataFrame, versions: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """References removed already in the version that stood at ``_t``.

    Versions and references of a key meet in buckets of time. A bucket that has
    references also gets the last version of the buckets before it, found from
    one row per key and bucket, so rows of a hot key are spread over its buckets.
    """
    by = [*keys, "_b"]
    r = refs.withColumn("_b", _bucket(F.col("_t"), seconds))
    v = versions.withColumn("_b", _bucket(F.col("_v.since"), seconds))
    asked = r.select(*by).distinct()
    v = v.join(r.select(*keys).distinct(), keys, "left_semi")
    last = v.groupBy(*by).agg(F.max("_v").alias("_v"))
    steps = last.unionByName(asked.withColumn("_v", F.lit(None).cast(last.schema["_v"].dataType)))
    steps = steps.groupBy(*by).agg(F.max("_v").alias("_v"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("_v", F.last("_v", ignorenulls=True).over(before)).dropna(subset=["_v"])
    entries = v.select(*by, "_v").unionByName(carried.select(*by, "_v")).join(asked, by, "left_semi")
    timeline = entries.select(*by, F.col("_v.since").alias("_t"), F.lit(0).alias("_kind"), "_v").unionByName(
        r.select(*by, "_t", F.lit(1).alias("_kind"), "_ref"), allowMissingColumns=True
    )
    so_far = Window.partitionBy(*by).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        timeline.withColumn("_v", F.max("_v").over(so_far))
        .where((F.col("_kind") == 1) & (F.col("_v.until") <= F.col("_t")))
        .select("_ref.*", F.lit("deleted").alias("state"))
    )


def evidence_orphans(evidence: DataFrame, memories: DataFrame, sources: DataFrame) -> DataFrame:
    """All references of evidence rows that do not hold: evidence_id, field, state, linked_at.

    ``memory_id`` refers to one version, ``source_name`` to a source, and
    ``external_key`` (judged only where the source exists) to an item of it.
    One distinct row per failing reference, however often the row is repeated.
    """
    carry = ["evidence_id", "linked_at"]
    size = memories.count()
    e = evidence.select("evidence_id", "memory_id", "source_name", "external_key", "linked_at")
    items = memories.select("source_id", "external_key", "version", "ingested_at", "deleted_at").join(
        sources.select("source_id", "source_name").dropna().distinct(), "source_id"
    )
    named = sources.select("source_name").distinct()
    by_version = orphan_references(
        e, memories, {"memory_id": "memory_id"}, carry,
        at="linked_at", since="ingested_at", until="deleted_at", order="version", expected_keys=size,
    )
    by_source = orphan_references(e, named, {"source_name": "source_name"}, carry)
    by_item = orphan_references(
        e.join(named, "source_name", "left_semi"), items,
        {"source_name": "source_name", "external_key": "external_key"}, carry,
        at="linked_at", since="ingested_at", until="deleted_at", order="version", expected_keys=size,
    )
    parts = {"memory_id": by_version, "source_name": by_source, "external_key": by_item}
    out = None
    for field, part in parts.items():
        part = part.withColumn("field", F.lit(field))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per referenced table, field, state and month of ``linked_at`` (null: no date)."""
    table = F.when(F.col("field") == "source_name", "sources").otherwise("memories")
    return orphans.groupBy(
        table.alias("parent_table"),
        "field",
        "state",
        F.date_format("linked_at", "yyyy-MM").alias("month"),
    ).agg(F.count(F.lit(1)).alias("orphans"))
