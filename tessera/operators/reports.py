"""Reports over a whole corpus: what a purge would take, what is unhealthy, what is connected, what an export holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.relational import top_per
from tessera.session import cut


def _n() -> Column:
    return F.count(F.lit(1))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def purge_scope(items: DataFrame, versions: DataFrame, chunks: DataFrame, mentions: DataFrame, tags: DataFrame, turns: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """What goes if ``items`` (``keys``) are purged: what, n.

    ``versions``: keys, memory_id, content_hash; ``chunks``: memory_id, chunk_id, embedded; ``mentions`` and ``tags``:
    memory_id and entity or name; ``turns``: external_key, message_id; ``evidence``: memory_id, evidence_id. Entities
    are orphaned if no version that stays mentions them; a blob is owned if only what goes has its hash, else shared.
    An empty scope counts 0 everywhere; nulls refer to nothing.
    """
    scope = items.select(*keys).dropna().distinct()
    gone = cut(versions.select(*keys, "memory_id", "content_hash").distinct().join(scope, keys, "left_semi"), "scope")
    ids = gone.select("memory_id").dropna().distinct()
    mine = lambda df: df.join(ids, "memory_id", "left_semi")
    stay = versions.join(scope, keys, "left_anti")
    named = mine(mentions).select("entity").distinct()
    kept = mentions.join(ids, "memory_id", "left_anti").select("entity").distinct()
    hashes = gone.select("content_hash").dropna().distinct()
    shared = hashes.join(stay.select("content_hash"), "content_hash", "left_semi")
    held = mine(chunks).select("chunk_id", "embedded").distinct()
    counts = {
        "items": scope, "versions": ids, "chunks": held.select("chunk_id").distinct(), "embedded chunks": held.where("embedded").select("chunk_id").distinct(),
        "mentions": mine(mentions).select("memory_id", "entity").distinct(), "tags": mine(tags).select("memory_id", "name").distinct(),
        "chat turns": turns.join(scope.select("external_key").distinct(), "external_key", "left_semi").select("message_id").distinct(),
        "evidence links": mine(evidence).select("evidence_id").distinct(), "orphaned entities": named.join(kept, "entity", "left_anti"),
        "owned blobs": hashes.join(stay.select("content_hash"), "content_hash", "left_anti"), "shared blobs": shared,
    }
    return _union([df.agg(_n().alias("n")).select(F.lit(what).alias("what"), "n") for what, df in counts.items()])


def checks(found: dict[str, DataFrame], examples: int = 3) -> DataFrame:
    """Per check (name to the ids that fail it, one column): check, n, examples (the first ids by order, joined).

    A check that nothing fails has n 0 and no examples.
    """
    rows = _union([df.select(F.lit(name).alias("check"), F.col(df.columns[0]).cast("string").alias("id")).distinct() for name, df in found.items()])
    names = rows.sparkSession.createDataFrame([(n,) for n in found], "check string")
    count = rows.groupBy("check").agg(_n().alias("n"))
    few = top_per(rows, ["check"], [F.asc("id")], examples).groupBy("check").agg(F.concat_ws(", ", F.sort_array(F.collect_list("id"))).alias("examples"))
    return names.join(count, "check", "left").join(few, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.lit("")).alias("examples"))


def sections(parts: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """One row per metric of each section: section, metric, value. Each metric is a table of one number."""
    return _union([df.select(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(df.columns[0]).cast("double").alias("value")) for s, metrics in parts.items() for m, df in metrics.items()])


def connections(items: DataFrame, links: DataFrame, live: DataFrame) -> DataFrame:
    """Other live items, known no later, that share an entity with each of ``items``: item, entity, items, total.

    ``links``: item, entity (mentioned or tagged, merges resolved; repeats count once); ``live``: item, at. The total
    counts each other item once, however many entities it shares.
    """
    known = links.dropna().distinct().join(live, "item")
    mine = items.select("item").distinct().join(known, "item").select(F.col("item").alias("of"), "entity", F.col("at").alias("until"))
    met = known.join(mine, "entity").where("item <> of AND at <= until")
    per = met.groupBy("of", "entity").agg(_n().alias("items"))
    total = met.groupBy("of").agg(F.countDistinct("item").alias("total"))
    return per.join(total, "of").select(F.col("of").alias("item"), "entity", "items", "total")


def export_items(versions: DataFrame, tags: DataFrame, chunks: DataFrame, keys: list[str], columns: list[str], batch: int = 100) -> DataFrame:
    """One JSON object per item and ``batch`` of its versions: keys, batch (from 0), json.

    Versions are nested in order with their ``columns``, tags (sorted) and number of chunks. An item with more
    versions than a batch has several rows, so no value grows with a history.
    """
    t = tags.groupBy("memory_id").agg(F.sort_array(F.collect_set("name")).alias("tags"))
    c = chunks.groupBy("memory_id").agg(F.countDistinct("chunk_id").alias("chunks"))
    v = versions.join(t, "memory_id", "left").join(c, "memory_id", "left")
    one = F.struct("version", *columns, F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    number = F.floor((F.col("version") - 1) / batch).cast("int")
    nested = v.select(*keys, number.alias("batch"), one.alias("v")).groupBy(*keys, "batch").agg(F.sort_array(F.collect_list("v")).alias("versions"))
    return nested.select(*keys, "batch", F.to_json(F.struct(*keys, "versions")).alias("json"))


def stages(messages: DataFrame, items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Q13: how far each message (message_id, external_key) has come: message_id, chunks, embedded, stage.

    ``items``: external_key, memory_id; ``chunks``: memory_id, chunk_id, embedded. A message without a key was not
    taken in; the stage follows from the chunks of all versions under its key.
    """
    c = chunks.distinct().groupBy("memory_id").agg(_n().alias("chunks"), F.count_if("embedded").alias("embedded"))
    per = items.select("external_key", "memory_id").distinct().join(c, "memory_id", "left").groupBy("external_key").agg(
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("embedded"), F.lit(0)).alias("embedded")
    )
    m = messages.select("message_id", "external_key").distinct().join(per, "external_key", "left")
    stage = (
        F.when(F.col("external_key").isNull(), "not taken in").when(F.col("chunks").isNull(), "waiting")
        .when(F.col("chunks") == 0, "chunking").when(F.col("embedded") < F.col("chunks"), "embedding").otherwise("ready")
    )
    return m.select("message_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("embedded", F.lit(0)).alias("embedded"), stage.alias("stage"))

