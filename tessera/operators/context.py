"""From results to a prompt: contexts, packing, intent, judged evaluation, discovery."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.scores import emittable, pattern_confidence, rrf_term
from tessera.functions.text import temporal_intent
from tessera.operators.graph import nearest
from tessera.operators.relational import SearchFilters, top_per
from tessera.operators.retrieval import rrf
from tessera.session import cut

PROMPT_TOKENS = 6000


def pack_prompt(hits: DataFrame, by: str, key: str, score: str, tokens: str, budget: int = PROMPT_TOKENS) -> DataFrame:
    """The best hits numbered [1..n] while they fit; what is too long is skipped, the rest goes on.

    All hits of a request stream through sorted batches in order of score; only the room that is left is held.
    """
    kinds = dict(hits.dtypes)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        request, left, number = object(), 0, 0
        for f in frames:
            keep, numbers = [], []
            for i, (r, t) in enumerate(zip(f[by].astype(object).where(f[by].notna(), None).tolist(), f["_t"].tolist())):
                if r != request:
                    request, left, number = r, budget, 0
                if t <= left:
                    left, number = left - t, number + 1
                    keep.append(i), numbers.append(number)
            yield f.iloc[keep][[by, key]].assign(number=numbers)

    every = hits.select(by, key, F.coalesce(score, F.lit(0.0)).alias("_s"), F.coalesce(tokens, F.lit(0)).alias("_t"))
    ordered = every.repartition(by).sortWithinPartitions(by, F.desc("_s"), F.asc(key))
    return ordered.mapInPandas(fold, f"{by} {kinds[by]}, {key} {kinds[key]}, number int")


def apply_intent(query: str, filters: SearchFilters, now: datetime, recency_weight: float = 0.15) -> tuple[SearchFilters, float, str | None]:
    """Filters tightened by a range (later start, earlier end), recency weight raised to 0.5 by a relative
    phrase, and the date order asked for."""
    t = temporal_intent(query, now)
    if t is None:
        return filters, recency_weight, None
    if t["kind"] == "range":
        starts = [x for x in (filters.occurred_after, t["start"] and t["start"].isoformat(sep=" ")) if x]
        ends = [x for x in (filters.occurred_before, t["end"] and t["end"].isoformat(sep=" ")) if x]
        tight = SearchFilters(filters.source_ids, filters.kinds, max(starts, default=None), min(ends, default=None), filters.include_deleted, filters.tags)
        return tight, recency_weight, None
    return filters, 0.5 if t["kind"] == "relative" else recency_weight, t["ordering"]


def context_lists(hits: DataFrame, items: DataFrame, evidence: DataFrame, mentions: DataFrame, by: str, k: int = 30, seeds: int = 5) -> DataFrame:
    """The five rankings of a request's context: ranking, by, id, rank.

    ``retrieval``: best score of what was found; ``recency``: the same by date; ``graph``: items near the best
    ``seeds`` by rare entities; ``name``: other items whose key ends in the same file name as something found, by the
    best rank that shares it; ``decisions``: decisions by the sum of 1 / (60 + rank) of the found items they rest on, under ids
    that begin with ``decision/``. ``hits``: by, memory_id, score; ``items``: memory_id, external_key, occurred_at;
    ``evidence``: decision_id, memory_id; ``mentions``: item, entity. Each ranking is cut at ``k``; nulls name nothing.
    """
    best = hits.where(F.col("memory_id").isNotNull()).groupBy(by, "memory_id").agg(F.max("score").alias("score"))
    known = items.select("memory_id", "occurred_at", F.regexp_extract("external_key", "[^/]+$", 0).alias("_name")).distinct()
    found = best.join(known, "memory_id", "left")
    lists = {"retrieval": top_per(found, [by], [F.desc_nulls_last("score"), F.asc("memory_id")], k), "recency": top_per(found, [by], [F.desc_nulls_last("occurred_at"), F.asc("memory_id")], k)}
    first = cut(lists["retrieval"].select(by, "memory_id", "_name", "rank"), "retrieval")
    out = None
    for name in lists:
        part = lists[name].select(F.lit(name).alias("ranking"), by, F.col("memory_id").alias("id"), "rank")
        out = part if out is None else out.unionByName(part)
    start = first.where(F.col("rank") <= seeds).select(by, F.col("memory_id").alias("item"))
    none = hits.sparkSession.createDataFrame([], "subject string, object string")
    graph = nearest(mentions, none, start, best.select(by, F.col("memory_id").alias("item")), [by], k, 1).withColumnRenamed("item", "memory_id")
    named = first.where("_name <> ''").groupBy(by, "_name").agg(F.min("rank").alias("_best"))
    alike = named.join(known.select("memory_id", "_name"), "_name").join(best.select(by, "memory_id"), [by, "memory_id"], "left_anti")
    alike = top_per(alike.groupBy(by, "memory_id").agg(F.min("_best").alias("_best")), [by], [F.asc("_best"), F.asc("memory_id")], k)
    rests = evidence.select("decision_id", "memory_id").dropna().distinct().join(first, "memory_id")
    rests = rests.groupBy(by, F.concat(F.lit("decision/"), F.col("decision_id").cast("string")).alias("memory_id")).agg(F.round(F.sum(rrf_term(F.col("rank"))), 12).alias("score"))
    rests = top_per(rests, [by], [F.desc("score"), F.asc("memory_id")], k)
    for name, part in (("graph", graph), ("name", alike), ("decisions", rests)):
        out = out.unionByName(part.select(F.lit(name).alias("ranking"), by, F.col("memory_id").alias("id"), "rank"))
    return out


#: The rankings of a context count alike.
CONTEXT = {"retrieval": 1.0, "recency": 1.0, "graph": 1.0, "name": 1.0, "decisions": 1.0}


def context_rankings(hits: DataFrame, items: DataFrame, evidence: DataFrame, mentions: DataFrame, by: str, k: int = 30) -> DataFrame:
    """:func:`context_lists` fused: by, id, score, rank."""
    return rrf(context_lists(hits, items, evidence, mentions, by, k), CONTEXT, [by])


def resolved(edges: DataFrame, a: str, b: str, merges: DataFrame) -> DataFrame:
    """Edges with both ends pointed at what they were merged into (one level), self-loops taken out. ``merges``: loser, winner."""
    m1, m2 = (merges.select(F.col("loser").alias(f"_l{i}"), F.col("winner").alias(f"_w{i}")) for i in (1, 2))
    out = edges.join(m1, edges[a] == m1["_l1"], "left").join(m2, edges[b] == m2["_l2"], "left")
    rest = [c for c in edges.columns if c not in (a, b)]
    return out.select(F.coalesce("_w1", a).alias(a), F.coalesce("_w2", b).alias(b), *rest).where(F.col(a) != F.col(b))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` put in place of those of equal keys; rows of one key must be one. Idempotent."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def discovered(counts: DataFrame, known: DataFrame, least: int = 4) -> DataFrame:
    """Statements (key, support, against) that the evidence carries, less those dismissed before; silent on the rest."""
    said = counts.where(emittable(F.col("support"), F.col("against"), least))
    said = said.withColumn("confidence", F.round(pattern_confidence(F.col("support"), F.col("against"), least), 6))
    return said.join(known.where("dismissed").select("key"), "key", "left_anti")


#: What a facet needs, and from which share a group of assumptions is weak or strong and a week is worked through or rested in.
FACET_SUPPORT, WEAK, STRONG, WORKED, RESTED = 3, 0.5, 0.8, 0.4, 0.1


def user_facets(patterns: DataFrame, groups: DataFrame, weeks: DataFrame, pairs: DataFrame) -> DataFrame:
    """What the evidence says of a user: key, value, support, against; only with enough support, and more than against.

    Four sources: ``patterns`` (grp, support, against) recur; ``groups`` of assumptions (grp, held, broke) are weak or strong by the
    share that held; ``weeks`` (weekend_share) tell whether weekends are worked or rested, one facet for all; ``pairs`` (a, b, n) go together.
    """
    rate = F.try_divide(F.col("held").cast("double"), F.col("held") + F.col("broke"))
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), c.cast("string"))
    row = lambda df, key, value, support, against: df.select(key.alias("key"), value.alias("value"), support.cast("bigint").alias("support"), against.cast("bigint").alias("against"))
    recur = row(patterns, name("pattern", F.col("grp")), F.lit("recurs"), F.col("support"), F.col("against"))
    weak = row(groups.where(rate <= WEAK), name("group", F.col("grp")), F.lit("weak"), F.col("broke"), F.col("held"))
    strong = row(groups.where(rate >= STRONG), name("group", F.col("grp")), F.lit("strong"), F.col("held"), F.col("broke"))
    w = weeks.agg(F.count_if(F.col("weekend_share") >= WORKED).alias("worked"), F.count_if(F.col("weekend_share") <= RESTED).alias("rested"))
    more = F.col("worked") > F.col("rested")
    rhythm = row(w, F.lit("rhythm:weekends"), F.when(more, "worked").otherwise("rested"), F.greatest("worked", "rested"), F.least("worked", "rested"))
    together = row(pairs, name("pair", F.concat_ws("+", "a", "b")), F.lit("together"), F.col("n"), F.lit(0))
    every = recur.unionByName(weak).unionByName(strong).unionByName(rhythm).unionByName(together)
    return every.where((F.col("support") >= FACET_SUPPORT) & (F.col("support") > F.col("against")))


def supersede(live: DataFrame, derived: DataFrame, key: str, value: str) -> DataFrame:
    """What a new derivation does to live statements: key, action (added, superseded, kept, withdrawn)."""
    a = live.select(F.col(key).alias("_a"), F.col(value).alias("_av"))
    b = derived.select(F.col(key).alias("_b"), F.col(value).alias("_bv"))
    action = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "withdrawn")
        .when(F.col("_av").eqNullSafe(F.col("_bv")), "kept").otherwise("superseded")
    )
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), action.alias("action"))


def judged(results: DataFrame, judgements: DataFrame, by: str, excluded: Column, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """What a query returned and what was relevant to it, in one naming: (by, id, rank) and (by, id).

    ``results``: by, id, chunks (ordinals met, an array), rank; ``judgements``: by, id, ordinal (null for the whole
    item), verdict. Excluded results go first and the others move up, so ``k`` of them stand where there are as many.
    Relevant is what was judged relevant or missing. Where an item has judgements of single chunks, these alone
    count: it is then named by its chunks, on both sides.
    """
    kept = results.where(~excluded)
    again = kept.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("rank", "id"))).where(F.col("rank") <= k)
    pinned = judgements.where("ordinal IS NOT NULL").select(by, "id").distinct().withColumn("_pinned", F.lit(True))
    name = lambda o: F.concat_ws("#", F.col("id"), o)
    chunks = F.when(F.col("_pinned"), F.coalesce(F.transform("chunks", lambda c: c.cast("string")), F.array(F.lit("")))).otherwise(F.array(F.lit(None).cast("string")))
    found = again.join(pinned, [by, "id"], "left").select(by, "id", "rank", F.explode(chunks).alias("o"))
    good = judgements.where(F.col("verdict").isin("relevant", "missing")).join(pinned, [by, "id"], "left").where("_pinned IS NULL OR ordinal IS NOT NULL")
    return found.select(by, name(F.col("o")).alias("id"), "rank"), good.select(by, name(F.col("ordinal").cast("string")).alias("id")).distinct()
