"""The graph of items and entities as two tables: projection, traversal, hubs, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window, functions as F

from tessera.operators.relational import top_per
from tessera.session import cut

HUB_SHARE, HUB_LEAST = 0.10, 2


def project_mentions(mentions: DataFrame, item: str, entity: str, ordinal: str) -> DataFrame:
    """G1: MENTIONS edges: item, entity, mentions, first_ordinal. Nulls name nothing."""
    return mentions.dropna(subset=[item, entity]).groupBy(F.col(item).alias("item"), F.col(entity).alias("entity")).agg(
        F.count(F.lit(1)).alias("mentions"), F.min(ordinal).alias("first_ordinal")
    )


def project_relations(assertions: DataFrame, subject: str, predicate: str, obj: str, confidence: str) -> DataFrame:
    """G1, A2: RELATES_TO edges without self-loops: subject, predicate, object, assertions, confidence (highest)."""
    return assertions.where(F.col(subject) != F.col(obj)).groupBy(
        F.col(subject).alias("subject"), F.col(predicate).alias("predicate"), F.col(obj).alias("object")
    ).agg(F.count(F.lit(1)).alias("assertions"), F.max(confidence).alias("confidence"))


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One order-free digest of a set of rows: rows, digest. Sums of 64-bit hashes, so it combines map-side."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("|", F.sum(h), F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)"))), 256).alias("digest"))


def hubs(mentions: DataFrame, share: float = HUB_SHARE, least: int = HUB_LEAST) -> DataFrame:
    """Per entity the items that mention it, idf = ln(1 + N / df), and whether it is a hub."""
    return _hubs(mentions.select("item", "entity").distinct(), share, least)


def _hubs(pairs: DataFrame, share: float, least: int) -> DataFrame:
    n = pairs.agg(F.countDistinct("item").alias("n")).scalar()
    df = pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("df")).withColumn("n", n)
    return df.select(
        "entity", "df", F.log1p(F.col("n") / F.col("df")).alias("idf"),
        (F.col("df") >= F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("n")))).alias("hub"),
    )


def neighbours(edges: DataFrame, start: DataFrame, depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes reached over undirected edges within ``depth`` (at most 6) steps, with the least: node, hops.

    ``start`` has one column of nodes. Breadth first: each round joins the frontier
    to the edges and takes out what was seen, so the work follows the new nodes.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth is 1 to 6")
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).union(edges.select(F.col(dst), F.col(src))).distinct()
    name = start.columns[0]
    seen = start.select(F.col(name).alias("node"), F.lit(0).alias("hops")).distinct()
    front = seen.select("node")
    for step in range(1, depth + 1):
        new = front.join(both, front["node"] == both["a"]).select(F.col("b").alias("node")).distinct()
        front = cut(new.join(seen.select("node"), "node", "left_anti"), "frontier")
        seen = seen.unionByName(front.withColumn("hops", F.lit(step)))
    return seen.where("hops > 0")


def _other_way(links: DataFrame, a: str, b: str) -> DataFrame:
    one = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    return one.union(one.select("b", "a")).where("a <> b").distinct()


def reach(mentions: DataFrame, relations: DataFrame, seeds: DataFrame, excluded: DataFrame | None = None, depth: int = 2, by: list[str] | None = None) -> DataFrame:
    """Entities reached from the entities that seed items mention: by, entity, hops.

    A walk takes one hop from an entity to an item that mentions it, one from an item
    to an entity it mentions, and one over a relation in either direction; it ends at
    ``2 * depth`` hops, and the fewest count. A seed entity is reached from itself in 2
    (through another item that mentions it), or in fewer from another seed. No walk
    starts from, crosses or ends at an excluded entity (hubs). ``seeds`` has the columns
    ``by`` (searches answered at once) and item. Items that mention what was reached are
    found by a join with ``mentions``.

    Breadth first: a hop joins only the entities that were new one and two hops before.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth is 1 to 3")
    m = cut(mentions.select("item", "entity").dropna().distinct(), "mentions")  # read by every hop
    bad = None if excluded is None else cut(excluded.select("entity").distinct(), "excluded")
    return _walked(m, _other_way(relations.dropna(subset=["subject", "object"]), "subject", "object"), seeds, bad, depth, by or [])


def _walked(m: DataFrame, r: DataFrame, seeds: DataFrame, excluded: DataFrame | None, depth: int, by: list[str]) -> DataFrame:
    if excluded is not None:
        bad = excluded.select("entity")
        m = m.join(bad, "entity", "left_anti")
        r = r.join(bad.withColumnRenamed("entity", "a"), "a", "left_anti").join(bad.withColumnRenamed("entity", "b"), "b", "left_anti")
    start = seeds.select(*by, "item").distinct().join(m, "item").select(*by, "entity").distinct()

    def shared(front: DataFrame) -> DataFrame:
        items = front.join(m, "entity").select(*by, "item").distinct()
        return items.join(m, "item").select(*by, "entity")

    levels = [cut(start, "level")]
    seen = levels[0].withColumn("hops", F.lit(0))
    for hop in range(1, 2 * depth + 1):
        near = levels[-1].join(r, levels[-1]["entity"] == r["a"]).select(*by, F.col("b").alias("entity"))
        if hop == 1:
            related = near  # seeds that another seed reaches over one relation
        else:
            near = near.unionByName(shared(levels[-2]))
        new = near.distinct().join(seen.select(*by, "entity"), [*by, "entity"], "left_anti")
        levels.append(cut(new, "level") if hop < 2 * depth else new)
        seen = seen.unionByName(levels[-1].withColumn("hops", F.lit(hop)))
    own = levels[0].withColumn("hops", F.lit(2)).unionByName(related.withColumn("hops", F.lit(1)))
    return seen.where("hops > 0").unionByName(own).groupBy(*by, "entity").agg(F.min("hops").alias("hops"))


def expand(mentions: DataFrame, relations: DataFrame, seeds: DataFrame, retrieved: DataFrame | None = None, depth: int = 2, by: list[str] | None = None) -> DataFrame:
    """Items near the seeds by rare entities: by, item, score, route, in order of (by, -score, item).

    Hubs are left out of every walk; an entity adds idf / hops once per item; the
    route shown ends at the entity of fewest hops, then highest idf. Seeds and what was
    retrieved already (``by``, item) are not candidates.
    """
    by = by or []
    pairs = cut(mentions.select("item", "entity").dropna().distinct(), "mentions")
    h = cut(_hubs(pairs, HUB_SHARE, HUB_LEAST), "hubs")
    both = _other_way(relations.dropna(subset=["subject", "object"]), "subject", "object")
    reached = _walked(pairs, both, seeds, h.where("hub"), depth, by)
    near = pairs.join(reached.join(h.select("entity", "idf"), "entity"), "entity")
    known = seeds.select(*by, "item")
    known = known if retrieved is None else known.union(retrieved.select(*by, "item"))
    per = near.join(known.distinct(), [*by, "item"], "left_anti").groupBy(*by, "item").agg(
        F.round(F.sum(F.col("idf") / F.col("hops")), 9).alias("score"),
        F.min_by("entity", F.struct("hops", (-F.col("idf")).alias("i"), "entity")).alias("route"),
    )
    return per.orderBy(*by, F.desc("score"), "item")


def nearest(mentions: DataFrame, relations: DataFrame, seeds: DataFrame, retrieved: DataFrame, by: list[str], k: int, depth: int = 2) -> DataFrame:
    """The first ``k`` items of every search of :func:`expand`: by, item, score, rank.

    Items that mention the same entities, hubs apart, score alike: searches walk over such
    kinds of items and score kinds, so none is joined with all items. The first ``k`` that
    were not retrieved are among the first ``k`` and as many as were retrieved; only these
    are taken out of their kinds. Null searches form one search.
    """
    pairs = cut(mentions.select("item", "entity").dropna().distinct(), "mentions")
    h = cut(_hubs(pairs, HUB_SHARE, HUB_LEAST), "hubs")
    rare = pairs.join(h.where("hub").select("entity"), "entity", "left_anti")
    items = cut(rare.groupBy("item").agg(F.sort_array(F.collect_list("entity")).alias("entities")), "items")
    kinds = cut(items.groupBy("entities").agg(F.min("item").alias("kind"), F.count(F.lit(1)).alias("size")), "kinds")
    members = cut(items.join(kinds, "entities").select("item", "kind"), "members")
    m = cut(kinds.select(F.col("kind").alias("item"), F.explode("entities").alias("entity")), "mentions")  # of kinds
    both = _other_way(relations.dropna(subset=["subject", "object"]), "subject", "object")
    asked = seeds.join(members, "item").select(*by, F.col("kind").alias("item"))
    reached = _walked(m, both, asked, h.where("hub"), depth, by)

    known = cut(seeds.select(*by, "item").union(retrieved.select(*by, "item")).distinct().toDF(*[f"_s{i}" for i in range(len(by))], "_known"), "known")
    room = known.groupBy(*known.columns[:-1]).agg((F.count(F.lit(1)) + k).alias("_room"))
    most = room.agg(F.max("_room")).first()[0] or k
    same = lambda df, other: [df[c].eqNullSafe(other[f"_s{i}"]) for i, c in enumerate(by)]
    weighed = reached.join(h.select("entity", "idf"), "entity")
    parts = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, or few bytes that become many rows end in one task
    weighed = weighed.join(room, same(weighed, room)).select(*by, "entity", "idf", "hops", "_room").repartition(parts, *by)
    scored = weighed.join(m.withColumnRenamed("item", "kind"), "entity").groupBy(*by, "_room", "kind").agg((-F.round(F.sum(F.col("idf") / F.col("hops")), 9)).alias("_low"))
    sized = scored.join(kinds.select("kind", "size"), "kind")
    order = Window.partitionBy(*by).orderBy("_low")
    better = F.sum("size").over(order) - F.sum("size").over(Window.partitionBy(*by, "_low"))  # items of a higher score
    placed = sized.withColumns({"_better": better, "_place": F.row_number().over(Window.partitionBy(*by).orderBy("_low", "kind"))})
    taken = placed.where("_place <= _room AND _better < _room").select(*by, "_low", "kind", F.explode(F.sequence(F.lit(1).cast("long"), F.least("size", F.col("_room") - F.col("_better")))).alias("_at"))
    named = top_per(members, ["kind"], [F.asc("item")], most).withColumnRenamed("rank", "_at")
    out = taken.join(named, ["kind", "_at"]).select(*by, "item", (-F.col("_low")).alias("score"))
    new = out.join(known, [*same(out, known), out["item"] == known["_known"]], "left_anti")
    return top_per(new, by, [F.desc("score"), F.asc("item")], k)


def components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """Connected components: node, component (its smallest node).

    Alternating large-star and small-star rounds over the edge table, which halve
    the depth of every tree each time and never gather a component in one place.
    Stops when the edges no longer change; a chain of a million nodes takes some
    twenty rounds. Nulls and self-loops link nothing; a self-loop still names a node.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    nodes = cut(e.select(F.col("u").alias("node")).union(e.select("v")).distinct(), "nodes")
    links = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    digest = None
    for _ in range(max_rounds):
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        seen = Observation()
        counted = small.where("u <> v").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        links = cut(counted, "links", instead_of=links)
        now = tuple(seen.get.values())
        if now == digest:
            break
        digest = now
    else:
        raise RuntimeError("components did not settle")
    root = links.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(root, nodes["node"] == root["u"], "left").select("node", F.coalesce("component", "node").alias("component"))


def component_label(members: DataFrame, component: str, statement: str) -> DataFrame:
    """A component is named by its longest statement, the first in order of equals."""
    return members.groupBy(component).agg(F.min_by(statement, F.struct((-F.length(statement)).alias("n"), F.col(statement).alias("s"))).alias("label"), F.count(F.lit(1)).alias("members"))


def sync_scope(changed: DataFrame, mentions: DataFrame, limit: int = 200) -> DataFrame:
    """Items whose edges a change touches: the changed, and all that share an entity with them; full from ``limit`` on."""
    touched = mentions.join(changed.select("item").distinct(), "item", "left_semi").select("entity").distinct()
    items = mentions.join(touched, "entity", "left_semi").select("item").union(changed.select("item")).distinct()
    n = changed.select("item").distinct().agg(F.count(F.lit(1))).scalar()
    return items.withColumn("mode", F.when(n >= limit, "full").otherwise("incremental"))
