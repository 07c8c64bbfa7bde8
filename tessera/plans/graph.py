"""Graph and entities: orders mention parts, suppliers and brands; parts relate to their brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import entities as en
from tessera.operators import graph as g
from tessera.operators import vectors as v
from tessera.operators.versions import keyed_diff
from tessera.sources.tables import read_table

def _raw(s, d):
    li = read_table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    part = read_table(s, d, "part").select("p_partkey", "p_brand")
    li = li.join(part, li["l_partkey"] == part["p_partkey"])
    three = F.explode(F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"), F.col("p_brand")))
    return li.select("l_orderkey", "l_linenumber", three.alias("entity"))


def _held(s, d):
    """What a projection holds that was last brought up to date at ``SYNCED`` and never told of the merges."""
    li = read_table(s, d, "lineitem").where(F.col("l_shipdate") < F.lit(SYNCED).cast("timestamp"))
    two = F.explode(F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")))
    return g.project_mentions(li.select("l_orderkey", "l_linenumber", two.alias("entity")), "l_orderkey", "entity", "l_linenumber")


def _due(s, d):
    """What it should hold: every line, merged suppliers under the one that stays."""
    li = read_table(s, d, "lineitem")
    supplier = F.when(F.col("l_suppkey").isin(1, 3), 2).otherwise(F.col("l_suppkey"))
    two = F.explode(F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), supplier)))
    return g.project_mentions(li.select("l_orderkey", "l_linenumber", two.alias("entity")), "l_orderkey", "entity", "l_linenumber")


def _diverged(s, d):
    return keyed_diff(_due(s, d), _held(s, d), ["item", "entity"], ["mentions"]).groupBy("difference").agg(F.count(F.lit(1)).alias("n"))


#: The middle of the ship dates.
SYNCED = "1998-01-01"


def mentions(s, d):
    return g.project_mentions(_raw(s, d), "l_orderkey", "entity", "l_linenumber")


def relations(s, d):
    p = read_table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("s"), F.lit("made_by").alias("p"), F.col("p_brand").alias("o"), F.col("p_retailprice").alias("c"))
    return g.project_relations(p, "s", "p", "o", "c")


def _seeds(s, d):
    return s.createDataFrame([(1,), (2,), (3,)], "item long")


def _expand(s, d):
    return g.expand(mentions(s, d), relations(s, d), _seeds(s, d), s.createDataFrame([(5,), (6,)], "item long"))


def _reached(s, d):
    """Default depth, hubs in no walk."""
    m = mentions(s, d)
    return g.reach(m, relations(s, d), _seeds(s, d), g.hubs(m).where("hub"))


def _near(s, d):
    return v.near_pairs(read_table(s, d, "embeddings"), 0.5, "vec_id", "embedding")


def _cited(s, d):
    """Decisions and the items they cite."""
    return read_table(s, d, "decision_evidence").select(F.concat(F.lit("d"), "decision_id").alias("a"), F.concat_ws("/", "source_name", "external_key").alias("b"))


def _merged(s, d):
    """E8 over all mentions: those of parts and brands stay as they are."""
    merges = s.createDataFrame([("s1", "s2"), ("s3", "s2")], "loser string, winner string")
    return en.merge(_raw(s, d), merges, "entity", ["l_orderkey", "l_linenumber"])


def _labels(s, d):
    p = read_table(s, d, "part").select(F.col("p_partkey").cast("string").alias("a"), F.col("p_brand").alias("b"), "p_name")
    c = g.components(p, "a", "b")
    return g.component_label(c.join(p, c["node"] == p["a"]), "component", "p_name")


def _parts(s, d):
    return read_table(s, d, "part").select("p_partkey", F.lower("p_type").alias("kind"), "p_name", "p_brand")


def _names(s, d):
    return read_table(s, d, "candidates").select("candidate_id", F.regexp_extract("item_key", r"[^/]*$", 0).alias("name")).distinct()


QUERIES = {
    "graph_mentions": mentions,
    "graph_relations": relations,
    "graph_hash": lambda s, d: g.content_hash(mentions(s, d), ["item", "entity", "mentions"]),
    "graph_divergence": _diverged,
    "graph_label_counts": lambda s, d: mentions(s, d).groupBy(F.substring("entity", 1, 1).alias("label")).agg(F.countDistinct("entity").alias("nodes"), F.count(F.lit(1)).alias("edges")),
    "entity_df_hubs": lambda s, d: g.hubs(mentions(s, d)).withColumn("idf", F.round("idf", 6)),
    "graph_neighbours": lambda s, d: g.neighbours(relations(s, d), s.createDataFrame([("p1",)], "node string"), 3, "subject", "object"),
    "graph_reach": lambda s, d: g.reach(mentions(s, d), relations(s, d), _seeds(s, d), None, 1),
    "graph_reach_past_hubs": _reached,
    "hub_suppressed_expansion": lambda s, d: _expand(s, d).select("item", "score"),
    "graph_prune": lambda s, d: mentions(s, d).join(read_table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("item")), "item", "left_anti").groupBy("entity").agg(F.count(F.lit(1)).alias("n")),
    "connected_components": lambda s, d: g.components(_cited(s, d), "a", "b"),
    "correction_threads": lambda s, d: g.components(read_table(s, d, "chat_messages").select("message_id", "corrects_message_id"), "message_id", "corrects_message_id"),
    "pairwise_similarity": _near,
    "similar_components": lambda s, d: g.components(v.near_links(read_table(s, d, "embeddings"), 0.5, "vec_id", "embedding"), "a", "b"),
    "component_labels": _labels,
    "canonical_names": lambda s, d: _names(s, d).select("candidate_id", tx.canonicalized(F.col("name"), F.lit("file")).alias("canonical")),
    "canonical_keys": lambda s, d: _parts(s, d).select("p_partkey", tx.canonical_key("p_name").alias("key"), tx.collapse_key("p_name").alias("collapsed")),
    "exact_candidates": lambda s, d: en.exact_candidates(_parts(s, d), "p_brand", tx.collapse_key("p_name"), "p_partkey"),
    "alias_candidates": lambda s, d: en.alias_candidates(read_table(s, d, "nation").select(F.lit("n").alias("k"), "n_name", "n_nationkey"), "k", F.lower("n_name"), "n_nationkey", (("nation_1", "nation_2"), ("france", "germany"))),
    "winner_choice": lambda s, d: en.winner(_parts(s, d).join(read_table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("m"), F.min("l_shipdate").alias("seen")), "p_partkey", "left"), ["p_brand", "p_name"], "m", "seen", "p_partkey"),
    "merge_ledger": lambda s, d: _merged(s, d)[1].groupBy("was", "now").agg(F.count(F.lit(1)).alias("n")),
    "graph_sync_scope": lambda s, d: g.sync_scope(_seeds(s, d), mentions(s, d)),
    "merge_collisions": lambda s, d: _merged(s, d)[0].groupBy("entity").agg(F.count(F.lit(1)).alias("n")),
    "near_duplicate_names": lambda s, d: _parts(s, d).groupBy("kind", tx.collapse_key("p_name").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
    "entity_lookup": lambda s, d: read_table(s, d, "nation").where(F.lower("n_name") == "nation_7").select("n_nationkey"),
}

_RAW = "raw AS (SELECT l_orderkey, l_linenumber, unnest(['p' || l_partkey, 's' || l_suppkey, p_brand]) AS entity FROM lineitem JOIN part ON p_partkey = l_partkey)"
_MEN = f"{_RAW}, men AS (SELECT l_orderkey AS item, entity, count(*) AS mentions, min(l_linenumber) AS first_ordinal FROM raw GROUP BY ALL)"
_REL = "rel AS (SELECT 'p' || p_partkey AS subject, 'made_by' AS predicate, p_brand AS object, count(*) AS assertions, max(p_retailprice) AS confidence FROM part GROUP BY ALL)"
_HUB = "hub AS (SELECT entity, count(DISTINCT item) AS df, ln(1 + (SELECT count(DISTINCT item) FROM men) / count(DISTINCT item)) AS idf, count(DISTINCT item) >= greatest(2, ceil(0.1e0 * (SELECT count(DISTINCT item) FROM men))) AS hub FROM men GROUP BY 1)"


def _walk(edges, hops):
    """Walks over mentions and relations between entities that ``edges`` has; a node is an item ('i' and its key) or an entity ('e' and its name)."""
    return f"""ed AS (SELECT 'i' || item AS a, 'e' || entity AS b FROM {edges} UNION SELECT 'e' || entity, 'i' || item FROM {edges}
  UNION SELECT 'e' || subject, 'e' || object FROM rel WHERE subject IN (SELECT entity FROM {edges}) AND object IN (SELECT entity FROM {edges}) UNION SELECT 'e' || object, 'e' || subject FROM rel WHERE subject IN (SELECT entity FROM {edges}) AND object IN (SELECT entity FROM {edges})),
st AS (SELECT DISTINCT 'e' || entity AS o FROM {edges} WHERE item IN (1, 2, 3)),
wk AS (SELECT o, o AS node, 0 AS hops FROM st UNION SELECT o, b, hops + 1 FROM wk JOIN ed ON a = node WHERE hops < {hops}),
reached AS (SELECT substr(node, 2) AS entity, min(hops) AS hops FROM (SELECT node, hops FROM wk WHERE node <> o AND node LIKE 'e%' UNION ALL SELECT o, 2 FROM st) GROUP BY 1)"""


_COLL = "(SELECT p_partkey, p_brand, p_name, lower(p_type) AS kind, CASE WHEN ends_with(b, 's') AND length(b) > 3 THEN left(b, -1) WHEN ends_with(b, 'py') AND length(b) > 4 THEN left(b, -2) WHEN ends_with(b, 'md') AND length(b) > 4 THEN left(b, -2) WHEN ends_with(b, 'txt') AND length(b) > 5 THEN left(b, -3) WHEN ends_with(b, 'json') AND length(b) > 6 THEN left(b, -4) WHEN ends_with(b, 'yml') AND length(b) > 5 THEN left(b, -3) WHEN ends_with(b, 'yaml') AND length(b) > 6 THEN left(b, -4) ELSE b END AS key FROM (SELECT *, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS b FROM part))"
_CC = "e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT a AS node, a AS r FROM e2 UNION SELECT e2.b, w.r FROM w JOIN e2 ON e2.a = w.node WHERE w.r < e2.b) SELECT node, min(r) AS component FROM w GROUP BY 1"
_MAP = "CASE WHEN entity IN ('s1', 's3') THEN 's2' ELSE entity END"

SQL = {
    "pairwise_similarity": "SELECT a, b, score FROM (SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE score >= 0.5",
    "similar_components": f"WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) >= 0.5), {_CC}",
    "canonical_names": f"""WITH n AS (SELECT DISTINCT candidate_id, lower(regexp_extract(item_key, '[^/]*$')) AS t FROM candidates)
SELECT candidate_id, regexp_replace(regexp_replace(t, '([^\\s.])\\.({"|".join(tx.FILE_EXTENSIONS)})$', '\\1'), '[^a-z0-9]+', '', 'g') AS canonical FROM n""",
    "graph_mentions": f"WITH {_MEN} SELECT * FROM men",
    "graph_relations": f"WITH {_REL} SELECT * FROM rel",
    "graph_divergence": f"""WITH e AS (SELECT l_orderkey AS item, entity, count(*) AS mentions FROM (SELECT l_orderkey, unnest(['p' || l_partkey, 's' || CASE WHEN l_suppkey IN (1, 3) THEN 2 ELSE l_suppkey END]) AS entity FROM lineitem) GROUP BY ALL),
a AS (SELECT l_orderkey AS item, entity, count(*) AS mentions FROM (SELECT l_orderkey, unnest(['p' || l_partkey, 's' || l_suppkey]) AS entity FROM lineitem WHERE l_shipdate < TIMESTAMP '{SYNCED}') GROUP BY ALL)
SELECT difference, count(*) AS n FROM (SELECT CASE WHEN a.item IS NULL THEN 'missing' WHEN e.item IS NULL THEN 'unexpected' WHEN a.mentions <> e.mentions THEN 'changed' END AS difference FROM e FULL JOIN a ON e.item = a.item AND e.entity = a.entity) WHERE difference IS NOT NULL GROUP BY 1""",
    "graph_label_counts": f"WITH {_MEN} SELECT left(entity, 1) AS label, count(DISTINCT entity) AS nodes, count(*) AS edges FROM men GROUP BY 1",
    "entity_df_hubs": f"WITH {_MEN}, {_HUB} SELECT entity, df, round(idf, 6) AS idf, hub FROM hub",
    "graph_neighbours": f"""WITH RECURSIVE {_REL}, both_ AS (SELECT subject AS a, object AS b FROM rel UNION SELECT object, subject FROM rel),
w AS (SELECT 'p1' AS node, 0 AS hops UNION SELECT b, hops + 1 FROM w JOIN both_ ON a = node WHERE hops < 3) SELECT node, min(hops) AS hops FROM w GROUP BY 1 HAVING min(hops) > 0""",
    "graph_reach": f"WITH RECURSIVE {_MEN}, {_REL}, {_walk('men', 2)} SELECT * FROM reached",
    "graph_reach_past_hubs": f"WITH RECURSIVE {_MEN}, {_REL}, {_HUB}, ok AS (SELECT item, entity FROM men JOIN hub USING (entity) WHERE NOT hub), {_walk('ok', 4)} SELECT * FROM reached",
    "hub_suppressed_expansion": f"""WITH RECURSIVE {_MEN}, {_REL}, {_HUB}, ok AS (SELECT item, entity FROM men JOIN hub USING (entity) WHERE NOT hub), {_walk('ok', 4)}
SELECT item, round(sum(idf / hops), 9) AS score FROM men JOIN reached USING (entity) JOIN hub USING (entity) WHERE item NOT IN (1, 2, 3, 5, 6) GROUP BY 1""",
    "graph_prune": f"WITH {_MEN} SELECT entity, count(*) AS n FROM men WHERE item NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1",
    "canonical_keys": f"SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS key, key AS collapsed FROM {_COLL}",
    "exact_candidates": f"WITH k AS {_COLL}, a AS (SELECT p_brand, key, min(p_partkey) AS anchor FROM k GROUP BY ALL HAVING count(*) > 1) SELECT p_brand AS kind, key, anchor, p_partkey AS id FROM k JOIN a USING (p_brand, key) WHERE p_partkey <> anchor",
    "alias_candidates": "SELECT least(a.n_nationkey, b.n_nationkey) AS a, greatest(a.n_nationkey, b.n_nationkey) AS b, 0.99e0 AS confidence FROM nation a JOIN nation b ON (lower(a.n_name), lower(b.n_name)) IN (('nation_1', 'nation_2'), ('france', 'germany'))",
    "winner_choice": """WITH m AS (SELECT p_brand, p_name, p_partkey, coalesce(n, 0) AS n, seen FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, min(l_shipdate) AS seen FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)
SELECT p_brand, p_name, p_partkey AS winner FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY n DESC, seen NULLS LAST, p_partkey) AS k FROM m) WHERE k = 1""",
    "merge_ledger": f"WITH {_RAW} SELECT entity AS was, 's2' AS now, count(*) AS n FROM raw WHERE entity IN ('s1', 's3') GROUP BY ALL",
    "graph_sync_scope": f"WITH {_MEN} SELECT item, 'incremental' AS mode FROM (SELECT item FROM men WHERE entity IN (SELECT entity FROM men WHERE item IN (1, 2, 3)) UNION SELECT unnest([1, 2, 3]))",
    "merge_collisions": f"WITH {_RAW}, m AS (SELECT DISTINCT l_orderkey, l_linenumber, {_MAP} AS entity FROM raw) SELECT entity, count(*) AS n FROM m GROUP BY 1",
    "near_duplicate_names": f"SELECT kind, key, count(*) AS n FROM {_COLL} GROUP BY ALL HAVING count(*) > 1",
    "connected_components": f"""WITH RECURSIVE e AS (SELECT DISTINCT 'd' || decision_id AS a, concat_ws('/', source_name, external_key) AS b FROM decision_evidence), {_CC}""",
    "correction_threads": f"WITH RECURSIVE e AS (SELECT DISTINCT message_id AS a, corrects_message_id AS b FROM chat_messages WHERE corrects_message_id IS NOT NULL), {_CC}",
    "component_labels": "SELECT component, label, members FROM (SELECT p_brand, min(least(p_partkey::VARCHAR, p_brand)) AS component, arg_min(p_name, {'n': -length(p_name), 's': p_name}) AS label, count(*) AS members FROM part GROUP BY 1)",
    "entity_lookup": "SELECT n_nationkey FROM nation WHERE lower(n_name) = 'nation_7'",
}
