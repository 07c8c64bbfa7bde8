"""Reports over memories, evidence, chats and hits: purge scope, health, the system report, connections, exports, stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import relational as rel
from tessera.operators import reports as rp
from tessera.plans.temporal import M, memories
from tessera.sources.tables import read_table

KEYS = ["source_id", "external_key"]
MODEL, MOST_TOKENS = "mini-48-v2", 512


def n_(df):
    return df.agg(F.count(F.lit(1)).alias("n"))


def chunks(s, d):
    """Chunks that searches have met: their version, and whether they have a vector."""
    c = read_table(s, d, "memory_hits").select("memory_id", F.explode("matched_chunks").alias("c"))
    return c.select("memory_id", "c.chunk_id", F.col("c.vector").isNotNull().alias("embedded")).distinct()


def mentions(s, d):
    """Versions and the words of their titles."""
    t = read_table(s, d, "memories").select("memory_id", F.explode(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]{4,}"), F.lit(0))).alias("entity"))
    return t.distinct()


def tags(s, d):
    return read_table(s, d, "memories").select("memory_id", F.explode(tx.tags("content")).alias("t")).select("memory_id", "t.name").distinct()


def evidence(s, d):
    return read_table(s, d, "decision_evidence").distinct()


def turns(s, d):
    return read_table(s, d, "chat_messages").select("message_id", "external_key").distinct()


def _purge(s, d):
    """Of every item with a removed version."""
    v = memories(s, d)
    return rp.purge_scope(v.where("deleted_at IS NOT NULL"), v, chunks(s, d), mentions(s, d), tags(s, d), turns(s, d), evidence(s, d), KEYS)


def _doctor(s, d):
    c = read_table(s, d, "candidates").select("candidate_id", "tokens", "embedding_model", "vector").distinct()
    m = memories(s, d, "content").where(rel.live())
    return rp.checks({
        "oversize chunk": c.where(F.col("tokens") > MOST_TOKENS).select("candidate_id"),
        "other model": c.where(rel.stale("embedding_model", MODEL)).select("candidate_id"),
        "no vector": c.where("vector IS NULL").select("candidate_id"),
        "content without chunks": m.where("content <> ''").join(chunks(s, d).select("memory_id").distinct(), "memory_id", "left_anti").select("memory_id"),
        "not extracted": m.join(mentions(s, d).select("memory_id").distinct(), "memory_id", "left_anti").select("memory_id"),
    })


def _report(s, d):
    v, e, c = memories(s, d), evidence(s, d), chunks(s, d)
    turns_ = read_table(s, d, "chat_messages").select("session_id", "ordinal", "answer_refused").distinct()
    share = lambda df, cond: df.agg(F.round(F.avg(F.expr(cond).cast("double")), 6).alias("n"))
    return rp.sections({
        "corpus": {"versions": n_(v), "items": n_(v.select(*KEYS).distinct()), "live": n_(v.where(rel.live())), "sources": n_(v.select("source_id").distinct()), "chunks": n_(c.select("chunk_id").distinct()), "embedded share": share(c, "embedded"), "undated share": share(v, "occurred_at IS NULL")},
        "decisions": {"decisions": n_(e.select("decision_id").distinct()), "links": n_(e), "stored share": share(e, "memory_id IS NOT NULL"), "contradicting share": share(e, "relation = 'contradicts'"), "links per decision": e.groupBy("decision_id").agg(F.count(F.lit(1)).alias("k")).agg(F.round(F.avg("k"), 6).alias("n"))},
        "behaviour": {"sessions": n_(turns_.where("session_id IS NOT NULL").select("session_id").distinct()), "turns": n_(turns_), "refused share": share(turns_.where("answer_refused IS NOT NULL"), "answer_refused"), "events": n_(read_table(s, d, "events")), "active users": n_(read_table(s, d, "events").select("user_id").distinct())},
    })


def _connections(s, d):
    """The orders of the first customer with any: entities are parts and suppliers, an order is known from its date."""
    li = read_table(s, d, "lineitem")
    links = li.select(F.col("l_orderkey").alias("item"), F.concat(F.lit("p"), "l_partkey").alias("entity")).union(li.select("l_orderkey", F.concat(F.lit("s"), "l_suppkey")))
    o = read_table(s, d, "orders")
    first = o.agg(F.min("o_custkey").alias("c")).scalar()
    mine = o.where(F.col("o_custkey") == first).select(F.col("o_orderkey").alias("item"))
    return rp.connections(mine, links, o.select(F.col("o_orderkey").alias("item"), F.col("o_orderdate").alias("at")))


def _export(s, d):
    return rp.export_items(memories(s, d), tags(s, d), chunks(s, d), KEYS, ["kind", "content_hash"])


def _stages(s, d):
    return rp.stages(turns(s, d), memories(s, d), chunks(s, d))


def _backfill(s, d):
    """Q14: live items by kind and what is still to be done for them."""
    m = memories(s, d).where(rel.live()).select("memory_id", "kind")
    c = chunks(s, d).groupBy("memory_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(~F.col("embedded")).alias("bare"))
    e = mentions(s, d).groupBy("memory_id").agg(F.count(F.lit(1)).alias("names"))
    j = m.join(c, "memory_id", "left").join(e, "memory_id", "left")
    todo = {"unchunked": "chunks IS NULL", "unembedded": "bare > 0", "unextracted": "names IS NULL", "ready for relations": "names >= 2"}
    long = j.select("kind", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.coalesce(F.expr(x), F.lit(False)).alias("due")) for t, x in todo.items()])).alias("t"))
    return long.groupBy("kind", "t.target").agg(F.count_if("t.due").alias("n"))


QUERIES = {
    "purge_scope": _purge,
    "doctor_checks": _doctor,
    "system_report": _report,
    "connections": _connections,
    "export_items": _export,
    "processing_status": _stages,
    "backfill_targets": _backfill,
}

_CH = "ch AS (SELECT DISTINCT memory_id, c.chunk_id AS chunk_id, c.vector IS NOT NULL AS embedded FROM (SELECT memory_id, unnest(matched_chunks) AS c FROM memory_hits))"
_MEN = "men AS (SELECT DISTINCT memory_id, unnest(regexp_extract_all(lower(title), '[a-z]{4,}')) AS entity FROM memories)"
_TAG = """tag0 AS (SELECT memory_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT DISTINCT memory_id, regexp_extract_all(content, '#([\\pL\\pN_][\\pL\\pN_-]*)', 1) AS t FROM memories)),
tag1 AS (SELECT memory_id, t, replace(replace(lower(t[i]), 'ß', 'ss'), 'ς', 'σ') AS name, min(i) AS i FROM tag0 GROUP BY ALL), tag AS (SELECT DISTINCT memory_id, name FROM tag1 QUALIFY row_number() OVER (PARTITION BY memory_id, t ORDER BY i) <= 10)"""
_V = f"v AS (SELECT * FROM {M})"
_EV = "e AS (SELECT DISTINCT * FROM decision_evidence)"


def _one(section, metric, sql):
    return f"SELECT '{section}' AS section, '{metric}' AS metric, CAST(({sql}) AS DOUBLE) AS value"


SQL = {
    "purge_scope": f"""WITH {_V}, {_CH}, {_MEN}, {_TAG}, {_EV}, scope AS (SELECT DISTINCT source_id, external_key FROM v WHERE deleted_at IS NOT NULL),
gone AS (SELECT v.* FROM v JOIN scope USING (source_id, external_key)), stay AS (SELECT v.* FROM v ANTI JOIN scope USING (source_id, external_key)), ids AS (SELECT DISTINCT memory_id FROM gone)
SELECT 'items' AS what, count(*) AS n FROM scope UNION ALL SELECT 'versions', count(*) FROM ids UNION ALL SELECT 'chunks', count(DISTINCT chunk_id) FROM ch JOIN ids USING (memory_id)
UNION ALL SELECT 'embedded chunks', count(DISTINCT chunk_id) FROM ch JOIN ids USING (memory_id) WHERE embedded UNION ALL SELECT 'mentions', count(*) FROM men JOIN ids USING (memory_id) UNION ALL SELECT 'tags', count(*) FROM tag JOIN ids USING (memory_id)
UNION ALL SELECT 'chat turns', count(DISTINCT message_id) FROM chat_messages WHERE external_key IN (SELECT external_key FROM scope) UNION ALL SELECT 'evidence links', count(DISTINCT evidence_id) FROM e JOIN ids USING (memory_id)
UNION ALL SELECT 'orphaned entities', count(*) FROM (SELECT entity FROM men JOIN ids USING (memory_id) EXCEPT SELECT entity FROM men WHERE memory_id NOT IN (SELECT memory_id FROM ids))
UNION ALL SELECT 'owned blobs', count(*) FROM (SELECT content_hash FROM gone WHERE content_hash IS NOT NULL EXCEPT SELECT content_hash FROM stay) UNION ALL SELECT 'shared blobs', count(*) FROM (SELECT content_hash FROM gone WHERE content_hash IS NOT NULL INTERSECT SELECT content_hash FROM stay)""",
    "doctor_checks": f"""WITH {_V}, {_CH}, {_MEN}, c AS (SELECT DISTINCT candidate_id, tokens, embedding_model, vector FROM candidates), m AS (SELECT DISTINCT memory_id, content FROM memories WHERE is_current AND deleted_at IS NULL),
r AS (SELECT 'oversize chunk' AS k, candidate_id::VARCHAR AS id FROM c WHERE tokens > {MOST_TOKENS} UNION SELECT 'other model', candidate_id::VARCHAR FROM c WHERE embedding_model IS DISTINCT FROM '{MODEL}' UNION SELECT 'no vector', candidate_id::VARCHAR FROM c WHERE vector IS NULL
UNION SELECT 'content without chunks', memory_id FROM m WHERE content <> '' AND memory_id NOT IN (SELECT memory_id FROM ch WHERE memory_id IS NOT NULL) UNION SELECT 'not extracted', memory_id FROM m WHERE memory_id NOT IN (SELECT memory_id FROM men))
SELECT k AS "check", count(id) AS n, array_to_string(list_sort(list(id ORDER BY id))[1:3], ', ') AS examples FROM (SELECT unnest(['oversize chunk', 'other model', 'no vector', 'content without chunks', 'not extracted']) AS k) LEFT JOIN r USING (k) GROUP BY 1""",
    "system_report": f"WITH {_V}, {_CH}, {_EV}, t AS (SELECT DISTINCT session_id, ordinal, answer_refused FROM chat_messages) " + " UNION ALL ".join(_one(*x) for x in (
        ("corpus", "versions", "SELECT count(*) FROM v"), ("corpus", "items", "SELECT count(*) FROM (SELECT DISTINCT source_id, external_key FROM v)"), ("corpus", "live", "SELECT count(*) FROM v WHERE is_current AND deleted_at IS NULL"),
        ("corpus", "sources", "SELECT count(*) FROM (SELECT DISTINCT source_id FROM v)"), ("corpus", "chunks", "SELECT count(DISTINCT chunk_id) FROM ch"), ("corpus", "embedded share", "SELECT round(avg(CAST(embedded AS INTEGER)), 6) FROM ch"), ("corpus", "undated share", "SELECT round(avg(CAST(occurred_at IS NULL AS INTEGER)), 6) FROM v"),
        ("decisions", "decisions", "SELECT count(*) FROM (SELECT DISTINCT decision_id FROM e)"), ("decisions", "links", "SELECT count(*) FROM e"), ("decisions", "stored share", "SELECT round(avg(CAST(memory_id IS NOT NULL AS INTEGER)), 6) FROM e"),
        ("decisions", "contradicting share", "SELECT round(avg(CAST(relation = 'contradicts' AS INTEGER)), 6) FROM e"), ("decisions", "links per decision", "SELECT round(avg(k), 6) FROM (SELECT count(*) AS k FROM e GROUP BY decision_id)"),
        ("behaviour", "sessions", "SELECT count(DISTINCT session_id) FROM t"), ("behaviour", "turns", "SELECT count(*) FROM t"), ("behaviour", "refused share", "SELECT round(avg(CAST(answer_refused AS INTEGER)), 6) FROM t"), ("behaviour", "events", "SELECT count(*) FROM events"), ("behaviour", "active users", "SELECT count(*) FROM (SELECT DISTINCT user_id FROM events)"),
    )),
    "connections": """WITH l AS (SELECT l_orderkey AS item, 'p' || l_partkey AS entity FROM lineitem UNION SELECT l_orderkey, 's' || l_suppkey FROM lineitem), k AS (SELECT item, entity, o_orderdate AS at FROM l JOIN orders ON o_orderkey = item),
met AS (SELECT a.item, a.entity, b.item AS other FROM k a JOIN k b ON b.entity = a.entity AND b.item <> a.item AND b.at <= a.at WHERE a.item IN (SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)))
SELECT item, entity, count(*) AS items, total FROM met JOIN (SELECT item, count(DISTINCT other) AS total FROM met GROUP BY 1) USING (item) GROUP BY ALL""",
    "export_items": f"""WITH {_V}, {_CH}, {_TAG}, x AS (SELECT source_id, external_key, CAST(floor((version - 1) / 100) AS INTEGER) AS batch, version, '{{"version":' || version || ',"kind":"' || kind || '","content_hash":"' || content_hash || '","tags":[' ||
  coalesce((SELECT string_agg('"' || name || '"', ',' ORDER BY name) FROM tag WHERE tag.memory_id = v.memory_id), '') || '],"chunks":' || (SELECT count(DISTINCT chunk_id) FROM ch WHERE ch.memory_id = v.memory_id) || '}}' AS one FROM v)
SELECT source_id, external_key, batch, '{{"source_id":"' || source_id || '","external_key":"' || external_key || '","versions":[' || every || ']}}' AS json FROM (SELECT source_id, external_key, batch, string_agg(one, ',' ORDER BY version) AS every FROM x GROUP BY ALL)""",
    "processing_status": f"""WITH {_V}, {_CH}, c AS (SELECT memory_id, count(*) AS chunks, count(*) FILTER (embedded) AS embedded FROM ch GROUP BY 1),
p AS (SELECT external_key, coalesce(sum(chunks), 0) AS chunks, coalesce(sum(embedded), 0) AS embedded FROM (SELECT DISTINCT external_key, memory_id FROM v) LEFT JOIN c USING (memory_id) GROUP BY 1),
m AS (SELECT DISTINCT message_id, external_key FROM chat_messages)
SELECT message_id, CAST(coalesce(chunks, 0) AS BIGINT) AS chunks, CAST(coalesce(embedded, 0) AS BIGINT) AS embedded, CASE WHEN m.external_key IS NULL THEN 'not taken in' WHEN chunks IS NULL THEN 'waiting' WHEN chunks = 0 THEN 'chunking' WHEN embedded < chunks THEN 'embedding' ELSE 'ready' END AS stage FROM m LEFT JOIN p ON p.external_key = m.external_key""",
    "backfill_targets": f"""WITH {_V}, {_CH}, {_MEN}, c AS (SELECT memory_id, count(*) AS chunks, count(*) FILTER (NOT embedded) AS bare FROM ch GROUP BY 1), e AS (SELECT memory_id, count(*) AS names FROM men GROUP BY 1),
j AS (SELECT kind, chunks, bare, names FROM v LEFT JOIN c USING (memory_id) LEFT JOIN e USING (memory_id) WHERE is_current AND deleted_at IS NULL)
SELECT kind, 'unchunked' AS target, count(*) FILTER (chunks IS NULL) AS n FROM j GROUP BY 1 UNION ALL SELECT kind, 'unembedded', count(*) FILTER (bare > 0) FROM j GROUP BY 1 UNION ALL SELECT kind, 'unextracted', count(*) FILTER (names IS NULL) FROM j GROUP BY 1 UNION ALL SELECT kind, 'ready for relations', count(*) FILTER (names >= 2) FROM j GROUP BY 1""",
}
