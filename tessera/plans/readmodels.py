"""Listing queries, sources, exports, and column encryption."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.functions import crypto
from tessera.operators import relational as rel
from tessera.operators.versions import follow_chain
from tessera.plans.temporal import M, events, memories
from tessera.sources import files, log
from tessera.sources.tables import read_table


def n_():
    return F.count(F.lit(1))


def evidence(s, d):
    return read_table(s, d, "decision_evidence").distinct()


def _sealed(s, d):
    m = read_table(s, d, "memories").select("memory_id", "title").where("title IS NOT NULL").distinct()
    key = F.unhex(F.substring(F.sha2("memory_id", 256), 1, 64))
    iv = F.unhex(F.substring(F.sha2(F.concat(F.lit("iv"), "memory_id"), 256), 1, 24))
    sealed = m.withColumn("sealed", crypto.encrypt(F.col("title"), key, iv, F.col("memory_id")))
    wrong = F.unhex(F.substring(F.sha2(F.concat(F.lit("x"), "memory_id"), 256), 1, 64))
    return sealed.select("memory_id", crypto.decrypt(F.col("sealed"), key, F.col("memory_id")).alias("title"), crypto.decrypt(F.col("sealed"), wrong, F.col("memory_id")).alias("shredded"))


def _superseded(s, d):
    m = read_table(s, d, "chat_messages").select("message_id", "corrects_message_id").distinct()
    by = m.where("corrects_message_id IS NOT NULL").groupBy(F.col("corrects_message_id").alias("message_id")).agg(F.max("message_id").alias("superseded_by"))
    return m.select("message_id").distinct().join(by, "message_id")


def _detail(m):
    """Every version of a key with its place, the newest first."""
    place = F.row_number().over(Window.partitionBy("source_id", "external_key").orderBy(F.desc("version")))
    return m.select("source_id", "external_key", "version", "memory_id", "ingested_at", place.alias("place"))


QUERIES = {
    "source_list": lambda s, d: read_table(s, d, "sources").join(memories(s, d).where(rel.live()).select("source_id", "memory_id", "external_key"), "source_id", "left").groupBy("source_name").agg(F.countDistinct("memory_id").alias("items"), F.countDistinct("external_key").alias("keys")),
    "memory_detail": lambda s, d: _detail(memories(s, d)),
    "decision_list": lambda s, d: evidence(s, d).groupBy("decision_id").agg(n_().alias("links"), F.count_if(F.col("relation") == "informed").alias("informed"), F.count_if(F.col("relation") == "contradicts").alias("contradicts"), F.max("linked_at").alias("last_linked")),
    "decision_detail": lambda s, d: evidence(s, d).where("memory_id IS NOT NULL").join(memories(s, d).select("memory_id", "kind", "is_current"), "memory_id").groupBy("decision_id", "relation", "kind").agg(n_().alias("n"), F.count_if("is_current").alias("current")),
    "review_queue": lambda s, d: rel.page(evidence(s, d).where("relation = 'contradicts'"), [F.desc_nulls_last("linked_at"), F.asc("evidence_id")], 50).select("evidence_id", "decision_id", "linked_at"),
    "evidence_by_side": lambda s, d: evidence(s, d).groupBy("source_name").pivot("relation", ["informed", "records", "contradicts"]).agg(n_().cast("bigint")),
    "event_tail": lambda s, d: events(s, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).orderBy("ts", "event_id").select("event_id", "ts"),
    "session_list": lambda s, d: read_table(s, d, "chat_sessions").distinct().where("archived_at IS NULL").select("session_id", "title", "last_activity", "message_count"),
    "session_counts_check": lambda s, d: read_table(s, d, "chat_sessions").select("session_id", "message_count").distinct().join(read_table(s, d, "chat_messages").groupBy("session_id").agg(F.countDistinct("ordinal").alias("turns")), "session_id", "left").where("message_count <> coalesce(turns, 0)").select("session_id", "message_count", F.coalesce("turns", F.lit(0)).alias("turns")),
    "superseded_messages": _superseded,
    "final_corrections": lambda s, d: follow_chain(read_table(s, d, "chat_messages").groupBy("message_id").agg(F.max("corrects_message_id").alias("c")), "message_id", "c").where("hops > 0").groupBy("hops").agg(n_().alias("n")),
    "assumption_proposals": lambda s, d: read_table(s, d, "memory_hits").select("query_id", "memory_id", "score", "searched_at").distinct().join(memories(s, d).select("memory_id", "occurred_at"), "memory_id").where("occurred_at > timestamp'2025-06-01'").join(evidence(s, d).groupBy("memory_id").agg(n_().alias("shared")), "memory_id", "left").select("query_id", "memory_id", "score", F.coalesce("shared", F.lit(0)).alias("shared")),
    "file_changes": lambda s, d: files.changed(memories(s, d).where("is_current").select("external_key", F.col("ingested_at").alias("modified_at"), F.length("content_hash").cast("long").alias("bytes")), memories(s, d).where("is_current AND kind <> 'note'").select("external_key", F.col("ingested_at").alias("modified_at"), F.length("content_hash").cast("long").alias("bytes"))).select("external_key").distinct(),
    "vanished_files": lambda s, d: files.vanished(memories(s, d).where("deleted_at IS NULL"), memories(s, d)),
    "blob_store": lambda s, d: files.blobs(read_table(s, d, "documents").select(F.col("text").cast("binary").alias("content"))).select("hash", "bytes"),
    "new_artifacts": lambda s, d: files.unknown_blobs(files.blobs(read_table(s, d, "documents").select(F.col("text").cast("binary").alias("content"))), files.blobs(read_table(s, d, "documents").where("kind = 'note'").select(F.col("text").cast("binary").alias("content")))).select("hash"),
    "parser_dispatch": lambda s, d: memories(s, d).groupBy(files.parser_of("external_key").alias("parser")).agg(n_().alias("n")),
    "log_append": lambda s, d: log.append(read_table(s, d, "item_log").select("seq"), events(s, d).select("event_id", "ts"), [F.unix_micros("ts"), F.col("event_id")], "2026-01-01").select("event_id", "seq"),
    "log_scan": lambda s, d: log.scan(read_table(s, d, "item_log"), 5000).select("seq", "event_id"),
    "export_json": lambda s, d: log.export_lines(memories(s, d), "source_id", "external_key", ["version", "kind", "content_hash"]).select("line"),
    "export_markdown": lambda s, d: log.export_markdown(read_table(s, d, "memories").select("memory_id", "title", "content").distinct(), "title", "content").select("memory_id", "markdown"),
    "column_encryption": _sealed,
}

E = "(SELECT DISTINCT * FROM decision_evidence)"
LIVE = "is_current AND deleted_at IS NULL"

SQL = {
    "source_list": f"SELECT source_name, count(DISTINCT memory_id) AS items, count(DISTINCT external_key) AS keys FROM sources LEFT JOIN (SELECT * FROM memories WHERE {LIVE}) m USING (source_id) GROUP BY 1",
    "memory_detail": f"SELECT source_id, external_key, version, memory_id, ingested_at, CAST(row_number() OVER (PARTITION BY source_id, external_key ORDER BY version DESC) AS INTEGER) AS place FROM {M} m",
    "decision_list": f"SELECT decision_id, count(*) AS links, count(*) FILTER (relation = 'informed') AS informed, count(*) FILTER (relation = 'contradicts') AS contradicts, max(linked_at) AS last_linked FROM {E} e GROUP BY 1",
    "decision_detail": f"SELECT decision_id, relation, kind, count(*) AS n, count(*) FILTER (is_current) AS current FROM {E} e JOIN {M} m USING (memory_id) GROUP BY ALL",
    "review_queue": f"SELECT evidence_id, decision_id, linked_at FROM {E} e WHERE relation = 'contradicts' ORDER BY linked_at DESC NULLS LAST, evidence_id LIMIT 50",
    "evidence_by_side": f"SELECT source_name, nullif(count(*) FILTER (relation = 'informed'), 0) AS informed, nullif(count(*) FILTER (relation = 'records'), 0) AS records, nullif(count(*) FILTER (relation = 'contradicts'), 0) AS contradicts FROM {E} e GROUP BY 1",
    "event_tail": "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "session_list": "SELECT DISTINCT session_id, title, last_activity, message_count FROM chat_sessions WHERE archived_at IS NULL",
    "session_counts_check": "SELECT session_id, message_count, coalesce(turns, 0) AS turns FROM (SELECT DISTINCT session_id, message_count FROM chat_sessions) LEFT JOIN (SELECT session_id, count(DISTINCT ordinal) AS turns FROM chat_messages GROUP BY 1) USING (session_id) WHERE message_count <> coalesce(turns, 0)",
    "superseded_messages": "SELECT corrects_message_id AS message_id, max(message_id) AS superseded_by FROM chat_messages WHERE corrects_message_id IN (SELECT message_id FROM chat_messages) GROUP BY 1",
    "final_corrections": """WITH RECURSIVE l AS (SELECT message_id, max(corrects_message_id) AS t FROM chat_messages GROUP BY 1),
c AS (SELECT message_id AS key, message_id AS final, 0 AS hops FROM l UNION ALL SELECT c.key, l.t, c.hops + 1 FROM c JOIN l ON l.message_id = c.final WHERE l.t IS NOT NULL AND c.hops < 8)
SELECT CAST(hops AS INTEGER) AS hops, count(*) AS n FROM (SELECT key, max(hops) AS hops FROM c GROUP BY 1) WHERE hops > 0 GROUP BY 1""",
    "assumption_proposals": f"""SELECT query_id, h.memory_id, score, coalesce(shared, 0) AS shared FROM (SELECT DISTINCT query_id, memory_id, score, searched_at FROM memory_hits) h JOIN {M} m ON m.memory_id = h.memory_id
LEFT JOIN (SELECT memory_id, count(*) AS shared FROM {E} e GROUP BY 1) x ON x.memory_id = h.memory_id WHERE occurred_at > '2025-06-01'""",
    "file_changes": "SELECT DISTINCT external_key FROM memories m WHERE is_current AND NOT EXISTS (SELECT 1 FROM memories k WHERE k.is_current AND k.kind <> 'note' AND k.external_key = m.external_key AND k.ingested_at = m.ingested_at)",
    "vanished_files": "SELECT external_key FROM memories EXCEPT SELECT external_key FROM memories WHERE deleted_at IS NULL",
    "blob_store": "SELECT DISTINCT sha256(text) AS hash, CAST(strlen(text) AS INTEGER) AS bytes FROM documents WHERE text IS NOT NULL",
    "new_artifacts": "SELECT sha256(text) AS hash FROM documents WHERE text IS NOT NULL EXCEPT SELECT sha256(text) FROM documents WHERE kind = 'note' AND text IS NOT NULL",
    "parser_dispatch": f"SELECT CASE WHEN regexp_matches(external_key, '\\.(md|markdown)$') THEN 'markdown' WHEN regexp_matches(external_key, '\\.(py|js|ts|go|rs|java|c|h|sh)$') THEN 'code' WHEN external_key LIKE '%.pdf' THEN 'pdf' ELSE 'text' END AS parser, count(*) AS n FROM {M} m GROUP BY 1",
    "log_append": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) + (SELECT max(seq) FROM item_log) AS seq FROM events",
    "log_scan": "SELECT seq, event_id FROM item_log WHERE seq > 5000",
    "export_markdown": "SELECT DISTINCT memory_id, '# ' || coalesce(title, '(untitled)') || chr(10) || chr(10) || coalesce(content, '') || chr(10) AS markdown FROM memories",
    "column_encryption": "SELECT DISTINCT memory_id, title, CAST(NULL AS VARCHAR) AS shredded FROM memories WHERE title IS NOT NULL",
    "export_json": f"""SELECT '{{"source_id":"' || source_id || '","external_key":"' || external_key || '","version":' || version || ',"kind":"' || kind || '","content_hash":"' || content_hash || '"}}' AS line FROM {M} m""",
}
