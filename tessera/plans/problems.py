"""Problems 1 and 4 over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.changefeed import PURGE, item_log_kind, items_in_view
from tessera.operators.orphans import evidence_orphans, orphan_report
from tessera.session import cut
from tessera.sources.tables import read_table


def _orphans(spark, d):
    return evidence_orphans(
        read_table(spark, d, "decision_evidence"), read_table(spark, d, "memories"), read_table(spark, d, "sources")
    )


def _resumed(s, d):
    """The log in two parts: the first makes the table, the second is applied to it. A purge stays known for ever."""
    feed = read_table(s, d, "item_log")
    middle = feed.agg(F.floor((F.min("seq") + F.max("seq")) / 2).alias("seq")).scalar()
    base = cut(items_in_view(feed.where(F.col("seq") <= middle)), "base")
    return items_in_view(feed.where((F.col("seq") > middle) | (item_log_kind() == PURGE)), base)


QUERIES = {
    "p1_found": lambda s, d: _orphans(s, d).select("evidence_id", "field", "state"),
    "p1_report": lambda s, d: orphan_report(_orphans(s, d)),
    "p4_found": lambda s, d: items_in_view(read_table(s, d, "item_log")),
    "p4_resumed": _resumed,
}

_ORPHANS = """
WITH e AS (SELECT DISTINCT evidence_id, memory_id, source_name, external_key, linked_at FROM decision_evidence),
m AS (SELECT DISTINCT memory_id, source_id, external_key, version, ingested_at, deleted_at FROM memories),
items AS (SELECT s.source_name, m.* FROM m JOIN (SELECT DISTINCT source_id, source_name FROM sources) s USING (source_id)),
by_id AS (
  SELECT e.evidence_id, 'memory_id' AS field, e.linked_at,
    CASE WHEN m.memory_id IS NULL THEN 'missing' WHEN m.ingested_at > e.linked_at THEN 'late'
         WHEN m.deleted_at <= e.linked_at OR (e.linked_at IS NULL AND m.deleted_at IS NOT NULL) THEN 'deleted' END AS state
  FROM e LEFT JOIN m USING (memory_id) WHERE e.memory_id IS NOT NULL),
by_source AS (
  SELECT evidence_id, 'source_name' AS field, linked_at, 'missing' AS state
  FROM e WHERE source_name IS NOT NULL AND source_name NOT IN (SELECT source_name FROM sources)),
refs AS (SELECT * FROM e WHERE external_key IS NOT NULL AND source_name IN (SELECT source_name FROM sources)),
ranked AS (
  SELECT r.evidence_id, r.linked_at, i.memory_id, i.deleted_at,
    (r.linked_at IS NULL OR i.ingested_at <= r.linked_at) AS known,
    row_number() OVER (PARTITION BY r.evidence_id
      ORDER BY (r.linked_at IS NULL OR i.ingested_at <= r.linked_at) DESC, i.ingested_at DESC, i.version DESC) AS n
  FROM refs r LEFT JOIN items i ON i.source_name = r.source_name AND i.external_key = r.external_key),
by_item AS (
  SELECT evidence_id, 'external_key' AS field, linked_at,
    CASE WHEN memory_id IS NULL THEN 'missing' WHEN NOT known THEN 'late'
         WHEN deleted_at <= linked_at OR (linked_at IS NULL AND deleted_at IS NOT NULL) THEN 'deleted' END AS state
  FROM ranked WHERE n = 1),
orphans AS (SELECT DISTINCT * FROM (SELECT * FROM by_id UNION ALL SELECT * FROM by_source UNION ALL SELECT * FROM by_item)
  WHERE state IS NOT NULL)
"""

SQL = {
    "p1_found": _ORPHANS + "SELECT evidence_id, field, state FROM orphans",
    "p1_report": _ORPHANS
    + """SELECT CASE WHEN field = 'source_name' THEN 'sources' ELSE 'memories' END AS parent_table, field, state,
  strftime(linked_at, '%Y-%m') AS month, count(*) AS orphans FROM orphans GROUP BY ALL""",
    "p4_found": """
WITH l AS (SELECT *, lower(regexp_replace(event_type, '^\\s+|\\s+$', '', 'g')) AS kind FROM item_log),
last AS (SELECT source_name, external_key, version, content_hash, kind, deleted_at,
  row_number() OVER (PARTITION BY source_name, external_key ORDER BY seq DESC) AS n
  FROM l WHERE seq IS NOT NULL AND kind IN ('artifact_observed', 'item_deleted', 'item_purged')),
purged AS (SELECT DISTINCT source_name, external_key FROM l WHERE kind = 'item_purged')
SELECT source_name, external_key, version, content_hash FROM last
WHERE n = 1 AND kind = 'artifact_observed' AND deleted_at IS NULL
  AND NOT EXISTS (SELECT 1 FROM purged p WHERE p.source_name = last.source_name AND p.external_key = last.external_key)""",
}
SQL["p4_resumed"] = SQL["p4_found"]
