"""Temporal and version operators over memories, events, item_log, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import temporal as t
from tessera.operators import versions as v
from tessera.operators.changefeed import plain
from tessera.sources.tables import read_table

MEMORY = ["memory_id", "source_id", "external_key", "version", "is_current", "content_hash", "kind", "occurred_at", "occurred_at_source", "ingested_at", "deleted_at"]


def memories(s, d, *more):
    """Distinct versions without their texts (and whatever more is asked for)."""
    return read_table(s, d, "memories").select(*MEMORY, *more).distinct()


def events(s, d):
    return read_table(s, d, "events")


M = "(SELECT DISTINCT memory_id, source_id, external_key, version, is_current, content_hash, kind, occurred_at, occurred_at_source, ingested_at, deleted_at FROM memories)"


def _period(period):
    step = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH"}[period]
    return f"""WITH b AS (SELECT date_trunc('{period}', min(ts)) AS a, max(ts) AS z FROM events),
spine AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), z, INTERVAL {step})) AS TIMESTAMP) AS bucket FROM b),
c AS (SELECT CAST(date_trunc('{period}', ts) AS TIMESTAMP) AS bucket, event_type AS kind, count(*) AS n FROM events GROUP BY ALL)
SELECT bucket, kind, coalesce(n, 0) AS n FROM spine LEFT JOIN c USING (bucket)"""


def _range_activity(s, d):
    return t.activity_by_period(memories(s, d).where("deleted_at IS NULL AND is_current"), "occurred_at", "month", "kind", "2024-01-01", "2027-06-01")


QUERIES = {
    **{f"activity_by_{p}": lambda s, d, p=p: t.activity_by_period(events(s, d), "ts", p, "event_type") for p in t.PERIODS},
    "activity_in_range": _range_activity,
    "memories_in_range": lambda s, d: t.in_range(memories(s, d), "occurred_at", "2025-03-01", "2025-09-01").select("memory_id", "occurred_at", "external_key"),
    "memories_as_of": lambda s, d: t.as_of(memories(s, d), ["source_id", "external_key"], "2025-10-01").select("memory_id", "version", "ingested_at"),
    "out_of_order": lambda s, d: t.out_of_order(memories(s, d), "occurred_at", "ingested_at", 30 * 86400).select("memory_id", "lag_us"),
    "find_gaps_by_user": lambda s, d: t.find_gaps(events(s, d), ["user_id"], "ts", "event_id", 6 * 3600),
    "find_gaps_by_type": lambda s, d: t.find_gaps(events(s, d), ["event_type"], "ts", "event_id", 3600),
    "find_gaps_by_source": lambda s, d: t.find_gaps(memories(s, d), ["source_id"], "occurred_at", "memory_id", 7 * 86400),
    "sessionize": lambda s, d: t.sessionize(events(s, d), ["user_id"], "ts", "event_id").select("event_id", "user_id", "session"),
    "provenance_profile": lambda s, d: t.provenance_profile(memories(s, d), "occurred_at_source", "occurred_at"),
    "observed_bounds": lambda s, d: t.observed_bounds(memories(s, d), "occurred_at"),
    "confidence_horizon": lambda s, d: memories(s, d)
    .select("memory_id", t.confidence_horizon(F.when(F.col("version") % 5 != 0, F.lit(0.5)), F.col("occurred_at_source"), F.col("occurred_at"), F.col("ingested_at"), F.col("deleted_at").isNotNull()).alias("horizon")),
    "outcome_window": lambda s, d: read_table(s, d, "orders").select("o_orderkey", F.round(t.outcome_window_days(F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_totalprice") % 1000) / 1000)), 6).alias("days")),
    "version_fold": lambda s, d: v.fold_versions(read_table(s, d, "item_log"), ["source_name", "external_key"], "seq", "content_hash", recorded="recorded_at").select("source_name", "external_key", "version", "is_current", "content_hash"),
    "replay_deletions": lambda s, d: v.fold_versions(read_table(s, d, "item_log"), ["source_name", "external_key"], "seq", "content_hash").where("deleted_at IS NOT NULL").select("source_name", "external_key", "version"),
    "version_changes": lambda s, d: v.version_changes(memories(s, d), ["source_id", "external_key"], "content_hash", "memory_id").select("memory_id", "text_changed", "bytes_changed", "adopted"),
    "replay_diff": lambda s, d: v.keyed_diff(
        memories(s, d).where("is_current").select("source_id", "external_key", "version", "content_hash"),
        t.as_of(memories(s, d), ["source_id", "external_key"], "2026-01-01", until="deleted_at").select("source_id", "external_key", "version", "content_hash"),
        ["source_id", "external_key"], ["version", "content_hash"]),
    "correction_chains": lambda s, d: v.follow_chain(
        read_table(s, d, "chat_messages").groupBy("message_id").agg(F.max("corrects_message_id").alias("corrects_message_id")), "message_id", "corrects_message_id"),
    "tombstones": lambda s, d: read_table(s, d, "item_log").where(plain("event_type") == "item_deleted").where("seq IS NOT NULL").groupBy("source_name").agg(F.countDistinct("seq").alias("deletions"), F.countDistinct("external_key").alias("items")),
    "purge_rules": lambda s, d: read_table(s, d, "item_log").groupBy("source_name", "external_key").agg(F.max((plain("event_type") == "item_purged").cast("int")).alias("purged")).groupBy("purged").agg(F.count(F.lit(1)).alias("items")),
}

_LOG = "l AS (SELECT *, lower(regexp_replace(event_type, '^\\s+|\\s+$', '', 'g')) AS kind_ FROM item_log)"
_FOLD = f"""WITH {_LOG}, p AS (SELECT DISTINCT source_name, external_key FROM l WHERE kind_ = 'item_purged'),
o AS (SELECT DISTINCT source_name, external_key, seq, kind_, content_hash, recorded_at FROM l WHERE seq IS NOT NULL AND kind_ <> 'item_purged'
  AND NOT EXISTS (SELECT 1 FROM p WHERE p.source_name = l.source_name AND p.external_key = l.external_key)),
o1 AS (SELECT source_name, external_key, seq, min(kind_) AS kind_, min(content_hash) AS content_hash FROM o GROUP BY ALL),
n AS (SELECT *, CAST(sum(CASE WHEN kind_ = 'artifact_observed' THEN 1 ELSE 0 END) OVER (PARTITION BY source_name, external_key ORDER BY seq) AS INTEGER) AS version FROM o1)
"""

SQL = {
    **{f"activity_by_{p}": _period(p) for p in t.PERIODS},
    "activity_in_range": f"""WITH spine AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2027-05-31', INTERVAL 1 MONTH)) AS TIMESTAMP) AS bucket),
c AS (SELECT CAST(date_trunc('month', occurred_at) AS TIMESTAMP) AS bucket, kind, count(*) AS n FROM {M} m WHERE is_current AND deleted_at IS NULL
  AND occurred_at >= '2024-01-01' AND occurred_at < '2027-06-01' GROUP BY ALL)
SELECT bucket, kind, coalesce(n, 0) AS n FROM spine LEFT JOIN c USING (bucket)""",
    "memories_in_range": f"SELECT memory_id, occurred_at, external_key FROM {M} m WHERE occurred_at >= '2025-03-01' AND occurred_at < '2025-09-01'",
    "memories_as_of": f"""SELECT memory_id, version, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id, external_key ORDER BY ingested_at DESC, version DESC) AS n
FROM {M} m WHERE ingested_at <= '2025-10-01') WHERE n = 1 AND (deleted_at IS NULL OR deleted_at > '2025-10-01')""",
    "out_of_order": f"SELECT memory_id, epoch_us(ingested_at) - epoch_us(occurred_at) AS lag_us FROM {M} m WHERE ingested_at - occurred_at > INTERVAL 30 DAY",
    "find_gaps_by_user": """SELECT user_id, p AS gap_start, ts AS gap_end, epoch_us(ts) - epoch_us(p) AS gap_us FROM
(SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE ts - p >= INTERVAL 6 HOUR""",
    "find_gaps_by_type": """SELECT event_type, p AS gap_start, ts AS gap_end, epoch_us(ts) - epoch_us(p) AS gap_us FROM
(SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events) WHERE ts - p >= INTERVAL 1 HOUR""",
    "find_gaps_by_source": f"""SELECT source_id, p AS gap_start, occurred_at AS gap_end, epoch_us(occurred_at) - epoch_us(p) AS gap_us FROM
(SELECT source_id, occurred_at, lag(occurred_at) OVER (PARTITION BY source_id ORDER BY occurred_at, memory_id) AS p FROM {M} m WHERE occurred_at IS NOT NULL) WHERE occurred_at - p >= INTERVAL 7 DAY""",
    "sessionize": """SELECT event_id, user_id, CAST(sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)""",
    "provenance_profile": f"""WITH c AS (SELECT coalesce(occurred_at_source, 'unknown') AS provenance, count(*) AS n, min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM {M} m GROUP BY 1)
SELECT provenance, coalesce(n, 0) AS n, first_at, last_at FROM (SELECT provenance FROM c UNION SELECT 'unknown') LEFT JOIN c USING (provenance)""",
    "observed_bounds": "SELECT min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM memories",
    "confidence_horizon": f"""SELECT memory_id, CASE WHEN version % 5 = 0 THEN 'unknown' WHEN deleted_at IS NOT NULL OR occurred_at_source <> 'declared' OR ingested_at - occurred_at > INTERVAL 1 DAY THEN 'hindsight' ELSE 'foresight' END AS horizon FROM {M} m""",
    "outcome_window": "SELECT o_orderkey, round(CASE WHEN o_orderkey % 7 = 0 THEN 90e0 ELSE 30e0 + 150e0 * ((o_totalprice % 1000) / 1000) END, 6) AS days FROM orders",
    "version_fold": _FOLD + """, w AS (SELECT source_name, external_key, version, content_hash, max(version) OVER (PARTITION BY source_name, external_key) AS top, kind_ FROM n)
SELECT source_name, external_key, version, content_hash, version = top AS is_current FROM w WHERE kind_ = 'artifact_observed'""",
    "replay_deletions": _FOLD + "SELECT DISTINCT source_name, external_key, version FROM n WHERE kind_ = 'item_deleted' AND version > 0",
    "version_changes": f"""SELECT memory_id, CASE WHEN n > 1 THEN p IS DISTINCT FROM content_hash END AS text_changed, CASE WHEN n > 1 THEN q IS DISTINCT FROM memory_id END AS bytes_changed,
CASE WHEN n > 1 THEN p IS NOT DISTINCT FROM content_hash AND q IS DISTINCT FROM memory_id END AS adopted FROM
(SELECT *, lag(content_hash) OVER w AS p, lag(memory_id) OVER w AS q, row_number() OVER w AS n FROM {M} m WINDOW w AS (PARTITION BY source_id, external_key ORDER BY version))""",
    "replay_diff": f"""WITH e AS (SELECT source_id, external_key, version, content_hash FROM {M} m WHERE is_current),
a AS (SELECT source_id, external_key, version, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY source_id, external_key ORDER BY ingested_at DESC, version DESC) AS n
  FROM {M} m WHERE ingested_at <= '2026-01-01') WHERE n = 1 AND (deleted_at IS NULL OR deleted_at > '2026-01-01'))
SELECT coalesce(e.source_id, a.source_id) AS source_id, coalesce(e.external_key, a.external_key) AS external_key,
CASE WHEN a.source_id IS NULL THEN 'missing' WHEN e.source_id IS NULL THEN 'unexpected' ELSE 'changed' END AS difference
FROM e FULL JOIN a ON e.source_id = a.source_id AND e.external_key = a.external_key
WHERE a.source_id IS NULL OR e.source_id IS NULL OR e.version <> a.version OR e.content_hash IS DISTINCT FROM a.content_hash""",
    "correction_chains": """WITH RECURSIVE l AS (SELECT message_id, max(corrects_message_id) AS t FROM chat_messages GROUP BY 1),
c AS (SELECT message_id AS key, message_id AS final, 0 AS hops FROM l UNION ALL SELECT c.key, l.t, c.hops + 1 FROM c JOIN l ON l.message_id = c.final WHERE l.t IS NOT NULL AND c.hops < 9)
SELECT key, CASE WHEN hops <= 8 THEN final END AS final, least(hops, 8) AS hops FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY hops DESC) AS n FROM c) WHERE n = 1""",
    "tombstones": f"WITH {_LOG} SELECT source_name, count(DISTINCT seq) AS deletions, count(DISTINCT external_key) AS items FROM l WHERE kind_ = 'item_deleted' AND seq IS NOT NULL GROUP BY 1",
    "purge_rules": f"WITH {_LOG} SELECT purged, count(*) AS items FROM (SELECT source_name, external_key, CAST(bool_or(kind_ = 'item_purged') AS INTEGER) AS purged FROM l GROUP BY ALL) GROUP BY 1",
}
