"""Streams over events (run on all input there is), their batch twins, and the surfacing gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import surfacing as sf
from tessera.plans.temporal import events
from tessera.sources.tables import read_table
from tessera.streaming import folds, streams as st


def _stream(s, d):
    return st.read_stream(s, d, "events")


def _history(s, d):
    day = F.to_date("ts")
    e = events(s, d).groupBy("user_id", day.alias("day")).agg(F.sort_array(F.collect_set("event_type")).alias("keys"), F.min("ts").alias("surfaced_at"), F.max("event_id").alias("m"))
    seen = F.col("surfaced_at")
    return e.select("user_id", "keys", "surfaced_at", F.when(F.col("m") % 5 == 0, seen + F.expr("INTERVAL 1 HOUR")).alias("dismissed_at"), (F.col("m") % 3 == 0).alias("useful"))


def _contexts(s, d):
    e = events(s, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_set("event_type")).alias("keys"), F.max("value").alias("v"), F.max("ts").alias("at"))
    return e.select("user_id", "day", "keys", F.when(F.col("v") > 12, F.round(F.col("v") / 1500, 9)).alias("score"), "at")


def _pending(s, d):
    rows = _stream(s, d).select("user_id", "event_type", "event_id", (F.col("value") > 15).alias("done"))
    return st.run_available(st.pending_dedupe(rows, ["user_id", "event_type"], "event_id", "done"), "append")


def _joined(s, d):
    clicks = _stream(s, d).where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("click_at"))
    buys = _stream(s, d).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("purchase_at"))
    return st.run_available(st.stream_join(clicks, buys, "user_id", "click_at", "purchase_at", "2 HOURS", "60 days"), "append").select("user_id", "click", "purchase")


QUERIES = {
    "stream_ingest": lambda s, d: st.run_available(_stream(s, d), "append", lambda b, n: b.withColumn("lag_us", F.lit(n * 0))).select("event_id", "event_type"),
    "tumbling_windows": lambda s, d: st.tumbling(events(s, d), "ts", "event_type", "1 hour"),
    "sliding_windows": lambda s, d: st.sliding(events(s, d), "ts", "event_type", "2 hours", "30 minutes"),
    "session_windows": lambda s, d: st.session_counts(events(s, d), "ts", "user_id"),
    "stream_tumbling": lambda s, d: st.run_available(st.tumbling(_stream(s, d), "ts", "event_type", "1 hour", "60 days"), "complete"),
    "stream_sliding": lambda s, d: st.run_available(st.sliding(_stream(s, d), "ts", "event_type", "2 hours", "30 minutes", "60 days"), "complete"),
    "stream_join": _joined,
    "stream_debounce": lambda s, d: st.run_available(st.debounce_stream(_stream(s, d).select("user_id", "event_id", "ts"), "user_id", "event_id", "ts", 3600), "append"),
    "debounce": lambda s, d: folds.debounce(events(s, d).select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 3600).where("emit").select("event_id"),
    "rate_limit": lambda s, d: folds.rate_limit(events(s, d).select("event_type", "event_id", "ts"), "event_type", "ts", "event_id", 3, 1800).select("event_id", "accepted"),
    "rate_limit_window": lambda s, d: folds.trailing_count(events(s, d), "event_type", "ts", 600).select("event_id", "in_window"),
    "pending_dedupe": _pending,
    "fan_out": lambda s, d: st.dispatch(events(s, d), s.createDataFrame([("click", "context"), ("click", "surface"), ("purchase", "context")], "kind string, handler string"), "event_type", "event_id"),
    "surfacing_thresholds": lambda s, d: sf.thresholds(_history(s, d), "user_id").withColumn("bar", F.round("bar", 9)),
    "surfacing_gate": lambda s, d: sf.gate(_contexts(s, d), _history(s, d), "user_id", "day"),
    "delivery_lag": lambda s, d: read_table(s, d, "item_log").select("event_id", (F.unix_micros("arrived_at") - F.unix_micros("recorded_at")).alias("lag_us")),
    "precompute_policy": lambda s, d: sf.precompute(events(s, d).withColumn("k", F.when(F.col("event_type") == "click", "editor_opened").when(F.col("event_type") == "view", "file_focused").otherwise("manual")), "k").groupBy("action").agg(F.count(F.lit(1)).alias("n")),
}

_TUM = "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"
_SLI = """SELECT start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start FROM events, range(0, 4) r(k)) GROUP BY ALL"""
_DEB = """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, event_id, ts AS last, n, true AS emit FROM o WHERE n = 1 UNION ALL
  SELECT o.user_id, o.event_id, CASE WHEN o.ts - w.last >= INTERVAL 1 HOUR THEN o.ts ELSE w.last END, o.n, o.ts - w.last >= INTERVAL 1 HOUR FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
SELECT event_id FROM w WHERE emit"""
_H = """h0 AS (SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list(DISTINCT event_type)) AS keys, min(ts) AS surfaced_at, max(ts) AS at, max(value) AS v, max(event_id) AS m FROM events GROUP BY ALL),
h AS (SELECT *, CASE WHEN m % 5 = 0 THEN surfaced_at + INTERVAL 1 HOUR END AS dismissed_at, m % 3 = 0 AS useful, CASE WHEN v > 12 THEN round(v / 1500, 9) END AS score FROM h0)"""
_BAR = "round(least(4e0, greatest(1e0, 1.8e0 + 0.6e0 * {d} - 0.2e0 * {u})) * (1e0 / 61), 9)"

SQL = {
    "rate_limit": """WITH RECURSIVE o AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT event_type, event_id, n, [ts] AS held, true AS accepted FROM o WHERE n = 1 UNION ALL
  SELECT o.event_type, o.event_id, o.n, CASE WHEN len(held) < 3 OR o.ts - held[1] >= INTERVAL 30 MINUTE THEN list_append(held, o.ts)[-3:] ELSE held END, len(held) < 3 OR o.ts - held[1] >= INTERVAL 30 MINUTE
  FROM w JOIN o ON o.event_type = w.event_type AND o.n = w.n + 1) SELECT event_id, accepted FROM w""",
    "pending_dedupe": """WITH RECURSIVE o AS (SELECT user_id, event_type, event_id, value > 15 AS done, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
w AS (SELECT user_id, event_type, event_id, n, CASE WHEN NOT done THEN event_id END AS pending, event_id AS stands_for FROM o WHERE n = 1 UNION ALL
  SELECT o.user_id, o.event_type, o.event_id, o.n, CASE WHEN NOT done THEN coalesce(w.pending, o.event_id) END, coalesce(w.pending, o.event_id) FROM w JOIN o ON o.user_id = w.user_id AND o.event_type = w.event_type AND o.n = w.n + 1)
SELECT event_id, stands_for FROM w""",
    "stream_ingest": "SELECT event_id, event_type FROM events",
    "tumbling_windows": _TUM,
    "stream_tumbling": _TUM,
    "sliding_windows": _SLI,
    "stream_sliding": _SLI,
    "session_windows": """WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events),
g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM f) SELECT min(ts) AS start, user_id, count(*) AS n FROM g GROUP BY user_id, k""",
    "stream_join": "SELECT a.user_id, a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b USING (user_id) WHERE a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOUR",
    "stream_debounce": _DEB,
    "debounce": _DEB,
    "rate_limit_window": "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND CURRENT ROW) AS in_window FROM events",
    "fan_out": "SELECT event_id, handler, event_id || ':' || handler AS dedupe_key FROM events JOIN (VALUES ('click', 'context'), ('click', 'surface'), ('purchase', 'context')) h(event_type, handler) USING (event_type)",
    "surfacing_thresholds": f"WITH {_H} SELECT user_id, count(dismissed_at) AS dismissed, count(*) FILTER (useful) AS useful, {_BAR.format(d='count(dismissed_at)', u='count(*) FILTER (useful)')} AS bar FROM h GROUP BY 1",
    "surfacing_gate": f"""WITH {_H}, p AS (SELECT c.user_id, c.day, any_value(c.score) AS score, count(*) FILTER (x.dismissed_at <= c.at) AS d, count(*) FILTER (x.useful) AS u,
bool_or(x.dismissed_at <= c.at AND c.at - x.dismissed_at < INTERVAL 30 DAY AND len(list_intersect(c.keys, x.keys)) / len(list_distinct(list_concat(c.keys, x.keys))) >= 0.6) AS unwanted,
bool_or(c.at - x.surfaced_at < INTERVAL 4 HOUR AND len(list_intersect(c.keys, x.keys)) / len(list_distinct(list_concat(c.keys, x.keys))) >= 0.6) AS repeated
FROM h c LEFT JOIN h x ON x.user_id = c.user_id AND x.surfaced_at < c.at GROUP BY ALL)
SELECT user_id, day, score, {_BAR.format(d='d', u='u')} AS bar, CASE WHEN score IS NULL THEN 'nothing_new' WHEN score <= {_BAR.format(d='d', u='u')} THEN 'below_threshold' WHEN unwanted THEN 'dismissed' WHEN repeated THEN 'already_surfaced' ELSE 'cleared' END AS reason FROM p""",
    "delivery_lag": "SELECT event_id, epoch_us(arrived_at) - epoch_us(recorded_at) AS lag_us FROM item_log",
    "precompute_policy": "SELECT CASE event_type WHEN 'click' THEN 'assemble' WHEN 'view' THEN 'read' ELSE 'none' END AS action, count(*) AS n FROM events GROUP BY 1",
}
