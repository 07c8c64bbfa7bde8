"""Filters, joins, aggregates, windows, set operations and limits over the test tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.operators import relational as r
from tessera.plans.temporal import M, events, memories
from tessera.sources.tables import read_table


def _t(name):
    return lambda s, d: read_table(s, d, name)


orders, lineitem, customer, part, nation, supplier, sources = map(_t, ("orders", "lineitem", "customer", "part", "nation", "supplier", "sources"))
evidence = lambda s, d: read_table(s, d, "decision_evidence").distinct()


def n_():
    return F.count(F.lit(1))


_FILTERS = r.SearchFilters(kinds=("note", "document"), occurred_after="2025-02-01", occurred_before="2026-02-01")


def _tags(s, d):
    return events(s, d).select("user_id", "event_type")


def _spans(s, d):
    e = events(s, d).select("event_id", "user_id", (F.col("value") * 10).cast("int").alias("a"))
    left = e
    chunk = left.select("user_id", F.col("event_id").alias("chunk"), F.col("a").alias("b_start"), (F.col("a") + 40).alias("b_end"))
    diff = left.select("user_id", F.col("event_id").alias("diff"), F.col("a").alias("a_start"), (F.col("a") + F.col("event_id") % 3 * 5).cast("int").alias("a_end"))
    met = r.overlap_join(diff, chunk, ["user_id"], ("a_start", "a_end"), ("b_start", "b_end"))
    return met.groupBy("user_id").agg(n_().alias("pairs"), F.countDistinct("chunk").alias("chunks"))


def _interval(s, d):
    o = orders(s, d).select("o_orderkey", F.col("o_orderdate").alias("decided"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(90))).alias("until"))
    l = lineitem(s, d).select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_shipdate").alias("seen"), "l_extendedprice")
    return r.interval_join(o, l, ["o_orderkey"], "decided", "until", "seen").groupBy("o_orderkey").agg(n_().alias("hits"), F.min("seen").alias("first_seen"))


def _jaccard(s, d):
    by_day = events(s, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("types"))
    back = by_day.select("user_id", F.date_add("day", 1).alias("day"), F.col("types").alias("before"))
    return by_day.join(back, ["user_id", "day"]).select("user_id", "day", F.round(r.jaccard(F.col("types"), F.col("before")), 6).alias("jaccard"))


def _term_overlap(s, d):
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: F.length(x) > 3))
    a = read_table(s, d, "chat_sessions").select("session_id", F.explode(words("title")).alias("term")).distinct()
    b = memories(s, d, "title").where(r.live()).select("memory_id", F.explode(words("title")).alias("term")).distinct()
    # each side is counted per term before they meet, so a common term costs no more than a rare one
    return a.groupBy("term").agg(n_().alias("sessions")).join(b.groupBy("term").agg(n_().alias("items")), "term")


def w_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


QUERIES = {
    "current_and_live": lambda s, d: memories(s, d).where(r.live()).select("memory_id", "kind"),
    "search_filters": lambda s, d: memories(s, d).where(_FILTERS.condition()).select("memory_id", "kind", "occurred_at"),
    "search_filters_deleted": lambda s, d: memories(s, d).where(r.SearchFilters(kinds=("code",), include_deleted=True).condition()).select("memory_id"),
    "all_of_tags": lambda s, d: r.with_all(_tags(s, d), "user_id", "event_type", ["click", "purchase", "error", "signup"]),
    "conjunctive_tag_filter": lambda s, d: events(s, d).where("value > 50").join(r.with_all(_tags(s, d), "user_id", "event_type", ["click", "purchase"]), "user_id", "left_semi").select("event_id"),
    "stale_rows": lambda s, d: read_table(s, d, "candidates").select("candidate_id", "embedding_model").distinct().where(r.stale("embedding_model", "mini-48-v2")).select("candidate_id"),
    "substring_search": lambda s, d: read_table(s, d, "chat_messages").where(F.col("content").ilike("%decide%")).select("message_id"),
    "suffix_match": lambda s, d: memories(s, d).where(F.col("external_key").endswith(".py")).select("memory_id"),
    "choice_phrases": lambda s, d: read_table(s, d, "documents").where(F.col("text").rlike(r"(?i)(rather than|instead of|decided|chosen|opted for)") & (F.length("text") >= 320)).select("doc_id"),
    "row_value_in": lambda s, d: memories(s, d).join(memories(s, d).where("version >= 3").select("source_id", "external_key").distinct(), ["source_id", "external_key"], "left_semi").select("memory_id"),
    "glob_exclusion": lambda s, d: memories(s, d).where(r.glob_excluded("external_key", ["*.pdf", "notes/*", "inbox/*/b*"])).select("memory_id"),
    "row_level_scope": lambda s, d: r.scoped(events(s, d).withColumn("owner", F.concat(F.lit("u"), "user_id")), "owner", "u17").select("event_id"),
    "second_page": lambda s, d: r.page(memories(s, d), [F.desc("ingested_at"), F.asc("memory_id")], 20, 20).select("memory_id", "ingested_at"),
    "inner_join": lambda s, d: evidence(s, d).where("memory_id IS NOT NULL").select("evidence_id", "memory_id").join(memories(s, d), "memory_id").join(sources(s, d).select("source_id", F.col("kind").alias("source_kind")), "source_id").groupBy("source_kind", "kind").agg(n_().alias("n")),
    "left_join_zero_kept": lambda s, d: sources(s, d).join(memories(s, d).where(r.live()).select("source_id", "memory_id"), "source_id", "left").groupBy("source_name").agg(F.count("memory_id").alias("items")),
    "left_join_aggregates": lambda s, d: memories(s, d).groupBy("source_id", "external_key").agg(n_().alias("versions"), F.max("memory_id").alias("memory_id")).join(evidence(s, d).groupBy("memory_id").agg(n_().alias("cited")), "memory_id", "left").select("source_id", "external_key", "versions", F.coalesce("cited", F.lit(0)).alias("cited")),
    "semi_join": lambda s, d: memories(s, d).join(evidence(s, d).where("relation = 'contradicts'"), "memory_id", "left_semi").select("memory_id"),
    "anti_join": lambda s, d: memories(s, d).where(r.live()).join(evidence(s, d), "memory_id", "left_anti").select("memory_id"),
    "not_reviewed": lambda s, d: memories(s, d).join(sources(s, d).select("source_id", "source_name"), "source_id").join(evidence(s, d).select("source_name", "external_key"), ["source_name", "external_key"], "left_anti").select("memory_id"),
    "key_difference": lambda s, d: memories(s, d).select("external_key").distinct().join(read_table(s, d, "item_log").select("external_key"), "external_key", "left_anti"),
    "full_outer_join": lambda s, d: memories(s, d).groupBy("kind").agg(n_().alias("items")).join(read_table(s, d, "documents").groupBy("kind").agg(n_().alias("documents")), "kind", "full_outer").select("kind", "items", "documents"),
    "customers_without_urgent_orders": lambda s, d: customer(s, d).join(orders(s, d).where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
    "unreturned_parts": lambda s, d: part(s, d).join(lineitem(s, d).where("l_returnflag = 'R' AND l_quantity >= 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey"),
    "cooccurrence": lambda s, d: r.pairs_within(lineitem(s, d), ["l_orderkey"], "l_partkey", 3, orders(s, d)),
    "natural_key_relink": lambda s, d: r.natural_key_links(evidence(s, d).select("evidence_id", "source_name", "external_key").dropna(), memories(s, d).where(r.live()).join(sources(s, d).select("source_id", "source_name"), "source_id").select("source_name", "external_key", "memory_id"), ["source_name", "external_key"]).select("evidence_id", "memory_id"),
    "interval_join": _interval,
    "span_overlap": _spans,
    "jaccard_history": _jaccard,
    "term_overlap": _term_overlap,
    "stats_one_pass": lambda s, d: memories(s, d).agg(n_().alias("total"), F.count_if("is_current").alias("current"), F.count_if(r.live()).alias("live"), F.countDistinct("source_id", "external_key").alias("items"), F.count_if(F.col("occurred_at").isNull()).alias("undated"), F.round(F.count_if(r.live()) / n_(), 6).alias("live_share")),
    "filtered_counts": lambda s, d: events(s, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 20).alias("large"), n_().alias("n")),
    "distinct_edges": lambda s, d: lineitem(s, d).where("l_partkey <> l_suppkey").agg(F.countDistinct("l_partkey", "l_suppkey", "l_returnflag").alias("edges")),
    "event_latency": lambda s, d: read_table(s, d, "item_log").groupBy("source_name").agg(n_().alias("n"), F.round(F.avg((F.unix_micros("arrived_at") - F.unix_micros("recorded_at")) / 1e6), 4).alias("mean_lag_s"), F.max(F.unix_micros("arrived_at") - F.unix_micros("recorded_at")).alias("worst_lag_us")),
    "importance_evidence": lambda s, d: memories(s, d).groupBy("source_id", "external_key").agg(n_().alias("versions")).groupBy("versions").agg(n_().alias("items")),
    "weekly_rhythm": lambda s, d: memories(s, d).where("occurred_at IS NOT NULL AND occurred_at_source <> 'filesystem'").groupBy(F.date_trunc("week", "occurred_at").alias("week")).agg(n_().alias("n"), F.round(F.count_if(F.weekday("occurred_at") >= 5) / n_(), 6).alias("weekend_share")).where("weekend_share >= 0.4 OR weekend_share <= 0.1"),
    "corpus_fingerprint": lambda s, d: memories(s, d).agg(F.sha2(F.concat_ws("|", n_(), F.count_if("is_current"), F.unix_micros(F.max("ingested_at")), F.max("memory_id")), 256).alias("fingerprint")),
    "relation_counts": lambda s, d: evidence(s, d).groupBy("relation").agg(n_().alias("n"), F.countDistinct("decision_id").alias("decisions")),
    "value_summary": lambda s, d: events(s, d).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.min("value").alias("least"), F.round(F.stddev_pop("value"), 6).alias("spread")),
    "message_ordinals": lambda s, d: read_table(s, d, "chat_messages").where("session_id IS NOT NULL").select("session_id", "message_id", F.row_number().over(Window.partitionBy("session_id").orderBy("received_at", "message_id")).alias("n")),
    "history_pairs": lambda s, d: read_table(s, d, "chat_messages").where("session_id IS NOT NULL AND ordinal IS NOT NULL").groupBy("session_id", "ordinal").agg(F.min(F.lower(F.trim("role"))).alias("role"), F.min("message_id").alias("message_id")).withColumns({"next_role": F.lead("role").over(Window.partitionBy("session_id").orderBy("ordinal")), "answer": F.lead("message_id").over(Window.partitionBy("session_id").orderBy("ordinal"))}).where("role = 'user' AND next_role = 'assistant'").select("message_id", "answer"),
    "nulls_last_order": lambda s, d: memories(s, d).orderBy(F.desc_nulls_last("occurred_at"), "memory_id").limit(50).select("memory_id", "occurred_at"),
    "nulls_first_order": lambda s, d: memories(s, d).orderBy(F.asc_nulls_first("occurred_at"), "memory_id").limit(50).select("memory_id", "occurred_at"),
    "random_sample": lambda s, d: r.sample(orders(s, d), "o_orderkey", 100, 11).select("o_orderkey"),
    "ordering_top_k": lambda s, d: orders(s, d).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate"),
    "union_distinct": lambda s, d: memories(s, d).select("external_key").union(read_table(s, d, "documents").select("external_key")).distinct(),
    "union_all": lambda s, d: memories(s, d).select("kind").union(read_table(s, d, "documents").select("kind")).groupBy("kind").agg(n_().alias("n")),
    "intersect_keys": lambda s, d: memories(s, d).select("external_key").intersect(evidence(s, d).select("external_key")),
    "except_keys": lambda s, d: evidence(s, d).select("external_key").subtract(memories(s, d).select("external_key")),
    "intersect_all": lambda s, d: memories(s, d).select("kind").intersectAll(read_table(s, d, "documents").select("kind")),
    "except_all": lambda s, d: read_table(s, d, "documents").select("kind").exceptAll(memories(s, d).select("kind")),
    "best_unordered_pair": lambda s, d: r.best_pairs(lineitem(s, d).where("l_partkey <> l_suppkey"), "l_partkey", "l_suppkey", "l_quantity"),
    "rollup": lambda s, d: lineitem(s, d).rollup("l_returnflag", "l_linestatus").agg(n_().alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.grouping_id().cast("int").alias("level")),
    "cube": lambda s, d: memories(s, d).cube("kind", "occurred_at_source").agg(n_().alias("n"), F.grouping_id().cast("int").alias("level")),
    "grouping_sets": lambda s, d: orders(s, d).groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(n_().alias("n")),
    "pivot": lambda s, d: lineitem(s, d).groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(n_().cast("bigint")),
    "ranking_windows": lambda s, d: orders(s, d).select("o_orderkey", *[f.over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias(n) for n, f in {"rn": F.row_number(), "rk": F.rank(), "dr": F.dense_rank(), "nt": F.ntile(3)}.items()]),
    "frame_windows": lambda s, d: events(s, d).select("event_id", F.round(F.sum("value").over(w_user().rowsBetween(-2, 0)), 4).alias("last_three"), F.lag("value").over(w_user()).alias("before"), F.lead("value", 2).over(w_user()).alias("after_next"), F.first("value").over(w_user()).alias("first_value")),
    "range_window": lambda s, d: events(s, d).select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3_600_000_000, 0)).alias("in_last_hour")),
    "lateral_top_n": lambda s, d: r.top_per(orders(s, d), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select("o_custkey", "o_orderkey", "rank"),
    "revenue_by_nation": lambda s, d: lineitem(s, d).join(orders(s, d), F.col("l_orderkey") == F.col("o_orderkey")).join(customer(s, d), F.col("o_custkey") == F.col("c_custkey")).join(nation(s, d), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), n_().alias("n")),
    "pricing_summary": lambda s, d: lineitem(s, d).where("l_shipdate <= timestamp'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), n_().alias("n")),
}

E = "(SELECT DISTINCT * FROM decision_evidence)"
LIVE = "is_current AND deleted_at IS NULL"

SQL = {
    "current_and_live": f"SELECT memory_id, kind FROM {M} m WHERE {LIVE}",
    "search_filters": f"SELECT memory_id, kind, occurred_at FROM {M} m WHERE {LIVE} AND kind IN ('note', 'document') AND occurred_at BETWEEN '2025-02-01' AND '2026-02-01'",
    "search_filters_deleted": f"SELECT memory_id FROM {M} m WHERE kind = 'code'",
    "all_of_tags": "SELECT user_id FROM events WHERE event_type IN ('click', 'purchase', 'error', 'signup') GROUP BY 1 HAVING count(DISTINCT event_type) = 4",
    "conjunctive_tag_filter": "SELECT event_id FROM events e WHERE value > 50 AND (SELECT count(DISTINCT event_type) FROM events t WHERE t.user_id = e.user_id AND event_type IN ('click', 'purchase')) = 2",
    "stale_rows": "SELECT DISTINCT candidate_id FROM candidates WHERE embedding_model IS DISTINCT FROM 'mini-48-v2'",
    "substring_search": "SELECT message_id FROM chat_messages WHERE content ILIKE '%decide%'",
    "suffix_match": f"SELECT memory_id FROM {M} m WHERE external_key LIKE '%.py'",
    "choice_phrases": "SELECT doc_id FROM documents WHERE regexp_matches(text, '(rather than|instead of|decided|chosen|opted for)', 'i') AND length(text) >= 320",
    "row_value_in": f"SELECT memory_id FROM {M} m WHERE (source_id, external_key) IN (SELECT (source_id, external_key) FROM memories WHERE version >= 3)",
    "glob_exclusion": f"SELECT memory_id FROM {M} m WHERE external_key LIKE '%.pdf' OR external_key LIKE 'notes/%' OR regexp_matches(external_key, '^inbox/.*/b.*$')",
    "row_level_scope": "SELECT event_id FROM events WHERE user_id = 17",
    "second_page": f"SELECT memory_id, ingested_at FROM {M} m ORDER BY ingested_at DESC, memory_id LIMIT 20 OFFSET 20",
    "inner_join": f"SELECT s.kind AS source_kind, m.kind, count(*) AS n FROM {E} e JOIN {M} m USING (memory_id) JOIN sources s USING (source_id) GROUP BY ALL",
    "left_join_zero_kept": f"SELECT source_name, count(memory_id) AS items FROM sources s LEFT JOIN (SELECT * FROM {M} x WHERE {LIVE}) m USING (source_id) GROUP BY 1",
    "left_join_aggregates": f"SELECT source_id, external_key, versions, coalesce(cited, 0) AS cited FROM (SELECT source_id, external_key, count(*) AS versions, max(memory_id) AS memory_id FROM {M} m GROUP BY ALL) LEFT JOIN (SELECT memory_id, count(*) AS cited FROM {E} e GROUP BY 1) USING (memory_id)",
    "semi_join": f"SELECT memory_id FROM {M} m WHERE memory_id IN (SELECT memory_id FROM decision_evidence WHERE relation = 'contradicts')",
    "anti_join": f"SELECT memory_id FROM {M} m WHERE {LIVE} AND NOT EXISTS (SELECT 1 FROM decision_evidence e WHERE e.memory_id = m.memory_id)",
    "not_reviewed": f"SELECT memory_id FROM {M} m JOIN (SELECT source_id, source_name FROM sources) s USING (source_id) WHERE NOT EXISTS (SELECT 1 FROM decision_evidence e WHERE e.source_name = s.source_name AND e.external_key = m.external_key)",
    "key_difference": "SELECT external_key FROM memories EXCEPT SELECT external_key FROM item_log",
    "full_outer_join": f"SELECT kind, items, documents FROM (SELECT kind, count(*) AS items FROM {M} m GROUP BY 1) FULL JOIN (SELECT kind, count(*) AS documents FROM documents GROUP BY 1) USING (kind)",
    "customers_without_urgent_orders": "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' GROUP BY 1 HAVING count(o_custkey) = 0",
    "unreturned_parts": "SELECT p_partkey FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 45 GROUP BY 1 HAVING count(l_partkey) = 0",
    "cooccurrence": "WITH x AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS n FROM x JOIN x y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey WHERE (SELECT count(DISTINCT l_orderkey) FROM lineitem) >= 0.5 * (SELECT count(*) FROM orders) GROUP BY ALL HAVING count(*) >= 3",
    "natural_key_relink": f"SELECT evidence_id, m.memory_id FROM {E} e JOIN sources s USING (source_name) JOIN {M} m ON m.source_id = s.source_id AND m.external_key = e.external_key WHERE {LIVE}",
    "interval_join": "SELECT o_orderkey, count(*) AS hits, min(l_shipdate) AS first_seen FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 90 DAY GROUP BY 1",
    "span_overlap": """WITH e AS (SELECT event_id, user_id, CAST(trunc(value * 10) AS INTEGER) AS a FROM events),
x AS (SELECT user_id, event_id, a, a + CAST(event_id % 3 * 5 AS INTEGER) AS z FROM e), y AS (SELECT user_id, event_id, a, a + 40 AS z FROM e)
SELECT x.user_id, count(*) AS pairs, count(DISTINCT y.event_id) AS chunks FROM x JOIN y USING (user_id) WHERE (x.a < y.z AND y.a < x.z) OR (x.a = x.z AND y.a <= x.a AND x.a <= y.z) GROUP BY 1""",
    "jaccard_history": """WITH t AS (SELECT user_id, CAST(ts AS DATE) AS day, list(DISTINCT event_type) AS types FROM events GROUP BY ALL)
SELECT a.user_id, a.day, round(len(list_intersect(a.types, b.types))::DOUBLE / len(list_distinct(list_concat(a.types, b.types))), 6) AS jaccard FROM t a JOIN t b ON a.user_id = b.user_id AND a.day = b.day + 1""",
    "term_overlap": f"""WITH a AS (SELECT DISTINCT session_id, unnest(regexp_split_to_array(lower(title), '[^a-z]+')) AS term FROM chat_sessions),
b AS (SELECT DISTINCT memory_id, unnest(regexp_split_to_array(lower(title), '[^a-z]+')) AS term FROM memories WHERE {LIVE})
SELECT term, count(DISTINCT session_id) AS sessions, count(DISTINCT memory_id) AS items FROM a JOIN b USING (term) WHERE length(term) > 3 GROUP BY 1""",
    "stats_one_pass": f"SELECT count(*) AS total, count(*) FILTER (is_current) AS current, count(*) FILTER ({LIVE}) AS live, count(DISTINCT (source_id, external_key)) AS items, count(*) FILTER (occurred_at IS NULL) AS undated, round(count(*) FILTER ({LIVE}) / count(*), 6) AS live_share FROM {M} m",
    "filtered_counts": "SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 20) AS large, count(*) AS n FROM events GROUP BY 1",
    "distinct_edges": "SELECT count(DISTINCT (l_partkey, l_suppkey, l_returnflag)) AS edges FROM lineitem WHERE l_partkey <> l_suppkey",
    "event_latency": "SELECT source_name, count(*) AS n, round(avg((epoch_us(arrived_at) - epoch_us(recorded_at)) / 1e6), 4) AS mean_lag_s, max(epoch_us(arrived_at) - epoch_us(recorded_at)) AS worst_lag_us FROM item_log GROUP BY 1",
    "importance_evidence": f"SELECT versions, count(*) AS items FROM (SELECT count(*) AS versions FROM {M} m GROUP BY source_id, external_key) GROUP BY 1",
    "weekly_rhythm": f"""SELECT * FROM (SELECT CAST(date_trunc('week', occurred_at) AS TIMESTAMP) AS week, count(*) AS n, round(count(*) FILTER (isodow(occurred_at) >= 6) / count(*), 6) AS weekend_share
FROM {M} m WHERE occurred_at IS NOT NULL AND occurred_at_source <> 'filesystem' GROUP BY 1) WHERE weekend_share >= 0.4 OR weekend_share <= 0.1""",
    "corpus_fingerprint": f"SELECT sha256(concat_ws('|', count(*), count(*) FILTER (is_current), epoch_us(max(ingested_at)), max(memory_id))) AS fingerprint FROM {M} m",
    "relation_counts": f"SELECT relation, count(*) AS n, count(DISTINCT decision_id) AS decisions FROM {E} e GROUP BY 1",
    "value_summary": "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS least, round(stddev_pop(value), 6) AS spread FROM events GROUP BY 1",
    "message_ordinals": "SELECT session_id, message_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY received_at, message_id) AS INTEGER) AS n FROM chat_messages WHERE session_id IS NOT NULL",
    "history_pairs": """WITH t AS (SELECT session_id, ordinal, min(lower(trim(role))) AS role, min(message_id) AS message_id FROM chat_messages WHERE session_id IS NOT NULL AND ordinal IS NOT NULL GROUP BY ALL),
p AS (SELECT *, lead(role) OVER w AS next_role, lead(message_id) OVER w AS answer FROM t WINDOW w AS (PARTITION BY session_id ORDER BY ordinal)) SELECT message_id, answer FROM p WHERE role = 'user' AND next_role = 'assistant'""",
    "nulls_last_order": f"SELECT memory_id, occurred_at FROM {M} m ORDER BY occurred_at DESC NULLS LAST, memory_id LIMIT 50",
    "nulls_first_order": f"SELECT memory_id, occurred_at FROM {M} m ORDER BY occurred_at ASC NULLS FIRST, memory_id LIMIT 50",
    "ordering_top_k": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "union_distinct": "SELECT external_key FROM memories UNION SELECT external_key FROM documents",
    "union_all": f"SELECT kind, count(*) AS n FROM (SELECT kind FROM {M} m UNION ALL SELECT kind FROM documents) GROUP BY 1",
    "intersect_keys": "SELECT external_key FROM memories INTERSECT SELECT external_key FROM decision_evidence",
    "except_keys": "SELECT external_key FROM decision_evidence EXCEPT SELECT external_key FROM memories",
    "intersect_all": f"SELECT kind FROM {M} m INTERSECT ALL SELECT kind FROM documents",
    "except_all": f"SELECT kind FROM documents EXCEPT ALL SELECT kind FROM {M} m",
    "best_unordered_pair": "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, max(l_quantity) AS score FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue, CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": f"SELECT kind, occurred_at_source, count(*) AS n, CAST(grouping(kind, occurred_at_source) AS INTEGER) AS level FROM {M} m GROUP BY CUBE (kind, occurred_at_source)",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "pivot": "SELECT l_returnflag, nullif(count(*) FILTER (l_linestatus = 'F'), 0) AS \"F\", nullif(count(*) FILTER (l_linestatus = 'O'), 0) AS \"O\" FROM lineitem GROUP BY 1",
    "ranking_windows": "SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER w AS INTEGER) AS rk, CAST(dense_rank() OVER w AS INTEGER) AS dr, CAST(ntile(3) OVER w AS INTEGER) AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "frame_windows": "SELECT event_id, round(sum(value) OVER (w ROWS 2 PRECEDING), 4) AS last_three, lag(value) OVER w AS before, lead(value, 2) OVER w AS after_next, first_value(value) OVER w AS first_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "range_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_last_hour FROM events",
    "lateral_top_n": "SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2",
    "revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY ALL",
}
