"""Gap analysis, message items, statistics and the remaining listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.analysis import STOP_WORDS
from tessera.functions.normal import normal_text
from tessera.operators import chunks as ch
from tessera.operators import entities as en
from tessera.operators import gaps, ports, relational as rel, surfacing as sf, vectors as v
from tessera.operators.changefeed import plain
from tessera.operators.ordered import running_sum, with_previous
from tessera.operators.versions import follow_chain
from tessera.plans import evidence as ev
from tessera.plans import graph as g
from tessera.plans import streaming as st
from tessera.plans.temporal import events, memories
from tessera.sources.tables import read_table


def n_():
    return F.count(F.lit(1))


def links(s, d):
    return read_table(s, d, "decision_evidence").distinct()


def _assumptions(s, d):
    word = F.when(F.col("l_returnflag") == "A", "held").when(F.col("l_returnflag") == "R", "failed")
    return read_table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", word.alias("held"), "l_shipdate", "l_extendedprice")


def _gaps(s, d):
    a = gaps.orphaned_work(links(s, d), "decision_id", "memory_id", "linked_at", F.col("relation") == "contradicts")
    b = gaps.unevaluated(_assumptions(s, d), "l_suppkey", "held", "l_shipdate", "2002-01-01")
    c = gaps.repeated(read_table(s, d, "orders"), "o_custkey", F.col("o_orderstatus") == "O")
    return gaps.sayable(a.unionByName(b).unionByName(c))


def _unstated(s, d):
    return gaps.unstated(read_table(s, d, "chat_sessions"), memories(s, d, "title").where("kind = 'note'"), "session_id", "title", "memory_id", "title")


def _messages(s, d):
    m = read_table(s, d, "chat_messages").groupBy("message_id").agg(F.max("corrects_message_id").alias("c"))
    return follow_chain(m, "message_id", "c").select(F.col("key").alias("message_id"), F.col("final").alias("item"), (F.col("hops") + 1).alias("version"))


def _ingest(s, d):
    """What becomes of each message of a user: a statement is an item, a correction a new version of the one it
    corrects; questions, empty texts and corrections that change nothing are refused."""
    m = read_table(s, d, "chat_messages").where("lower(trim(role)) = 'user'").groupBy("message_id").agg(F.max("intent").alias("intent"), F.max("content").alias("content"), F.max("corrects_message_id").alias("corrects"))
    old = read_table(s, d, "chat_messages").groupBy(F.col("message_id").alias("_id")).agg(F.max("content").alias("_old"))
    j = m.join(old, m["corrects"] == old["_id"], "left")
    fate = (
        F.when(~F.coalesce("content", F.lit("")).rlike(r"[^\s\p{Z}]"), "refused: empty").when(F.col("intent") == "question", "refused: question")
        .when(F.col("corrects").isNull(), "item").when(F.col("_old").isNull(), "refused: nothing to correct").when(F.col("_old") == F.col("content"), "refused: unchanged").otherwise("version")
    )
    return j.select("message_id", "corrects", fate.alias("fate"))


def _rated(s, d):
    """ST10: every rating moves the bar of its user from then on; a context is rated once."""
    h = st._history(s, d).where("dismissed_at IS NOT NULL OR useful")
    h = h.select("user_id", "surfaced_at", F.col("dismissed_at").isNotNull().cast("bigint").alias("_d"), F.col("useful").cast("bigint").alias("_u"))
    h = running_sum(h, ["user_id"], "surfaced_at", "_d", "_d", "dismissed")
    h = running_sum(h, ["user_id"], "surfaced_at", "_d", "_u", "acted")
    return h.select("user_id", "surfaced_at", "dismissed", "acted", F.round(sf.bar(F.col("dismissed"), F.col("acted")), 9).alias("bar"))


def _event_stats(s, d):
    e = read_table(s, d, "item_log").withColumn("lag", (F.unix_micros("arrived_at") - F.unix_micros("recorded_at")) / 1e6)
    per = e.groupBy(plain("event_type").alias("kind")).agg(n_().alias("n"), F.round(F.avg("lag"), 4).alias("mean_lag"))
    return per.unionByName(e.agg(n_().alias("n"), F.round(F.avg("lag"), 4).alias("mean_lag")).select(F.lit("all").alias("kind"), "n", "mean_lag"))


def _restored(s, d):
    o = read_table(s, d, "item_log").where("seq IS NOT NULL").groupBy("source_name", "external_key", "seq").agg(F.min(plain("event_type")).alias("kind"))
    return with_previous(o, ["source_name", "external_key"], "seq", "kind", value="kind", out="before").where("kind = 'artifact_observed' AND before = 'item_deleted'").groupBy("source_name", "external_key").agg(n_().alias("restorations"))


def _pairs(s, d):
    a = _assumptions(s, d)
    x = a.select("l_orderkey", F.col("l_suppkey").alias("a"), F.col("l_extendedprice").alias("ap"))
    y = a.select("l_orderkey", F.col("l_suppkey").alias("b"), F.col("l_extendedprice").alias("bp"))
    return x.join(y, "l_orderkey").where("a < b").select("l_orderkey", "a", "b", F.round(F.abs(F.col("ap") - F.col("bp")), 2).alias("difference")).distinct()


def _pipeline(s, d):
    """ST12: normalize, chunk, embed, extract as one plan over every document, counted by stage."""
    docs = read_table(s, d, "documents").select("doc_id", "text", "kind")
    norm = docs.select("doc_id", normal_text("text").alias("t")).where("t <> ''")
    parts = ch.chunk(docs, "doc_id", "text", F.col("kind") == "code")
    vecs = ports.embed(parts, "content", lambda: ports.HashEmbedder(16))
    found = ports.verified(ports.extract(parts, "doc_id", "content", ports.PatternExtractor), "doc_id").where("fate = 'kept'")
    out = None
    for stage, df in (("normalized", norm), ("chunks", parts), ("vectors", vecs), ("mentions", found)):
        row = df.agg(n_().alias("n")).select(F.lit(stage).alias("stage"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def _similar_names(s, d):
    names = read_table(s, d, "memories").select("title").where("title IS NOT NULL").distinct()
    vecs = ports.embed(names, "title", lambda: ports.HashEmbedder(32)).select(F.xxhash64("hash").alias("id"), "vector")
    return en.similar_names(v.near_pairs(vecs, en.NAME_FLOOR, "id", "vector"))


def _with_next(m):
    """Entities that an order shares with the next one: an equi-join on item and entity, no sets are built."""
    m = m.select("item", "entity")
    return m.join(m.select((F.col("item") - 1).alias("item"), "entity"), ["item", "entity"]).groupBy("item").agg(n_().alias("shared"))


QUERIES = {
    "gap_analysis": _gaps,
    "unstated_assumptions": _unstated,
    "message_items": _messages,
    "message_ingest": _ingest,
    "feedback_bar": _rated,
    "event_stats": _event_stats,
    "restored_items": _restored,
    "surfacing_stats": lambda s, d: st.QUERIES["surfacing_gate"](s, d).groupBy("reason").agg(n_().alias("n")),
    "surfacing_log": lambda s, d: rel.page(st.QUERIES["surfacing_gate"](s, d).where("reason = 'cleared'"), [F.desc("day"), F.asc("user_id")], 100),
    "entity_stats": lambda s, d: rel.top_per(g.mentions(s, d).groupBy(F.substring("entity", 1, 1).alias("type"), "entity").agg(F.sum("mentions").alias("n")), ["type"], [F.desc("n"), F.asc("entity")], 5),
    "mention_edges": lambda s, d: g.mentions(s, d).where("item IN (1, 2, 3, 5)").select("item", "entity").distinct(),
    "shared_entities": lambda s, d: _with_next(g.mentions(s, d)),
    "similar_names": _similar_names,
    "assumption_list": lambda s, d: _assumptions(s, d).where("held IS NULL").join(ev.decisions(s, d).select(F.col("decision_id").alias("l_orderkey"), "decided_at"), "l_orderkey").groupBy("l_suppkey").agg(n_().alias("open"), F.min("decided_at").alias("oldest")),
    "group_candidate_pairs": _pairs,
    "pattern_list": lambda s, d: ev._patterns(s, d).join(_assumptions(s, d).groupBy(F.col("l_suppkey").alias("grp")).agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen")), "grp"),
    "live_model": lambda s, d: rel.top_per(memories(s, d).where(rel.live()), ["kind"], [F.desc("version"), F.asc("memory_id")], 10).select("kind", "memory_id", "rank"),
    "next_claim": lambda s, d: events(s, d).where("event_type = 'purchase'").orderBy(F.desc("value"), "ts", "event_id").limit(1).select("event_id"),
    "pipeline_stages": _pipeline,
}

_GATE = st.SQL["surfacing_gate"]
_LOG = "l AS (SELECT *, lower(regexp_replace(event_type, '^\\s+|\\s+$', '', 'g')) AS kind_ FROM item_log)"

_TOPIC = f"length(term) > 3 AND term NOT IN ({', '.join(map(repr, STOP_WORDS))})"

SQL = {
    "unstated_assumptions": f"""WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(title), '[\\pL\\pN_]+')) AS term FROM memories WHERE kind = 'note'),
t AS (SELECT DISTINCT session_id, unnest(regexp_extract_all(lower(title), '[\\pL\\pN_]+')) AS term FROM chat_sessions)
SELECT DISTINCT 'unstated' AS kind, session_id AS key FROM chat_sessions WHERE session_id NOT IN (SELECT session_id FROM t WHERE {_TOPIC} AND term IN (SELECT term FROM k))""",
    "gap_analysis": """WITH e AS (SELECT DISTINCT * FROM decision_evidence), a AS (SELECT 'orphaned_work' AS kind, decision_id::VARCHAR AS key, count(DISTINCT memory_id) AS support, count(*) FILTER (relation = 'contradicts') AS against, count(*) AS evidence
  FROM e GROUP BY decision_id HAVING count(DISTINCT memory_id) >= 2 AND (SELECT max(linked_at) FROM e) - max(linked_at) > INTERVAL 30 DAY),
b AS (SELECT 'unevaluated' AS kind, l_suppkey::VARCHAR AS key, count(*) FILTER (l_returnflag NOT IN ('A', 'R') AND TIMESTAMP '2002-01-01' - l_shipdate > INTERVAL 30 DAY) AS support, count(*) FILTER (l_returnflag IN ('A', 'R')) AS against, count(*) AS evidence FROM lineitem GROUP BY l_suppkey),
c AS (SELECT 'repeated' AS kind, o_custkey::VARCHAR AS key, count(*) FILTER (o_orderstatus = 'O') AS support, count(*) FILTER (o_orderstatus <> 'O') AS against, count(*) AS evidence FROM orders GROUP BY o_custkey),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), f AS (SELECT *, round(CASE WHEN support <= 0 THEN 0 ELSE least(0.95e0, support::DOUBLE / (support + against) * least(1e0, support / 4e0)) END, 6) AS confidence FROM u)
SELECT * FROM f WHERE support >= 2 AND support > against AND confidence >= 0.5 AND evidence >= 2""",
    "message_items": """WITH RECURSIVE l AS (SELECT message_id, max(corrects_message_id) AS t FROM chat_messages GROUP BY 1),
c AS (SELECT message_id AS key, message_id AS final, 0 AS hops FROM l UNION ALL SELECT c.key, l.t, c.hops + 1 FROM c JOIN l ON l.message_id = c.final WHERE l.t IS NOT NULL AND c.hops < 9)
SELECT key AS message_id, CASE WHEN hops <= 8 THEN final END AS item, CAST(least(hops, 8) + 1 AS INTEGER) AS version FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY hops DESC) AS n FROM c) WHERE n = 1""",
    "message_ingest": """WITH m AS (SELECT message_id, max(intent) AS intent, max(content) AS content, max(corrects_message_id) AS corrects FROM chat_messages WHERE lower(trim(role)) = 'user' GROUP BY 1), o AS (SELECT message_id AS oid, max(content) AS old FROM chat_messages GROUP BY 1)
SELECT message_id, corrects, CASE WHEN NOT regexp_matches(coalesce(content, ''), '[^\\s\\pZ]') THEN 'refused: empty' WHEN intent = 'question' THEN 'refused: question' WHEN corrects IS NULL THEN 'item' WHEN old IS NULL THEN 'refused: nothing to correct' WHEN old = content THEN 'refused: unchanged' ELSE 'version' END AS fate FROM m LEFT JOIN o ON oid = corrects""",
    "feedback_bar": f"""WITH {st._H}, r AS (SELECT user_id, surfaced_at, CAST(dismissed_at IS NOT NULL AS INTEGER) AS d, CAST(useful AS INTEGER) AS u FROM h WHERE dismissed_at IS NOT NULL OR useful),
x AS (SELECT user_id, surfaced_at, sum(d) OVER w AS dismissed, sum(u) OVER w AS acted FROM r WINDOW w AS (PARTITION BY user_id ORDER BY surfaced_at, d ROWS UNBOUNDED PRECEDING))
SELECT user_id, surfaced_at, CAST(dismissed AS BIGINT) AS dismissed, CAST(acted AS BIGINT) AS acted, {st._BAR.format(d='dismissed', u='acted')} AS bar FROM x""",
    "event_stats": f"WITH {_LOG}, x AS (SELECT kind_, (epoch_us(arrived_at) - epoch_us(recorded_at)) / 1e6 AS lag FROM l) SELECT kind_ AS kind, count(*) AS n, round(avg(lag), 4) AS mean_lag FROM x GROUP BY 1 UNION ALL SELECT 'all', count(*), round(avg(lag), 4) FROM x",
    "restored_items": f"WITH {_LOG}, o AS (SELECT source_name, external_key, seq, min(kind_) AS k FROM l WHERE seq IS NOT NULL GROUP BY ALL), w AS (SELECT *, lag(k) OVER (PARTITION BY source_name, external_key ORDER BY seq) AS b FROM o) SELECT source_name, external_key, count(*) AS restorations FROM w WHERE k = 'artifact_observed' AND b = 'item_deleted' GROUP BY ALL",
    "surfacing_stats": f"SELECT reason, count(*) AS n FROM ({_GATE}) GROUP BY 1",
    "surfacing_log": f"SELECT * FROM ({_GATE}) WHERE reason = 'cleared' ORDER BY day DESC, user_id LIMIT 100",
    "entity_stats": f"WITH {g._MEN}, t AS (SELECT left(entity, 1) AS type, entity, CAST(sum(mentions) AS BIGINT) AS n FROM men GROUP BY ALL) SELECT type, entity, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, entity) AS r FROM t) WHERE r <= 5",
    "mention_edges": f"WITH {g._MEN} SELECT DISTINCT item, entity FROM men WHERE item IN (1, 2, 3, 5)",
    "shared_entities": f"WITH {g._MEN} SELECT a.item, count(*) AS shared FROM men a JOIN men b ON b.item = a.item + 1 AND b.entity = a.entity GROUP BY 1",
    "assumption_list": "SELECT l_suppkey, count(*) AS open, min(o_orderdate) AS oldest FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag NOT IN ('A', 'R') GROUP BY 1",
    "group_candidate_pairs": "SELECT DISTINCT x.l_orderkey, x.l_suppkey AS a, y.l_suppkey AS b, round(abs(x.l_extendedprice - y.l_extendedprice), 2) AS difference FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey",
    "pattern_list": f"SELECT p.*, first_seen, last_seen FROM ({ev.SQL['pattern_confidence']}) p JOIN (SELECT l_suppkey AS grp, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1) USING (grp)",
    "live_model": "SELECT kind, memory_id, CAST(r AS INTEGER) AS rank FROM (SELECT kind, memory_id, row_number() OVER (PARTITION BY kind ORDER BY version DESC, memory_id) AS r FROM (SELECT DISTINCT kind, memory_id, version FROM memories WHERE is_current AND deleted_at IS NULL)) WHERE r <= 10",
    "next_claim": "SELECT event_id FROM events WHERE event_type = 'purchase' ORDER BY value DESC, ts, event_id LIMIT 1",
}
