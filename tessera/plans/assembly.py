"""Contexts, prompts, judged evaluation, models behind ports, discovery."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tessera.functions.text import grounding, token_count
from tessera.operators import context as cx
from tessera.operators import evaluate as ev
from tessera.operators import ports
from tessera.operators import retrieval as r
from tessera.operators import evidence as evd
from tessera.operators.relational import SearchFilters, glob_excluded, pairs_within
from tessera.plans.evidence import held
from tessera.plans.graph import relations
from tessera.plans import text as tp
from tessera.plans.temporal import M, memories
from tessera.sources.tables import read_table


def hits(s, d):
    return read_table(s, d, "memory_hits").select("hit_id", "query_id", "memory_id", "source_name", "external_key", "score").distinct()


def evidence(s, d):
    return read_table(s, d, "decision_evidence").distinct()


def _mentions(s, d):
    """Versions and the words of their titles."""
    return read_table(s, d, "memories").select(F.col("memory_id").alias("item"), F.explode(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]{4,}"), F.lit(0))).alias("entity")).distinct()


def _context_inputs(s, d):
    return hits(s, d), memories(s, d).select("memory_id", "external_key", "occurred_at"), evidence(s, d), _mentions(s, d)


def _contexts(s, d):
    return cx.context_rankings(*_context_inputs(s, d), "query_id")


def _prompt(s, d):
    """Every hit costs the tokens of its version's text."""
    texts = read_table(s, d, "memories").select("memory_id", token_count("content").alias("tokens")).groupBy("memory_id").agg(F.max("tokens").alias("tokens"))
    return cx.pack_prompt(hits(s, d).join(texts, "memory_id", "left"), "query_id", "hit_id", "score", "tokens", 1200)


def _retrieved(s, d):
    """Per query the versions found, by best score, with the chunks that matched."""
    h = read_table(s, d, "memory_hits").select("query_id", "memory_id", "external_key", "score", F.explode_outer("matched_chunks.ordinal").alias("o")).where("score IS NOT NULL AND memory_id IS NOT NULL")
    best = h.groupBy("query_id", F.col("memory_id").alias("id"), "external_key").agg(F.max("score").alias("score"), F.sort_array(F.collect_set("o")).alias("chunks"))
    return r.ranked(best, ["query_id"], "score", "id")


def _golden(s, d):
    """Judged by the evidence: what informed a decision was relevant, pinned to a chunk where the evidence names one."""
    res = _retrieved(s, d)
    verdict = F.when(F.col("relation") == "informed", "relevant").otherwise("not_relevant")
    j = evidence(s, d).where("memory_id IS NOT NULL").select(F.col("memory_id").alias("id"), F.col("chunk_ordinal").alias("ordinal"), verdict.alias("verdict")).distinct()
    found, good = cx.judged(res, res.select("query_id", "id").join(j, "id"), "query_id", glob_excluded("external_key", ["*.pdf"]))
    return ev.ir_metrics(found, good, "query_id", "id")


def _tuning(s, d):
    """Three rankings of a context, every combination of four weights each, against what informed decisions."""
    lists = cx.context_lists(*_context_inputs(s, d), "query_id").where(F.col("ranking").isin("retrieval", "recency", "name"))
    informed = evidence(s, d).where("relation = 'informed' AND memory_id IS NOT NULL").select(F.col("memory_id").alias("id")).distinct()
    good = hits(s, d).where("memory_id IS NOT NULL").select("query_id", F.col("memory_id").alias("id")).distinct().join(informed, "id")
    grid = ev.weight_grid(lists, good, "query_id", {n: [0.0, 0.15, 0.3, 0.6] if n != "retrieval" else [0.25, 0.5, 0.75, 1.0] for n in ("retrieval", "recency", "name")})
    return ev.tuned(grid, {"retrieval": 1.0, "recency": 0.0, "name": 0.0})


def _steps(s, d):
    h = read_table(s, d, "memory_hits").select("query_id", "hit_id", "searched_at", "memory_id", "source_name", F.col("matched_chunks.chunk_id").alias("parts")).dropDuplicates(["query_id", "hit_id"])
    return ev.hops_of(h, "query_id", ["searched_at", "hit_id"], "memory_id", "source_name", "parts")


def _trajectories(s, d):
    """The hits of a query in order of time are its steps."""
    steps = _steps(s, d).withColumns({"run": F.col("query_id"), "min_hops": F.lit(2), "ended": F.lit("answered")})
    out = ev.trajectory(steps)
    return out.select("run", *[F.round(c, 6).alias(c) for c in ("gain", "dependency", "efficiency", "termination")], "overall")


def _answers(s, d):
    """What answers cite, claim and refuse; a question is within the corpus if its session took anything in."""
    m = read_table(s, d, "chat_messages")
    inside = m.groupBy("session_id").agg((F.count("external_key") > 0).alias("in_corpus"))
    a = m.where("answer_refused IS NOT NULL AND session_id IS NOT NULL").select("message_id", "session_id", "content", "answer_refused").distinct()
    g = a.join(inside, "session_id").select("message_id", "in_corpus", F.col("answer_refused").alias("refused"), grounding("content", 5).alias("g"))
    return g.select("message_id", "in_corpus", "refused", F.col("g.supported").alias("cited"), F.col("g.claims").alias("claims"), F.size("g.invented").alias("invented"), F.col("g.rate").alias("rate"), F.lit(None).cast("string").alias("error"))


def _verdicts(s, d):
    """A verdict on every answer."""
    return _answers(s, d).select("message_id", ev.answer_verdict(F.col("rate"), F.col("invented") > 0).alias("verdict"))


def _merges(s, d):
    p = read_table(s, d, "part")
    return p.where("p_partkey % 10 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("loser"), F.concat(F.lit("p"), F.col("p_partkey") + 1).alias("winner"))


def _intent(s, d):
    filters, weight, order = cx.apply_intent("what changed since August 2025", SearchFilters(kinds=("note", "code")), datetime(2026, 6, 15))
    return memories(s, d).where(filters.condition()).select("memory_id", F.lit(weight).alias("weight"))


CITED = "review checklist"


def _excerpts(s, d):
    """Where each document first says what was searched for, with what stands around it."""
    docs = read_table(s, d, "documents").select("doc_id", "text", "source", F.col("external_key").alias("key"), (F.locate(CITED, F.col("text")) - 1).alias("at")).where("at >= 0")
    end = F.col("at") + len(CITED)
    return docs.select("doc_id", r.locator(F.col("source"), F.col("key"), F.lit(0), F.col("at"), end, F.lit(1)).alias("locator"), r.excerpt(F.col("text"), F.col("at"), F.lit(len(CITED))).alias("excerpt"))


def _counts(s, d):
    g = held(s, d).groupBy("grp").agg(F.count_if(F.col("verdict") == "failed").alias("support"), F.count_if(F.col("verdict") == "held").alias("against"))
    return g.select(F.col("grp").alias("key"), "support", "against")


def _discovered(s, d):
    return cx.discovered(_counts(s, d), s.createDataFrame([(1, True), (2, False)], "key long, dismissed boolean"))


def _entities(s, d):
    p = ports.extract(read_table(s, d, "documents"), "doc_id", "text", ports.PatternExtractor)
    return ports.verified(p, "doc_id").groupBy("kind", "fate").agg(F.count(F.lit(1)).alias("n"))


def _embedded(s, d):
    titles = read_table(s, d, "memories").select("title")
    cache = ports.embed(titles.where("title LIKE 'A%'"), "title", lambda: ports.HashEmbedder(32))
    return ports.embed(titles, "title", lambda: ports.HashEmbedder(32), cache).select("hash", "model", F.size("vector").alias("dim"))


def _claims(s, d):
    c = hits(s, d).where("score IS NOT NULL").select(F.col("query_id").alias("claim"), F.col("hit_id").alias("step"), "score")
    return ev.claim_support(c, "claim", "step", "score")


#: When the model of the user was derived before.
BEFORE = "1998-01-01", "2025-09-01"


def _facets(s, d, lines="true", items="true"):
    """Groups of assumptions are suppliers, pairs are parts of one order, weeks are those of the memories."""
    li = read_table(s, d, "lineitem").where(lines)
    word = F.when(F.col("l_returnflag") == "A", "held").when(F.col("l_returnflag") == "R", "failed")
    kept = li.select(F.col("l_suppkey").alias("grp"), word.alias("verdict"))
    dated = memories(s, d).where("occurred_at IS NOT NULL AND occurred_at_source <> 'filesystem'").where(items)
    weeks = dated.groupBy(F.date_trunc("week", "occurred_at").alias("week")).agg((F.count_if(F.weekday("occurred_at") >= 5) / F.count(F.lit(1))).alias("weekend_share"))
    pairs = pairs_within(li, ["l_orderkey"], "l_partkey", 3, read_table(s, d, "orders"))
    return cx.user_facets(evd.group_patterns(kept, "grp", "verdict"), evd.group_rates(kept, "grp", "verdict"), weeks, pairs)


def _model_changes(s, d):
    """What deriving the model anew does to the one derived before; facets that were dismissed stay away."""
    then = _facets(s, d, f"l_shipdate < timestamp'{BEFORE[0]}'", f"occurred_at < timestamp'{BEFORE[1]}'")
    dismissed = s.createDataFrame([("group:1",), ("pattern:2",)], "key string")
    now = _facets(s, d).join(dismissed, "key", "left_anti")
    return cx.supersede(then, now, "key", "value")


QUERIES = {
    "user_model": _facets,
    "user_model_changes": _model_changes,
    "context_assembly": _contexts,
    "prompt_packing": _prompt,
    "golden_evaluation": _golden,
    "golden_worst": lambda s, d: ev.worst(_golden(s, d), "query_id", 10),
    "weight_tuning": _tuning,
    "trajectory_scores": _trajectories,
    "answer_evaluation": lambda s, d: ev.answer_rates(_answers(s, d)),
    "answer_verdicts": _verdicts,
    "merge_chain_resolution": lambda s, d: cx.resolved(relations(s, d), "subject", "object", _merges(s, d)).groupBy("subject", "object").agg(F.sum("assertions").alias("assertions")),
    "graph_upsert": lambda s, d: cx.upsert(relations(s, d), relations(s, d).where("subject LIKE 'p1%'").withColumn("confidence", F.lit(0.5)), ["subject", "predicate", "object"]).groupBy("object").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == 0.5).alias("replaced")),
    "intent_application": _intent,
    "citation_excerpts": _excerpts,
    "pattern_discovery": _discovered,
    "entity_extraction": _entities,
    "embedding_cache": _embedded,
    "claim_support": _claims,
}

_HIT = "hit AS (SELECT DISTINCT hit_id, query_id, memory_id, source_name, external_key, score FROM memory_hits)"
_E = "(SELECT DISTINCT * FROM decision_evidence)"

_CTX = f"""{_HIT}, found AS (SELECT query_id, memory_id, score, occurred_at, nm FROM (SELECT query_id, memory_id, max(score) AS score FROM hit WHERE memory_id IS NOT NULL GROUP BY ALL) LEFT JOIN (SELECT DISTINCT memory_id, occurred_at, regexp_extract(external_key, '[^/]+$') AS nm FROM memories) USING (memory_id)),
first AS (SELECT query_id, memory_id, nm, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, memory_id) AS rank FROM found QUALIFY rank <= 30),
men AS (SELECT DISTINCT memory_id AS item, unnest(regexp_extract_all(lower(title), '[a-z]{{4,}}')) AS entity FROM memories),
hub AS (SELECT entity, ln(1 + (SELECT count(DISTINCT item) FROM men) / count(*)) AS idf FROM men GROUP BY 1 HAVING count(*) < greatest(2, ceil(0.1e0 * (SELECT count(DISTINCT item) FROM men)))),
ok AS (SELECT * FROM men JOIN hub USING (entity)), e0 AS (SELECT DISTINCT query_id, entity FROM first JOIN ok ON item = memory_id WHERE rank <= 5), e2 AS (SELECT DISTINCT query_id, b.entity FROM e0 JOIN ok a USING (entity) JOIN ok b ON b.item = a.item),
near AS (SELECT query_id, item AS id, round(sum(idf / 2), 9) AS score FROM e2 JOIN ok USING (entity) WHERE (query_id, item) NOT IN (SELECT (query_id, memory_id) FROM found) GROUP BY ALL),
alike AS (SELECT f.query_id, m.memory_id AS id, min(f.rank) AS best FROM first f JOIN (SELECT DISTINCT memory_id, regexp_extract(external_key, '[^/]+$') AS nm FROM memories) m ON m.nm = f.nm WHERE f.nm <> '' AND (f.query_id, m.memory_id) NOT IN (SELECT (query_id, memory_id) FROM found) GROUP BY ALL),
rests AS (SELECT query_id, 'decision/' || decision_id AS id, round(sum(1 / (60e0 + rank)), 12) AS score FROM first JOIN (SELECT DISTINCT decision_id, memory_id FROM decision_evidence WHERE decision_id IS NOT NULL) USING (memory_id) GROUP BY ALL),
lists AS (SELECT 'retrieval' AS ranking, query_id, memory_id AS id, rank FROM first UNION ALL SELECT * FROM (SELECT 'recency' AS ranking, query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY occurred_at DESC NULLS LAST, memory_id) AS rank FROM found) WHERE rank <= 30
  UNION ALL SELECT * FROM (SELECT 'graph' AS ranking, query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near) WHERE rank <= 30 UNION ALL SELECT * FROM (SELECT 'name' AS ranking, query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY best, id) AS rank FROM alike) WHERE rank <= 30
  UNION ALL SELECT * FROM (SELECT 'decisions' AS ranking, query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM rests) WHERE rank <= 30)"""
_GOLD = """h0 AS (SELECT query_id, memory_id AS id, external_key, score, unnest(CASE WHEN coalesce(len(matched_chunks), 0) = 0 THEN [NULL] ELSE list_transform(matched_chunks, lambda c: c.ordinal) END) AS o FROM memory_hits WHERE score IS NOT NULL AND memory_id IS NOT NULL),
b AS (SELECT query_id, id, external_key, max(score) AS score, list_distinct(list(o) FILTER (o IS NOT NULL)) AS chunks FROM h0 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b),
x AS (SELECT query_id, id, chunks, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS rank FROM k WHERE external_key NOT LIKE '%.pdf' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, id) <= 10),
j AS (SELECT DISTINCT memory_id AS id, chunk_ordinal AS o, relation = 'informed' AS good FROM decision_evidence WHERE memory_id IS NOT NULL), pin AS (SELECT DISTINCT id FROM j WHERE o IS NOT NULL),
res AS (SELECT query_id, id AS i, rank FROM x WHERE id NOT IN (SELECT id FROM pin) UNION SELECT query_id, id || '#' || c, rank FROM (SELECT query_id, id, rank, unnest(chunks) AS c FROM x WHERE id IN (SELECT id FROM pin))),
rel AS (SELECT DISTINCT query_id, CASE WHEN o IS NULL THEN j.id ELSE j.id || '#' || o END AS i FROM (SELECT DISTINCT query_id, id FROM b) JOIN j USING (id) WHERE good AND (o IS NOT NULL OR j.id NOT IN (SELECT id FROM pin))), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
h AS (SELECT query_id, count(*) AS h, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM (SELECT query_id, i, min(rank) AS rank FROM res GROUP BY ALL) JOIN rel USING (query_id, i) GROUP BY 1),
met AS (SELECT query_id, round(coalesce(h / n, 0), 6) AS recall, round(coalesce(h / 10, 0), 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr,
  round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10) + 1) t(i)), 0), 6) AS ndcg FROM n LEFT JOIN h USING (query_id))"""
_ANS = f"""ins AS (SELECT session_id, count(external_key) > 0 AS i FROM chat_messages GROUP BY 1), a AS (SELECT DISTINCT message_id, session_id, coalesce(content, '') AS content, answer_refused AS r FROM chat_messages WHERE answer_refused IS NOT NULL AND session_id IS NOT NULL),
p AS (SELECT message_id, i, r, content, {tp._NUMBERS} AS nums, coalesce({tp._REFUSED}, false) AS refusal, list_filter({tp._PARTS}, lambda s: regexp_matches(s, '[A-Za-z]') AND NOT regexp_matches(regexp_replace(lower(trim(s)), '^[-*# ]+', ''), '^(?:{tp._NO_CLAIMS})')) AS parts FROM a JOIN ins USING (session_id)),
c AS (SELECT *, CASE WHEN refusal THEN [] ELSE coalesce(parts, []) END AS claims FROM p), q AS (SELECT *, len(claims) AS n, len(list_filter(claims, lambda s: regexp_matches(s, '{tp._CITED}'))) AS k, len(list_distinct({tp._UNBOUND})) AS x FROM c),
ans AS (SELECT *, CASE WHEN n > 0 THEN round(k / n, 6) ELSE 1e0 END AS rate FROM q)"""


def _edge(side, whole):
    """The SQL of one side of an excerpt."""
    out = side
    for mark, follow in reversed(r.EDGES):
        cut = f"regexp_replace({side}, '^.*?{mark}{follow}\\s*', '', 's')" if side == "before" else f"regexp_replace({side}, '^(.*{mark}){follow}.*$', '\\1', 's')" if follow else f"regexp_replace({side}, '^(.*){mark}.*$', '\\1', 's')"
        out = f"CASE WHEN regexp_matches({side}, '{mark}{follow}') THEN {cut} ELSE {out} END"
    return f"CASE WHEN {whole} THEN {side} ELSE {out} END"


def _facets_sql(lines="TRUE", items="TRUE"):
    return f"""SELECT key, value, CAST(support AS BIGINT) AS support, CAST(against AS BIGINT) AS against FROM (
WITH li AS (SELECT * FROM lineitem WHERE {lines}), g AS (SELECT l_suppkey AS grp, count(*) FILTER (l_returnflag = 'A') AS held, count(*) FILTER (l_returnflag = 'R') AS broke FROM li GROUP BY 1),
w AS (SELECT count(*) FILTER (isodow(occurred_at) >= 6) / count(*) AS x FROM {M} m WHERE occurred_at IS NOT NULL AND occurred_at_source <> 'filesystem' AND {items} GROUP BY date_trunc('week', occurred_at)),
r AS (SELECT count(*) FILTER (x >= 0.4) AS a, count(*) FILTER (x <= 0.1) AS b FROM w), x AS (SELECT DISTINCT l_orderkey, l_partkey FROM li)
SELECT 'pattern:' || grp AS key, 'recurs' AS value, broke AS support, held AS against FROM g WHERE broke >= 4 AND broke > held UNION ALL SELECT 'group:' || grp, 'weak', broke, held FROM g WHERE held / nullif(held + broke, 0) <= 0.5
UNION ALL SELECT 'group:' || grp, 'strong', held, broke FROM g WHERE held / nullif(held + broke, 0) >= 0.8 UNION ALL SELECT 'rhythm:weekends', CASE WHEN a > b THEN 'worked' ELSE 'rested' END, greatest(a, b), least(a, b) FROM r
UNION ALL SELECT 'pair:' || x.l_partkey || '+' || y.l_partkey, 'together', count(*), 0 FROM x JOIN x y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey WHERE (SELECT count(DISTINCT l_orderkey) FROM x) >= 0.5 * (SELECT count(*) FROM orders) GROUP BY x.l_partkey, y.l_partkey HAVING count(*) >= 3)
WHERE support >= 3 AND support > against"""


SQL = {
    "user_model": _facets_sql(),
    "user_model_changes": f"""WITH a AS ({_facets_sql(f"l_shipdate < TIMESTAMP '{BEFORE[0]}'", f"occurred_at < TIMESTAMP '{BEFORE[1]}'")}), b AS (SELECT * FROM ({_facets_sql()}) WHERE key NOT IN ('group:1', 'pattern:2'))
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'withdrawn' WHEN a.value = b.value THEN 'kept' ELSE 'superseded' END AS action FROM a FULL JOIN b ON a.key = b.key""",
    "citation_excerpts": f"""WITH x AS (SELECT doc_id, text, source, external_key AS key, instr(text, '{CITED}') - 1 AS a FROM documents WHERE instr(text, '{CITED}') > 0),
y AS (SELECT *, substr(text, CAST(greatest(a - 200, 0) + 1 AS BIGINT), CAST(a - greatest(a - 200, 0) AS BIGINT)) AS before, substr(text, CAST(a + {len(CITED)} + 1 AS BIGINT), 200) AS after FROM x)
SELECT doc_id, source || '::' || key || '#0 @' || a || '-' || (a + {len(CITED)}) || ' (v1)' AS locator, regexp_replace({_edge("before", "a <= 200")} || '{CITED}' || {_edge("after", f"a + {len(CITED)} + 200 >= length(text)")}, '^\\s+|\\s+$', '', 'g') AS excerpt FROM y""",
    "prompt_packing": f"""WITH RECURSIVE {_HIT}, tk AS (SELECT memory_id, max(len(regexp_extract_all(content, '[\\pL\\pN_]+|[^\\pL\\pN_\\s\\v\\pZ\\x1c-\\x1f\\x{{85}}]'))) AS t FROM memories GROUP BY 1),
o AS (SELECT query_id, hit_id, coalesce(t, 0) AS t, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, hit_id) AS n FROM hit LEFT JOIN tk USING (memory_id)),
w AS (SELECT query_id, hit_id, n, CASE WHEN t <= 1200 THEN 1200 - t ELSE 1200 END AS room, CAST(t <= 1200 AS INTEGER) AS number, t <= 1200 AS fits FROM o WHERE n = 1 UNION ALL
  SELECT o.query_id, o.hit_id, o.n, CASE WHEN o.t <= room THEN room - o.t ELSE room END, number + CAST(o.t <= room AS INTEGER), o.t <= room FROM w JOIN o ON o.query_id = w.query_id AND o.n = w.n + 1)
SELECT query_id, hit_id, number FROM w WHERE fits""",
    "embedding_cache": "SELECT DISTINCT sha256('hash-32|' || title) AS hash, 'hash-32' AS model, 32 AS dim FROM memories WHERE trim(title) <> '' AND title NOT LIKE 'A%'",
    "context_assembly": f"WITH {_CTX} SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT query_id, id, round(sum(1 / (60e0 + rank)), 12) AS score FROM lists GROUP BY ALL)",
    "golden_evaluation": f"WITH {_GOLD} SELECT * FROM met",
    "golden_worst": f"WITH {_GOLD} SELECT *, CAST(row_number() OVER (ORDER BY mrr, ndcg, query_id) AS INTEGER) AS place FROM met ORDER BY mrr, ndcg, query_id LIMIT 10",
    "weight_tuning": f"""WITH {_CTX}, good AS (SELECT DISTINCT query_id, memory_id AS id FROM hit WHERE memory_id IN (SELECT memory_id FROM decision_evidence WHERE relation = 'informed')), n AS (SELECT query_id, count(*) AS n FROM good GROUP BY 1),
g AS (SELECT x::DOUBLE AS retrieval, y::DOUBLE AS recency, z::DOUBLE AS name FROM (VALUES (0.25), (0.5), (0.75), (1)) p(x), (VALUES (0), (0.15), (0.3), (0.6)) q(y), (VALUES (0), (0.15), (0.3), (0.6)) u(z)),
f AS (SELECT retrieval, recency, name, query_id, id, round(sum(CASE ranking WHEN 'retrieval' THEN retrieval WHEN 'recency' THEN recency ELSE name END / (60 + rank)), 12) AS score FROM g, lists WHERE ranking IN ('retrieval', 'recency', 'name') GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY retrieval, recency, name, query_id ORDER BY score DESC, id) AS rank FROM f),
h AS (SELECT retrieval, recency, name, query_id, min(rank) AS first, count(*) FILTER (rank <= 10) AS h FROM k JOIN good USING (query_id, id) GROUP BY ALL),
o AS (SELECT retrieval, recency, name, round(sum(1 / first) / (SELECT count(*) FROM n), 6) AS mrr, round(sum(h / n) / (SELECT count(*) FROM n), 6) AS recall FROM h JOIN n USING (query_id) GROUP BY ALL),
b AS (SELECT mrr FROM o WHERE retrieval = 1 AND recency = 0 AND name = 0)
SELECT *, CAST(row_number() OVER (ORDER BY mrr DESC, recall DESC, retrieval, recency, name) AS INTEGER) AS place, round(mrr - (SELECT mrr FROM b), 6) AS gain, round(mrr - (SELECT mrr FROM b), 6) > 0.0122 AS resolved FROM o""",
    "trajectory_scores": """WITH m AS (SELECT query_id, hit_id, any_value(searched_at) AS searched_at, any_value(memory_id) AS memory_id, any_value(source_name) AS source_name, any_value(list_distinct(list_transform(matched_chunks, lambda c: c.chunk_id))) AS parts FROM memory_hits GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY searched_at, hit_id) AS hop FROM m), p AS (SELECT DISTINCT query_id, hop, unnest(parts) AS p FROM n), f AS (SELECT query_id, hop, count(*) AS new FROM (SELECT query_id, p, min(hop) AS hop FROM p GROUP BY ALL) GROUP BY ALL),
s AS (SELECT n.query_id, n.hop, coalesce(len(parts), 0) AS returned, coalesce(new, 0) AS new, coalesce(min(n.hop) OVER (PARTITION BY n.query_id, memory_id) < n.hop AND memory_id IS NOT NULL, false) AS used, coalesce(min(n.hop) OVER (PARTITION BY n.query_id, source_name) < n.hop AND source_name IS NOT NULL, false) AS borrowed FROM n LEFT JOIN f ON f.query_id = n.query_id AND f.hop = n.hop),
x AS (SELECT query_id AS run, coalesce(sum(new)::DOUBLE / nullif(sum(returned), 0), 0) AS gain, avg(CASE WHEN used THEN 1e0 WHEN borrowed THEN 0.5e0 ELSE 0e0 END) FILTER (hop > 1) AS dependency, least(1e0, 2 / max(hop)) AS efficiency, 1e0 AS termination FROM s GROUP BY 1)
SELECT run, round(gain, 6) AS gain, round(dependency, 6) AS dependency, round(efficiency, 6) AS efficiency, termination, round((gain + coalesce(dependency, 1) + efficiency + 1) / 4, 6) AS overall FROM x""",
    "answer_evaluation": f"""WITH {_ANS} SELECT count(*) AS n, round(avg(k / n) FILTER (i AND NOT r AND n > 0), 6) AS citation_rate, round(count(*) FILTER (NOT i AND r) / nullif(count(*) FILTER (NOT i), 0), 6) AS refusal_rate,
round(count(*) FILTER (i AND r) / nullif(count(*) FILTER (i), 0), 6) AS false_refusal_rate, round(count(*) FILTER (NOT r AND x > 0) / nullif(count(*) FILTER (NOT r), 0), 6) AS hallucinated_rate FROM ans""",
    "answer_verdicts": f"WITH {_ANS} SELECT message_id, CASE WHEN rate < 0.5 THEN 'ungrounded' WHEN rate < 0.8 OR x > 0 THEN 'partial' ELSE 'grounded' END AS verdict FROM ans",
    "merge_chain_resolution": """SELECT CASE WHEN p_partkey % 10 = 0 THEN 'p' || (p_partkey + 1) ELSE 'p' || p_partkey END AS subject, p_brand AS object, count(*) AS assertions FROM part GROUP BY ALL""",
    "graph_upsert": "SELECT p_brand AS object, count(*) AS n, count(*) FILTER (('p' || p_partkey) LIKE 'p1%') AS replaced FROM part GROUP BY 1",
    "intent_application": f"SELECT memory_id, 0.15e0 AS weight FROM {M} m WHERE is_current AND deleted_at IS NULL AND kind IN ('note', 'code') AND occurred_at >= '2025-08-01'",
    "pattern_discovery": """WITH g AS (SELECT l_suppkey AS key, count(*) FILTER (l_returnflag = 'R') AS support, count(*) FILTER (l_returnflag = 'A') AS against FROM lineitem GROUP BY 1)
SELECT *, round(least(0.95e0, support::DOUBLE / (support + against) * least(1e0, support / 8e0)), 6) AS confidence FROM g WHERE support >= 4 AND support > against AND key <> 1""",
    "claim_support": f"WITH {_HIT}, c AS (SELECT query_id AS claim, max(score) AS best, count(DISTINCT CASE WHEN score >= 0.58 THEN hit_id END) AS steps FROM hit WHERE score IS NOT NULL GROUP BY 1) SELECT claim, best, steps, CASE WHEN best >= 0.62 THEN 'direct' WHEN steps >= 2 THEN 'inferred' ELSE 'none' END AS support FROM c",
}
