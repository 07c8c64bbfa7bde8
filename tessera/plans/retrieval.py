"""Search, fusion, selection and their measures over embeddings, documents, candidates and memory_hits.

Vector queries are the rows whose id is divisible by 50, against all rows. The
vector of a document stands in as the one of the same number.
"""

from __future__ import annotations

import re

from pyspark.sql import Window, functions as F

from tessera.functions import scores as sc
from tessera.functions.analysis import STOP_WORDS, parse_search
from tessera.operators import evaluate as ev
from tessera.operators import relational as rel
from tessera.operators import retrieval as r
from tessera.operators import selection as sel
from tessera.operators import vectors as v
from tessera.functions.stemming import stem
from tessera.functions.text import token_count
from tessera.operators import graph as gr
from tessera.operators import ports
from tessera.session import cut, stored
from tessera.sources.tables import read_table, state

SEARCHES = {1: "review checklist", 2: '"token budget" -reranker or "export job" sync', 3: "the handwritten labels", 4: '"source of that claim"', 5: "missing replies"}
K = 10
#: Results each leg of a fused search brings, as a multiple of those asked for.
FAN = 5


def embeddings(s, d):
    return read_table(s, d, "embeddings")


def documents(s, d):
    return read_table(s, d, "documents").select("doc_id", "text", "source", "occurred_at", "n_chars")


def index(s, d):
    """The stored postings of the documents' stems: written once a session, then read by term."""
    made = lambda path: r.write_index(r.postings(read_table(s, d, "documents"), "doc_id", "text", stems=True), path)
    return stored(s, "postings " + state(d, "documents"), made)


def _vector(s, d, k=K, asked=None, rows=None):
    e = embeddings(s, d)
    queries = e.where("vec_id % 50 = 0") if asked is None else e.where(F.col("vec_id").isin(asked))
    return v.vector_topk(queries, e if rows is None else rows, k, "vec_id", "embedding")


def _keyword(s, d, k=K, within=None):
    return r.keyword_search(index(s, d), SEARCHES, k, within=within)


def _legs(s, d, k=K, within=None):
    """Two rankings per search, each of ``FAN`` times ``k``: words, and likeness to the document numbered 50 times
    the search's number. ``within`` (ids) holds in both."""
    rows = None if within is None else embeddings(s, d).join(within.toDF("vec_id"), "vec_id", "left_semi")
    vec = _vector(s, d, FAN * k, [50 * q for q in SEARCHES], rows)
    a = vec.select(F.lit("vector").alias("ranking"), (F.col("query") / 50).cast("int").alias("query"), "id", "rank")
    return a.unionByName(_keyword(s, d, FAN * k, within).select(F.lit("keyword").alias("ranking"), "query", "id", "rank"))


def _fused(s, d, within=None):
    fused = r.rrf(_legs(s, d, within=within), {"vector": 1.0, "keyword": 1.0}, ["query"]).where(F.col("rank") <= K)
    docs = documents(s, d).select(F.col("doc_id").alias("id"), "source")
    return fused.join(docs, "id").select("query", "rank", F.col("id").alias("doc_id"), "source", "score")


def _hybrid_filtered(s, d):
    """The filters hold inside both legs, so each still brings its full number."""
    some = read_table(s, d, "documents").where("kind IN ('note', 'decision', 'minutes') AND occurred_at >= '2025-03-01'")
    return _fused(s, d, some.select("doc_id"))


def hybrid(s, d):
    """The flagship: both legs fused, the documents with the best fused score first."""
    return _fused(s, d)


NOW = "2026-06-01"
#: Seeds of the graph signal per search, and how many documents each signal ranks.
SEEDS = 5


def _mentions(s, d):
    """Documents and the words of their keys: what files of one topic or folder share."""
    key = F.explode(F.regexp_extract_all(F.lower("external_key"), F.lit("[a-z]+"), F.lit(0)))
    return read_table(s, d, "documents").select(F.col("doc_id").alias("item"), key.alias("entity")).distinct()


def _seeded(legs):
    """The best rank of a document over the rankings, and its place by (best, id)."""
    best = legs.groupBy("query", "id").agg(F.min("rank").alias("best"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("best", "id")))


def _signals(s, d):
    """Vector and keyword find; recency and importance order what they found; the graph adds what is near the best."""
    legs = cut(_legs(s, d), "legs")  # top lists, used four times
    docs = read_table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", "external_key", "occurred_at")
    found = legs.select("query", "id").distinct().join(docs, "id")
    versions = docs.where("external_key IS NOT NULL").groupBy("source", "external_key").agg(F.count(F.lit(1)).alias("versions"))
    known = found.join(versions, ["source", "external_key"], "left")
    recent = sc.recency(F.col("occurred_at"), F.lit(NOW).cast("timestamp"))
    parts = F.ceil(F.coalesce(token_count("text"), F.lit(0)) / 396).cast("int")
    scored = known.select("query", "id", F.round(recent, 9).alias("recency"), sc.importance(parts, F.coalesce("versions", F.lit(1)), recent).alias("importance"))
    seeds = _seeded(legs).where(F.col("place") <= SEEDS).select("query", F.col("id").alias("item"))
    none = s.createDataFrame([], "subject string, object string")
    near = gr.expand(_mentions(s, d), none, seeds, legs.select("query", F.col("id").alias("item")), 1, ["query"])
    graph = rel.top_per(near.withColumnRenamed("item", "id"), ["query"], [F.desc("score"), F.asc("id")], FAN * K)
    out = legs.unionByName(graph.select(F.lit("graph").alias("ranking"), "query", "id", "rank"))
    for name in ("recency", "importance"):
        out = out.unionByName(r.ranked(scored, ["query"], name, "id").select(F.lit(name).alias("ranking"), "query", "id", "rank"))
    return out


#: Stems of all words searched for.
_ASKED = sorted({stem(w) for t in SEARCHES.values() for a in parse_search(t) for phrase, _ in a for w in phrase if w})
WEIGHTS = {"vector": 1.0, "keyword": 1.0, "recency": 0.3, "importance": 0.2, "graph": 0.5}


def _five(s, d):
    out = r.signal_fusion(_signals(s, d), WEIGHTS, ["query"]).where(F.col("rank") <= K)
    return out.select("query", "id", "score", "rank", *[f"{n}_rank" for n in WEIGHTS], *[f"{n}_share" for n in WEIGHTS], "keyword_strength", "graph_strength", r.explained(list(WEIGHTS)).alias("why"))


def _chunks(s, d):
    h = read_table(s, d, "memory_hits").select("query_id", "memory_id", "matched_chunks").distinct()
    c = h.select("query_id", "memory_id", F.explode("matched_chunks").alias("c"))
    return r.group_chunks(c.select("query_id", "memory_id", "c.chunk_id", "c.score").distinct(), ["query_id"], "memory_id", "chunk_id", "score", K)


def _rerank(s, d):
    """The model behind the port scores the first 25 of each search, and only those."""
    fused = r.rrf(_legs(s, d), {"vector": 1.0, "keyword": 0.5}, ["query"]).select("query", "id", F.col("score").alias("fused"))
    fused = cut(fused, "fused")  # scored in part, then joined with its scores
    texts = documents(s, d).select(F.col("doc_id").alias("id"), "text")
    asked = F.element_at(F.create_map(*[x for q, t in SEARCHES.items() for x in (F.lit(q), F.lit(t))]), F.col("query"))
    first = rel.top_per(fused, ["query"], [F.desc("fused"), F.asc("id")], r.RERANKED).join(texts, "id")
    pairs = first.select(F.concat_ws(":", "query", "id").alias("key"), asked.alias("asked"), "text")
    scored = ports.scored_pairs(pairs, "key", "asked", "text", ports.OverlapReranker).select("key", F.col("score").alias("model"))
    both = fused.join(scored, F.concat_ws(":", "query", "id") == F.col("key"), "left")
    out = r.rerank(both.select("query", "id", "fused", "model"), ["query"], "id", "fused", F.round("model", 9))
    return out.select("query", "id", "before", "final", F.round("score", 9).alias("score"))


def _relevant(s, d):
    e = embeddings(s, d)
    a = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "label")
    return a.join(e.select(F.col("vec_id").alias("id"), "label"), "label").where("query <> id").select("query", "id")


def _metrics(s, d):
    return ev.ir_metrics(_vector(s, d), _relevant(s, d), "query", "id", K)


def _ann(s, d):
    e = embeddings(s, d)
    return v.ivf_topk(e.where("vec_id % 50 = 0"), e, K, "vec_id", "embedding", share=0.72)


def _mmr(s, d):
    c = read_table(s, d, "candidates").distinct()
    return sel.diverse_selection(c, "embedding_model", "candidate_id", "relevance", "vector", "tokens", "category")


def _compaction(s, d):
    m = read_table(s, d, "chat_messages").where("session_id IS NOT NULL AND ordinal IS NOT NULL").groupBy("session_id", "ordinal").agg(F.max(F.length("content")).alias("t"))
    return sel.compact_history(m.select("session_id", "ordinal", F.coalesce("t", F.lit(0)).alias("t")), "session_id", "ordinal", "t", 400)


QUERIES = {
    "vector_topk": lambda s, d: _vector(s, d).select("query", "id", "score", "rank"),
    "not_unit_vectors": lambda s, d: v.not_unit(read_table(s, d, "candidates").select("candidate_id", "vector").where("vector IS NOT NULL AND size(vector) = 48").distinct(), "vector").select("candidate_id"),
    "ann_topk": lambda s, d: _ann(s, d).select("query", "id", "score", "rank"),
    "ann_recall": lambda s, d: v.recall(_ann(s, d), _vector(s, d), K),
    "keyword_topk": lambda s, d: _keyword(s, d),
    "keyword_grammar": lambda s, d: r.keyword_topk(documents(s, d), "doc_id", "text", SEARCHES[2], 20, stems=False),
    "postings": lambda s, d: r.postings(documents(s, d), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("positions")).alias("occurrences")),
    "rrf_fusion": lambda s, d: r.rrf(_legs(s, d), {"vector": 1.0, "keyword": 1.0}, ["query"]),
    "weighted_rrf": lambda s, d: r.rrf(_legs(s, d), {"vector": 2.0, "keyword": 0.0}, ["query"]),
    "stored_index": lambda s, d: index(s, d).where(F.col("term").isin(_ASKED)).groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("positions")).alias("occurrences")),
    "hybrid_documents": hybrid,
    "hybrid_filtered": _hybrid_filtered,
    "five_signal_fusion": _five,
    "chunk_grouping": _chunks,
    "best_rank_seeds": lambda s, d: _seeded(_legs(s, d)),
    "rerank_tail": _rerank,
    "ir_metrics": _metrics,
    "metric_summary": lambda s, d: ev.summary(_metrics(s, d), ["recall", "precision", "mrr", "ndcg"]),
    "mmr_select": _mmr,
    "history_compaction": _compaction,
    "latest_hits_per_query": lambda s, d: rel.top_per(read_table(s, d, "memory_hits").select("query_id", "hit_id", "score").distinct().where("score IS NOT NULL"), ["query_id"], [F.desc("score"), F.asc("hit_id")], 3),
}

_V = """vt AS (SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM (
  SELECT a.vec_id AS query, b.vec_id AS id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0))"""
_WORDS = "tok AS (SELECT id, word, pos FROM (SELECT doc_id AS id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') AS w FROM documents)))"
#: Endings that stemming takes off or changes; a word form is one that has the same stem as the word searched for.
_ENDINGS = ["", "s", "es", "ed", "d", "ing", "er", "ers", "y", "ies", "ied", "ly", "ment", "ments", "ness", "al", "ation", "ations", "ion", "ions", "'s", "e", "ings", "able", "ive", "or", "ors"]


def _forms(t):
    bases = {t, t[:-1], t + "e", t[:-1] + "y", t + t[-1]}
    return sorted({b + e for b in bases for e in _ENDINGS if stem(b + e) == t})


def _search_sql(queries, within="TRUE", stems=True):
    """Common tables up to ``kw`` (query, id, score, rank): the grammar and cover density, alternative by alternative."""
    word = stem if stems else str
    forms, alts, terms, tests = set(), [], [], []
    for q, text in queries.items():
        for n, a in enumerate(parse_search(text)):
            ok = []
            for phrase, no in a:
                t = [(j, word(w)) for j, w in enumerate(phrase) if w]
                forms |= {(f, x) for _, x in t for f in (_forms(x) if stems else [x])}
                terms += [] if no else [(q, n, x) for _, x in t]
                more = "".join(f" AND EXISTS (SELECT 1 FROM p p{j} WHERE p{j}.id = p0.id AND p{j}.term = '{x}' AND p{j}.pos = p0.pos + {j})" for j, x in t[1:])
                ok.append(f"{'NOT ' if no else ''}EXISTS (SELECT 1 FROM p p0 WHERE p0.id = d.id AND p0.term = '{t[0][1]}'{more})")
            tests.append(f"SELECT {q} AS query, {n} AS alt, id FROM (SELECT DISTINCT id FROM p) d WHERE {' AND '.join(ok)}")
    return f"""{_WORDS}, forms(word, term) AS (VALUES {", ".join(f"('{w.replace(chr(39), chr(39) * 2)}', '{t}')" for w, t in sorted(forms))}),
p AS (SELECT id, term, pos FROM tok JOIN forms USING (word) WHERE id IN (SELECT doc_id FROM documents WHERE {within})), asked(query, alt, term) AS (VALUES {", ".join(map(str, sorted(set(terms))))}), fits AS ({" UNION ALL ".join(tests)}),
spots AS (SELECT query, alt, id, term, pos FROM fits JOIN asked USING (query, alt) JOIN p USING (id, term)),
ends AS (SELECT query, alt, id, stop, min(last) AS start FROM (SELECT e.query, e.alt, e.id, e.pos AS stop, o.term, max(o.pos) AS last FROM spots e JOIN spots o ON o.query = e.query AND o.alt = e.alt AND o.id = e.id AND o.pos <= e.pos GROUP BY ALL) x
  GROUP BY query, alt, id, stop HAVING count(*) = (SELECT count(*) FROM asked a WHERE a.query = x.query AND a.alt = x.alt)),
covers AS (SELECT * FROM ends QUALIFY start > coalesce(max(start) OVER (PARTITION BY query, alt, id ORDER BY stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)),
held AS (SELECT c.query, c.alt, c.id, c.start, c.stop, count(*) AS n FROM covers c JOIN spots s ON s.query = c.query AND s.alt = c.alt AND s.id = c.id AND s.pos BETWEEN c.start AND c.stop GROUP BY ALL),
dense AS (SELECT query, alt, id, round(sum(0.1e0 * n / (1 + greatest(0, stop - start - (n - 1)))), 9) AS score FROM held GROUP BY ALL),
kw AS (SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT query, id, max(score) AS score FROM dense GROUP BY ALL))"""


_K = _search_sql(SEARCHES)
_TS = "ts AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS term FROM documents)"
_DEEP = f"rank <= {FAN * K}"


def _legs_sql(within="TRUE"):
    held = _V.replace("WHERE a.vec_id % 50 = 0", f"WHERE a.vec_id IN (50, 100, 150, 200, 250) AND b.vec_id IN (SELECT doc_id FROM documents WHERE {within})") if within != "TRUE" else _V
    return f"""{held}, {_search_sql(SEARCHES, within)}, legs AS (SELECT 'vector' AS ranking, CAST(query / 50 AS INTEGER) AS query, id, rank FROM vt WHERE query IN (50, 100, 150, 200, 250) AND {_DEEP}
  UNION ALL SELECT 'keyword', query, id, rank FROM kw WHERE {_DEEP})"""


_LEGS = _legs_sql()


def _rrf(w):
    return f"SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT query, id, round(sum({w} / (60e0 + rank)), 12) AS score FROM legs GROUP BY ALL)"


_SIG = f"""{_LEGS}, best AS (SELECT query, id, CAST(min(rank) AS INTEGER) AS best FROM legs GROUP BY ALL), seeded AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY best, id) AS INTEGER) AS place FROM best),
vers AS (SELECT source, external_key, count(*) AS versions FROM documents WHERE external_key IS NOT NULL GROUP BY ALL),
known AS (SELECT query, id, ceil(coalesce(len(regexp_extract_all(text, '[\\pL\\pN_]+|[^\\pL\\pN_\\s\\pZ\\x1c-\\x1f\\x85]')), 0) / 396e0) AS parts, coalesce(versions, 1) AS versions, coalesce(pow(2e0, -((epoch_us(TIMESTAMP '{NOW}') - epoch_us(occurred_at)) / 86400e6) / 180e0), 0.5e0) AS rec
  FROM best JOIN documents ON doc_id = id LEFT JOIN vers USING (source, external_key)),
scored AS (SELECT query, id, round(rec, 9) AS recency, round_even(greatest(0, least(1, 0.3e0 * ln(1 + least(parts, 64)::DOUBLE) / ln(65e0) + 0.45e0 * ln(1 + least(greatest(versions - 1, 0), 12)::DOUBLE) / ln(13e0) + 0.25e0 * least(1e0, rec))), 4) AS importance FROM known),
men AS (SELECT DISTINCT doc_id AS item, unnest(regexp_extract_all(lower(external_key), '[a-z]+')) AS entity FROM documents),
hub AS (SELECT entity, ln(1 + (SELECT count(DISTINCT item) FROM men) / count(*)) AS idf FROM men GROUP BY 1 HAVING count(*) < greatest(2, ceil(0.1e0 * (SELECT count(DISTINCT item) FROM men)))),
ok AS (SELECT * FROM men JOIN hub USING (entity)), e0 AS (SELECT DISTINCT query, entity FROM seeded JOIN ok ON item = id WHERE place <= {SEEDS}),
e2 AS (SELECT DISTINCT query, b.entity FROM e0 JOIN ok a USING (entity) JOIN ok b ON b.item = a.item),
near AS (SELECT query, item AS id, round(sum(idf / 2), 9) AS score FROM e2 JOIN ok USING (entity) WHERE (query, item) NOT IN (SELECT (query, id) FROM legs) GROUP BY ALL),
sig AS (SELECT * FROM legs UNION ALL SELECT 'recency', query, id, row_number() OVER (PARTITION BY query ORDER BY recency DESC, id) FROM scored UNION ALL SELECT 'importance', query, id, row_number() OVER (PARTITION BY query ORDER BY importance DESC, id) FROM scored
  UNION ALL SELECT * FROM (SELECT 'graph' AS ranking, query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM near) WHERE {_DEEP})"""
_REL = "rel AS (SELECT a.vec_id AS query, b.vec_id AS id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"
_MET = f"""{_V}, {_REL}, nr AS (SELECT query, count(*) AS n FROM rel GROUP BY 1),
hit AS (SELECT query, count(*) AS h, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM vt JOIN rel USING (query, id) WHERE rank <= 10 GROUP BY 1),
met AS (SELECT query, round(coalesce(h / n, 0), 6) AS recall, round(coalesce(h / 10, 0), 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr,
  round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10) + 1) t(i)), 0), 6) AS ndcg FROM nr LEFT JOIN hit USING (query))"""

SQL = {
    "history_compaction": """WITH RECURSIVE m AS (SELECT session_id, ordinal, coalesce(max(length(content)), 0) AS t FROM chat_messages WHERE session_id IS NOT NULL AND ordinal IS NOT NULL GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal DESC) AS n FROM m),
w AS (SELECT session_id, ordinal, n, 400 AS room, 'verbatim' AS state FROM o WHERE n = 1 UNION ALL
  SELECT o.session_id, o.ordinal, o.n, CASE WHEN o.n > 2 AND o.t <= w.room THEN w.room - o.t ELSE w.room END, CASE WHEN o.n <= 2 THEN 'verbatim' WHEN o.t <= w.room THEN 'kept' ELSE 'dropped' END
  FROM w JOIN o ON o.session_id = w.session_id AND o.n = w.n + 1) SELECT session_id, ordinal, state FROM w""",
    "vector_topk": f"WITH {_V} SELECT * FROM vt WHERE rank <= 10",
    "not_unit_vectors": "SELECT DISTINCT candidate_id FROM candidates WHERE len(vector) = 48 AND abs(sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[])) - 1) >= 1e-3",
    "keyword_topk": f"WITH {_K} SELECT * FROM kw WHERE rank <= 10",
    "stored_index": f"WITH {_K} SELECT term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM p GROUP BY 1",
    "keyword_grammar": f"WITH {_search_sql({2: SEARCHES[2]}, stems=False)} SELECT id, score, rank FROM kw WHERE rank <= 20",
    "hybrid_filtered": f"WITH {_legs_sql(chr(34) + 'kind' + chr(34) + " IN ('note', 'decision', 'minutes') AND occurred_at >= '2025-03-01'")}, f AS ({_rrf('1e0')}) SELECT query, rank, id AS doc_id, source, score FROM f JOIN documents ON doc_id = id WHERE rank <= 10",
    "postings": f"WITH {_TS} SELECT term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM ts WHERE term NOT IN ({', '.join(map(repr, STOP_WORDS))}) GROUP BY 1",
    "rrf_fusion": f"WITH {_LEGS} {_rrf('1e0')}",
    "weighted_rrf": f"WITH {_LEGS} {_rrf('''CASE ranking WHEN 'vector' THEN 2e0 ELSE 0e0 END''')}",
    "hybrid_documents": f"WITH {_LEGS}, f AS ({_rrf('1e0')}) SELECT query, rank, id AS doc_id, source, score FROM f JOIN documents ON doc_id = id WHERE rank <= 10",
    "five_signal_fusion": f"""WITH {_SIG}, ranks AS (SELECT query, id, {", ".join(f"min(rank) FILTER (ranking = '{n}') AS {n}_rank" for n in WEIGHTS)} FROM sig GROUP BY ALL),
c AS (SELECT *, {", ".join(f"coalesce({w}e0 / (60e0 + {n}_rank), 0) AS {n}_part" for n, w in WEIGHTS.items())} FROM ranks), t AS (SELECT *, {" + ".join(f"{n}_part" for n in WEIGHTS)} AS total FROM c),
f AS (SELECT *, round(total, 12) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round(total, 12) DESC, id) AS INTEGER) AS rank FROM t)
SELECT query, id, score, rank, {", ".join(f"{n}_rank, round({n}_part / total, 6) AS {n}_share" for n in WEIGHTS)}, {", ".join(f"CASE WHEN {n}_rank <= 3 THEN 'strong' WHEN {n}_rank <= 10 THEN 'moderate' WHEN {n}_rank IS NOT NULL THEN 'weak' END AS {n}_strength" for n in ("keyword", "graph"))},
'Ranked by ' || concat_ws(', ', {", ".join(f"CASE WHEN {n}_rank <= 3 THEN 'strong {n} (rank ' || {n}_rank || ')' WHEN {n}_rank <= 10 THEN 'moderate {n} (rank ' || {n}_rank || ')' WHEN {n}_rank IS NOT NULL THEN 'weak {n} (rank ' || {n}_rank || ')' END" for n in WEIGHTS)}) || '.' AS why FROM f WHERE rank <= 10""",
    "chunk_grouping": """WITH c AS (SELECT DISTINCT query_id, memory_id, c.chunk_id, c.score FROM (SELECT query_id, memory_id, unnest(matched_chunks) AS c FROM memory_hits)),
g AS (SELECT query_id, memory_id, max(score) AS best, round(avg(score), 9) AS mean, count(*) AS chunks FROM c WHERE score IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best DESC, mean DESC, memory_id) AS INTEGER) AS rank FROM g) WHERE rank <= 10""",
    "rerank_tail": f"""WITH {_LEGS}, f AS (SELECT query, id, round(sum(CASE ranking WHEN 'vector' THEN 1e0 ELSE 0.5e0 END / (60e0 + rank)), 12) AS fused FROM legs GROUP BY ALL),
q(query, words) AS (VALUES {", ".join(f"({n}, {list(dict.fromkeys(re.findall(r'[^\W]+', t.lower())))!r})" for n, t in SEARCHES.items())}),
b AS (SELECT query, id, words, list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS w, row_number() OVER (PARTITION BY query ORDER BY fused DESC, id) AS before FROM f JOIN documents ON doc_id = id JOIN q USING (query)),
s AS (SELECT query, id, before, CASE WHEN before <= 25 THEN round(coalesce(len(list_intersect(words, w)), 0)::DOUBLE / len(words), 9) END AS s FROM b),
t AS (SELECT query, id, before, coalesce(s, min(s) OVER (PARTITION BY query) - 1e-6 * (before - 25)) AS score FROM s)
SELECT query, id, CAST(before AS INTEGER) AS before, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS final, round(score, 9) AS score FROM t""",
    "best_rank_seeds": f"WITH {_SIG} SELECT * FROM seeded",
    "ir_metrics": f"WITH {_MET} SELECT * FROM met",
    "metric_summary": f"WITH {_MET}, l AS (UNPIVOT (SELECT recall, precision, mrr, ndcg FROM met) ON recall, precision, mrr, ndcg INTO NAME metric VALUE v) SELECT metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, min(v) AS least, round(stddev_pop(v), 6) AS spread FROM l GROUP BY 1",
    "latest_hits_per_query": "SELECT query_id, hit_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS rank FROM (SELECT DISTINCT query_id, hit_id, score FROM memory_hits WHERE score IS NOT NULL)) WHERE rank <= 3",
}
