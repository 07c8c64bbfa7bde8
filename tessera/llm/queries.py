"""Problems 2, 3, 5, 6, 7 and 8 over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.llm import conversations as c
from tessera.llm import lookalikes, mixing, neighbours, packing, splitting, tokens
from tessera.session import cut
from tessera.sources.tables import read_table


def _documents(s, d):
    return read_table(s, d, "documents")


def _split(s, d, pieces):
    return splitting.split_texts(read_table(s, d, "memories"), "memory_id", "content", pieces=pieces)


def _units(s, d):
    all_ = neighbours.collection(read_table(s, d, "candidates"), read_table(s, d, "memory_hits"))
    return neighbours.unit_vectors(all_, "id", "vector", neighbours.KNN.dim)


def _sittings(s, d):
    """Every session id as a channel with many sittings: only questions have an intent, only answers can be refusals."""
    hint = F.when(F.col("intent").isNotNull(), "user").when(F.col("answer_refused").isNotNull(), "assistant")
    return c.rebuilt_sessions(read_table(s, d, "chat_messages"), "session_id", "created_at", "message_id", "role", "content", hint)


def _dropped(s, d):
    v = c.session_verdicts(read_table(s, d, "chat_messages"), read_table(s, d, "chat_sessions"))
    return v.where("dropped IS NOT NULL").select("session_id")


def _pieces_hold(s, d):
    """Per oversized version: that its pieces are numbered, within the limit, overlap as asked and make up its normal form."""
    w = Window.partitionBy("memory_id").orderBy("piece")
    p = _split(s, d, True).withColumn("before", F.coalesce(F.lag("end").over(w), F.lit(0)))
    joined = (F.col("start") == F.greatest(F.col("before") - splitting.OVERLAP, F.lit(0))) & (F.char_length("content") == F.col("end") - F.col("start"))
    new = F.substring("content", F.col("before") - F.col("start") + 1, F.lit(splitting.LIMIT))
    per = p.groupBy("memory_id").agg(
        (F.max("piece") + 1 == F.count(F.lit(1))).alias("numbered"), (F.max(F.char_length("content")) <= splitting.LIMIT).alias("within"), F.min(F.coalesce(joined, F.lit(False))).alias("joined"),
        F.sum(F.char_length(new)).alias("length"),
    )
    return per.select("memory_id", "numbered", "within", "joined", F.col("length").cast("bigint").alias("length"))


def _packed(s, d):
    """Per kind: containers above the capacity, texts cut although they fit, tokens lost or doubled."""
    sizes, kinds = cut(tokens.sized(_documents(s, d), ["doc_id"]), "sizes"), read_table(s, d, "containers").distinct()
    put = cut(packing.pack(sizes, kinds)[0], "packed")
    each = [(r.container_kind, r.capacity_tokens) for r in kinds.collect()]  # a small fixed table, checked by pack
    cap = kinds.select("container_kind", "capacity_tokens")
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity_tokens")) for k, c in each]))
    over = put.groupBy("container_kind", "container_no").agg(F.sum("tokens").alias("t")).join(cap, "container_kind").groupBy("container_kind").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("over"))
    per = put.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    held = sizes.where("tokens IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "tokens", every.alias("k")).select("doc_id", "tokens", "k.*").join(per, ["container_kind", "doc_id"], "left")
    whole = held.groupBy("container_kind").agg(F.count_if((F.col("tokens") <= F.col("capacity_tokens")) & (F.col("n") > 1)).alias("cut"), F.count_if(~F.col("t").eqNullSafe(F.col("tokens"))).alias("wrong"))
    return over.join(whole, "container_kind")


def _mixed(s, d):
    """Per target source: documents used more often than allowed, of another source, or with other tokens than they have."""
    sizes = cut(tokens.sized(_documents(s, d), ["doc_id", "source"]), "sizes")
    mixture, _ = mixing.mix(sizes, read_table(s, d, "mix_targets"))
    used = mixture.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("copy").alias("copies"), F.max("tokens").alias("t"))
    t = read_table(s, d, "mix_targets").select("source", "max_repeats").distinct()
    real = sizes.select("doc_id", F.col("source").alias("own"), "tokens")
    j = t.join(used.join(real, "doc_id", "left"), "source", "left")
    wrong = ~F.col("own").eqNullSafe(F.col("source")) | ~F.col("t").eqNullSafe(F.col("tokens")) | (F.col("n") != F.col("copies"))
    return j.groupBy("source").agg(F.count_if(F.col("n") > F.col("max_repeats")).alias("too_often"), F.count_if(F.col("doc_id").isNotNull() & wrong).alias("wrong"))


QUERIES = {
    "p2_found": lambda s, d: neighbours.near_pairs(_units(s, d), 0.95).select("id_a", "id_b"),
    "p2_neighbours": lambda s, d: neighbours.nearest(_units(s, d), 10),
    "p2_recall": lambda s, d: neighbours.recall(_units(s, d), 10),
    "p3_found": _dropped,
    "p3_conversations": lambda s, d: c.conversations(read_table(s, d, "chat_messages"), read_table(s, d, "chat_sessions")),
    "p3_sessions": _sittings,
    "p5_found": lambda s, d: _split(s, d, False).select("memory_id").distinct(),
    "p5_pieces": lambda s, d: _split(s, d, True),
    "p5_pieces_hold": _pieces_hold,
    "p6_packing": lambda s, d: packing.pack(tokens.sized(_documents(s, d), ["doc_id"]), read_table(s, d, "containers"))[0],
    "p6_report": lambda s, d: packing.pack_report(tokens.sized(_documents(s, d), ["doc_id"]), read_table(s, d, "containers")),
    "p6_packing_holds": _packed,
    "p7_mix": lambda s, d: mixing.mix(tokens.sized(_documents(s, d), ["doc_id", "source"]), read_table(s, d, "mix_targets"))[0],
    "p7_report": lambda s, d: mixing.mix_report(tokens.sized(_documents(s, d), ["doc_id", "source"]), read_table(s, d, "mix_targets")),
    "p7_mix_holds": _mixed,
    "p8_found": lambda s, d: lookalikes.same_looking(_documents(s, d)).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b")),
    "p8_normalized": lambda s, d: lookalikes.normalized(_documents(s, d)),
}

_TURNS = """
WITH m AS (SELECT session_id, ordinal, lower(regexp_replace(role, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')) AS role, content FROM chat_messages
  WHERE session_id IN (SELECT session_id FROM chat_sessions)),
t AS (SELECT DISTINCT session_id, ordinal, role, content FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) - 1 AS turn,
  count(*) OVER (PARTITION BY session_id, ordinal) AS at_ordinal, count(*) OVER (PARTITION BY session_id) AS turns FROM t),
bad AS (SELECT DISTINCT session_id FROM n WHERE ordinal IS NULL OR at_ordinal > 1
  OR coalesce(role, '') <> CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END OR turns % 2 = 1
  OR NOT regexp_matches(coalesce(content, ''), '[^\\s\\pZ\\p{Cc}\\p{Cf}]')),
dropped AS (SELECT DISTINCT session_id FROM chat_sessions WHERE session_id IS NOT NULL
  AND (session_id NOT IN (SELECT session_id FROM n) OR session_id IN (SELECT session_id FROM bad)))
"""

_SITTINGS = """
WITH m AS (SELECT *, lower(regexp_replace(role, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')) AS spelled FROM chat_messages
  WHERE session_id IS NOT NULL AND created_at IS NOT NULL AND regexp_matches(coalesce(content, ''), '[^\\s\\pZ\\p{Cc}\\p{Cf}]')),
t AS (SELECT session_id, created_at, content, min(message_id) AS message_id, max(CASE WHEN spelled IN ('user', 'assistant') THEN spelled WHEN intent IS NOT NULL THEN 'user' WHEN answer_refused IS NOT NULL THEN 'assistant' END) AS known, max(CASE WHEN spelled IN ('user', 'assistant') THEN spelled END) AS read
  FROM m GROUP BY session_id, created_at, coalesce(spelled, ''), content),
g AS (SELECT *, (epoch_us(created_at) - epoch_us(lag(created_at) OVER w)) / 1e6 AS gap FROM t WINDOW w AS (PARTITION BY session_id ORDER BY created_at, message_id)),
h AS (SELECT floor(log2(gap) * 8) AS b, count(*)::DOUBLE AS n FROM g WHERE gap > 0 GROUP BY 1),
k AS (SELECT b, sum(n) OVER o AS n1, sum(n * b) OVER o AS m1, sum(n) OVER () AS n_all, sum(n * b) OVER () AS m_all, lead(b) OVER (ORDER BY b) AS b2 FROM h WINDOW o AS (ORDER BY b ROWS UNBOUNDED PRECEDING)),
cal AS (SELECT pow(2, (b + 1 + b2) / 2 / 8) AS pause FROM k WHERE b2 IS NOT NULL ORDER BY pow(m1 / n1 - (m_all - m1) / (n_all - n1), 2) * n1 * (n_all - n1) DESC, b LIMIT 1),
p AS (SELECT *, sum(CASE WHEN gap >= (SELECT pause FROM cal) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY created_at, message_id ROWS UNBOUNDED PRECEDING) AS part FROM g),
i AS (SELECT *, row_number() OVER (PARTITION BY session_id, part ORDER BY created_at, message_id) - 1 AS turn FROM p),
f AS (SELECT *, CASE WHEN known IS NOT NULL THEN (turn + CAST(known = 'assistant' AS INTEGER)) % 2 END AS own FROM i),
l AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY session_id, part ORDER BY turn ROWS UNBOUNDED PRECEDING) AS before, first_value(own IGNORE NULLS) OVER (PARTITION BY session_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first FROM f),
r AS (SELECT *, coalesce(known, CASE WHEN (turn + coalesce(before, first, 0)) % 2 = 0 THEN 'user' ELSE 'assistant' END) AS role FROM l)
SELECT session_id, CAST(part AS BIGINT) AS part, turn, role, read IS NULL AS inferred, created_at, message_id, content FROM (SELECT *, min(role) OVER q AS a, max(role) OVER q AS b FROM r WINDOW q AS (PARTITION BY session_id, part)) WHERE a < b
"""

_NORMAL = """
WITH a AS (SELECT DISTINCT memory_id, nfc_normalize(content) AS t FROM memories WHERE content IS NOT NULL),
b AS (SELECT memory_id, replace(replace(CASE WHEN left(t, 1) = chr(65279) THEN substr(t, 2) ELSE t END, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM a),
c AS (SELECT memory_id, regexp_replace(regexp_replace(t, '[\\t\\v\\f\\x1c-\\x1f\\x85\\pZ]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS t FROM b)
"""

SQL = {
    "p2_found": """
WITH c AS (SELECT candidate_id AS id, vector FROM candidates UNION SELECT c.chunk_id, c.vector FROM (SELECT unnest(matched_chunks) AS c FROM memory_hits)),
v AS (SELECT id, vector::DOUBLE[] AS x FROM c WHERE id IS NOT NULL AND len(vector) = 48 AND len(list_filter(vector, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
u AS (SELECT id, x, sqrt(list_inner_product(x, x)) AS n FROM v WHERE list_inner_product(x, x) > 0)
SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM u a JOIN u b ON a.id < b.id WHERE list_inner_product(a.x, b.x) >= 0.95 * a.n * b.n""",
    "p3_sessions": _SITTINGS,
    "p3_found": _TURNS + "SELECT session_id FROM dropped",
    "p3_conversations": _TURNS
    + "SELECT session_id, turn, CAST(ordinal AS BIGINT) AS ordinal, role, content FROM n WHERE session_id NOT IN (SELECT session_id FROM dropped)",
    "p6_packing_holds": "SELECT DISTINCT container_kind, 0 AS over, 0 AS cut, 0 AS wrong FROM containers WHERE capacity_tokens > 0",
    "p7_mix_holds": "SELECT DISTINCT source, 0 AS too_often, 0 AS wrong FROM mix_targets WHERE source IS NOT NULL",
    "p5_pieces_hold": _NORMAL + "SELECT memory_id, true AS numbered, true AS within, true AS joined, max(length(trim(t, chr(10)))) AS length FROM c WHERE length(trim(t, chr(10))) > 2000 GROUP BY 1",
    "p5_found": _NORMAL + "SELECT DISTINCT memory_id FROM c WHERE length(trim(t, chr(10))) > 2000",
}
