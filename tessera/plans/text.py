"""Text functions over documents, memories and chat messages, always over whole texts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.normal import normal_text
from tessera.operators import chunks as ch
from tessera.operators import retrieval as r
from tessera.sources.tables import read_table

NOW = datetime(2026, 6, 15, 12, 0, 0)


def docs(s, d):
    return read_table(s, d, "documents").select("doc_id", "text", "kind")


def messages(s, d):
    return read_table(s, d, "chat_messages").select("message_id", "content", "role")


def _intents(s, d):
    """Every message of a chat as a query at one moment: what it asks of time."""
    return messages(s, d).select("message_id", "content").distinct().select("message_id", tx.temporal_intents(F.col("content"), NOW).alias("t")).where("t IS NOT NULL").select("message_id", "t.*")


def _grounding(s, d):
    a = messages(s, d).where("lower(trim(role)) = 'assistant'").select("message_id", "content").distinct()
    return a.select("message_id", tx.grounding("content", 5).alias("g")).select("message_id", "g.claims", "g.supported", "g.rate", "g.refusal", "g.grounded", F.size("g.invented").alias("invented"))


def _reflections(s, d):
    """Answers read as reflections on their session's pattern: nothing is exempt, the uncited claims are
    counted anew, and one may be written only if it cites something and nothing that does not exist."""
    m = read_table(s, d, "chat_messages").where("lower(trim(role)) = 'assistant'").select("message_id", "session_id", "content").distinct()
    about = read_table(s, d, "chat_sessions").groupBy("session_id").agg(F.min("title").alias("pattern"))
    g = m.join(about, "session_id").select("message_id", "session_id", "pattern", tx.grounding("content", 5, exempt=False).alias("g"), F.array_sort(F.array_distinct(tx.cited(F.coalesce("content", F.lit(""))))).alias("citations"))
    writable = (F.size("g.invented") == 0) & (F.col("g.supported") > 0)
    return g.select("message_id", "session_id", "pattern", F.concat_ws(",", "citations").alias("citations"), (F.col("g.claims") - F.col("g.supported")).alias("uncited"), "g.rate", writable.alias("writable"))


def _chunked(s, d):
    return ch.chunk(docs(s, d), "doc_id", "text", F.col("kind") == "code")


def _citations(s, d):
    """Chunks of documents against their documents; every seventh is damaged first."""
    c = _chunked(s, d)
    bad = F.when(F.col("ordinal") % 7 == 3, F.concat(F.lit("x"), "content")).otherwise(F.col("content"))
    norm = docs(s, d).select("doc_id", normal_text("text").alias("parent"))
    j = c.withColumn("content", bad).join(norm, "doc_id")
    return j.select("doc_id", "ordinal", r.citation_state(F.col("content"), F.col("prefix_chars"), F.col("parent"), F.col("char_start"), F.col("char_end")).alias("state"))


QUERIES = {
    "normalize_text": lambda s, d: read_table(s, d, "memories").select("memory_id", normal_text("content").alias("text")).distinct(),
    "token_count": lambda s, d: docs(s, d).select("doc_id", tx.token_count("text").alias("tokens")),
    "sentences": lambda s, d: docs(s, d).select("doc_id", F.size(tx.sentence_spans("text")).alias("sentences")),
    "tags": lambda s, d: docs(s, d).select("doc_id", F.explode(tx.tags("text")).alias("t")).select("doc_id", "t.name", "t.label"),
    "message_intent": lambda s, d: messages(s, d).select("message_id", tx.message_intent("content").alias("intent")),
    "refers_back": lambda s, d: messages(s, d).select("message_id", tx.refers_back("content").alias("refers_back")),
    "session_titles": lambda s, d: messages(s, d).select("message_id", tx.session_title("content").alias("title")),
    "query_kinds": lambda s, d: read_table(s, d, "chat_sessions").select("session_id", tx.is_prose("title").alias("prose")).distinct(),
    "citation_grounding": _grounding,
    "reflection_list": _reflections,
    "technical_terms": lambda s, d: docs(s, d).select("doc_id", F.explode(tx.technical_terms("text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("documents")),
    "summary_grounding": lambda s, d: read_table(s, d, "memories").select("memory_id", F.size(tx.unsupported_terms("title", F.col("content"))).alias("unsupported")).distinct(),
    "temporal_intents": _intents,
    "kind_by_suffix": lambda s, d: read_table(s, d, "memories").select("memory_id", ch.kind_of("external_key").alias("inferred")).distinct(),
    "chunks": lambda s, d: _chunked(s, d).select("doc_id", "ordinal", "char_start", "char_end", "prefix_chars", "token_count"),
    "citation_integrity": _citations,
    "markdown_structure": lambda s, d: docs(s, d).select("doc_id", ch.markdown("text").alias("m")).select("doc_id", "m.title", F.posexplode("m.headings").alias("n", "h")).select("doc_id", "title", "n", "h.level", F.col("h.text").alias("heading"), "h.start"),
    "code_definitions": lambda s, d: docs(s, d).where("kind = 'code'").select("doc_id", F.posexplode(ch.definitions("text")).alias("n", "name")),
    "python_definitions": lambda s, d: docs(s, d).where("kind = 'code'").select("doc_id", F.explode_outer(ch.python_definitions("text")).alias("p")).select("doc_id", "p.*"),
    "diff_spans": lambda s, d: ch.version_spans(read_table(s, d, "memories"), ["source_id", "external_key"], "version", "content"),
    "line_diff": lambda s, d: ch.version_diffs(read_table(s, d, "memories"), ["source_id", "external_key"], "version", "content"),
}

_WORDS = ", ".join("'" + w.replace("'", "''") + "'" for w in [*tx.FUNCTION_WORDS, *tx.POINTING])
_NORMAL = """WITH a AS (SELECT DISTINCT memory_id, nfc_normalize(content) AS t FROM memories),
b AS (SELECT memory_id, replace(replace(CASE WHEN left(t, 1) = chr(65279) THEN substr(t, 2) ELSE t END, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM a)
SELECT memory_id, trim(regexp_replace(regexp_replace(t, '[\\t\\v\\f\\x1c-\\x1f\\x85\\pZ]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)) AS text FROM b"""

_CITED = "[\\[【](\\d+(?:\\s*,\\s*\\d+)*)[\\]】]"
_PARTS = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace(content, '^ +| +$', '', 'g'), '([.!?])[\\s\\v]+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s) <> '')"
_NUMBERS = f"list_transform(flatten(list_transform(regexp_extract_all(content, '{_CITED}', 1), lambda s: string_split(s, ','))), lambda n: CAST(trim(n) AS INTEGER))"
_NEGATED = "|".join(x.replace("'", "''").replace(" ", "[^\\w'']+") for x in tx.NEGATIONS)
_REFUSED = f"regexp_matches(lower(content), '(?:^|[^\\w''])(?:{_NEGATED})(?:[^\\w'']+[\\w'']+){{0,3}}[^\\w'']+(?:{'|'.join(tx.DECLINED)})') AND len({_NUMBERS}) = 0"
_NO_CLAIMS = "|".join(x.replace("'", "''") for x in tx.NO_CLAIM)
_UNBOUND = "list_filter(nums, lambda n: n < 1 OR n > 5)"



def _starts(*slots):
    """The opening of a clause for DuckDB, which has no look-ahead."""
    return tx._opening(*slots).replace(r"(?![\w'])", r"(?:[^\w']|$)").replace("'", "''")


_ASKS = f"""(ends_with(c, '?') OR (regexp_matches(q, '{_starts(tx.ASKING)}') AND NOT regexp_matches(q, '{_starts(tx.EXCLAIMING, tx.ARTICLES_INDEFINITE)}') AND NOT regexp_matches(q, '{_starts([tx.EXCLAIMING_THAT], None, ["that"])}'))
  OR regexp_matches(q, '{_starts(tx.AUXILIARIES, tx.SUBJECTS)}') OR regexp_matches(q, '{_starts(tx.REQUESTS)}'))"""
_MARKERS = ", ".join(f"'{w}'" for w in tx.PROSE_MARKERS)
_TERM = """CASE WHEN starts_with(p, '`') THEN replace(p, '`', '') WHEN regexp_matches(regexp_replace(p, '^[^A-Za-z_`]+([A-Za-z_])', '\\1'), '^[A-Za-z_].*[./]') THEN regexp_replace(p, '^[^A-Za-z_`]+([A-Za-z_])', '\\1')
  WHEN regexp_matches(p, '^[a-z0-9]+(?:_[a-z0-9]+)+$') OR regexp_matches(p, '^(?:[a-z][a-z]*[A-Z]|[A-Z][a-z0-9]+[A-Z])[A-Za-z0-9]*$') THEN p END"""

SQL = {
    "message_intent": f"""WITH m AS (SELECT message_id, content, string_split_regex(regexp_replace(regexp_replace(content, '([.!?])[\\s\\v]+', '\\1' || chr(10), 'g'), '[\\s\\v]+(?:[—–]|--)[\\s\\v]+', chr(10), 'g'), '[;\\n]+') AS parts, row_number() OVER () AS n FROM chat_messages),
l AS (SELECT n, lower(regexp_replace(unnest(parts), '^ +| +$', '', 'g')) AS c FROM m), x AS (SELECT n, c, regexp_replace(c, '{_starts(tx.LEADING)}', '') AS q FROM l WHERE c <> ''),
k AS (SELECT n, bool_or({_ASKS}) AS asks, bool_or(NOT {_ASKS} AND len(string_split_regex(c, '[\\s\\v]+')) >= 4) AS states FROM x GROUP BY 1)
SELECT message_id, CASE WHEN content IS NULL THEN NULL WHEN asks AND states THEN 'both' WHEN asks THEN 'question' ELSE 'statement' END AS intent FROM m LEFT JOIN k USING (n)""",
    "session_titles": """WITH f AS (SELECT message_id, regexp_replace(regexp_replace(content, '[\\s\\v]+', ' ', 'g'), '^ +| +$', '', 'g') AS flat FROM chat_messages),
h AS (SELECT *, left(flat, 61) AS head FROM f), c AS (SELECT *, regexp_extract(head, '^(.*?)(?:[.!?;:]| [—–] )', 1) AS clause, regexp_matches(head, '[.!?;:]| [—–] ') AS marked, regexp_extract(head, '^(.*) ', 1) AS words FROM h)
SELECT message_id, CASE WHEN flat = '' THEN NULL WHEN length(flat) <= 60 THEN flat WHEN marked AND length(clause) >= 20 THEN regexp_replace(clause, ' +$', '') ELSE regexp_replace(CASE WHEN length(words) > 20 THEN words ELSE left(flat, 60) END, ' +$', '') || '…' END AS title FROM c""",
    "query_kinds": f"""WITH p AS (SELECT DISTINCT session_id, list_filter(list_transform(string_split_regex(title, '[\\s\\v]+'), lambda w: regexp_replace(w, '^[`''"?.,()]+|[`''"?.,()]+$', '', 'g')), lambda w: w <> '') AS w FROM chat_sessions)
SELECT DISTINCT session_id, len(w) > 0 AND len(list_filter(w, lambda x: regexp_matches(x, '^\\pL+$') AND NOT (upper(x) = x AND lower(x) <> x))) > 0 AND (len(w) >= 4 OR len(list_filter(w, lambda x: lower(x) IN ({_MARKERS}))) > 0) AS prose FROM p""",
    "technical_terms": f"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '`[^`\\n]{{2,80}}`|\\w+(?:[./]\\w+)*')) AS p FROM documents), t AS (SELECT DISTINCT doc_id, {_TERM} AS term FROM d)
SELECT term, count(*) AS documents FROM t WHERE length(term) >= 3 AND lower(term) NOT IN ('e.g', 'i.e', 'n.b') GROUP BY 1""",
    "citation_grounding": f"""WITH a AS (SELECT DISTINCT message_id, coalesce(content, '') AS content FROM chat_messages WHERE lower(trim(role)) = 'assistant'),
p AS (SELECT message_id, content, {_NUMBERS} AS nums, coalesce({_REFUSED}, false) AS refusal, list_filter({_PARTS}, lambda s: regexp_matches(s, '[A-Za-z]') AND NOT regexp_matches(regexp_replace(lower(trim(s)), '^[-*# ]+', ''), '^(?:{_NO_CLAIMS})')) AS parts FROM a),
c AS (SELECT *, CASE WHEN refusal THEN [] ELSE coalesce(parts, []) END AS claims FROM p),
n AS (SELECT *, len(claims) AS n, len(list_filter(claims, lambda s: regexp_matches(s, '{_CITED}'))) AS k FROM c)
SELECT message_id, CAST(n AS INTEGER) AS claims, CAST(k AS INTEGER) AS supported, CASE WHEN n > 0 THEN round(k / n, 6) ELSE 1e0 END AS rate, refusal, len(list_distinct({_UNBOUND})) = 0 AND (n = 0 OR k = n) AS grounded, CAST(len(list_distinct({_UNBOUND})) AS INTEGER) AS invented FROM n""",
    "reflection_list": f"""WITH a AS (SELECT DISTINCT message_id, session_id, coalesce(content, '') AS content FROM chat_messages WHERE lower(trim(role)) = 'assistant'), s AS (SELECT session_id, min(title) AS pattern FROM chat_sessions GROUP BY 1),
p AS (SELECT message_id, session_id, pattern, {_NUMBERS} AS nums, coalesce(list_filter({_PARTS}, lambda s: regexp_matches(s, '[A-Za-z]')), []) AS claims FROM a JOIN s USING (session_id)),
n AS (SELECT *, len(claims) AS n, len(list_filter(claims, lambda s: regexp_matches(s, '{_CITED}'))) AS k FROM p)
SELECT message_id, session_id, pattern, array_to_string(list_sort(list_distinct(nums)), ',') AS citations, CAST(n - k AS INTEGER) AS uncited, CASE WHEN n > 0 THEN round(k / n, 6) ELSE 0e0 END AS rate, len({_UNBOUND}) = 0 AND k > 0 AS writable FROM n""",
    "normalize_text": _NORMAL,
    "tags": """WITH l AS (SELECT doc_id, unnest(t) AS label, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '#([\\pL\\pN_][\\pL\\pN_-]*)', 1) AS t FROM documents)),
f AS (SELECT doc_id, replace(replace(lower(label), 'ß', 'ss'), 'ς', 'σ') AS name, min(i) AS i, arg_min(label, i) AS label FROM l GROUP BY ALL) SELECT doc_id, name, label FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 10""",
    "refers_back": f"SELECT message_id, len(list_filter(list_distinct(regexp_extract_all(lower(content), '[a-z0-9_]+')), lambda w: w NOT IN ({_WORDS}))) < 2 AS refers_back FROM chat_messages",
    "code_definitions": f"SELECT doc_id, CAST(unnest(range(0, len(d))) AS INTEGER) AS n, unnest(d) AS name FROM (SELECT doc_id, regexp_extract_all(text, '{ch.DEFINITION}', 1) AS d FROM documents WHERE kind = 'code')",
    "markdown_structure": r"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
f AS (SELECT *, sum(CAST(regexp_matches(line, '^ {0,3}(```|~~~)') AS INTEGER)) OVER w AS fences, coalesce(sum(length(line) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, start, length(regexp_extract(line, '^ {0,3}(#{1,6})(?:[ 	]|$)', 1)) AS level, trim(regexp_replace(regexp_replace(line, '^ {0,3}#{1,6}(?:[ 	]+|$)', ''), '(^|[ 	]+)#+[ 	]*$', '')) AS heading FROM f WHERE fences % 2 = 0 AND regexp_matches(line, '^ {0,3}#{1,6}(?:[ 	]|$)'))
SELECT doc_id, first(CASE WHEN level = 1 THEN heading END ORDER BY CASE WHEN level = 1 THEN i END NULLS LAST) OVER (PARTITION BY doc_id) AS title, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS n, CAST(level AS INTEGER) AS level, heading, CAST(start AS INTEGER) AS start FROM h""",
    "token_count": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\pL\\pN_]+|[^\\pL\\pN_\\s\\v\\pZ\\x1c-\\x1f\\x{85}]')) AS INTEGER) AS tokens FROM documents",
    "kind_by_suffix": "SELECT DISTINCT memory_id, CASE WHEN regexp_matches(external_key, '\\.(md|txt)$') THEN 'note' WHEN external_key LIKE '%.py' THEN 'code' WHEN external_key LIKE '%.pdf' THEN 'document' ELSE 'other' END AS inferred FROM memories",
}
