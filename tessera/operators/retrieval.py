"""Keyword search, rank fusion, grouping and explanation of results."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.functions.analysis import STOP_WORDS, parse_search, words
from tessera.functions.scores import rrf_term, strength
from tessera.functions.stemming import stem
from tessera.session import cut, remove

#: Results reranked by the costly scorer, and the step by which the tail is put below them.
RERANKED, TAIL_STEP = 25, 1e-6


def postings(docs: DataFrame, id_col: str, text: str, stems: bool = False) -> DataFrame:
    """Inverted index as rows: term, id, positions (ascending, from 0). Stop words keep their place but have no row.

    With ``stems`` terms are Porter2 stems, worked out once for each distinct word of a
    batch. Null and empty texts have no row; a repeated row repeats its rows. A document
    is one row, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            terms: dict[str, int] = {}
            number = [-1 if w in STOP_WORDS else terms.setdefault(stem(w) if stems else w, len(terms)) for w in coded.dictionary.to_pylist()]
            term = np.array(number, dtype=np.int64)[coded.indices.to_numpy()]
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            order = np.lexsort((pos, term, row))
            order = order[term[order] >= 0]
            row, term, pos = row[order], term[order], pos[order].astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])) if len(row) else np.zeros(0, dtype=int)
            held = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(pos))
            names = pa.array(list(terms), pa.string())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(term[first])), batch.column(0).take(pa.array(row[first])), held], names=["term", "id", "positions"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("id", kind), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    return docs.select(id_col, words(text).alias("w")).mapInArrow(run, schema)


def write_index(index: DataFrame, path: str) -> None:
    """Stores postings by term, so that a search reads the row groups of its own terms. Terms are parted by
    (term, id): one that a third of the documents hold is spread over files."""
    made = cut(index, "postings")  # ranges are found by a sample first
    made.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)
    remove(index.sparkSession, made.__dict__["_written"])


def cover_density(lists: list[list[int]], weight: float = 0.1) -> float:
    """Cover density of position lists, one per term: every shortest stretch that holds all terms adds the
    weight times its number of terms over one plus the foreign words inside."""
    if not lists or any(not x for x in lists):
        return 0.0
    spots = sorted((p, i) for i, x in enumerate(lists) for p in x)
    places = [p for p, _ in spots]
    last: dict[int, int] = {}
    score, open_from = 0.0, -1
    for at, (p, i) in enumerate(spots):
        last[i] = p
        if len(last) == len(lists):
            start = min(last.values())
            if start > open_from:  # a later start: the stretch before cannot be shortened
                held = at + 1 - bisect_left(places, start)
                score += weight * held / (1 + max(0, (p - start) - (held - 1)))
                open_from = start
    return score


def search_score(alternatives: list, at: dict[str, list[int]]) -> float | None:
    """The best cover density over the alternatives that a document's positions meet; None if it meets none."""
    best = None
    for a in alternatives:
        ok, lists = True, []
        for phrase, excluded in a:
            terms = [(j, t) for j, t in enumerate(phrase) if t is not None]
            held = [set(at.get(t, ())) for _, t in terms]
            first = any(all(p + j in h for (j, _), h in zip(terms, held)) for p in at.get(phrase[0], ()))
            ok &= first != excluded
            if not excluded:
                lists += [at.get(t, []) for _, t in terms]
        if ok:
            best = max(best or 0.0, cover_density(lists))
    return best


def keyword_search(index: DataFrame, queries: dict[int, str], k: int, stems: bool = True, within: DataFrame | None = None) -> DataFrame:
    """Query, id, score, rank of the ``k`` best documents of each query by cover density, ties by id.

    Full search grammar: phrases in quotes, ``or``, exclusion by a minus. ``index`` are :func:`postings` (of stems,
    if ``stems``), made on the spot or read from :func:`write_index`; only rows of the queries' terms are read and
    shuffled, once for all queries. ``within``: only documents with these ids (one column) may be found. A blank
    query, or one of stop words alone, finds nothing.
    """
    word = stem if stems else str
    parsed = {q: [[(tuple(t and word(t) for t in phrase), no) for phrase, no in a] for a in parse_search(s)] for q, s in queries.items()}
    terms = sorted({t for alternatives in parsed.values() for a in alternatives for p, _ in a for t in p if t})

    @F.pandas_udf("array<struct<query int, score double>>")
    def scored(found: pd.Series) -> pd.Series:
        out = []
        for rows in found:
            at = {r["term"]: list(r["positions"]) for r in rows}
            each = ((q, search_score(a, at)) for q, a in parsed.items())
            out.append([{"query": q, "score": s} for q, s in each if s is not None])
        return pd.Series(out, dtype=object)

    hits = index.where(F.col("term").isin(terms))
    if within is not None:
        hits = hits.join(within.toDF("id").distinct(), "id", "left_semi")
    per = hits.groupBy("id").agg(F.collect_list(F.struct("term", "positions")).alias("found"))
    per = per.select("id", F.explode(scored("found")).alias("s")).select(F.col("s.query").alias("query"), "id", F.round("s.score", 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return per.withColumn("rank", rank).where(F.col("rank") <= k)


def keyword_topk(docs: DataFrame, id_col: str, text: str, query: str, k: int, stems: bool = True) -> DataFrame:
    """:func:`keyword_search` for one query over texts without a stored index: id, score, rank."""
    return keyword_search(postings(docs, id_col, text, stems=stems), {0: query}, k, stems).select("id", "score", "rank")


def ranked(df: DataFrame, by: list[str], score: str, id_col: str) -> DataFrame:
    """Adds ``rank``, 1-based, by (score descending, id)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), id_col)))


def rrf(rankings: DataFrame, weights: dict[str, float], by: list[str] | None = None, k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of rows (ranking, id, rank): id, score, order by (-score, id) in ``rank``.

    Of an id that a ranking holds twice the better rank counts. A ranking of
    weight 0 still admits its ids, at 0; one without a weight is an error.
    """
    by = by or []
    if k < 0:
        raise ValueError("k must not be negative")
    known = F.col("ranking").isin(list(weights))
    weight = F.coalesce(*[F.when(F.col("ranking") == n, F.lit(float(w))) for n, w in weights.items()])
    checked = F.when(known, weight).otherwise(F.raise_error(F.concat(F.lit("no weight for ranking "), F.col("ranking"))).cast("double"))
    best = rankings.groupBy(*by, "ranking", "id").agg(F.min("rank").alias("rank"))
    fused = best.groupBy(*by, "id").agg(F.round(F.sum(rrf_term(F.col("rank"), checked, k)), 12).alias("score"))
    return ranked(fused, by, "score", "id")


def signal_fusion(rankings: DataFrame, weights: dict[str, float], by: list[str], may_introduce: tuple[str, ...] = ("vector", "keyword", "graph"), k: int = 60) -> DataFrame:
    """Fusion that keeps every signal's rank, contribution and strength.

    Signals outside ``may_introduce`` only reorder what the others found, and
    are skipped at weight 0 when the plan is made.
    """
    used = {n: w for n, w in weights.items() if w > 0 or n in may_introduce}
    ranks = rankings.groupBy(*by, "id").agg(*[F.min(F.when(F.col("ranking") == n, F.col("rank"))).alias(f"{n}_rank") for n in used])
    admitted = F.coalesce(*[F.col(f"{n}_rank") for n in used if n in may_introduce]).isNotNull()
    parts = {n: F.coalesce(rrf_term(F.col(f"{n}_rank"), w, k), F.lit(0.0)) for n, w in used.items()}
    total = sum(parts.values(), F.lit(0.0))
    out = ranks.where(admitted).withColumn("score", F.round(total, 12))
    out = out.withColumns({f"{n}_share": F.round(F.coalesce(F.try_divide(p, total), F.lit(0.0)), 6) for n, p in parts.items()})
    out = out.withColumns({f"{n}_strength": strength(F.col(f"{n}_rank")) for n in used})
    return ranked(out, by, "score", "id")


def explained(signals: list[str]) -> Column:
    """One sentence that says which signals ranked a result, how strongly and where, in the given order."""
    parts = [F.concat(strength(F.col(f"{n}_rank")), F.lit(f" {n} (rank "), F.col(f"{n}_rank"), F.lit(")")) for n in signals]
    return F.concat(F.lit("Ranked by "), F.concat_ws(", ", *parts), F.lit("."))


def group_chunks(hits: DataFrame, by: list[str], doc: str, chunk: str, score: str, k: int) -> DataFrame:
    """Documents by the best, then the mean of their chunks, then id; null scores do not count."""
    per = hits.where(F.col(score).isNotNull()).groupBy(*by, doc).agg(
        F.max(score).alias("best"), F.round(F.avg(score), 9).alias("mean"), F.count(F.lit(1)).alias("chunks")
    )
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("best"), F.desc("mean"), doc))
    return per.withColumn("rank", rank).where(F.col("rank") <= k)


def rerank(results: DataFrame, by: list[str], id_col: str, first: str, second: Column, n: int = RERANKED) -> DataFrame:
    """The first ``n`` by ``first`` get the score ``second``; the others follow below its least, in order.

    Adds before, final, score and movement (places gained).
    """
    order = Window.partitionBy(*by).orderBy(F.desc(first), id_col)
    r = results.withColumn("before", F.row_number().over(order)).withColumn("_s", F.when(F.col("before") <= n, second))
    floor = F.min("_s").over(Window.partitionBy(*by))
    r = r.withColumn("score", F.coalesce("_s", floor - TAIL_STEP * (F.col("before") - n)))
    r = r.withColumn("final", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), id_col)))
    return r.withColumn("movement", F.col("before") - F.col("final")).drop("_s")


#: Where an excerpt may begin and end, strongest first: a paragraph, a line, a sentence, a word; and what of the mark stays.
EDGES = ((r"\n[ \t]*\n", ""), (r"\n", ""), (r"[.!?]", r"\s"), (r"\s", ""))


def excerpt(text: Column, at: Column, length: Column, window: int = 200) -> Column:
    """A span with up to ``window`` characters on either side, drawn in to the strongest boundary each side has.

    A side that reaches the end of the text stays whole, one without a boundary is cut
    where the window ends. White space around the excerpt is cut. Null for null.
    """
    lo = F.greatest(at - window, F.lit(0))
    before, body = F.substring(text, lo + 1, at - lo), F.substring(text, at + 1, length)
    after = F.substring(text, at + length + 1, F.lit(window))
    left, right = before, after
    for mark, follow in reversed(EDGES):
        left = F.when(before.rlike(mark + follow), F.regexp_replace(before, rf"(?s)^.*?{mark}{follow}\s*", "")).otherwise(left)
        kept = rf"(?s)^(.*{mark}){follow}.*$" if follow else rf"(?s)^(.*){mark}.*$"
        right = F.when(after.rlike(mark + follow), F.regexp_replace(after, kept, "$1")).otherwise(right)
    left = F.when(lo == 0, before).otherwise(left)
    right = F.when(at + length + window >= F.char_length(text), after).otherwise(right)
    return F.regexp_replace(F.concat(left, body, right), r"^\s+|\s+$", "")


def locator(source: Column, key: Column, ordinal: Column, start: Column, end: Column, version: Column) -> Column:
    """Where a citation points."""
    return F.concat(source, F.lit("::"), key, F.lit("#"), ordinal, F.lit(" @"), start, F.lit("-"), end, F.lit(" (v"), version, F.lit(")"))


def citation_state(chunk: Column, prefix: Column, parent: Column, start: Column, end: Column) -> Column:
    """Whether a chunk still says what its document says at its span."""
    body = F.substring(chunk, prefix + 1, F.char_length(chunk))
    return (
        F.when(parent.isNull(), "unverifiable")
        .when((start < 0) | (end > F.char_length(parent)) | (start > end), "span outside text")
        .when(body == F.substring(parent, start + 1, end - start), "holds")
        .when(F.char_length(body) != end - start, "length differs")
        .otherwise("text differs")
    )
