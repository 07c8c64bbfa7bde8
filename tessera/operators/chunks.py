"""Parsing texts into structure and chunks, and comparing versions line by line."""

from __future__ import annotations

import ast
import difflib
import itertools
import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.functions.normal import normal_form
from tessera.functions.text import sentences

#: Tokens: the window less the overlap of special tokens, the target, what is too small, and what is repeated.
MOST, TARGET, LEAST, OVERLAP = 496, 396, 79, 47
_TOKEN = re.compile(r"\w+|[^\w\s]")


def kind_of(key: str | Column) -> Column:
    """Kind of an item by its suffix."""
    suffix = F.lower(F.regexp_extract(key, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix.isin("md", "txt"), "note").when(suffix == "py", "code").when(suffix == "pdf", "document").otherwise("other")


_FRONT = re.compile(r"\A---[ \t]*\n(.*?)^(?:---|\.\.\.)[ \t]*(?:\n|\Z)", re.S | re.M)
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\Z")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def parse_markdown(text: str | None) -> dict | None:
    """Title (of the front matter, else the first heading of level 1), where the body begins, and the ATX headings
    outside fenced code: level, text, start (offset). Null stays null; a front matter that is not closed is text."""
    if text is None:
        return None
    front = _FRONT.match(text)
    body = front.end() if front else 0
    named = re.search(r"^title[ \t]*:[ \t]*(.+?)[ \t]*$", front[1], re.M) if front else None
    title = named[1].strip("\"'") if named else None
    found, fence, at = [], None, body
    for line in text[body:].splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        mark = _FENCE.match(bare)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not bare[mark.end() :].strip():
                fence = None
        elif mark:
            fence = mark[1]
        elif m := _ATX.match(bare):
            found.append({"level": len(m[1]), "text": (m[2] or "").strip(), "start": at})
        at += len(line)
    if title is None:
        title = next((h["text"] for h in found if h["level"] == 1), None)
    return {"title": title, "body": body, "headings": found}


_HEADING = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType())])
_MARKDOWN = T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.IntegerType()), T.StructField("headings", T.ArrayType(_HEADING))])


@F.pandas_udf(_MARKDOWN)
def markdown(texts: pd.Series) -> pd.DataFrame:
    """Column form of :func:`parse_markdown`."""
    empty = {"title": None, "body": None, "headings": None}
    return pd.DataFrame([parse_markdown(t) or empty for t in texts], columns=["title", "body", "headings"], dtype=object)


# Words that may stand before a definition, and words that open one.
MODIFIERS = ["export", "default", "declare", "public", "private", "protected", "static", "abstract", "final", "async", "pub", "unsafe", "extern"]
OPENERS = ["def", "class", "function", "fn", "func", "struct", "interface", "type", "impl", "enum", "trait"]
DEFINITION = rf"(?m)^(?:(?:{'|'.join(MODIFIERS)})[ \t]+)*(?:{'|'.join(OPENERS)})[ \t]+([A-Za-z_]\w*)"


def definitions(text: str | Column) -> Column:
    """Names defined at the outermost level, with any modifiers before them, in order."""
    return F.regexp_extract_all(text, F.lit(DEFINITION), F.lit(1))


def parse_python(text: str | None) -> list[dict] | None:
    """Functions and classes at the top of a Python text by its syntax tree: kind, name, start and end (lines from 1).

    A text that is no Python gives None, as a null does: the caller falls back on :func:`definitions`.
    """
    try:
        tree = None if text is None else ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    if tree is None:
        return None
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return [{"kind": kinds[type(n)], "name": n.name, "start": n.lineno, "end": n.end_lineno} for n in tree.body if type(n) in kinds]


_DEFINED = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_DEFINED)
def python_definitions(texts: pd.Series) -> pd.Series:
    """Column form of :func:`parse_python`."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return pd.Series([parse_python(t) for t in texts], dtype=object)


def _pieces(text: str, code: bool) -> list[tuple[int, int]]:
    """Spans that are kept together if they fit: sentences within paragraphs and headings, or blocks of code."""
    out: list[tuple[int, int]] = []
    for m in re.finditer(r"\S(?:.*?\S)??(?=\n\s*\n|\n#|\s*\Z)", text, re.S):
        if code:
            out.append(m.span())
        else:
            out += [(m.start() + a, m.start() + b) for a, b in sentences(m.group())]
    return out


def chunk_spans(text: str, code: bool = False) -> list[tuple[int, int, int, int]]:
    """(start, end, prefix start, tokens) of the chunks of a text in normal form.

    Pieces fill a chunk to the target; one above the maximum is cut at lines, then
    at tokens. A last chunk that is too small joins the one before if both fit. The
    prefix is the stretch before a chunk that is repeated in it, at most the
    overlap in tokens; offsets never include it.
    """
    marks = [m.span() for m in _TOKEN.finditer(text)]
    starts = [a for a, _ in marks]
    def tokens(a: int, b: int) -> int:
        return bisect_left(starts, b) - bisect_left(starts, a)

    units: list[tuple[int, int]] = []
    for a, b in _pieces(text, code):
        todo = [(a, b)] if tokens(a, b) <= MOST else [(a + m.start(), a + m.end()) for m in re.finditer(r"[^\n]+", text[a:b])]
        for c, e in todo:
            while tokens(c, e) > MOST:
                cut = marks[bisect_left(starts, c) + MOST - 1][1]
                units.append((c, cut))
                c = cut + len(text[cut:e]) - len(text[cut:e].lstrip())
            if c < e:
                units.append((c, e))
    spans: list[list[int]] = []
    for a, b in units:
        if spans and tokens(spans[-1][0], b) <= TARGET:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    if len(spans) > 1 and tokens(*spans[-1]) < LEAST and tokens(spans[-2][0], spans[-1][1]) <= MOST:
        spans[-2:] = [[spans[-2][0], spans[-1][1]]]
    out = []
    for i, (a, b) in enumerate(spans):
        prefix = a
        if i:
            room = min(OVERLAP, MOST - tokens(a, b))
            first = bisect_left(starts, a) - room
            prefix = max(spans[i - 1][0], starts[first] if room > 0 and first >= 0 else a)
        out.append((a, b, prefix, tokens(prefix, b)))
    return out


def chunk(docs: DataFrame, id_col: str, text: str, code: Column | None = None) -> DataFrame:
    """Chunks of every text: id, ordinal, content, char_start, char_end, prefix_chars, token_count.

    Offsets are of the normal form and content[prefix_chars:] equals the text there.
    Null, empty and blank texts have no chunk. One text at a time is held.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ordinal", T.IntegerType()), T.StructField("content", T.StringType())] + [T.StructField(n, T.IntegerType()) for n in ("char_start", "char_end", "prefix_chars", "token_count")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, raw, is_code in zip(f[id_col], f["_t"], f["_c"]):
                t = normal_form(raw)
                for i, (a, b, p, n) in enumerate(chunk_spans(t, bool(is_code)) if t else []):
                    rows.append((key, i, t[p:b], a, b, a - p, n))
            yield pd.DataFrame(rows, columns=schema.names)

    flag = F.coalesce(code, F.lit(False)) if code is not None else F.lit(False)
    return docs.select(id_col, F.col(text).alias("_t"), flag.alias("_c")).where("_t IS NOT NULL").mapInPandas(run, schema)


def diff_lines(old: str | None, new: str | None) -> tuple[int, int, int]:
    """Lines added, removed and kept between two texts; null is no line."""
    a, b = (old or "").splitlines(), (new or "").splitlines()
    kept = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    return len(b) - kept, len(a) - kept, kept


_DIFF = T.StructType([T.StructField(n, T.IntegerType()) for n in ("added", "removed", "kept")])


@F.pandas_udf(_DIFF)
def line_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([diff_lines(a, b) for a, b in zip(old, new)], columns=["added", "removed", "kept"])


_SPANS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("old_start", "old_end", "new_start", "new_end")]]))


def diff_spans(old: str | None, new: str | None) -> list[dict]:
    """What changed between two texts, whole lines at a time: op (replace, delete, insert) and the character spans
    on both sides; null is the empty text. Putting the new spans in place of the old ones gives the new text."""
    a, b = (old or "").splitlines(keepends=True), (new or "").splitlines(keepends=True)
    at, bt = ([0, *itertools.accumulate(map(len, x))] for x in (a, b))
    codes = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return [{"op": op, "old_start": at[i], "old_end": at[j], "new_start": bt[k], "new_end": bt[n]} for op, i, j, k, n in codes if op != "equal"]


@F.pandas_udf(_SPANS)
def line_spans(old: pd.Series, new: pd.Series) -> pd.Series:
    """Column form of :func:`diff_spans`."""
    return pd.Series([diff_spans(a, b) for a, b in zip(old, new)], dtype=object)


def _adjacent(versions: DataFrame, keys: list[str], version: str, text: str) -> DataFrame:
    v = versions.select(*keys, F.col(version).alias("version"), F.col(text).alias("_new")).dropDuplicates([*keys, "version"])
    before = v.select(*keys, (F.col("version") + 1).alias("version"), F.col("_new").alias("_old"))
    return v.join(before, [*keys, "version"])


def version_spans(versions: DataFrame, keys: list[str], version: str, text: str) -> DataFrame:
    """Every change of a version against the one before it: keys, version, op and spans."""
    return _adjacent(versions, keys, version, text).select(*keys, "version", F.explode(line_spans("_old", "_new")).alias("d")).select(*keys, "version", "d.*")


def version_diffs(versions: DataFrame, keys: list[str], version: str, text: str) -> DataFrame:
    """Every version against the one before it: keys, version, added, removed, kept. A join, so no item is held whole."""
    return _adjacent(versions, keys, version, text).select(*keys, "version", line_diff("_old", "_new").alias("d")).select(*keys, "version", "d.*")
