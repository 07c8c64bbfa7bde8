"""Splitting oversized texts at natural boundaries, by pointer doubling.

Every boundary of a text (paragraph, line, sentence, word, and every place inside
runs without any) is joined to its farthest legal successor; squaring the
successor table until nothing new is reached gives all greedy cuts at once, hard
ones included. All texts of an Arrow batch share one table, so there is no loop over
pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.functions.normal import normal_form

LIMIT, OVERLAP = 2000, 200
#: A stronger boundary is preferred to a weaker one if the piece is at least this full.
FILL = 0.5
#: A composed normal form is at most three times shorter than the raw text is long: see prefilter.
GROWTH = 3
#: Code points per table: bounds the memory of a worker whatever the batch holds.
BATCH_CHARS = 2_000_000

# Characters that end a sentence, that may follow its end, and white space.
ENDERS = ".!?…。！？:;"
CLOSERS = "\"')]}»”’"
SPACES = "\t\n \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Full-width punctuation ends something without white space after it.
WIDE = "。！？、，；："
_SPACE, _NEWLINE, _ENDER, _CLOSER, _WIDE = 1, 2, 4, 8, 16
_CLASS = np.zeros(65536, dtype=np.uint8)
for _chars, _bit in ((SPACES, _SPACE), ("\n", _NEWLINE), (ENDERS, _ENDER), (CLOSERS + "」』）", _CLOSER), (WIDE, _WIDE)):
    for _c in _chars:
        _CLASS[ord(_c)] |= _bit


def _levels(c: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Cut positions per strength, strongest first; position p cuts between p-1 and p.

    White space belongs to the piece that it ends. A start of a text is no cut.
    """
    kind = _CLASS[np.minimum(c, 65535)]
    space = (kind & _SPACE) > 0
    ends = np.zeros(len(c), dtype=bool)
    ends[1:] = space[:-1] & ~space[1:]
    wide = (kind & _WIDE) > 0
    ends[1:] |= wide[:-1] & ((kind[1:] & (_SPACE | _WIDE | _CLOSER)) == 0)
    ends[starts[starts < len(c)]] = False
    p = np.flatnonzero(ends)
    shown = np.flatnonzero(~space)
    own = starts[np.searchsorted(starts, p, side="right") - 1]
    at = np.searchsorted(shown, p) - 1  # the last visible character before each cut
    last = np.where(at >= 0, shown[np.maximum(at, 0)], -1) if len(shown) else np.full(len(p), -1)
    p, last = p[last >= own], last[last >= own]
    breaks = np.concatenate([[0], np.cumsum((kind & _NEWLINE) > 0)])
    lines = breaks[p] - breaks[last]  # line ends in the white space before the cut
    ender = (kind & _ENDER) > 0
    closed = ((kind[last] & _CLOSER) > 0) & ender[np.maximum(last - 1, 0)]
    return [p[lines > 1], p[lines > 0], p[ender[last] | closed], p]


def cut_tables(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP, fill: float = FILL) -> list[np.ndarray]:
    """The cuts of each text: ascending positions from 0 to its length.

    Piece i is text[max(0, cut_i - overlap):cut_(i+1)], never longer than
    ``limit``. A text within the limit, or empty, has the one piece it is.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    if not len(texts) or not lengths.sum():
        return [np.array([0, n]) for n in lengths]
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    stops = np.cumsum(lengths)
    starts = stops - lengths
    bounds = _levels(c, starts)
    step = limit - overlap
    mark = np.zeros(len(c) + 1, dtype=bool)
    for positions in (starts, stops, bounds[3]):
        mark[positions] = True
    mark |= _inside(np.flatnonzero(mark), len(c), step)
    nodes = np.flatnonzero(mark)
    end = stops[np.searchsorted(stops, nodes, side="right").clip(max=len(stops) - 1)]
    opens = np.zeros(len(c) + 1, dtype=bool)
    opens[starts] = True
    first = opens[nodes]
    reach = nodes + np.where(first, limit, step)

    succ = np.full(len(nodes), -1, dtype=np.int64)
    final = (reach >= end) | (nodes >= end)
    succ[final] = np.searchsorted(nodes, end[final])
    for strength, positions in enumerate(bounds):
        todo = np.nonzero(succ < 0)[0]
        if not len(todo) or not len(positions):
            continue
        far = np.searchsorted(positions, reach[todo], side="right") - 1
        at = positions[np.maximum(far, 0)]
        least = nodes[todo] + (0 if strength == 3 else ((reach[todo] - nodes[todo]) * fill).astype(np.int64))
        ok = (far >= 0) & (at > nodes[todo]) & (at >= least)
        succ[todo[ok]] = np.searchsorted(nodes, at[ok])
    todo = np.nonzero(succ < 0)[0]
    succ[todo] = np.searchsorted(nodes, _whole(c, reach[todo]) if step > 64 else reach[todo])  # a hard cut at the limit

    reached = np.zeros(len(nodes), dtype=bool)
    front = np.searchsorted(nodes, starts)
    reached[front] = True
    jump = succ
    while True:  # after k rounds everything within 2**k - 1 cuts of a start is marked
        before = int(reached.sum())
        reached[jump[np.nonzero(reached)[0]]] = True
        if int(reached.sum()) == before:
            break
        jump = jump[jump]
    cuts = nodes[reached]
    out = []
    for a, b in zip(starts, stops):
        i, j = np.searchsorted(cuts, a), np.searchsorted(cuts, b)
        out.append(np.append(cuts[i:j], b) - a if b > a else np.array([0, 0]))
    return out


def _inside(nodes: np.ndarray, n: int, step: int) -> np.ndarray:
    """Marks every position inside a run without a boundary that is longer than a piece: a hard cut may fall on any."""
    gaps = np.flatnonzero(np.diff(nodes) > step)
    edge = np.zeros(n + 2, dtype=np.int8)
    edge[nodes[gaps] + 1] = 1
    edge[nodes[gaps + 1]] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def _whole(c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``at`` moved back, by less than 32, to the start of the character it would cut from its marks."""
    marks = ((c >= 0x300) & (c <= 0x36F)) | (c == 0x200D) | ((c >= 0xFE00) & (c <= 0xFE0F)) | ((c >= 0x1F3FB) & (c <= 0x1F3FF))
    starts = np.maximum.accumulate(np.where(marks, -1, np.arange(len(c))))[at]
    return np.where(starts > at - 32, starts, at)


def split_texts(
    df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, fill: float = FILL, pieces: bool = True
) -> DataFrame:
    """Pieces of every text that in normal form is longer than ``limit``: key, piece, start, end, content.

    Pieces are numbered from 0; ``start`` and ``end`` are code points of the
    normal form; every piece after the first opens with the last ``overlap``
    characters before its cut. Null and empty texts, and texts within the limit,
    give no row; repeated rows give one set of pieces. Texts too short to be over
    the limit in any normal form never leave the JVM. With ``pieces`` false only
    key, piece, start and end are returned.
    """
    kind = df.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
        + ([T.StructField("content", T.StringType())] if pieces else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                normal = normal_form(raw.as_py())
                if normal is not None and len(normal) > limit:
                    held.append((k, normal))
                    size += len(normal)
                if size > BATCH_CHARS:
                    yield _rows(held)
                    held, size = [], 0
            if held:
                yield _rows(held)

    def _rows(held: list[tuple]) -> pa.RecordBatch:
        keys, numbers, starts, ends, contents = [], [], [], [], []
        for (k, t), cuts in zip(held, cut_tables([t for _, t in held], limit, overlap, fill)):
            for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                a = max(0, a - overlap) if i else a
                keys.append(k), numbers.append(i), starts.append(a), ends.append(b)
                if pieces:
                    contents.append(t[a:b])
        arrays = [pa.array(keys, type=_arrow(kind)), pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
        if pieces:
            arrays.append(pa.array(contents, pa.string()))
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    long = df.select(key, text).where(F.char_length(text) * GROWTH > limit)
    long = long.dropDuplicates([key, text]) if pieces else long
    return long.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
