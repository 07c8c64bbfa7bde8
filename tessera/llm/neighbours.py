"""Most similar vectors for every vector, by cross-polytope hashing.

Unit vectors are padded to a power of two and turned by fast Hadamard
pseudo-rotations (three rounds of random signs and the transform). In each table
a vector is filed under the signed axis nearest to its turned form; with several
``levels`` under one axis of each of as many rotations. A query looks into the
cells that come next to its own over all tables (multiprobe), and what it finds
there is compared exactly.

Hashing is the same at every size: tables, levels and probes are parameters and
never follow the data, so the cells a query looks into do not change when the
collection grows, and its true neighbours only move nearer. What follows the data is
the layout alone: cells are gathered into parts of bounded size, a cell above that
size is cut by id on the side that is filed and by id on the side that asks, and
every piece meets every other, so no candidate is dropped and no task is unbounded.
:func:`exact_nearest` is the way without hashing.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.functions import bloom
from tessera.session import cut


@dataclass(frozen=True)
class Hashing:
    """Parameters. More ``tables`` and ``probes`` find more and compare more; a level more makes cells as many
    times smaller as there are signed axes."""

    dim: int = 48
    tables: int = 8
    levels: int = 1
    #: Cells a query looks into, over all tables.
    probes: int = 48
    seed: int = 7
    #: Layout only, nothing is lost by it: vectors filed in a task at most, and vectors asking in it at most.
    part_rows: int = 262_144
    ask_rows: int = 1_048_576

    @property
    def width(self) -> int:
        return 1 << (self.dim - 1).bit_length()

    @property
    def span(self) -> int:
        """Signed axes of one rotation."""
        return 2 * self.width

    @property
    def below(self) -> int:
        """Cells under one axis of the first level."""
        return self.span ** (self.levels - 1)


#: For the nearest of any likeness: one level, wide probing.
KNN = Hashing()
#: Near-identical directions share their nearest axes, so two levels and few probes do.
NEAR = Hashing(tables=6, levels=2, probes=48)
#: Turned coordinates above this (in units of their spread) cost a probe nothing.
FREE = 3.84


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


@functools.lru_cache(maxsize=256)
def _rotation(h: Hashing, table: int, level: int) -> np.ndarray:
    rng = np.random.default_rng([h.seed, table, level])
    x = np.eye(h.dim, h.width, dtype=np.float32)
    for _ in range(3):
        x = _hadamard(x * rng.choice(np.array([-1, 1], dtype=np.float32), h.width)) / np.float32(np.sqrt(h.width))
    return x


def rotate(v: np.ndarray, h: Hashing, table: int, level: int) -> np.ndarray:
    """Pseudo-rotation number (table, level) of the rows of ``v``: the three rounds are put through the fast
    transform once, and what they come to is one product for all rows."""
    return v @ _rotation(h, table, level)


def _cheapest(cost: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` cheapest of each row, cheapest first."""
    if n < cost.shape[1]:
        top = np.argpartition(cost, n - 1, axis=1)[:, :n]
        cost, code = np.take_along_axis(cost, top, 1), np.take_along_axis(code, top, 1)
    by = np.argsort(cost, axis=1)
    return np.take_along_axis(cost, by, 1), np.take_along_axis(code, by, 1)


def cells(v: np.ndarray, h: Hashing) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``filed`` (row, table) -> cell, and ``row``, ``table``, ``cell`` of every probe.

    A probe costs the sum over the levels of the squared lack of its coordinate;
    the cheapest over all tables are taken. Of two sorted lists only places i and j
    with i * j <= probes (from 1) can be among the cheapest sums.
    """
    n, filed, costs, codes = len(v), [], [], []
    free = np.float32(FREE / np.sqrt(h.width))
    for t in range(h.tables):
        own, cost, code = np.zeros(n, dtype=np.int64), None, None
        for level in range(h.levels):
            y = rotate(v, h, t, level)
            size = np.abs(y)
            axis = np.arange(h.width) + h.width * (y < 0)
            own = own * h.span + np.take_along_axis(axis, size.argmax(axis=1)[:, None], 1)[:, 0]
            lack, axis = _cheapest(np.square(np.maximum(0, free - size)), axis, h.probes)
            if cost is None:
                cost, code = lack, axis
                continue
            i, j = np.divmod(np.arange(cost.shape[1] * lack.shape[1]), lack.shape[1])
            near = np.flatnonzero((i + 1) * (j + 1) <= h.probes)
            i, j = i[near], j[near]
            cost, at = _cheapest(cost[:, i] + lack[:, j], np.broadcast_to(np.arange(len(near)), (n, len(near))), h.probes)
            code = np.take_along_axis(code, i[at], 1) * h.span + np.take_along_axis(axis, j[at], 1)
        filed.append(own), costs.append(cost), codes.append(code)
    table = np.repeat(np.arange(h.tables), [c.shape[1] for c in costs])
    cost, code = np.concatenate(costs, axis=1), np.concatenate(codes, axis=1)
    p = min(h.probes, cost.shape[1])
    top = np.argpartition(cost, p - 1, axis=1)[:, :p]
    return np.stack(filed, axis=1), np.repeat(np.arange(n), p), table[top].ravel(), np.take_along_axis(code, top, 1).ravel()


def _floats(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column of ``dim`` 4-byte floats or 2-byte fixed-point numbers."""
    if not len(column):
        return np.zeros((0, dim), dtype=np.float32)
    raw = b"".join(column.to_pylist())
    if len(raw) == 4 * dim * len(column):
        return np.frombuffer(raw, dtype=np.float32).reshape(-1, dim)
    return np.frombuffer(raw, dtype="<i2").reshape(-1, dim).astype(np.float32) / np.float32(32767)


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of the given numbers of elements from one flat array."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def unit_vectors(df: DataFrame, key: str, vector: str, dim: int = 48) -> DataFrame:
    """``id`` and ``unit``, the direction as ``dim`` 4-byte floats, of every usable vector.

    Not usable: a null id, a null vector, one of another length, all zero, or
    holding a null, NaN or infinity. Directions are rounded to six decimals, which
    moves a cosine by less than 1e-5 and makes equal directions equal bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            fits = np.equal(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), -1)), dim)
            use = pa.array(fits & ~np.asarray(ids.is_null()))
            ids, lists = ids.filter(use), lists.filter(use)
            x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
            with np.errstate(all="ignore"):
                scaled = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
                unit = np.round(scaled / np.linalg.norm(scaled, axis=1, keepdims=True), 6) + 0.0
            ok = np.isfinite(unit).all(axis=1) & np.isfinite(x).all(axis=1) if len(x) else np.zeros(0, dtype=bool)
            raw = unit[ok].astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [ids.filter(pa.array(ok)), pa.array([r.tobytes() for r in raw], pa.binary())], names=["id", "unit"]
            )

    found = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return found.mapInArrow(run, "id bigint, unit binary")


@dataclass
class Collection:
    """Distinct directions (rep, unit, asks: whether one of its ids is asked for), the ids of those that several
    ids share (rep, id), and the number of directions."""

    reps: DataFrame
    copies: DataFrame
    n: int


def _asked(id_col: str, every: int) -> Column:
    return F.col(id_col) % every == 0


def collect_directions(units: DataFrame, every: int = 1) -> Collection:
    """Ids of one direction stand behind the smallest of them; a repeated id counts once.

    An id has one vector; should it come with several, each is searched.
    """
    groups = units.groupBy("unit").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.max(_asked("id", every)).alias("asks"))
    groups = cut(groups, "directions")
    n = groups.count()
    shared = groups.where("last > rep").select("unit", "rep")
    likely = units.where(bloom.might_contain(bloom.build(shared, F.col("unit"), n), F.col("unit")))
    copies = cut(likely.join(shared, "unit").select("rep", "id").distinct(), "copies")
    return Collection(groups.select("rep", "unit", "asks"), copies, n)


@dataclass
class _Layout:
    """Where the cells of each first-level axis (table * span + axis) are: their first part, into how many parts
    they are cut by id, and of each part its first task and into how many its askers are cut."""

    part: np.ndarray
    pieces: np.ndarray
    task: np.ndarray
    slices: np.ndarray
    tasks: int


def _mix(ids: np.ndarray, salt: int) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(2)).astype(np.int64)


#: Vectors hashed at once by a worker.
CHUNK = 2048


def _layout(c: Collection, h: Hashing) -> _Layout:
    """Counted on the cluster; what comes back has tables times signed axes rows, whatever the data. A collection
    that is below both bounds as a whole needs no count: its layout is the same for any."""
    files = np.zeros(h.tables * h.span, dtype=np.int64)
    looks = files.copy()
    if c.n <= min(h.part_rows, h.ask_rows):
        return lay_out(files, looks, c.n, h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed_in = np.zeros(h.tables * h.span, dtype=np.int64)
        looked_in = filed_in.copy()
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                some = batch.slice(i, CHUNK)
                asks = np.asarray(some.column(1))
                filed, row, table, code = cells(_floats(some.column(0), h.dim), h)
                filed_in += np.bincount((np.arange(h.tables) * h.span + filed // h.below).ravel(), minlength=len(filed_in))
                use = asks[row]
                met = np.unique(row[use] * len(filed_in) + table[use] * h.span + code[use] // h.below)
                looked_in += np.bincount(met % len(filed_in), minlength=len(filed_in))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(filed_in))), pa.array(filed_in), pa.array(looked_in)], names=["cell", "files", "looks"])

    counted = c.reps.select("unit", "asks").mapInArrow(run, "cell bigint, files bigint, looks bigint")
    counted = counted.groupBy("cell").agg(F.sum("files").alias("files"), F.sum("looks").alias("looks"))
    for r in counted.collect():
        files[r.cell], looks[r.cell] = r.files, r.looks
    return lay_out(files, looks, c.n, h)


def lay_out(files: np.ndarray, looks: np.ndarray, n: int, h: Hashing) -> _Layout:
    """Cells of a table go, largest first, to the part with the fewest filed; a cell above ``part_rows`` is cut."""
    part, pieces = np.zeros(len(files), dtype=np.int64), np.ones(len(files), dtype=np.int64)
    asking: list[int] = []
    for t in range(h.tables):
        mine = np.arange(t * h.span, (t + 1) * h.span)
        large = mine[files[mine] > h.part_rows]
        small = mine[files[mine] <= h.part_rows]
        held = np.zeros(max(1, -(-int(files[small].sum()) // h.part_rows)), dtype=np.int64)
        asked = np.zeros(len(held), dtype=np.int64)
        for cell in small[np.argsort(-files[small], kind="stable")]:
            p = int(held.argmin())
            part[cell] = len(asking) + p
            held[p] += files[cell]
            asked[p] += looks[cell]
        asking += np.minimum(asked, n).tolist()
        for cell in large:
            part[cell], pieces[cell] = len(asking), -(-int(files[cell]) // h.part_rows)
            asking += [int(looks[cell])] * int(pieces[cell])
    slices = np.maximum(1, -(-np.array(asking, dtype=np.int64) // h.ask_rows))
    task = np.cumsum(slices) - slices
    return _Layout(part, pieces, task, slices, int(slices.sum()))


def _spread(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _sent(reps: np.ndarray, asks: np.ndarray, v: np.ndarray, h: Hashing, lay: _Layout) -> tuple[np.ndarray, ...]:
    """(row, task, cell it is filed in there or -1, number of cells it asks there, those cells one after the other)."""
    filed, row, table, code = cells(v, h)
    use = asks[row]
    row, table, code = row[use], table[use], code[use]

    at = (np.arange(h.tables) * h.span + filed // h.below).ravel()
    own = np.repeat(np.arange(len(v)), h.tables)
    part = lay.part[at] + _mix(reps[own], 1) % lay.pieces[at]
    copies = lay.slices[part]
    fkey = np.repeat(own * lay.tasks + lay.task[part], copies) + _spread(copies)
    fcode = np.repeat(filed.ravel(), copies)

    at = table * h.span + code // h.below
    copies = lay.pieces[at]
    part = np.repeat(lay.part[at], copies) + _spread(copies)
    row, code = np.repeat(row, copies), np.repeat(code, copies)
    akey = row * lay.tasks + lay.task[part] + _mix(reps[row], 2) % lay.slices[part]
    order = np.argsort(akey, kind="stable")
    groups, sizes = np.unique(akey, return_counts=True)

    key = np.union1d(fkey, groups)
    cell, n = np.full(len(key), -1, dtype=np.int32), np.zeros(len(key), dtype=np.int64)
    cell[np.searchsorted(key, fkey)] = fcode
    n[np.searchsorted(key, groups)] = sizes
    return key // lay.tasks, key % lay.tasks, cell, n, code[order].astype(np.int32)


_TASKS = "task int, role tinyint, rep bigint, cell int, asks binary, unit binary"


def _placed(c: Collection, h: Hashing) -> DataFrame:
    """Every vector once for each task that it is filed or looked for in, one task a partition, the filed first.

    Between machines a direction has 2-byte numbers, which moves a cosine by about 1e-5.
    """
    lay = _layout(c, h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                some = batch.slice(i, CHUNK)
                reps, v = some.column(0).to_numpy(), _floats(some.column(1), h.dim)
                row, task, cell, n, asked = _sent(reps, np.asarray(some.column(2)), v, h, lay)
                units = np.rint(v * 32767).astype("<i2")[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(task.astype(np.int32)), pa.array((cell < 0).astype(np.int8)), pa.array(reps[row]), pa.array(cell), _binary(asked, n), _binary(units, np.full(len(row), h.dim))],
                    names=["task", "role", "rep", "cell", "asks", "unit"],
                )

    sent = c.reps.select("rep", "unit", "asks").mapInArrow(run, _TASKS)
    return sent.repartitionById(lay.tasks, "task").sortWithinPartitions("task", "role")


#: Scores held at once by a worker, and askers held at once.
BLOCK, ASKERS = 1_000_000, 65_536


class _Filed:
    """The vectors filed in a task, by cell."""

    def __init__(self, reps: np.ndarray, code: np.ndarray, v: np.ndarray):
        order = np.argsort(code, kind="stable")
        self.reps, self.v = reps[order], v[order]
        self.codes, self.starts = np.unique(code[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.by_rep = np.argsort(self.reps, kind="stable")

    def scores(self, reps: np.ndarray, v: np.ndarray, n: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
        """(rows asking, first and last place of a cell, cosines) in blocks; a vector has -2 with itself."""
        if not len(self.reps) or not len(asked):
            return
        row = np.repeat(np.arange(len(reps)), n)
        at = np.searchsorted(self.codes, asked).clip(max=len(self.codes) - 1)
        there = self.codes[at] == asked
        row, at = row[there], at[there]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        sorted_reps = self.reps[self.by_rep]
        near = np.searchsorted(sorted_reps, reps).clip(max=len(sorted_reps) - 1)
        own = np.where(sorted_reps[near] == reps, self.by_rep[near], -1)
        firsts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, dtype=int)
        for i, j in zip(firsts.tolist(), np.append(firsts[1:], len(at)).tolist()):
            a, b = int(self.starts[at[i]]), int(self.ends[at[i]])
            x = self.v[a:b].T
            step = max(1, BLOCK // (b - a))
            for s in range(i, j, step):
                rows = row[s : min(j, s + step)]
                cos = v[rows] @ x
                mine = own[rows]
                self_in = np.flatnonzero((mine >= a) & (mine < b))
                cos[self_in, mine[self_in] - a] = -2
                yield rows, a, b, cos


def _per_task(dim: int, answer: Callable[[_Filed, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]):
    """Runs ``answer`` (filed, reps, vectors, numbers of cells asked, cells) over blocks of a task's askers.

    The filed, which are bounded, come first and are held; askers stream past them.
    """

    def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lists = table.column("asks").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        n = np.asarray(pa.compute.binary_length(lists)).astype(np.int64) // 4
        asked = np.frombuffer(b"".join(lists.to_pylist()), dtype=np.int32)
        units = table.column("unit").combine_chunks()
        units = units.chunk(0) if isinstance(units, pa.ChunkedArray) else units
        return table.column("rep").to_numpy(), _floats(units, dim), n, asked

    def blocks(batches: list[pa.RecordBatch]) -> Iterator[pa.Table]:
        table = pa.Table.from_batches(batches)
        table = table.filter(pa.compute.greater(pa.compute.binary_length(table.column("asks")), 0))
        for i in range(0, len(table), ASKERS):
            yield table.slice(i, ASKERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: list[pa.RecordBatch] = []
        asks: list[pa.RecordBatch] = []
        index: _Filed | None = None

        def indexed() -> Iterator[pa.RecordBatch]:
            nonlocal index
            table = pa.Table.from_batches(files)
            reps, v, _, _ = unpack(table)
            index = _Filed(reps, table.column("cell").to_numpy(), v)
            for block in blocks(files):
                yield from answer(index, *unpack(block))
            files.clear()

        for batch in batches:
            filed = np.asarray(batch.column(1)) == 0
            if filed.any():
                files.append(batch.filter(pa.array(filed)))
            if not filed.all():
                if index is None and files:
                    yield from indexed()
                asks.append(batch.filter(pa.array(~filed)))
                if index is not None and sum(map(len, asks)) >= ASKERS:
                    for block in blocks(asks):
                        yield from answer(index, *unpack(block))
                    asks.clear()
        if index is None and files:
            yield from indexed()
        if index is not None and asks:
            for block in blocks(asks):
                yield from answer(index, *unpack(block))

    return run


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest values of each row (all, if there are no more)."""
    n = s.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), s.shape).copy()
    if n > 64 * k:  # the k largest lie in the k stripes with the largest maxima
        width = n // 32
        head = s[:, : 32 * width].reshape(len(s), 32, width).max(axis=1)
        stripes = np.argpartition(-head, k - 1, axis=1)[:, :k]
        cols = (stripes[:, :, None] + np.arange(32) * width).reshape(len(s), -1)
        cols = np.concatenate([cols, np.broadcast_to(np.arange(32 * width, n), (len(s), n - 32 * width))], axis=1)
        some = np.take_along_axis(s, cols, 1)
        return np.take_along_axis(cols, np.argpartition(-some, k - 1, axis=1)[:, :k], 1)
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


_FOUND = T.StructType([T.StructField("rep", T.LongType()), T.StructField("found", T.BinaryType())])
_PAIR = np.dtype([("id", "<i8"), ("cos", "<f4")])


def _merge_top(k: int):
    """Best ``k`` of the lists of each rep; rows come sorted by rep, which may run over batches."""

    def best(reps: list[int], lists: list[bytes]) -> pa.RecordBatch:
        pairs = np.frombuffer(b"".join(lists), dtype=_PAIR)
        rep = np.repeat(np.array(reps, dtype=np.int64), [len(x) // _PAIR.itemsize for x in lists])
        order = np.lexsort((pairs["id"], rep))
        rep, pairs = rep[order], pairs[order]
        first = np.ones(len(rep), dtype=bool)
        first[1:] = (rep[1:] != rep[:-1]) | (pairs["id"][1:] != pairs["id"][:-1])
        rep, pairs = rep[first], pairs[first]
        order = np.lexsort((pairs["id"], -pairs["cos"], rep))
        rep, pairs = rep[order], pairs[order]
        starts = np.flatnonzero(np.concatenate([[True], rep[1:] != rep[:-1]])) if len(rep) else np.zeros(0, dtype=int)
        rank = np.arange(len(rep)) - np.repeat(starts, np.diff(np.append(starts, len(rep))))
        keep = rank < k
        return pa.RecordBatch.from_arrays(
            [pa.array(rep[keep]), pa.array(np.ascontiguousarray(pairs["id"][keep])), pa.array(np.ascontiguousarray(pairs["cos"][keep]))],
            names=["rep", "near", "cosine"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps: list[int] = []
        lists: list[bytes] = []
        for batch in batches:
            reps += batch.column(0).to_pylist()
            lists += batch.column(1).to_pylist()
            i = len(reps)
            while i and reps[i - 1] == reps[-1]:
                i -= 1
            if i:
                yield best(reps[:i], lists[:i])
                reps, lists = reps[i:], lists[i:]
        if reps:
            yield best(reps, lists)

    return run


def _improve(best: np.ndarray, who: np.ndarray, rows: np.ndarray, i: np.ndarray, cos: np.ndarray, ids: np.ndarray) -> None:
    """Brings found (place in ``rows``, cosine, id), in order of place, into the lists of their rows."""
    k = best.shape[1]
    some, start, count = np.unique(i, return_index=True, return_counts=True)
    wide = np.full((len(some), k + int(count.max())), -2, dtype=np.float32)
    names = np.full(wide.shape, -1, dtype=np.int64)
    wide[:, :k], names[:, :k] = best[rows[some]], who[rows[some]]
    r = np.repeat(np.arange(len(some)), count)
    c = k + np.arange(len(i)) - np.repeat(start, count)
    wide[r, c], names[r, c] = cos, ids
    top = np.argpartition(-wide, k - 1, axis=1)[:, :k]
    best[rows[some]], who[rows[some]] = np.take_along_axis(wide, top, 1), np.take_along_axis(names, top, 1)


def _top_of_task(k: int):
    """The ``k`` best of each asker over all cells it asks for in the task."""

    def answer(filed: _Filed, reps: np.ndarray, v: np.ndarray, n: np.ndarray, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
        best = np.full((len(reps), k), -2, dtype=np.float32)
        who = np.full((len(reps), k), -1, dtype=np.int64)
        for rows, a, _, cos in filed.scores(reps, v, n, asked):
            least = best[rows].min(axis=1)
            fresh = least <= -2  # not yet k found: take the best of the cell
            if fresh.any():
                first = rows[fresh]
                cols = _best(cos[fresh], k)
                both = np.concatenate([best[first], np.take_along_axis(cos[fresh], cols, 1)], axis=1)
                names = np.concatenate([who[first], filed.reps[a + cols]], axis=1)
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                best[first], who[first] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
                least = np.where(fresh, 2, least)
            at = np.flatnonzero((cos > least[:, None]).ravel())  # few: what is nearer than the last one so far
            if len(at):
                _improve(best, who, rows, at // cos.shape[1], cos.ravel()[at], filed.reps[a + at % cos.shape[1]])
        pairs = np.zeros(best.shape, dtype=_PAIR)
        pairs["id"], pairs["cos"] = who, best
        real = best > -2
        some = real.any(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(reps[some]), _binary(pairs[real], real.sum(axis=1)[some])], names=["rep", "found"])

    return answer


def _nearest_reps(placed: DataFrame, dim: int, k: int) -> DataFrame:
    tops = placed.mapInArrow(_per_task(dim, _top_of_task(k)), _FOUND)
    return tops.repartition("rep").sortWithinPartitions("rep").mapInArrow(_merge_top(k), "rep bigint, near bigint, cosine float")


def _with_copies(near: DataFrame, c: Collection, k: int, every: int = 1) -> DataFrame:
    """From directions to ids: the ``k`` nearest other ids of every asked id, ties by id; only k + 1 ids of a direction can matter."""
    by_id = Window.partitionBy("rep").orderBy("id")
    few = c.copies.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).select("rep", "id")
    other = near.join(few.select(F.col("rep").alias("near"), "id"), "near", "left")
    other = other.select("rep", F.coalesce("id", "near").alias("id_b"), F.col("cosine").cast("double").alias("cosine"))
    own = few.select("rep", F.col("id").alias("id_b"), F.lit(1.0).alias("cosine"))
    best = Window.partitionBy("rep").orderBy(F.desc("cosine"), "id_b")
    listed = other.unionByName(own).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    met = listed.join(c.copies, "rep", "left").select(F.coalesce("id", "rep").alias("id_a"), "id_b", "cosine").where("id_a <> id_b")
    rank = Window.partitionBy("id_a").orderBy(F.desc("cosine"), "id_b")
    return met.where(_asked("id_a", every)).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("id_a", "rank", "id_b", "cosine")


def nearest(units: DataFrame, k: int = 10, hashing: Hashing = KNN, every: int = 1) -> DataFrame:
    """id_a, rank (from 1), id_b, cosine (within 1e-4): for every id the ``k`` nearest others found, ties by id.

    ``units`` comes from :func:`unit_vectors`. Asked are the ids divisible by
    ``every``, searched are all. A direction whose cells held fewer than ``k`` others
    is asked again by the exact route, so an id has fewer than ``k`` rows only if
    there are no more ids. An empty or one-row collection gives no row.
    """
    c = collect_directions(units, every)
    near = cut(_nearest_reps(_placed(c, hashing), hashing.dim, k), "nearest")
    most = min(k, c.n - 1)
    asking = c.reps.where("asks").select("rep", "unit")
    full = near.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most)
    short = cut(asking.join(full, "rep", "left_anti"), "short") if most > 0 else asking.limit(0)
    if lacking := short.count():
        again = _exact_reps(c, short, lacking, hashing.dim, k)
        near = near.join(short, "rep", "left_anti").unionByName(again)
    return _with_copies(near, c, k, every)


#: Rows of a block of the exact route.
EXACT_BLOCK = 65_536


def _exact_reps(c: Collection, asking: DataFrame, asks: int, dim: int, k: int, block: int = EXACT_BLOCK) -> DataFrame:
    """rep, near, cosine of ``asking`` (rep, unit) against all: each pair of blocks is one task with one cell."""
    a, b = max(1, -(-asks // block)), max(1, -(-c.n // block))
    own, other = F.pmod(F.xxhash64("rep"), F.lit(a)), F.pmod(F.hash("rep"), F.lit(b))
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    row = lambda at, role, cell, cells: (at.cast("int").alias("task"), F.lit(role).cast("tinyint").alias("role"), "rep", F.lit(cell).alias("cell"), F.lit(cells).alias("asks"), "unit")
    filed = c.reps.withColumn("x", all_of(a)).select(*row(F.col("x") * b + other, 0, 0, b""))
    asked = asking.withColumn("x", all_of(b)).select(*row(own * b + F.col("x"), 1, -1, bytes(4)))
    placed = filed.unionByName(asked).repartitionById(a * b, "task").sortWithinPartitions("task", "role")
    return _nearest_reps(placed, dim, k)


def exact_nearest(units: DataFrame, k: int = 10, every: int = 1, dim: int = 48, block: int = EXACT_BLOCK) -> DataFrame:
    """What :func:`nearest` approaches: blocks of those asked against blocks of all, each pair of blocks one task.

    Exact at any size; work and what is sent grow with the square of the collection.
    """
    c = collect_directions(units, every)
    asking = c.reps.where("asks").select("rep", "unit")
    return _with_copies(_exact_reps(c, asking, asking.count(), dim, k, block), c, k, every)


def recall(units: DataFrame, k: int = 10, hashing: Hashing = KNN, every: int = 50) -> DataFrame:
    """Loss against brute force over the final ids: one row. Asked is every id divisible by ``every``, copies included.

    queries, k, recall (share of the true neighbours found; an id as near as the
    last true one counts, by 1e-4), cosine_loss (mean of true minus found cosine by
    rank), worst_loss.
    """
    found = cut(nearest(units, k, hashing, every), "found")
    true = cut(exact_nearest(units, k, every, hashing.dim), "true")
    last = true.groupBy("id_a").agg(F.min("cosine").alias("least"), F.count(F.lit(1)).alias("n"), F.sum("cosine").alias("sum"))
    got = found.join(last.select("id_a", "least"), "id_a").groupBy("id_a").agg(
        F.count_if(F.col("cosine") >= F.col("least") - 1e-4).alias("hits"), F.sum("cosine").alias("got")
    )
    per = last.join(got, "id_a", "left")
    loss = (F.col("sum") - F.coalesce("got", F.lit(0.0))) / F.col("n")
    return per.agg(
        F.count(F.lit(1)).alias("queries"),
        F.lit(k).alias("k"),
        (F.sum(F.least(F.coalesce("hits", F.lit(0)), "n")) / F.sum("n")).alias("recall"),
        F.avg(loss).alias("cosine_loss"),
        F.max(loss).alias("worst_loss"),
    )


def near_directions(units: DataFrame, least: float, hashing: Hashing = NEAR) -> tuple[DataFrame, DataFrame]:
    """Pairs of directions (a < b, cosine) whose cosine is at least ``least``, and membership (rep, id) of the ids
    that share a direction; a direction is named by its smallest id. Copies are not paired out.

    Candidates come from the shared cells; the cosine of each is then worked out in double precision.
    """
    c = collect_directions(units)
    dim = hashing.dim

    def answer(filed: _Filed, reps: np.ndarray, v: np.ndarray, n: np.ndarray, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
        lows, highs = [], []
        for rows, a, _, cos in filed.scores(reps, v, n, asked):
            i, j = np.nonzero(cos >= least - 2e-4)
            if len(i):
                x, y = reps[rows[i]], filed.reps[a + j]
                lows.append(np.minimum(x, y)), highs.append(np.maximum(x, y))
            if sum(map(len, lows)) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lows)), pa.array(np.concatenate(highs))], names=["a", "b"])
                lows, highs = [], []
        if lows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lows)), pa.array(np.concatenate(highs))], names=["a", "b"])

    @F.pandas_udf(T.DoubleType())
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        u, v = (np.frombuffer(b"".join(z), dtype=np.float32).reshape(-1, dim).astype(np.float64) for z in (x, y))
        return pd.Series((u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1)))

    likely = _placed(c, hashing).mapInArrow(_per_task(dim, answer), "a bigint, b bigint")
    likely = cut(likely.distinct(), "likely")
    ends = likely.select(F.explode(F.array("a", "b")).alias("rep"))
    named = bloom.build(ends, F.col("rep"), 2 * likely.count())
    few = c.reps.where(bloom.might_contain(named, F.col("rep")))
    pairs = likely.join(few.select(F.col("rep").alias("a"), F.col("unit").alias("u")), "a")
    pairs = pairs.join(few.select(F.col("rep").alias("b"), F.col("unit").alias("v")), "b")
    return pairs.select("a", "b", cosine("u", "v").alias("cosine")).where(F.col("cosine") >= least), c.copies


def near_pairs(units: DataFrame, least: float, hashing: Hashing = NEAR) -> DataFrame:
    """id_a < id_b, cosine: pairs of ids whose cosine is at least ``least``.

    :func:`near_directions` with its membership written out: every pair of ids of one
    direction is a pair, so m copies of one vector give m * (m - 1) / 2 rows.
    """
    pairs, copies = near_directions(units, least, hashing)
    one, two = (copies.select(F.col("rep").alias(x), F.col("id").alias(f"id_{x}")) for x in "ab")
    wide = pairs.join(one, "a", "left").join(two, "b", "left").select(
        F.coalesce("id_a", "a").alias("x"), F.coalesce("id_b", "b").alias("y"), "cosine"
    )
    left, right = copies.select("rep", F.col("id").alias("x")), copies.select("rep", F.col("id").alias("y"))
    same = left.join(right, "rep").where("x < y").select("x", "y", F.lit(1.0).alias("cosine"))
    return wide.unionByName(same).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "cosine").where("id_a < id_b")


def collection(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """Ids and vectors of the candidates and of all matched chunks (one id space)."""
    chunks = hits.select(F.explode("matched_chunks").alias("c")).select(F.col("c.chunk_id").alias("id"), F.col("c.vector").alias("vector"))
    return candidates.select(F.col("candidate_id").alias("id"), "vector").unionByName(chunks)
