"""Filling containers of fixed capacity with items, hardly any room left over.

Sizes are whole tokens up to the capacity, so an instance of any number of items
is a histogram of at most ``capacity`` rows: it is counted on the cluster, solved
on the driver, and the solution, again bounded by the capacity and not by the
data, is applied to the items where they lie.

Solving: Martello and Toth's dominance reduction fixes, from the largest size
down, containers of up to three items that provably dominate every other way to
accompany that item; best fit in decreasing order packs what is left. Equal
containers are handled in one step with their count.
"""

from __future__ import annotations

import bisect
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tessera.session import cut

#: Items per salt when items of one size are numbered.
PER_SALT = 200_000


@dataclass
class Packing:
    """Groups of equal containers: (count, {size: items of it in each})."""

    capacity: int
    groups: list[tuple[int, dict[int, int]]] = field(default_factory=list)
    fixed: int = 0

    @property
    def containers(self) -> int:
        return sum(n for n, _ in self.groups)


def _companions(sizes: np.ndarray, counts: dict[int, int], w: int, room: int) -> tuple[int, ...] | None:
    """What must go with an item of size ``w``: a set that dominates all feasible ones, or None.

    ``sizes`` ascending, all with a count above 0. A set dominates another that
    can be divided among its members without any member being exceeded.
    """
    fit = sizes[: np.searchsorted(sizes, room, side="right")]
    if counts[w] == 1:
        fit = fit[fit != w]
    if not len(fit):
        return ()
    best = int(fit[-1])
    if best == room:
        return (best,)
    low = []
    for s in fit[:3]:
        low += [int(s)] * min(3, counts[int(s)] - (s == w))
    low = sorted(low)[:3]
    if len(low) < 2 or low[0] + low[1] > room:
        return (best,)
    if len(low) == 3 and sum(low) <= room:
        return None
    # at most two companions fit: the largest feasible sum, and the largest smaller half of a feasible pair
    partner = np.searchsorted(fit, np.minimum(fit, room - fit), side="right") - 1
    sums, halves = [], []
    for a, i in zip(fit.tolist(), partner.tolist()):
        if i >= 0 and int(fit[i]) == a and counts[a] - (a == w) < 2:
            i -= 1
        if i >= 0:
            sums.append(a + int(fit[i])), halves.append(int(fit[i]))
    if not sums or best >= max(sums):
        return (best,)
    i = int(np.searchsorted(fit, min(best, room - best), side="right")) - 1
    if i >= 0 and int(fit[i]) == best and counts[best] - (best == w) < 2:
        i -= 1
    if i >= 0 and int(fit[i]) >= max(halves):
        return (best, int(fit[i]))
    return None


def reduce_dominated(histogram: dict[int, int], capacity: int) -> tuple[Packing, dict[int, int]]:
    """The containers fixed by dominance, and the histogram of what is left.

    Sizes are tried from the largest; one without a dominating set stays in the
    instance and may still accompany smaller ones.
    """
    counts = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    if counts and max(counts) > capacity:
        raise ValueError("an item is larger than the capacity")
    out = Packing(capacity)
    sizes = sorted(counts)
    for w in reversed(sizes.copy()):
        while w in counts:
            more = _companions(np.array(sizes), counts, w, capacity - w)
            if more is None:
                break
            pattern = Counter((w, *more))
            n = min(counts[s] // q for s, q in pattern.items())
            out.groups.append((n, dict(pattern)))
            for s, q in pattern.items():
                counts[s] -= n * q
                if not counts[s]:
                    del counts[s]
                    sizes.pop(bisect.bisect_left(sizes, s))
    out.fixed = out.containers
    return out, counts


def best_fit(histogram: dict[int, int], out: Packing) -> Packing:
    """Adds the items to ``out`` in decreasing order, each to the fullest open container that takes it."""
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []

    def add(room: int, n: int, pattern: dict[int, int]) -> None:
        if n:
            if room not in open_:
                bisect.insort(rooms, room)
            open_.setdefault(room, []).append([n, pattern])

    for w in sorted(histogram, reverse=True):
        left = histogram[w]
        while left:
            i = bisect.bisect_left(rooms, w)
            if i == len(rooms):
                each = out.capacity // w
                add(out.capacity - each * w, left // each, {w: each})
                if left % each:
                    add(out.capacity - left % each * w, 1, {w: left % each})
                break
            room = rooms[i]
            group = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            n, pattern = group
            each = room // w
            whole = min(n, left // each)
            add(room - each * w, whole, {**pattern, w: pattern.get(w, 0) + each})
            left -= whole * each
            n -= whole
            if n and left and left < each:
                add(room - left * w, 1, {**pattern, w: pattern.get(w, 0) + left})
                n, left = n - 1, 0
            add(room, n, pattern)
    for room in rooms:
        out.groups += [(n, p) for n, p in open_[room]]
    return out


def solve(histogram: dict[int, int], capacity: int) -> Packing:
    """A packing of the items counted in ``histogram`` (size: count), none above ``capacity``."""
    out, kept = reduce_dominated(histogram, capacity)
    return best_fit(kept, out)


def _slots(packing: Packing) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size, by number of the item among its equals: first number, first container, items in each."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    at = 0
    for n, pattern in packing.groups:
        for s, q in pattern.items():
            found.setdefault(s, []).append((used[s], at, q))
            used[s] += n * q
        at += n
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for s, rows in found.items()}


def pack(sizes: DataFrame, containers: DataFrame, key: str = "doc_id") -> tuple[DataFrame, list[tuple]]:
    """Assignments and one summary tuple per container kind.

    ``sizes`` has ``key`` (unique) and ``tokens``; ``containers`` has
    ``container_kind`` and ``capacity_tokens`` and is small and fixed (checked).
    Assignments: container_kind, container_no (from 0), key, piece (from 0),
    token_start, tokens. An item above the capacity is cut into full containers
    and one rest, which is packed like any item; all others stay whole. Items of
    0 tokens go to container 0. Rows with null tokens or key are left out; so are
    kinds with a null or non-positive capacity. Without items there is no row.
    """
    spark = sizes.sparkSession
    kinds = [tuple(r) for r in containers.select("container_kind", F.col("capacity_tokens").cast("long")).dropna().where("capacity_tokens > 0").distinct().orderBy("container_kind", "capacity_tokens").limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError("containers are a small fixed table of at most 1000 kinds")
    sizes = cut(sizes.select(key, "tokens").dropna(), "sizes")
    choice = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(c).alias("capacity")) for i, (_, c) in enumerate(kinds)]) if kinds else None
    if choice is None:
        empty = sizes.where("false").select(F.lit("").alias("container_kind"), F.lit(0).cast("long").alias("container_no"), key, F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("token_start"), "tokens")
        return empty, []
    items = sizes.select(key, "tokens", F.explode(choice).alias("c")).select(
        key, "tokens", F.col("c.kind").alias("kind"), F.col("c.capacity").cast("long").alias("capacity")
    )
    full = F.when(F.col("tokens") <= F.col("capacity"), 0).otherwise(F.floor(F.col("tokens") / F.col("capacity")))
    items = items.withColumn("full", full.cast("long")).withColumn("size", F.col("tokens") - F.col("full") * F.col("capacity"))
    # at most capacity + 1 rows a kind, whatever the number of items
    histogram = items.groupBy("kind", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).collect()
    by_kind: dict[int, dict[int, int]] = {i: {} for i in range(len(kinds))}
    fulls: Counter = Counter()
    for r in histogram:
        by_kind[r.kind][r.size] = r.n
        fulls[r.kind] += r.full
    packings = {i: solve({s: n for s, n in h.items() if s > 0}, kinds[i][1]) for i, h in by_kind.items()}
    slots = {i: _slots(p) for i, p in packings.items()}
    base = {i: max(p.containers, int(by_kind[i].get(0, 0) > 0)) for i, p in packings.items()}

    total = max((sum(h.values()) for h in by_kind.values()), default=0)
    salts = total // PER_SALT + 1
    items = items.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)))

    def numbered(df: DataFrame, by: list[str], amount) -> DataFrame:
        """The sum of ``amount`` over the rows before each in its group ``by``; hot groups are counted by salt."""
        per = df.groupBy(*by, "salt").agg(F.sum(amount).alias("_n"))
        earlier = Window.partitionBy(*by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select(*by, "salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
        within = Window.partitionBy(*by, "salt").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("_before", F.coalesce(F.sum(amount).over(within), F.lit(0)))
        return df.join(per, [*by, "salt"]).withColumn("number", F.col("_before") + F.col("_offset"))

    @F.pandas_udf(T.LongType())
    def container(kind: pd.Series, size: pd.Series, number: pd.Series) -> pd.Series:
        k, s, n = kind.to_numpy(), size.to_numpy(), number.to_numpy()
        out = np.zeros(len(k), dtype=np.int64)
        order = np.lexsort((s, k))
        edges = np.flatnonzero(np.diff(k[order]) | np.diff(s[order])) + 1
        for rows in np.split(order, edges) if len(order) else []:
            if s[rows[0]] > 0:
                first, at, each = slots[int(k[rows[0]])][int(s[rows[0]])]
                j = np.searchsorted(first, n[rows], side="right") - 1
                out[rows] = at[j] + (n[rows] - first[j]) // each[j]
        return pd.Series(out)

    label = F.element_at(F.array(*[F.lit(k) for k, _ in kinds]), F.col("kind") + 1).alias("container_kind")
    whole = numbered(items.where("size > 0 OR tokens = 0"), ["kind", "size"], F.lit(1)).select(
        label, container("kind", "size", "number").alias("container_no"), key, F.col("full").alias("piece"),
        (F.col("full") * F.col("capacity")).alias("token_start"), F.col("size").alias("tokens"),
    )
    start = F.element_at(F.array(*[F.lit(base[i]).cast("long") for i in range(len(kinds))]), F.col("kind") + 1)
    over = numbered(items.where("full > 0"), ["kind"], F.col("full"))
    over = over.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1))).select(
        label, (start + F.col("number") + F.col("piece")).alias("container_no"), key, "piece",
        (F.col("piece") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("tokens"),
    )
    summary = []
    for i, (kind, capacity) in enumerate(kinds):
        tokens = sum(s * n for s, n in by_kind[i].items()) + fulls[i] * capacity
        used = base[i] + fulls[i]
        summary.append((kind, capacity, sum(by_kind[i].values()), tokens, used, fulls[i], packings[i].fixed, -(-tokens // capacity), tokens / (used * capacity) if used else None))
    return whole.unionByName(over), summary


SUMMARY = "container_kind string, capacity_tokens long, items long, tokens long, containers long, cut_full long, fixed_by_dominance long, lower_bound long, fill double"


def pack_report(sizes: DataFrame, containers: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per container kind: containers used, the least possible by volume, and how full they are."""
    _, summary = pack(sizes, containers, key)
    return sizes.sparkSession.createDataFrame(summary, SUMMARY)
