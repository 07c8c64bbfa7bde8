"""Mixing sources to target weights by Poisson replication.

Every document has a number in (0, 1) hashed from its id and a seed. Read through
the inverse of a Poisson distribution whose mean is its source's repetition rate,
that number says how often the document is used. The count rises with the mean,
so a source's mean is set where its tokens meet the target exactly up to one
document. Copies are then put in an order hashed from id and copy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.session import cut

#: Bins of the two searches for a mean; together they part means that differ by 1 in 10**6.
BINS = 4096
_LOW, _HIGH = -14.0, 6.0


def poisson_at_least(u: np.ndarray, k: int) -> np.ndarray:
    """The mean from which on the inverse Poisson distribution gives at least ``k`` at ``u``.

    That is the mean at which k - 1 or fewer has probability u: found by bisection.
    """
    low, high = np.full(len(u), 0.0), np.full(len(u), 60.0 + 2.0 * k)
    for _ in range(60):
        mean = (low + high) / 2
        term, below = np.exp(-mean), np.zeros(len(u))
        for i in range(k):
            below += term
            term = term * mean / (i + 1)
        rises = below > u
        low, high = np.where(rises, mean, low), np.where(rises, high, mean)
    return high


def _uniform(seed: int, key: str):
    """A number in (0, 1) from the id, the same on every run."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _histogram(rows: DataFrame, repeats: list[int], low: list[float], high: list[float]) -> dict[int, np.ndarray]:
    """Per source, tokens added by bin of the logarithm of the mean; the first bin also holds all below it."""
    least, most = np.array(low), np.array(high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(repeats), BINS + 2))
        for batch in batches:
            s = batch.column(0).to_numpy()
            tokens = batch.column(1).to_numpy().astype(float)
            u = batch.column(2).to_numpy()
            for k in range(1, max(repeats) + 1):
                use = np.flatnonzero(np.array(repeats)[s] >= k)
                if len(use):
                    x = np.log(np.maximum(poisson_at_least(u[use], k), 1e-300))
                    b = np.floor((x - least[s[use]]) / (most[s[use]] - least[s[use]]) * BINS).clip(-1, BINS).astype(int) + 1
                    np.add.at(held, (s[use], b), tokens[use])
        i, j = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(held[i, j])], names=["s", "b", "t"])

    out = {i: np.zeros(BINS + 2) for i in range(len(repeats))}
    for r in rows.mapInArrow(run, "s int, b int, t double").groupBy("s", "b").agg(F.sum("t").alias("t")).collect():
        out[r.s][r.b] = r.t
    return out


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 20240607) -> tuple[DataFrame, list[tuple]]:
    """The mixture and one report tuple per target source.

    ``sizes`` has ``key`` (unique), ``source`` and ``tokens``; ``targets`` has
    source, target_share, max_repeats and is small and fixed (checked). The whole
    is as large as it can be with every source at its share and no document used
    more than max_repeats times. A target source without tokens, or with a null or
    non-positive share or repeats, cannot take part; the shares of the others keep
    their proportions, and the report shows the source at 0. Documents of other or
    null sources, with null or 0 tokens or a null id are not used. Mixture: key,
    source, copy (from 0), tokens, position_key, in the order of position_key.
    """
    wanted = [tuple(r) for r in targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).dropna(subset=["source"]).distinct().orderBy("source").limit(10_001).collect()]
    if len(wanted) > 10_000 or len({w[0] for w in wanted}) < len(wanted):
        raise ValueError("targets are a small fixed table with one row per source")
    numbers = targets.sparkSession.createDataFrame([(w[0], i) for i, w in enumerate(wanted)], "source string, s int")
    # the list of names goes below the tokenizer, so other sources are not tokenized
    sizes = sizes.where(F.col("source").isin([w[0] for w in wanted]) & (F.col("tokens") > 0) & F.col(key).isNotNull()).join(numbers, "source")
    sizes = cut(sizes.select(key, "source", "s", F.col("tokens").cast("long").alias("tokens")), "mix")
    have = {r.s: (r.n, r.t) for r in sizes.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()}
    taking = [i for i, (_, share, m) in enumerate(wanted) if i in have and (share or 0) > 0 and (m or 0) > 0]
    mass = sum(wanted[i][1] for i in taking)
    share = {i: wanted[i][1] / mass for i in taking}
    total = min((have[i][1] * wanted[i][2] / share[i] for i in taking), default=0.0)
    goal = {i: share[i] * total for i in taking}
    repeats = [wanted[i][2] if i in share else 0 for i in range(len(wanted))]

    means = {i: 0.0 for i in range(len(wanted))}
    if taking:
        rows = sizes.select("s", "tokens", _uniform(seed, key).alias("u"))
        low, high = [_LOW] * len(wanted), [_HIGH] * len(wanted)
        for last in (False, True):
            found = _histogram(rows, repeats, low, high)
            for i in taking:
                sums = np.cumsum(found[i])
                if goal[i] >= sums[-1] * (1 - 1e-12):
                    means[i] = math.inf
                    continue
                b = int(np.searchsorted(sums, goal[i], side="right"))  # the bin in which the goal is met
                width = (high[i] - low[i]) / BINS
                if last:
                    under = sums[b - 1] if b else 0.0
                    b += int(sums[b] - goal[i] < goal[i] - under)
                    means[i] = math.exp(low[i] + (b - 1) * width)
                else:
                    low[i], high[i] = low[i] + (b - 1) * width, low[i] + b * width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = np.array([means[i] for i in range(len(wanted))])
        most = np.array(repeats)
        for batch in batches:
            s, u = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            copies = np.zeros(len(s), dtype=np.int32)
            for k in range(1, max(repeats, default=0) + 1):
                use = np.flatnonzero(most[s] >= k)
                copies[use] += poisson_at_least(u[use], k) < mean[s[use]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(copies)], names=[key, "source", "tokens", "copies"])

    kind = sizes.schema[key].dataType.simpleString()
    counted = sizes.select(key, "source", "s", "tokens", _uniform(seed, key).alias("u")).mapInArrow(
        count, f"`{key}` {kind}, source string, tokens long, copies int"
    )
    used = counted.where("copies > 0")
    mixture = used.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(
        key, "source", "copy", "tokens", F.xxhash64(F.lit(seed + 1), F.col(key), F.col("copy")).alias("position_key")
    )
    mixture = mixture.orderBy("position_key", key, "copy")
    sums = {r.source: r for r in used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.sum("copies").alias("c"), F.max("copies").alias("m")).collect()}
    whole = sum(r.t for r in sums.values())
    report = []
    for i, (source, target, most) in enumerate(wanted):
        r = sums.get(source)
        t = r.t if r else 0
        docs, tokens = have.get(i, (0, 0))
        report.append((source, target, share.get(i, 0.0), most, docs, tokens, t, t / whole if whole else 0.0, t / tokens if tokens else 0.0, r.m if r else 0))
    return mixture, report


REPORT = "source string, target_share double, reachable_share double, max_repeats int, documents long, tokens long, used_tokens long, actual_share double, mean_repeats double, most_repeats int"


def mix_report(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 20240607) -> DataFrame:
    """One row per target source: its target, the share reachable and the share really reached."""
    _, report = mix(sizes, targets, key, seed)
    return sizes.sparkSession.createDataFrame(report, REPORT)
