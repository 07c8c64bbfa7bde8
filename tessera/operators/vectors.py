"""Vector search: exact, by blocks, and by inverted lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.session import cut

#: Rows of a block of the exact search; both sides are cut into blocks of about this many.
BLOCK = 8192
_TOP = "query bigint, id bigint, score double"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _top_of_block(k: int):
    def run(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        ids, v = table.column("id").to_numpy(), _matrix(table.column("v"))
        q, x, qi, xi = v[ask], v[~ask], ids[ask], ids[~ask]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(0, len(q) if len(x) else 0, 512):
            s = q[i : i + 512] @ x.T
            n = min(k, s.shape[1])
            least = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
            r, c = np.nonzero(s >= least - 1e-12)  # ties with the last one stay until ids decide
            out.append((qi[i : i + 512][r], xi[c], s[r, c]))
        a, b, c = (np.concatenate(z) if out else np.zeros(0) for z in (zip(*out) if out else ([], [], [])))
        return pa.table({"query": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    return run


def _ranked(found: DataFrame, k: int, include_self: bool) -> DataFrame:
    """Best ``k`` per query by (rounded score, id): rounding makes the order independent of blocks."""
    f = found if include_self else found.where("query <> id")
    f = f.withColumn("score", F.round("score", 9)).distinct()
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return f.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_topk(queries: DataFrame, rows: DataFrame, k: int, id_col: str, vector: str, include_self: bool = False, live_filter=None) -> DataFrame:
    """R2, L1: for each query vector the ``k`` rows of the largest inner product: query, id, score, rank.

    Exact. Queries and rows are cut into blocks by a hash of their id and every
    pair of blocks is one matrix product, so neither side need fit anywhere.
    Vectors must have one length; null vectors, and vectors with a null, are left
    out. Ties go to the smaller id. Fewer than ``k`` rows give fewer results.
    """
    clean = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    q, r = clean(queries), clean(rows if live_filter is None else rows.where(live_filter))
    nq, nr = queries.count() // BLOCK + 1, rows.count() // BLOCK + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("id", "v", F.pmod(F.hash("id"), F.lit(nq)).alias("qb"), every(nr).alias("rb"), F.lit(True).alias("ask"))
    r = r.select("id", "v", every(nq).alias("qb"), F.pmod(F.hash("id"), F.lit(nr)).alias("rb"), F.lit(False).alias("ask"))
    tops = q.unionByName(r).groupBy("qb", "rb").applyInArrow(_top_of_block(k + 1), _TOP)
    return _ranked(tops, k, include_self)


def _pairs_of_blocks(floor: float, rows: int = 128):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ask = table.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        ids, v = table.column("id").to_numpy(), _matrix(table.column("v"))
        q, x, qi, xi = v[ask], v[~ask], ids[ask], ids[~ask]
        same = len(table) > 0 and table.column("qb")[0] == table.column("rb")[0]
        for i in range(0, len(q) if len(x) else 0, rows):  # a few rows at a time: where all are near, all are written
            s = q[i : i + rows] @ x.T
            r, c = np.nonzero(s >= floor - 1e-9)
            a, b, score = qi[i : i + rows][r], xi[c], s[r, c]
            keep = a < b if same else a != b
            ends = [pa.array(f(a[keep], b[keep]), pa.int64()) for f in (np.minimum, np.maximum)]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(score[keep], pa.float64())], names=["a", "b", "score"])

    return run


def _near_directions(rows: DataFrame, floor: float, id_col: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Pairs at or above the floor between numbers of vectors that differ (a, b, score), and the ids of every
    vector (rep: its number, id, first: its smallest id, score: of the vector with itself)."""
    clean = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    clean = cut(clean.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())), "vectors")
    reps = cut(clean.groupBy("v").agg(F.min("id").alias("first")).withColumn("rep", F.monotonically_increasing_id()), "reps")
    own = F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 9)
    held = cut(clean.join(reps, "v").select("rep", "id", "first", own.alias("score")).distinct(), "held")
    n = reps.count() // BLOCK + 1
    block, num = F.pmod(F.hash("rep"), F.lit(n)), F.col("rep").alias("id")
    asks = reps.select(num, "v", block.alias("qb"), F.explode(F.sequence(block, F.lit(n - 1))).alias("rb"), F.lit(True).alias("ask"))
    holds = reps.select(num, "v", F.explode(F.sequence(F.lit(0), block)).alias("qb"), block.alias("rb"), F.lit(False).alias("ask"))
    found = asks.unionByName(holds).groupBy("qb", "rb").applyInArrow(_pairs_of_blocks(floor), "a bigint, b bigint, score double")
    return cut(found.withColumn("score", F.round("score", 9)).where(F.col("score") >= floor), "near"), held


def near_pairs(rows: DataFrame, floor: float, id_col: str, vector: str) -> DataFrame:
    """Every pair of ids whose inner product, rounded to 9 places, is at least ``floor``: a < b, score.

    Exact and without a limit of partners. Rows are cut into blocks by a hash of
    their id and every pair of blocks is one matrix product. Equal vectors are one
    while comparing; afterwards all their ids take part, so the result is as large
    as the pairs are many. Null vectors, and vectors with a null, are left out.
    """
    found, held = _near_directions(rows, floor, id_col, vector)
    x, y = held.select(F.col("rep").alias("a"), F.col("id").alias("x")), held.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    wide = found.join(x, "a").join(y, "b").select("x", "y", "score")
    ids = held.where(F.col("score") >= floor)
    same = ids.select("rep", "score", F.col("id").alias("x")).join(ids.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y", "score")
    return wide.unionByName(same).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score").distinct()


def near_links(rows: DataFrame, floor: float, id_col: str, vector: str) -> DataFrame:
    """Links (a, b) that connect the same ids as :func:`near_pairs`, without its pairs among equal vectors."""
    found, held = _near_directions(rows, floor, id_col, vector)
    near = found.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    one, two = (held.where("id = first").select(F.col("rep").alias(x), F.col("id").alias(f"id_{x}")) for x in "ab")
    across = found.join(one, "a").join(two, "b").select("id_a", "id_b")
    # ids of one vector are linked by each other if it is near itself, else by any vector that is near it
    within = held.where(F.col("score") >= floor).select("first", "id").unionByName(held.join(near, "rep", "left_semi").select("first", "id"))
    return across.union(within).toDF("a", "b").where("a <> b").distinct()


def centroids(rows: DataFrame, id_col: str, vector: str, lists: int, sample: int = 20_000, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of the inverted lists, by spherical k-means on a sample of at most ``sample`` rows drawn by hash."""
    drawn = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(sample)
    x = np.array([r[0] for r in drawn.select(F.col(vector).cast("array<double>")).collect()], dtype=np.float64)
    if not len(x):
        return np.zeros((1, 1))
    c = x[:lists].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def _assigned(df: DataFrame, id_col: str, vector: str, c: np.ndarray, probes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _matrix(pa.chunked_array([b.column(1)])) @ c.T if b.num_rows else np.zeros((0, len(c)))
            best = np.argsort(-s, axis=1, kind="stable")[:, :probes]
            at = np.repeat(np.arange(b.num_rows), best.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(best.ravel())], names=["id", "v", "list"])

    clean = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    return clean.mapInArrow(run, "id bigint, v array<double>, list bigint")


def list_count(n: int) -> int:
    """Lists for ``n`` rows: the root of their number, at least 8, so that centres and lists grow alike."""
    return max(8, math.isqrt(n))


def file_lists(rows: DataFrame, id_col: str, vector: str, lists: int | None = None) -> tuple[np.ndarray, DataFrame]:
    """The inverted lists: their centres, and every row filed under its nearest one, written in a folder per list.

    A search reads only the folders of the lists it looks into, so one filing serves any number of searches.
    """
    c = centroids(rows, id_col, vector, lists or list_count(rows.count()))
    return c, cut(_assigned(rows, id_col, vector, c, 1), "lists", by=["list"])


def ivf_topk(queries: DataFrame, rows: DataFrame, k: int, id_col: str, vector: str, lists: int | None = None, share: float = 0.25, part_rows: int = 50_000, filed: tuple[np.ndarray, DataFrame] | None = None) -> DataFrame:
    """Approximate search. Every row is filed under its nearest centre; a query looks into ``share`` of the lists.

    A list of more than ``part_rows`` rows is searched in parts. ``filed``: lists made before by :func:`file_lists`.
    """
    c, held = filed or file_lists(rows, id_col, vector, lists)
    sizes = {r["list"]: r.n for r in held.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.element_at(F.create_map(*[x for j in range(len(c)) for x in (F.lit(j).cast("bigint"), F.lit(sizes.get(j, 0) // part_rows + 1))]), F.col("list"))
    r = held.select("id", "v", "list", F.pmod(F.hash("id"), parts).alias("part"), F.lit(False).alias("ask"))
    q = _assigned(queries, id_col, vector, c, math.ceil(share * len(c)))
    met = [x["list"] for x in q.select("list").distinct().collect()]  # at most as many as there are lists
    q = q.select("id", "v", "list", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("ask"))
    tops = q.unionByName(r.where(F.col("list").isin(met))).groupBy("list", "part").applyInArrow(_top_of_block(k + 1), _TOP)
    return _ranked(tops, k, False)


def recall(found: DataFrame, true: DataFrame, k: int) -> DataFrame:
    """Share of the true neighbours found, by query and overall: queries, recall, worst."""
    hits = true.select("query", "id").join(found.select("query", "id"), ["query", "id"]).groupBy("query").agg(F.count(F.lit(1)).alias("h"))
    per = true.groupBy("query").agg(F.count(F.lit(1)).alias("n")).join(hits, "query", "left").select((F.coalesce("h", F.lit(0)) / F.col("n")).alias("r"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("r"), 6).alias("recall"), F.min("r").alias("worst"))


def not_unit(df: DataFrame, vector: str, tolerance: float = 1e-3) -> DataFrame:
    """Rows whose vector has not length 1, which an inner-product search must refuse."""
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.where(F.abs(norm - 1) >= tolerance)
