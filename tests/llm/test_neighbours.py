from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tessera.llm import neighbours as nb

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("unit", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "other") for i, v in rows], ROW)


def points(n, dim=48, groups=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.9
    x[n // 2 :: 7] = x[: len(x[n // 2 :: 7])] + rng.normal(size=(len(x[n // 2 :: 7]), dim)) * 0.05
    return x


def brute(x, ids, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    a, b = np.nonzero(np.triu(s >= least, 1))
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(a, b)}, s


def test_rotation_keeps_lengths_and_angles():
    x = points(50).astype(np.float32)
    y = nb.rotate(x, nb.KNN, 3, 1)
    assert np.allclose(x @ x.T, y @ y.T, rtol=1e-3, atol=1e-2)


def test_near_pairs_equal_brute_force(spark):
    x = points(700)
    ids = list(range(10, 710))
    want, _ = brute(x, ids, 0.95)
    got = {(r.id_a, r.id_b) for r in nb.near_pairs(nb.unit_vectors(frame(spark, zip(ids, x.tolist())), "id", "vector"), 0.95).collect()}
    assert want and got == want


def test_recall_and_exact_cosines(spark):
    x = points(3000, seed=2)
    rows = nb.nearest(nb.unit_vectors(frame(spark, enumerate(x.tolist())), "id", "vector"), 10).collect()
    _, s = brute(x, list(range(len(x))), 2)
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1)[:, :10]
    hit = sum(r.id_b in true[r.id_a] for r in rows)
    assert hit / true.size >= 0.9
    assert all(abs(r.cosine - s[r.id_a, r.id_b]) < 1e-4 for r in rows[:500])
    one = nb.recall(nb.unit_vectors(frame(spark, enumerate(x.tolist())), "id", "vector"), 10).first()
    assert one.queries == 60 and one.recall >= 0.9


@pytest.mark.parametrize("n", [2_000, 16_384])
def test_recall_of_the_same_hashing_at_any_size(n):
    """What a query's cells hold of its true neighbours; the hashing does not know the size."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(n, 48)) * np.linspace(1.6, 0.4, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    filed, row, table, code = nb.cells(x, nb.KNN)
    assert filed.shape == (n, nb.KNN.tables) and len(row) == n * nb.KNN.probes
    asked = np.zeros((200, nb.KNN.tables, nb.KNN.span), dtype=bool)
    use = row < 200
    asked[row[use], table[use], code[use]] = True
    found = 0
    for i in range(200):
        s = x @ x[i]
        s[i] = -2
        true = np.argpartition(-s, 10)[:10]
        found += asked[i][np.arange(nb.KNN.tables), filed[true]].any(axis=1).sum()
    assert found / 2000 >= 0.9


def test_probes_of_two_levels_are_the_cheapest():
    h = nb.Hashing(tables=2, levels=2, probes=20)
    x = points(40).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    filed, row, table, code = nb.cells(x, h)
    for i in range(len(x)):
        cost = []
        for t in range(2):
            lack = [np.square(np.maximum(0, nb.FREE / 8 - np.abs(nb.rotate(x[i : i + 1], h, t, k)[0]))) for k in range(2)]
            cost.append((lack[0][:, None] + lack[1][None, :]).ravel())
        best = np.sort(np.concatenate(cost))[:20]
        axes = [(c // h.span % h.width, c % h.span % h.width) for c in code[row == i]]
        got = sorted(cost[t][a * h.width + b] for t, (a, b) in zip(table[row == i], axes))
        assert np.allclose(got, best, atol=1e-5)
        assert {(t, c) for t, c in enumerate(filed[i])} & set(zip(table[row == i].tolist(), code[row == i].tolist()))


def test_layout_changes_nothing(spark):
    """A cell with two thirds of all rows is cut for those filed and those asking; every result stays."""
    rng = np.random.default_rng(4)
    tight = rng.normal(size=48) + rng.normal(size=(600, 48)) * 0.01
    x = np.concatenate([tight, points(300)])
    units = nb.unit_vectors(frame(spark, enumerate(x.tolist())), "id", "vector").cache()
    small = {"part_rows": 70, "ask_rows": 90}
    want, _ = brute(x, list(range(len(x))), 0.95)
    for h in (nb.NEAR, replace(nb.NEAR, **small)):
        assert {(r.id_a, r.id_b) for r in nb.near_pairs(units, 0.95, h).collect()} == want
    a, b = ({(r.id_a, r["rank"]): r.cosine for r in nb.nearest(units, 5, h).collect()} for h in (nb.KNN, replace(nb.KNN, **small)))
    assert a.keys() == b.keys() and len(a) == 5 * len(x)
    assert all(abs(a[k] - b[k]) < 1e-5 for k in a)  # equal but for the rounding of sums


def test_layout_bounds_every_task():
    h = replace(nb.KNN, tables=2, part_rows=100, ask_rows=50)
    files = np.zeros(2 * h.span, dtype=np.int64)
    files[:5], files[h.span : h.span + 3] = [950, 60, 60, 40, 20], [400, 400, 330]
    lay = nb.lay_out(files, np.minimum(files * 2, 1130), 1130, h)
    assert lay.pieces[0] == 10 and lay.pieces[1] == 1 and lay.tasks == lay.slices.sum()
    small = {p: files[[c for c in range(1, 5) if lay.part[c] == p]].sum() for p in set(lay.part[1:5])}
    assert max(small.values()) <= 120 and sum(small.values()) == 180


def test_exact_route_equals_brute_force(spark):
    x = points(400, seed=5)
    units = nb.unit_vectors(frame(spark, enumerate(x.tolist())), "id", "vector")
    rows = nb.exact_nearest(units, 4, every=3, block=90).collect()
    _, s = brute(x, list(range(400)), 2)
    np.fill_diagonal(s, -2)
    assert {r.id_a for r in rows} == set(range(0, 400, 3)) and len(rows) == 4 * 134
    assert all(abs(r.cosine - np.sort(s[r.id_a])[-r["rank"]]) < 1e-5 for r in rows)


def test_directions_and_membership(spark):
    a, b = [1.0] + [0.0] * 47, [1.0, 0.2] + [0.0] * 46
    units = nb.unit_vectors(frame(spark, [(i, a) for i in range(1, 30)] + [(50, b), (51, b)]), "id", "vector")
    pairs, members = nb.near_directions(units, 0.95)
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 50)]
    assert {(r.rep, r.id) for r in members.collect()} == {(1, i) for i in range(1, 30)} | {(50, 50), (50, 51)}


def test_unusable_vectors_copies_and_repeats(spark):
    a = [1.0] + [0.0] * 47
    b = [2.0] + [0.0] * 47
    bad = [None, [0.0] * 48, [float("nan")] + [1.0] * 47, [float("inf")] + [1.0] * 47, [1.0] * 32, [], [None] + [1.0] * 47]
    rows = [(1, a), (2, b), (2, b), (3, a), (None, a), (4, [0.0, 1.0] + [0.0] * 46)] + [(10 + i, v) for i, v in enumerate(bad)]
    units = nb.unit_vectors(frame(spark, rows), "id", "vector")
    assert {(r.id_a, r.id_b) for r in nb.near_pairs(units, 0.95).collect()} == {(1, 2), (1, 3), (2, 3)}
    near = {(r.id_a, r["rank"]): r.id_b for r in nb.nearest(units, 2).collect()}
    assert near[1, 1] == 2 and near[1, 2] == 3 and near[2, 1] == 1 and near[3, 2] == 2 and near[4, 1] == 1


@pytest.mark.parametrize("rows", [[], [(1, [1.0] * 48)]])
def test_empty_and_single(spark, rows):
    units = nb.unit_vectors(frame(spark, rows), "id", "vector")
    assert nb.near_pairs(units, 0.95).count() == 0
    assert nb.nearest(units, 10).count() == 0


def test_collection_counts_each_id_once(spark):
    c = spark.createDataFrame([(1, [1.0] * 48), (1, [1.0] * 48)], "candidate_id long, vector array<float>")
    h = spark.createDataFrame([([(7, 0, 0.5, [1.0] * 48)],), ([(7, 0, 0.4, [1.0] * 48)],), ([],), (None,)], "matched_chunks array<struct<chunk_id: long, ordinal: int, score: double, vector: array<float>>>")
    units = nb.unit_vectors(nb.collection(c, h), "id", "vector")
    assert {(r.id_a, r.id_b) for r in nb.near_pairs(units, 0.95).select("id_a", "id_b").collect()} == {(1, 7)}
    assert units.where(F.col("id").isNull()).count() == 0
