import math
import random

import numpy as np

from tessera.llm import mixing as m


def test_inverse_poisson():
    u = np.array([0.01, 0.3, 0.5, 0.9, 0.999])
    for k in (1, 2, 5):
        means = m.poisson_at_least(u, k)
        below = [sum(math.exp(-x) * x**i / math.factorial(i) for i in range(k)) for x in means]
        assert np.allclose(below, u, atol=1e-9)
    assert (m.poisson_at_least(u, 2) > m.poisson_at_least(u, 1)).all()


def frames(spark, docs, targets):
    return (
        spark.createDataFrame([(i, s, t, 7) for i, s, t in docs], "doc_id long, source string, tokens long, copy int"),
        spark.createDataFrame(targets, "source string, target_share double, max_repeats int"),
    )


def test_shares_and_caps(spark):
    rng = random.Random(1)
    docs = [(i, "big", rng.randint(1, 200)) for i in range(3000)] + [(10_000 + i, "small", rng.randint(1, 200)) for i in range(300)]
    docs += [(20_000 + i, "other", 50) for i in range(50)]
    mixture, report = m.mix(*frames(spark, docs, [("big", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 3)]))
    rows = mixture.collect()
    size = {"big": 0, "small": 0}
    tokens = {i: t for i, _, t in docs}
    for r in rows:
        size[r.source] += r.tokens
        assert r.tokens == tokens[r.doc_id] and 0 <= r.copy < (1 if r.source == "big" else 4)
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    whole = sum(size.values())
    assert abs(size["big"] / whole - 2 / 3) < 0.002 and abs(size["small"] / whole - 1 / 3) < 0.002
    by = {r[0]: r for r in report}
    assert by["absent"][7] == 0.0 and abs(by["big"][7] - size["big"] / whole) < 1e-12 and by["big"][2] > by["big"][1]
    keys = [r.position_key for r in rows]
    assert keys == sorted(keys) and [r.doc_id for r in rows[:300]] != sorted(r.doc_id for r in rows[:300])
    again = m.mix(*frames(spark, docs[::-1], [("big", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 3)]))[0].collect()
    assert again == rows


def test_edges(spark):
    targets = [("a", 1.0, 2), ("none", 0.0, 2), ("null", None, None)]
    mixture, report = m.mix(*frames(spark, [(1, "a", 5), (2, "a", None), (3, None, 5), (None, "a", 5), (4, "a", 0), (5, "none", 9)], targets))
    assert [(r.doc_id, r.copy) for r in mixture.orderBy("copy").collect()] == [(1, 0), (1, 1)]
    mixture, report = m.mix(*frames(spark, [], targets))
    assert mixture.count() == 0 and all(r[7] == 0 for r in report)
    mixture, report = m.mix(frames(spark, [(1, "a", 5)], targets)[0], frames(spark, [], targets)[1].where("false"))
    assert mixture.count() == 0 and report == []
