import random
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm import packing as p


def counted(packing):
    used = Counter()
    for n, pattern in packing.groups:
        assert n > 0 and sum(s * q for s, q in pattern.items()) <= packing.capacity
        for s, q in pattern.items():
            used[s] += n * q
    return used


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=25), st.integers(60, 100))
def test_every_item_is_packed_once(histogram, capacity):
    assert counted(p.solve(histogram, capacity)) == Counter(histogram)


def optimum(items, capacity):
    """Fewest containers, by search over all placements."""
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in {bins[k]: k for k in range(len(bins))}.values():
            if bins[j] + items[i] <= capacity:
                place(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


def test_fixed_sets_cost_nothing():
    """With the containers fixed by dominance the rest can still be packed in the fewest containers."""
    rng = random.Random(2)
    for _ in range(150):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        fixed, rest = p.reduce_dominated(dict(Counter(items)), 20)
        left = sorted(Counter(rest).elements(), reverse=True)
        assert fixed.containers + optimum(left, 20) == optimum(items, 20), items


def test_too_large_is_an_error():
    with pytest.raises(ValueError):
        p.solve({11: 1}, 10)


def frames(spark, sizes, kinds=(("s", 10), ("l", 25))):
    return (
        spark.createDataFrame([(i, t, "x") for i, t in sizes], "doc_id long, tokens long, kind string"),
        spark.createDataFrame(list(kinds), "container_kind string, capacity_tokens int"),
    )


def test_assignment(spark, monkeypatch):
    monkeypatch.setattr(p, "PER_SALT", 50)
    rng = random.Random(5)
    sizes = [(i, 7 if i % 3 == 0 else rng.randint(0, 60)) for i in range(500)]
    out, summary = p.pack(*frames(spark, sizes))
    rows = out.collect()
    for kind, capacity in (("s", 10), ("l", 25)):
        mine = [r for r in rows if r.container_kind == kind]
        fill, pieces = Counter(), {}
        for r in mine:
            fill[r.container_no] += r.tokens
            pieces.setdefault(r.doc_id, []).append((r.piece, r.token_start, r.tokens))
        assert max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
        for i, t in sizes:
            got = sorted(pieces[i])
            assert sum(x[2] for x in got) == t and [x[0] for x in got] == list(range(len(got)))
            assert [x[1] for x in got] == [sum(y[2] for y in got[:j]) for j in range(len(got))]
            assert len(got) == 1 or t > capacity
        s = next(x for x in summary if x[0] == kind)
        assert s[4] == len(fill) and s[7] <= s[4] <= s[7] * 1.1 + 2


def test_edges(spark):
    out, summary = p.pack(*frames(spark, [(1, 0), (2, None), (None, 3), (3, 10), (4, 20)], [("s", 10), ("bad", 0), (None, 5)]))
    rows = {(r.doc_id, r.piece): r.container_no for r in out.collect()}
    assert set(rows) == {(1, 0), (3, 0), (4, 0), (4, 1)} and rows[1, 0] == 0 and len({rows[3, 0], rows[4, 0], rows[4, 1]}) == 3
    out, summary = p.pack(*frames(spark, []))
    assert out.count() == 0 and [s[4] for s in summary] == [0, 0]
    sizes, kinds = frames(spark, [(1, 1)])
    assert p.pack(sizes, kinds.where("false"))[0].count() == 0
