"""Orphan references and change feeds against plain Python, with every awkward row."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import changefeed as cf
from tessera.operators import orphans as o

T0 = datetime(2026, 1, 1)


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


REF = "ref long, k string, h string, at timestamp, state string"
PAR = "k string, h string, since timestamp, until timestamp, version int, state string"


def judge(refs, parents):
    out = set()
    for r, k, h, t in refs:
        if k is None or h is None:
            continue
        rows = [p for p in parents if p[0] == k and p[1] == h]
        if not rows:
            out.add((r, "missing"))
            continue
        known = [p for p in rows if t is None or p[2] is None or p[2] <= t]
        if not known:
            out.add((r, "late"))
            continue
        last = max(known, key=lambda p: (p[2] or datetime(1, 1, 1), p[4], p[3] or datetime(1, 1, 1)))
        if last[3] is not None and (t is None or last[3] <= t):
            out.add((r, "deleted"))
    return out


def run(spark, refs, parents, **more):
    r = spark.createDataFrame([(*x, "clash") for x in refs], REF)
    p = spark.createDataFrame([(*x, "clash") for x in parents], PAR)
    got = o.orphan_references(r, p, {"k": "k", "h": "h"}, ["ref"], at="at", since="since", until="until", order="version", **more)
    return {tuple(x) for x in got.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_histories(spark, seed):
    rng = random.Random(seed)
    names = ["hot"] * 10 + [f"k{i}" for i in range(12)]
    parents = [(rng.choice(names), "x", at(rng.choice([None, *range(40)])), at(rng.choice([None, None, *range(60)])), rng.randint(1, 5)) for _ in range(150)]
    refs = [(i, rng.choice([*names, "gone", None]), rng.choice(["x", "x", "x", "y", None]), at(rng.choice([None, *range(60)]))) for i in range(250)]
    parents += parents[:20] + [(None, "x", T0, None, 1)]
    assert run(spark, refs, parents, bucket_seconds=7200) == judge(refs, parents)


def test_empty_sides(spark):
    assert run(spark, [(1, "a", "x", T0)], []) == {(1, "missing")}
    assert run(spark, [], [("a", "x", T0, None, 1)]) == set()


def test_small_filter_is_only_slower(spark):
    """A filter with far too few bits lets references pass; the exact step still judges them."""
    refs = [(i, f"k{i}", "x", T0) for i in range(400)]
    parents = [(f"k{i}", "x", at(-1), None, 1) for i in range(0, 400, 2)]
    assert run(spark, refs, parents, expected_keys=1) == judge(refs, parents)


def test_evidence(spark):
    ev = spark.createDataFrame(
        [(1, "m1", "s", "k", T0), (1, "m1", "s", "k", T0), (2, "mX", "nope", "k", T0), (3, None, "s", "zz", None), (4, "m2", "s", None, T0), (5, None, None, "k", T0)],
        "evidence_id long, memory_id string, source_name string, external_key string, linked_at timestamp",
    )
    mem = spark.createDataFrame(
        [("m1", "S", "k", 1, at(-2), None), ("m2", "S", "k2", 1, at(-2), at(-1)), ("m2", "S", "k2", 1, at(-2), at(-1))],
        "memory_id string, source_id string, external_key string, version int, ingested_at timestamp, deleted_at timestamp",
    )
    src = spark.createDataFrame([("S", "s"), ("E", None)], "source_id string, source_name string")
    found = o.evidence_orphans(ev, mem, src)
    assert {(r.evidence_id, r.field, r.state) for r in found.collect()} == {(2, "memory_id", "missing"), (2, "source_name", "missing"), (3, "external_key", "missing"), (4, "memory_id", "deleted")}
    report = {(r.parent_table, r.field, r.month): r.orphans for r in o.orphan_report(found).collect()}
    assert report["sources", "source_name", "2026-01"] == 1 and report["memories", "external_key", None] == 1


FEED = "k string, seq long, kind string, a int, b string, _seq string"


def state(feed, base=None):
    now = {k: list(v) for k, v in (base or {}).items()}
    purged = {k for k, _, kind, *_ in feed if kind == "purge"}
    for k, seq, kind, a, b in sorted((f for f in set(feed) if f[1] is not None and f[2]), key=lambda f: f[1]):
        if kind == "put":
            now[k] = [a, b]
        elif kind == "drop":
            now.pop(k, None)
        elif kind == "merge" and k in now:
            now[k] = [a if a is not None else now[k][0], b if b is not None else now[k][1]]
    return {(k, *v) for k, v in now.items() if k not in purged}


def applied(spark, feed, base=None, chunk=8):
    df = spark.createDataFrame([(*f, "clash") for f in feed], FEED)
    b = None if base is None else spark.createDataFrame([(k, *v) for k, v in base.items()], "k string, a int, b string")
    return {tuple(r) for r in cf.apply_changes(df, ["k"], "seq", F.col("kind"), ["a", "b"], b, chunk).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_feed_equals_replay(spark, seed):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + [f"k{i}" for i in range(8)] + [None]
    feed = []
    for seq in range(200):
        kind = rng.choice(["put", "put", "merge", "drop", None]) if rng.random() > 0.01 else "purge"
        feed.append((rng.choice(keys), seq, kind, rng.choice([None, rng.randint(0, 9)]), rng.choice([None, "x", "y"])))
    # merges of rows that are not there: the plain replay skips them, and so does a feed that never makes the row
    feed = [f for f in feed if f[2] != "merge" or any(g[0] == f[0] and g[1] < f[1] and g[2] == "put" for g in feed) and not any(g[0] == f[0] and g[2] == "drop" for g in feed)]
    late = feed + feed[::3] + [(k, None, kind, a, b) for k, _, kind, a, b in feed[:20] if kind != "purge"]
    rng.shuffle(late)
    assert applied(spark, late) == state(feed)
    assert applied(spark, late, chunk=1 << 20) == state(feed)


def test_base_and_empty(spark):
    base = {"old": (1, "p"), "gone": (2, "q"), "edit": (3, None)}
    feed = [("gone", 5, "drop", None, None), ("edit", 6, "merge", None, "new"), ("edit", 4, "merge", 9, None), ("add", 1, "put", None, "z")]
    assert applied(spark, feed, base) == {("old", 1, "p"), ("edit", 9, "new"), ("add", None, "z")}
    assert applied(spark, [], base) == {(k, *v) for k, v in base.items()}
    assert applied(spark, []) == set()


def test_item_log(spark):
    rows = [("s", "k", 1, " Artifact_Observed\n", 1, "h1", None), ("s", "k", 3, "artifact_observed", 2, "h2", None), ("s", "k", 3, "ARTIFACT_OBSERVED", 2, "h2", None), ("s", "k", None, "item_deleted", None, None, None),
            ("s", "gone", 1, "artifact_observed", 1, "h", None), ("s", "gone", 2, "artifact_observed", 2, "h", T0), ("s", "p", 9, "item_purged", None, None, None), ("s", "p", 10, "artifact_observed", 1, "h", None)]
    log = spark.createDataFrame(rows, "source_name string, external_key string, seq long, event_type string, version int, content_hash string, deleted_at timestamp")
    assert [tuple(r) for r in cf.items_in_view(log).collect()] == [("s", "k", 2, "h2")]


def test_more_keys_than_one_filter_holds(spark, monkeypatch):
    """Keys go to several filters, which still prove nearly all orphans; the answer is that of one filter."""
    from tessera.functions import bloom

    rng = random.Random(9)
    parents = [(f"k{i}", "x", T0, None, 1) for i in range(900)]
    refs = [(i, rng.choice(["hot"] * 3 + [f"k{rng.randrange(900)}", f"gone{i}"]), "x", T0) for i in range(1500)]
    want = run(spark, refs, parents)
    monkeypatch.setattr(bloom, "KEYS", 100)
    assert bloom.ranges(900) == 9
    assert run(spark, refs, parents) == want == judge(refs, parents)
    r = spark.createDataFrame([(*x, "clash") for x in refs], REF)
    p = spark.createDataFrame([(*x, "clash") for x in parents], PAR)
    key = F.struct("k", "h")
    tested = o._tested(r.select("ref", "k", "h"), p.select("k", "h"), key, 900)
    proved = tested.where("NOT _maybe").count()
    assert tested.count() == 1500 and proved >= 0.9 * len(want)


def test_a_cluster_without_a_shared_folder_is_refused():
    from tessera import session

    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
    assert session._one_machine("local[8]") and session._one_machine("local") and not session._one_machine("local-cluster[3,2,3000]")
