"""Operators on small hand-made tables, with numbers worked out by hand."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scores as sc
from tessera.functions import text as tx
from tessera.functions.analysis import parse_search
from tessera.functions.stemming import stem
from tessera.operators import (
    chunks, context, entities, evaluate, evidence, graph, ordered, ports, relational as rel, retrieval as r, selection as sel, surfacing, temporal as t, vectors, versions,
)
from tessera.sources import files, log
from tessera.streaming import folds

D = datetime(2026, 1, 1)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def rows(df, *columns):
    return sorted(tuple(x) for x in df.select(*columns or df.columns).collect())


# ---- time ----


def test_calendar_and_spine(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 15), "a"), (datetime(2026, 3, 1), "b"), (None, "c")], "at timestamp, kind string")
    got = rows(t.activity_by_period(df, "at", "month", "kind"))
    assert got == [(datetime(2026, 1, 1), "a", 1), (datetime(2026, 2, 1), None, 0), (datetime(2026, 3, 1), "b", 1)]
    assert t.activity_by_period(df, "at", "month", "kind", "2026-02-01", "2026-02-01").count() == 0
    assert t.activity_by_period(df.where("false"), "at", "week", "kind").count() == 0
    with pytest.raises(ValueError):
        t.truncate("hour", "at")


def test_previous_and_sessions_cross_buckets(spark):
    times = [0, 29, 59, 60, 24 * 60 + 200, 24 * 60 + 230, 3 * 24 * 60]
    df = spark.createDataFrame([(None if i == 3 else 1, i, D + timedelta(minutes=m)) for i, m in enumerate(times)] + [(1, 99, None)], "u int, id int, at timestamp")
    got = {x.id: x.session for x in t.sessionize(df, ["u"], "at", "id").collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 1, 4: 3, 5: 4, 6: 5}
    p = {x.id: x.previous for x in ordered.with_previous(df, ["u"], "at", "id").collect()}
    assert p[0] is None and p[4] == D + timedelta(minutes=59) and p[6] == D + timedelta(minutes=24 * 60 + 230)
    assert rows(t.find_gaps(df, ["u"], "at", "id", 30 * 60), "gap_us")[0] == (30 * 60 * 1_000_000,)


def test_as_of_reads_the_row_that_stood(spark):
    v = spark.createDataFrame(
        [("k", 1, D, None, "x"), ("k", 2, D + timedelta(days=2), D + timedelta(days=3), "x"), ("k", 2, D + timedelta(days=2), D + timedelta(days=3), "x"), ("n", 1, None, None, "x")],
        "k string, version int, ingested_at timestamp, deleted_at timestamp, extra string",
    )
    at = lambda day: [x.version for x in t.as_of(v, ["k"], str(D + timedelta(days=day))).collect()]
    assert (at(-1), at(1), at(2), at(4)) == ([], [1], [2], [])


def test_fold_and_diff(spark):
    lg = spark.createDataFrame(
        [("k", 1, "artifact_observed", "a", D), ("k", 3, "artifact_observed", "b", D), ("k", 3, "ARTIFACT_OBSERVED", "b", D), ("k", 2, "item_deleted", None, D), ("p", 1, "artifact_observed", "a", D), ("p", 2, "item_purged", None, D), ("d", 1, "item_deleted", None, D)],
        "k string, seq long, event_type string, h string, recorded_at timestamp",
    )
    got = rows(versions.fold_versions(lg, ["k"], "seq", "h"), "k", "version", "h", "is_current", F.col("deleted_at").isNotNull())
    assert got == [("k", 1, "a", False, True), ("k", 2, "b", True, False)]
    a = spark.createDataFrame([(1, "x"), (None, "n"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (None, "n"), (3, "z")], "k int, v string")
    assert rows(versions.keyed_diff(a, b, ["k"], ["v"])) == [(1, "changed"), (2, "missing"), (3, "unexpected")]


def test_chains_end_even_in_circles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("z", "gone")], "k string, t string")
    assert rows(versions.follow_chain(links, "k", "t"), "key", "final", "hops")[:3] == [("a", "c", 2), ("b", "c", 1), ("c", "c", 0)]
    got = {x.key: x.final for x in versions.follow_chain(links, "k", "t").collect()}
    assert got["x"] is None and got["z"] == "gone"


# ---- scores ----


@pytest.mark.parametrize(("k", "n", "low", "high"), [(14, 14, 0.784686, 1.0), (0, 10, 0.0, 0.277533), (5, 10, 0.236593, 0.763407), (0, 0, 0.0, 1.0)])
def test_wilson(spark, k, n, low, high):
    i = one(spark, sc.wilson(F.col("k"), F.col("n")), k=k, n=n)
    assert math.isclose(i.low, low, abs_tol=1e-5) and math.isclose(i.high, high, abs_tol=1e-5)


def test_pattern_bar(spark):
    conf = lambda s, c, least=4: one(spark, sc.pattern_confidence(F.lit(s), F.lit(c), least))
    assert (conf(0, 3), conf(4, 0), conf(100, 0)) == (0.0, 0.5, 0.95)
    assert one(spark, sc.support_needed(F.lit(0), F.lit(0), 0.5)) == 4
    assert one(spark, sc.support_needed(F.lit(0), F.lit(1000), 0.9)) is None


def test_signals(spark):
    now = F.lit(D)
    assert one(spark, sc.recency(F.lit(D - timedelta(days=180)), now)) == 0.5
    assert one(spark, sc.recency(F.lit(None).cast("timestamp"), now)) == 0.5
    assert one(spark, sc.recency(F.lit(D + timedelta(days=180)), now)) == 2.0
    assert one(spark, sc.importance(F.lit(1000), F.lit(50), F.lit(3.0))) == 1.0
    assert one(spark, sc.importance(F.lit(0), F.lit(1), F.lit(0.0))) == 0.0
    assert one(spark, sc.nearest_rank(F.array(*map(F.lit, [4, 1, 3, 2])), 0.5)) == 3
    assert one(spark, sc.nearest_rank(F.array().cast("array<int>"), 0.5)) is None


def test_rates_and_calibration(spark):
    out = spark.createDataFrame([(1, "failed", D, D), (1, "worked", D + timedelta(1), D), (2, "mixed", D, D), (2, "mixed", D, D), (3, "too_early", D, D)], "decision_id int, verdict string, observed_at timestamp, created_at timestamp")
    dec = spark.createDataFrame([(i, 0.9) for i in range(1, 5)], "decision_id int, confidence double")
    x = evidence.success_rate(dec, out).first()
    assert (x.worked, x.mixed, x.too_early, x.undecided, x.rate) == (1, 1, 1, 1, 0.5)
    assert evidence.success_rate(dec, out.where("false")).first().rate is None
    c = spark.createDataFrame([(1.0, True), (0.0, False), (0.75, True), (None, True), (0.5, None)], "c double, ok boolean")
    assert rows(evidence.calibration(c, "c", "ok"), "band", "n", "worked") == [(0, 1, 0), (3, 2, 2)]


# ---- relational ----


def test_filters(spark):
    assert one(spark, rel.glob_excluded("k", ["*.pdf", "notes/*"]), k="a/b.pdf") and one(spark, rel.glob_excluded("k", ["notes/*"]), k="notes/x")
    assert not one(spark, rel.glob_excluded("k", ["x*"]), k="x/y") and not one(spark, rel.glob_excluded("k", []), k="x")
    tags = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (None, "a")], "i int, t string")
    assert rows(rel.with_all(tags, "i", "t", ["a", "b"])) == [(1,)]
    assert rel.with_all(tags, "i", "t", ["zz"]).count() == 0


@pytest.mark.parametrize(("a", "b", "meets"), [((0, 5), (4, 9), True), ((0, 4), (4, 9), False), ((4, 4), (4, 9), True), ((9, 9), (4, 9), True), ((10, 10), (4, 9), False)])
def test_spans(spark, a, b, meets):
    assert one(spark, rel.spans_overlap(*map(F.lit, (*a, *b)))) is meets


def test_interval_join(spark):
    left = spark.createDataFrame([(1, D, D + timedelta(days=90)), (1, D, D), (2, None, D)], "k int, a timestamp, z timestamp")
    right = spark.createDataFrame([(1, D), (1, D + timedelta(days=90)), (1, D + timedelta(days=45)), (1, D + timedelta(days=91)), (1, None)], "k int, t timestamp")
    assert rows(rel.interval_join(left, right, ["k"], "a", "z", "t"), "t") == [(D + timedelta(days=45),), (D + timedelta(days=90),)]


def test_jaccard(spark):
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")
    assert one(spark, rel.jaccard(a(1, 2, 2), a(2, 3))) == 1 / 3
    assert one(spark, rel.jaccard(a(), a())) == 0.0 and one(spark, rel.jaccard(F.lit(None).cast("array<int>"), a())) is None


# ---- retrieval ----


def test_rrf_by_hand(spark):
    ranks = [("x", "a", 1), ("x", "b", 2), ("x", "c", 3), ("y", "c", 1), ("y", "a", 2), ("y", "d", 3), ("y", "d", 9)]
    df = spark.createDataFrame(ranks, "ranking string, id string, rank int")
    got = {x.id: (round(x.score, 7), x["rank"]) for x in r.rrf(df, {"x": 1.0, "y": 1.0}).collect()}
    assert got == {"a": (0.0325225, 1), "c": (0.0322665, 2), "b": (0.016129, 3), "d": (0.015873, 4)}
    assert {x.id: round(x.score, 7) for x in r.rrf(df, {"x": 2.0, "y": 0.5}).collect()}["a"] == 0.0408514
    assert {x.id: x.score for x in r.rrf(df, {"x": 1.0, "y": 0.0}).collect()}["d"] == 0.0
    with pytest.raises(ValueError):
        r.rrf(df, {"x": 1.0, "y": 1.0}, k=-1)
    with pytest.raises(Exception, match="no weight"):
        r.rrf(df, {"x": 1.0}).collect()


def test_search_grammar():
    assert parse_search('"Big Red" -dog or the cat') == [[(("big", "red"), False), (("dog",), True)], [(("cat",), False)]]
    assert parse_search("the of and") == [] and parse_search("") == [] and parse_search('-x "') == []


STEMS = "consigning:consign consistency:consist consolatory:consolatori knackeries:knackeri knitting:knit generously:generous communication:communic ties:tie cries:cri gas:gas gaps:gap hopping:hop hoped:hope by:by say:say agreed:agre proceed:proceed relational:relat happily:happili policy:polici dying:die feed:feed controlled:control news:news naïve:naïve 2x:2x"


def test_stems():
    for pair in STEMS.split():
        word, want = pair.split(":")
        assert stem(word) == want, pair


def test_cover_density():
    assert r.cover_density([[0], [1]]) == pytest.approx(0.2)
    assert r.cover_density([[0], [4]]) == pytest.approx(0.2 / 4)
    assert r.cover_density([[0, 10], [1, 11]]) > r.cover_density([[0], [1]])
    assert r.cover_density([[1], []]) == 0.0 and r.cover_density([]) == 0.0


def test_keyword_search(spark):
    docs = spark.createDataFrame([(1, "A red fox, red."), (2, "red and far away and long a fox"), (3, "fox"), (4, None), (5, ""), (6, "Red FOX dog")], "d long, t string")
    assert [x.id for x in r.keyword_topk(docs, "d", "t", "red fox", 9).collect()] == [1, 6, 2]
    assert {x.id for x in r.keyword_topk(docs, "d", "t", '"red fox" -dog', 9).collect()} == {1}
    assert {x.id for x in r.keyword_topk(docs, "d", "t", "dog or far", 9).collect()} == {2, 6}
    assert r.keyword_topk(docs, "d", "t", "the", 9).count() == 0
    forms = spark.createDataFrame([(1, "They decided."), (2, "deciding now"), (3, "a decision")], "d long, t string")
    assert {x.id for x in r.keyword_topk(forms, "d", "t", "decides", 9).collect()} == {1, 2}
    assert r.keyword_topk(forms, "d", "t", "decides", 9, stems=False).count() == 0
    many = {1: "red fox", 2: '"red fox" -dog', 3: "dog or far", 4: "the", 5: ""}
    found = r.keyword_search(r.postings(docs, "d", "t", stems=True), many, 9)
    assert {q: {x.id for x in found.collect() if x["query"] == q} for q in many} == {1: {1, 2, 6}, 2: {1}, 3: {2, 6}, 4: set(), 5: set()}
    assert {x.id for x in r.keyword_search(r.postings(docs, "d", "t", stems=True), {1: "red fox"}, 9, within=docs.where("d > 1").select("d")).collect()} == {2, 6}
    apart = spark.createDataFrame([(1, "source of that claim"), (2, "source claim"), (3, "claim of that source")], "d int, t string")
    assert {x.id for x in r.keyword_topk(apart, "d", "t", '"source of that claim"', 9).collect()} == {1}
    assert parse_search('"the source of that claim"') == [[(("source", None, None, "claim"), False)]]


def test_vectors_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)] + [(99, None, "c"), (98, [None] * 5, "c")], "i long, v array<double>, score string")
    got = {(a.query, a["rank"]): a.id for a in vectors.vector_topk(df.where("i < 5"), df, 3, "i", "v").collect()}
    s = x @ x.T
    for q in range(5):
        order = [j for j in np.argsort(-s[q]) if j != q][:3]
        assert [got[q, n + 1] for n in range(3)] == order
    ivf = vectors.ivf_topk(df.where("i < 5"), df, 3, "i", "v", lists=4, share=1.0)
    assert vectors.recall(ivf, vectors.vector_topk(df.where("i < 5"), df, 3, "i", "v"), 3).first().recall == 1.0
    assert vectors.vector_topk(df.where("false"), df, 3, "i", "v").count() == 0


def test_near_pairs_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    x[:20] = x[0] + 0.05 * rng.normal(size=(20, 8))  # near each other: far more than 3 partners
    x[20:30] = x[20]  # equal
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[30:33] = 0.1 * x[30]  # equal and not near themselves
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "i long, v array<double>")
    s = np.round(x @ x.T, 9)
    want = {(i, j): s[i, j] for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.5}
    got = vectors.near_pairs(df, 0.5, "i", "v").collect()
    assert len(got) == len(want) and {(a.a, a.b) for a in got} == want.keys() and len(want) > 200
    assert all(abs(a.score - want[a.a, a.b]) < 1e-8 for a in got)
    pairs = spark.createDataFrame(list(want), "a long, b long")
    assert rows(graph.components(vectors.near_links(df, 0.5, "i", "v"), "a", "b")) == rows(graph.components(pairs, "a", "b"))
    assert vectors.near_pairs(df.where("false"), 0.5, "i", "v").count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [0.0, 1.0])], "i long, v array<double>")
    assert rows(vectors.near_pairs(twice, 0.5, "i", "v")) == [(1, 2, 1.0), (1, 3, 1.0)]


def test_similar_pairs_have_no_limit_of_partners(spark, tmp_path):
    from tessera.plans import graph as plan

    df = spark.createDataFrame([(i, [1.0, i / 1000], 0) for i in range(12)], "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert plan.QUERIES["pairwise_similarity"](spark, str(tmp_path)).count() == 12 * 11 // 2
    assert rows(plan.QUERIES["similar_components"](spark, str(tmp_path))) == [(i, 0) for i in range(12)]


def test_similar_names_have_no_limit_of_partners(spark, tmp_path):
    from itertools import permutations

    from tessera.plans import listings as plan

    names = [" ".join(w) for w in permutations(["alpha", "beta", "gamma", "delta"])][:12]  # one vector: any order of the same words
    spark.createDataFrame([(t,) for t in names], "title string").write.parquet(f"{tmp_path}/memories.parquet")
    got = plan.QUERIES["similar_names"](spark, str(tmp_path))
    assert got.count() == 12 * 11 // 2 and got.where("score < 0.86 OR status <> 'proposed'").count() == 0


def test_rerank_tail_stays_below(spark):
    df = spark.createDataFrame([(1, i, 100.0 - i, float(i)) for i in range(30)], "q int, id int, s double, second double")
    got = r.rerank(df, ["q"], "id", "s", F.col("second")).orderBy("final").collect()
    assert [x.id for x in got] == [*range(24, -1, -1), *range(25, 30)] and got[0].movement == 24
    assert got[25].score < got[24].score


def test_mmr_and_budget():
    v = [np.array([1.0, 0]), np.array([1.0, 0]), np.array([0, 1.0]), None]
    assert sel.mmr_order(np.array([1.0, 0.9, 0.5, 0.1]), v)[:2] == [0, 2]
    assert sel.mmr_order(np.array([0.3, 0.3]), [None, None]) == [0, 1] and sel.mmr_order(np.array([]), []) == []
    fate = sel.select_within([0, 1, 2, 3, 4], [50, 0, 60, 10, 10], list("aabab"), 100, 4)
    assert fate == ["chosen", "EMPTY", "OVER_BUDGET", "chosen", "chosen"]
    assert sel.select_within([0, 1], [1, 1], ["a", "a"], 9, 2) == ["chosen", "CATEGORY_FULL"]


def test_every_candidate_is_ordered_and_has_a_fate(spark):
    rng = np.random.default_rng(6)
    n = 400
    x, rel_ = rng.normal(size=(n, 6)), rng.random(n)
    x[:150] = x[0] + 0.1 * rng.normal(size=(150, 6))
    rel_[:150] += 1  # the most relevant 150 are alike
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    scaled, near, want = (rel_ - rel_.min()) / (rel_.max() - rel_.min()), None, []
    for _ in range(n):
        s = 0.5 * scaled - 0.5 * (0 if near is None else near)
        s[want] = -np.inf
        want.append(int(s.argmax()))
        near = unit @ unit[want[-1]] if near is None else np.maximum(near, unit @ unit[want[-1]])
    assert sel.mmr_order(rel_, list(x), window=16) == want == sel.mmr_order(rel_, list(x))
    tokens, kinds = [int(i) for i in rng.integers(0, 900, n)], ["abc"[i % 3] for i in range(n)]
    df = spark.createDataFrame([("q", i, float(rel_[i]), x[i].tolist(), tokens[i], kinds[i]) for i in range(n)], "q string, k int, r double, v array<double>, t int, c string")
    fate = sel.select_within(want, tokens, kinds, 6000, 20)
    got = sel.diverse_selection(df, "q", "k", "r", "v", "t", "c")
    assert rows(got, "k", "fate") == list(enumerate(fate)) and [r.k for r in got.orderBy("place").collect()] == want


def test_prompt_packing_goes_on_to_the_last_hit(spark):
    hits = [("q", i, 1.0 - i / 100, 90) for i in range(70)] + [("q", 70, 0.1, 10), ("r", 1, 0.5, 100), (None, 2, 0.5, 60), (None, 3, 0.4, 60)]
    got = context.pack_prompt(spark.createDataFrame(hits, "q string, k long, s double, t int"), "q", "k", "s", "t", 100)
    assert sorted(map(tuple, got.collect()), key=str) == [("q", 0, 1), ("q", 70, 2), ("r", 1, 1), (None, 2, 1)]


def test_compaction(spark):
    df = spark.createDataFrame([("r", i, tk) for i, tk in enumerate([5, 30, 6, 50, 50])], "run string, n int, t int")
    assert [x.state for x in sel.compact_history(df, "run", "n", "t", 12).orderBy("n").collect()] == ["kept", "dropped", "kept", "verbatim", "verbatim"]


def test_ir_metrics(spark):
    res = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("q", "b", 9), ("none", "a", 1)], "q string, id string, rank int")
    rl = spark.createDataFrame([("q", "b"), ("q", "z"), ("q", "b"), ("missed", "k")], "q string, id string")
    got = {x.q: x for x in evaluate.ir_metrics(res, rl, "q", "id", 2).collect()}
    assert (got["q"].recall, got["q"].precision, got["q"].mrr) == (0.5, 0.5, 0.5)
    assert got["q"].ndcg == round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 6) and got["missed"].ndcg == 0.0 and "none" not in got


def test_nearest_rank_is_spread(spark):
    rng = np.random.default_rng(1)
    vals = [("hot", float(x)) for x in rng.integers(0, 50, 900)] + [("one", 3.0), ("one", None), ("none", None)] + [(None, float(i)) for i in range(10)]
    df = spark.createDataFrame(vals, "g string, v double")
    got = {x.g: (x.lo, x.hi) for x in evaluate.nearest_rank(df, "g", "v", {"lo": 0.5, "hi": 0.95}, buckets=8).collect()}
    hot = sorted(v for g, v in vals if g == "hot")
    assert got == {"hot": (hot[round(0.5 * 899)], hot[round(0.95 * 899)]), "one": (3.0, 3.0), None: (4.0, 9.0)}


def test_overlap_join_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    spans = lambda n: [(int(k), int(a), int(a + w)) for k, a, w in zip(rng.integers(0, 3, n), rng.integers(0, 400, n), rng.choice([0, 0, 5, 90], n))]
    x, y = spans(60), spans(60)
    a = spark.createDataFrame([(i, *r) for i, r in enumerate(x)], "i int, k int, s int, e int")
    b = spark.createDataFrame([(i, *r) for i, r in enumerate(y)], "j int, k int, t int, u int")
    got = sorted(tuple(r) for r in rel.overlap_join(a, b, ["k"], ("s", "e"), ("t", "u"), 16).select("i", "j").collect())
    meets = lambda p, q: (p[1] == p[2] and q[1] <= p[1] <= q[2]) or (p[1] < q[2] and q[1] < p[2])
    assert got == sorted((i, j) for i, p in enumerate(x) for j, q in enumerate(y) if p[0] == q[0] and meets(p, q))


def test_intent_application():
    f, w, o = context.apply_intent("notes since March 2025", rel.SearchFilters(occurred_after="2025-01-01 00:00:00"), datetime(2026, 6, 1))
    assert f.occurred_after == "2025-03-01 00:00:00" and f.occurred_before is None and (w, o) == (0.15, None)
    assert context.apply_intent("what did I do recently", rel.SearchFilters(), D)[1] == 0.5
    assert context.apply_intent("the first draft", rel.SearchFilters(), D)[2] == "earliest"


# ---- graph and entities ----


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7), (200, 200), (None, 3)]
    df = spark.createDataFrame(edges, "a int, b int")
    got = dict(rows(graph.components(df, "a", "b")))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and got[200] == 200 and len(got) == 45
    assert graph.components(df.where("false"), "a", "b").count() == 0


def test_reach_and_hubs(spark):
    m = spark.createDataFrame([(i, e) for i in range(20) for e in (["hub"] + (["rare"] if i < 2 else []))], "item int, entity string")
    h = {x.entity: (x.df, x.hub) for x in graph.hubs(m, 0.5).collect()}
    assert h == {"hub": (20, True), "rare": (2, False)}
    rl = spark.createDataFrame([("rare", "near"), ("hub", "far")], "subject string, object string")
    seeds = spark.createDataFrame([(0,)], "item int")
    bad = spark.createDataFrame([("hub",)], "entity string")
    assert rows(graph.reach(m, rl, seeds, bad), "entity", "hops") == [("near", 1), ("rare", 2)]
    assert rows(graph.neighbours(rl.withColumnRenamed("subject", "src").withColumnRenamed("object", "dst"), spark.createDataFrame([("near",)], "n string"), 2)) == [("rare", 1)]


@pytest.mark.parametrize("depth", [1, 2])
def test_nearest_is_the_head_of_expand(spark, depth):
    rng = np.random.default_rng(depth)
    words = [f"w{i:02}" for i in range(25)]
    of = {f"i{i:03}": sorted({words[x] for x in rng.integers(0, 25, 1 + i % 2)}) for i in range(150)}
    men = spark.createDataFrame([(i, w) for i, ws in of.items() for w in ws] + [(f"i{i:03}", "hub") for i in range(160)] + [("i000", None), (None, "w00")], "item string, entity string")
    rl = spark.createDataFrame([("w00", "w24"), ("w03", "hub"), ("w05", None)], "subject string, object string")
    seeds = spark.createDataFrame([(q, f"i{x:03}") for q in (1, 2, 3, None) for x in rng.integers(0, 160, 3).tolist()], "q long, item string")
    got = spark.createDataFrame([(1, f"i{i:03}") for i in range(0, 150, 2)] + [(None, "i001"), (2, "else"), (9, "i003"), (3, None)], "q long, item string")
    known = {(x.q, x.item) for x in seeds.union(got).collect()}
    per = {}
    for x in graph.expand(men, rl, seeds, None, depth, ["q"]).collect():
        if (x.q, x.item) not in known:
            per.setdefault(x.q, []).append((-x.score, x.item))
    want = {(q, item, -low, i) for q, v in per.items() for i, (low, item) in enumerate(sorted(v)[:20], 1)}
    assert len(want) > 40
    assert {tuple(x) for x in graph.nearest(men, rl, seeds, got, ["q"], 20, depth).select("q", "item", "score", "rank").collect()} == want
    assert graph.nearest(men, rl, seeds.where("false"), got, ["q"], 20, depth).count() == 0


def test_contexts_do_not_pair_searches_with_items(spark):
    """150 searches in 1,500 items that fall into 72 kinds: what is shuffled follows their sum, not their 225,000 pairs."""
    men = [(f"i{i}", f"w{x}") for i in range(1500) for x in (i % 24, (i % 24 + 1 + i // 24 % 3) % 24)]
    hits = [(q, f"i{(q * 97 + x * 331) % 1500}", 1 - x / 10) for q in range(150) for x in range(5)]
    items = spark.createDataFrame([(f"i{i}", f"k{i}", D) for i in range(1500)], "memory_id string, external_key string, occurred_at timestamp")
    ev = spark.createDataFrame([], "decision_id long, memory_id string")
    core = spark.sparkContext._jsc.sc()

    def shuffled():
        core.listenerBus().waitUntilEmpty(30_000)
        status = core.statusStore()
        every = status.stageList(None, *(getattr(status, f"stageList$default${i}")() for i in range(2, 6)))
        return {every.apply(i).stageId(): every.apply(i).shuffleWriteRecords() for i in range(every.size())}

    before = shuffled()
    out = context.context_lists(spark.createDataFrame(hits, "q long, memory_id string, score double"), items, ev, spark.createDataFrame(men, "item string, entity string"), "q")
    assert out.where("ranking = 'graph'").count() == 150 * 30
    assert sum(n for stage, n in shuffled().items() if stage not in before) < 100_000


@pytest.mark.parametrize(
    ("name", "kind", "out"),
    [("Dr. Chen", "person", "chen"), ("Dr", "person", "dr"), ("Ann Lee, PhD", "person", "annlee"), ("the React library", "technology", "react"), ("React.js", "technology", "react"), ("ReactJS", "technology", "react"),
     ("js", "technology", "js"), ("config.py", "file", "config"), (".gitignore", "file", "gitignore"), ("Ｆｕｌｌ", "concept", "full"), ("!!!", "concept", "!!!"), ("", "file", ""), (None, "file", None)],
)
def test_canonicalize(name, kind, out):
    assert tx.canonicalize(name, kind) == out


def test_merge_and_revert(spark):
    m = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (2, 0, "a")], "c int, p int, e string")
    after, moved = entities.merge(m, spark.createDataFrame([("a", "b")], "loser string, winner string"), "e", ["c", "p"])
    assert rows(after) == [(1, 0, "b"), (2, 0, "b")] and rows(moved) == [(1, 0, "a", "b"), (2, 0, "a", "b")]
    assert (2, 0, "a") in rows(entities.revert(after, moved, "e", ["c", "p"], "a"))


# ---- text ----


def test_whole_mentions_and_memories(spark, tmp_path):
    import __spark_entry__ as entry

    q, at = entry.queries(), str(tmp_path)
    lines = [(1, 1, 1, 1), (1, 1, 3, 1), (2, 2, 2, 1), (3, 3, 3, 1), (4, 4, 1, 1), (5, 5, 9, 1), (7, 7, 9, 1)]  # order, part, supplier, line
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{at}/lineitem.parquet")
    parts = [(i, "B" if i in (1, 2, 5) else f"B{i}") for i in range(1, 8)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{at}/part.parquet")
    # 4 shares a supplier with a changed order, 5 only a brand, 7 nothing
    assert rows(q["graph_sync_scope"](spark, at), "item") == [(1,), (2,), (3,), (4,), (5,)]
    assert rows(q["shared_entities"](spark, at)) == [(1, 1)]
    got = {r.entity: r.n for r in q["merge_collisions"](spark, at).collect()}
    assert got["s2"] == 4 and got["p1"] == 1 and got["B"] == 3 and "s1" not in got and got["s9"] == 2
    assert rows(q["merge_ledger"](spark, at)) == [("s1", "s2", 2), ("s3", "s2", 2)]
    m = [(f"m{v}{k}", 1, k, v, v == 2, "h", "note", D, "x", D, None) for k in ("a-1", "b-100") for v in (1, 2)]
    kinds = "memory_id string, source_id int, external_key string, version int, is_current boolean, content_hash string, kind string, occurred_at timestamp, occurred_at_source string, ingested_at timestamp, deleted_at timestamp"
    spark.createDataFrame(m, kinds).write.parquet(f"{at}/memories.parquet")
    assert rows(q["memory_detail"](spark, at), "external_key", "version", "place") == [("a-1", 1, 2), ("a-1", 2, 1), ("b-100", 1, 2), ("b-100", 2, 1)]


def test_sentences():
    text = 'See e.g. this one. It works! "Really?" Yes. J. Smith left.'
    assert [text[a:b] for a, b in tx.sentences(text)] == ["See e.g. this one.", "It works!", '"Really?"', "Yes.", "J. Smith left."]
    assert tx.sentences("") == [] and tx.sentences(None) == []


def test_temporal_intent():
    now = datetime(2026, 2, 10)
    day = lambda *a: datetime(*a)
    got = lambda q: (lambda x: x and (x["kind"], x["start"], x["end"]))(tx.temporal_intent(q, now))
    assert got("in March") == ("range", day(2025, 3, 1), day(2025, 4, 1))
    assert got("before 3 May 2025") == ("range", None, day(2025, 5, 3))
    assert got("after January") == ("range", day(2026, 2, 1), None)
    assert got("last two weeks") == ("range", now - timedelta(days=14), now + timedelta(days=1))
    assert got("the first version in August")[0] == "range" and got("lately")[0] == "relative" and got("nothing here") is None


def test_grounding(spark):
    g = lambda s, **k: one(spark, tx.grounding("a", 3, **k), a=s)
    x = g("It is so [1]. And more [2, 9]. I cannot say. Bare claim.")
    assert (x.claims, x.supported, list(x.invented), x.refusal, x.grounded) == (3, 2, [9], False, False)
    x = g("The passages do not mention it.")
    assert x.refusal and x.rate == 1.0 and x.grounded
    assert g("I cannot say.", exempt=False).rate == 0.0 and g("Said【3】.").grounded


def test_messages(spark):
    kind = lambda s: one(spark, tx.message_intent(F.col("a")), a=s)
    assert [kind(s) for s in ("Why is that?", "We chose the blue one", "We chose the blue one. Why?", "show me the plan", "what a day", "so, what did I decide")] == ["question", "statement", "both", "question", "statement", "question"]
    title = lambda s: one(spark, tx.session_title("a"), a=s)
    assert title("  short one ") == "short one" and title(" ") is None and title("word " * 30).endswith("word…") and len(title("x" * 99)) == 61
    assert title("A first clause that is long: and then much more text follows here") == "A first clause that is long"
    assert one(spark, tx.refers_back("a"), a="what about the other one?") and not one(spark, tx.refers_back("a"), a="why external_key on transcripts")
    assert one(spark, tx.is_prose("a"), a="how does it work") and not one(spark, tx.is_prose("a"), a="ON DELETE CASCADE x_y")
    assert one(spark, tx.token_count("a"), a="Ab c_d, é!") == 5


def test_chunks_round_trip():
    text = "\n\n".join(f"# Head {i}\n\n" + "One sentence of some words here. " * 40 for i in range(6)).strip()
    spans = chunks.chunk_spans(text)
    assert all(n <= chunks.MOST and a >= p for a, _, p, n in spans) and spans[0][2] == spans[0][0]
    assert "".join(text[a:b] for a, b, _, _ in spans).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    assert chunks.chunk_spans("") == [] and len(chunks.chunk_spans("word " * 3000)) > 5
    assert chunks.diff_lines("a\nb\nc", "a\nx\nc\nd") == (2, 1, 2) and chunks.diff_lines(None, "a") == (1, 0, 0)


# ---- streams, surfacing, sources, ports ----


def test_folds(spark):
    df = spark.createDataFrame([("k", i, D + timedelta(seconds=s)) for i, s in enumerate([0, 10, 29, 30, 45, 61, 500])] + [("j", 9, D)], "k string, id int, at timestamp")
    emit = {x.id for x in folds.debounce(df, "k", "at", "id", 30).where("emit").collect()}
    assert emit == {0, 3, 5, 6, 9}
    ok = {x.id: x.accepted for x in folds.rate_limit(df, "k", "at", "id", 2, 60).collect()}
    assert ok == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True, 6: True, 9: True}


def test_gate(spark):
    h = spark.createDataFrame([("f", ["a", "b"], D, None, False), ("g", ["a", "b"], D - timedelta(days=300), D - timedelta(days=29), False), ("h", ["a"], D - timedelta(days=90), D - timedelta(days=31), True)], "f string, keys array<string>, surfaced_at timestamp, dismissed_at timestamp, useful boolean")
    c = spark.createDataFrame([("f", 1, ["a", "b"], 0.05, D + timedelta(hours=1)), ("f", 2, ["z"], 0.05, D + timedelta(hours=1)), ("f", 3, ["z"], 0.001, D + timedelta(hours=1)), ("f", 4, [], None, D), ("g", 5, ["a", "b"], 0.06, D), ("n", 6, ["q"], None, D), ("h", 7, ["a"], 0.05, D)], "f string, c int, keys array<string>, score double, at timestamp")
    assert {x.c: x.reason for x in surfacing.gate(c, h, "f", "c").collect()} == {1: "already_surfaced", 2: "cleared", 3: "below_threshold", 4: "no_context", 5: "dismissed", 6: "nothing_new", 7: "cleared"}


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("﻿hé".encode())
    (tmp_path / "sub" / "b.txt").write_bytes("h\xe9".encode("latin-1"))
    (tmp_path / "sub" / "c.txt").write_bytes(b"")
    seen = files.observe(spark, str(tmp_path), exclude=("sub/c*",))
    got = {x.external_key: x.t for x in seen.select("external_key", files.decode("content").alias("t")).collect()}
    assert got == {"a.md": "hé", "sub/b.txt": "hé"}
    assert files.changed(seen, seen).count() == 0 and rows(files.vanished(seen.where("false"), seen)) == [("a.md",), ("sub/b.txt",)]
    assert files.unknown_blobs(files.blobs(seen), files.blobs(seen)).count() == 0


def test_log_numbers_in_order(spark):
    df = spark.createDataFrame([(i, (i * 7919) % 1000) for i in range(1000)], "id int, k int")
    got = log.numbered(df, [F.col("k"), F.col("id")]).collect()
    assert [x.k for x in sorted(got, key=lambda x: x.seq)] == sorted(x.k for x in got) and {x.seq for x in got} == set(range(1, 1001))
    assert log.numbered(df.where("false"), [F.col("k")]).count() == 0


def test_ports(spark):
    docs = spark.createDataFrame([(1, "the file a/b.py and snake_case"), (2, None), (3, " ")], "d int, t string")
    got = rows(ports.verified(ports.extract(docs, "d", "t", ports.PatternExtractor), "d"), "name", "start", "fate")
    assert got == [("a/b.py", 9, "kept"), ("snake_case", 20, "kept")]
    pairs = spark.createDataFrame([(1, "red fox", "a red dog"), (2, "red fox", None), (3, None, "x"), (4, "fox", "FOX")], "i int, q string, t string")
    assert rows(ports.scored_pairs(pairs, "i", "q", "t", ports.OverlapReranker)) == [(1, 0.5), (2, 0.0), (3, 0.0), (4, 1.0)]
    e = ports.embed(docs, "t", lambda: ports.HashEmbedder(8))
    assert e.count() == 1 and ports.embed(docs, "t", lambda: ports.HashEmbedder(8), e).count() == 0


# ---- reports ----


def test_purge_scope_counts_what_goes(spark):
    from tessera.operators import reports as rp

    v = spark.createDataFrame([("s", "a", "m1", "h1"), ("s", "a", "m2", "h2"), ("s", "b", "m3", "h2"), ("s", None, "m4", None)], "source_id string, external_key string, memory_id string, content_hash string")
    ch = spark.createDataFrame([("m1", 1, True), ("m1", 2, False), ("m3", 3, True), ("m1", 1, True)], "memory_id string, chunk_id long, embedded boolean")
    men = spark.createDataFrame([("m1", "x"), ("m2", "y"), ("m3", "y"), (None, "z")], "memory_id string, entity string")
    tag = spark.createDataFrame([("m1", "t"), ("m2", "t")], "memory_id string, name string")
    turns = spark.createDataFrame([("t1", "a"), ("t2", None), ("t3", "b")], "message_id string, external_key string")
    ev = spark.createDataFrame([(1, "m1"), (1, "m1"), (2, None), (3, "m3")], "evidence_id long, memory_id string")
    keys = ["source_id", "external_key"]
    got = dict(rows(rp.purge_scope(v.where("external_key = 'a'"), v, ch, men, tag, turns, ev, keys)))
    assert got == {"items": 1, "versions": 2, "chunks": 2, "embedded chunks": 1, "mentions": 2, "tags": 2, "chat turns": 1, "evidence links": 1, "orphaned entities": 1, "owned blobs": 1, "shared blobs": 1}
    assert set(dict(rows(rp.purge_scope(v.where("false"), v, ch, men, tag, turns, ev, keys))).values()) == {0}


def test_checks_stages_and_connections(spark):
    from tessera.operators import reports as rp

    a = spark.createDataFrame([(i,) for i in (5, 3, 9, 1, 3)], "id long")
    got = {x.check: (x.n, x.examples) for x in rp.checks({"some": a, "none": a.where("false")}, 2).collect()}
    assert got == {"some": (4, "1, 3"), "none": (0, "")}
    links = spark.createDataFrame([(1, "e"), (1, "e"), (2, "e"), (3, "e"), (1, "f"), (2, "f"), (4, None)], "item long, entity string")
    live = spark.createDataFrame([(1, 10), (2, 9), (3, 11), (4, 1)], "item long, at int")
    assert rows(rp.connections(links.where("item = 1"), links, live)) == [(1, "e", 1, 1), (1, "f", 1, 1)]
    m = spark.createDataFrame([("a", None), ("b", "new"), ("c", "k")], "message_id string, external_key string")
    items = spark.createDataFrame([("k", "m1"), ("k", "m2")], "external_key string, memory_id string")
    ch = spark.createDataFrame([("m1", 1, True), ("m2", 2, False)], "memory_id string, chunk_id long, embedded boolean")
    assert {x.message_id: x.stage for x in rp.stages(m, items, ch).collect()} == {"a": "not taken in", "b": "waiting", "c": "embedding"}


def test_export_in_batches_of_versions(spark):
    import json

    from tessera.operators import reports as rp

    v = spark.createDataFrame([("s", "k", i, f"m{i}") for i in range(1, 6)], "source string, key string, version int, memory_id string")
    tag = spark.createDataFrame([("m1", "b"), ("m1", "a")], "memory_id string, name string")
    ch = spark.createDataFrame([("m1", 7), ("m1", 7), ("m5", 8)], "memory_id string, chunk_id long")
    out = {x.batch: json.loads(x.json) for x in rp.export_items(v, tag, ch, ["source", "key"], ["memory_id"], 2).collect()}
    assert sorted(out) == [0, 1, 2] and [x["version"] for x in out[1]["versions"]] == [3, 4]
    assert out[0]["versions"][0] == {"version": 1, "memory_id": "m1", "tags": ["a", "b"], "chunks": 1}


# ---- parsing ----


def test_markdown_front_matter_fences_and_offsets():
    t = "---\ntitle: \"A plan\"\ntags: x\n---\n\n# One #\n```\n# not this\n~~~\n# nor this\n```\ntext\n## Two\n####### seven\n#no space\n"
    got = chunks.parse_markdown(t)
    assert got["title"] == "A plan" and t[got["body"] :].startswith("\n# One")
    assert [(h["level"], h["text"], t[h["start"] :].split("\n")[0]) for h in got["headings"]] == [(1, "One", "# One #"), (2, "Two", "## Two")]
    assert chunks.parse_markdown("## b\n# a")["title"] == "a" and chunks.parse_markdown("---\nopen") == {"title": None, "body": 0, "headings": []}
    assert chunks.parse_markdown(None) is None and chunks.parse_markdown("")["headings"] == []


def test_definitions(spark):
    t = "export default async function f() {}\npublic static class C {}\n  def inner\ntype T = 1\npub fn g()\nimpl S {}\ndef p(x):\n"
    assert one(spark, chunks.definitions(F.lit(t))) == ["f", "C", "T", "g", "S", "p"]
    code = "import os\n\n@dec\nclass A:\n    def m(self): pass\n\nasync def f():\n    return 1\n"
    assert [(p["kind"], p["name"], p["start"]) for p in chunks.parse_python(code)] == [("class", "A", 4), ("function", "f", 7)]
    assert chunks.parse_python("def broken(") is None and chunks.parse_python(None) is None and chunks.parse_python("") == []


@pytest.mark.parametrize(("old", "new"), [("a\nb\nc", "a\nx\nc\nd\n"), (None, "a"), ("a\n", None), ("", ""), ("same\n", "same\n"), ("a\r\nb", "b")])
def test_diff_spans_rebuild_the_new_text(old, new):
    a, b = old or "", new or ""
    out, at = [], 0
    for s in chunks.diff_spans(old, new):
        out += [a[at : s["old_start"]], b[s["new_start"] : s["new_end"]]]
        at = s["old_end"]
    assert "".join(out) + a[at:] == b


def test_excerpt_edges(spark):
    cut = lambda t, at, n, w: one(spark, r.excerpt(F.lit(t), F.lit(at), F.lit(n), w))
    assert cut("short text", 6, 4, 50) == "short text"
    t = "First para.\n\nA line here\nwith the words around it. And more.\n\nLast para."
    at = t.index("words")
    assert cut(t, at, 5, 60) == t and cut(t, at, 5, 30) == "A line here\nwith the words around it. And more."
    assert cut(t, at, 5, 20) == "with the words around it." and cut(t, at, 5, 6) == "the words"
    assert cut("x" * 100, 50, 2, 10) == "x" * 22


def test_terms_and_refusals(spark):
    t = "Use `run_all now` and src/app.main or snake_case, camelCase, CamelCase; not 3.5, e.g. plain, `src/x.py` or A_b."
    assert one(spark, tx.technical_terms(F.lit(t))) == ["run_all now", "src/app.main", "snake_case", "camelCase", "CamelCase", "src/x.py"]
    for text, said in (("The passages do not contain it.", True), ("I could not find any mention there.", True), ("Nothing in them says so.", True), ("It is not so, but the note covers it [1].", False), ("All is well.", False), ("", False)):
        assert one(spark, tx.is_refusal(F.lit(text))) is said, text


def test_sentences_by_words():
    t = 'Dr. Who met J. Doe. "Really?" she said. It cost 3.5 e.g. Much. (Yes.) No'
    assert [t[a:b] for a, b in tx.sentences(t)] == ['Dr. Who met J. Doe.', '"Really?" she said.', "It cost 3.5 e.g. Much.", "(Yes.)", "No"]
    assert tx.sentences("") == [] and tx.sentences(" ab.  B") == [(0, 4), (6, 7)]


def test_order_and_recency_phrases():
    now = datetime(2026, 6, 15)
    kind = lambda q: (lambda t: t and (t["kind"], t["ordering"], t["phrase"]))(tx.temporal_intent(q, now))
    assert kind("show the first version of it") == ("ordering", "earliest", "the first version")
    assert kind("what did it say originally") == ("ordering", "earliest", "originally")
    assert kind("the most recent draft") == ("ordering", "latest", "the most recent draft")
    assert kind("most recently changed") == ("relative", None, "most recently") and kind("plain words") is None


# ---- validation, contexts, judged results ----


def test_record_rules(spark):
    from tessera.operators import validation as val

    d = spark.createDataFrame([("q?", "A", ["a", "b"], 0.5, "declared"), (" ", "A", ["a", "A "], 1.5, "else"), (None, None, None, None, None)], "q string, c string, a array<string>, x double, p string")
    said = [x.v for x in d.select(val.broken(val.decision_rules("q", "c", "a", "x", "p")).alias("v")).collect()]
    assert said == [[], ["no question", "no alternative", "confidence out of range", "unknown provenance"], ["no question", "nothing chosen", "no alternative", "confidence out of range", "unknown provenance"]]
    o = spark.createDataFrame([("declared", 1.0), ("declared", 0.9), ("inferred", 1.0), ("inferred", 0.4)], "p string, x double")
    assert [x.v for x in o.select(val.broken(val.outcome_rules("p", "x")).alias("v")).collect()] == [[], ["declared but not certain"], ["inferred but certain"], []]
    j = spark.createDataFrame([("missing", None), ("missing", 2), ("relevant", 1), ("relevant", None), ("odd", 1)], "v string, r int")
    assert [x.v for x in j.select(val.broken(val.judgement_rules("v", "r")).alias("v")).collect()] == [[], ["missing but ranked"], [], ["no rank"], ["unknown verdict"]]
    good, bad = val.split(j, val.judgement_rules("v", "r"))
    assert good.count() == 2 and bad.count() == 3


def test_context_of_five_rankings(spark):
    hits = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (1, None, 0.4)], "q long, memory_id string, score double")
    items = spark.createDataFrame([("a", "x/one.md", D), ("b", "x/two.md", None), ("c", "y/one.md", D), ("d", None, D)], "memory_id string, external_key string, occurred_at timestamp")
    ev = spark.createDataFrame([(7, "a"), (7, "b"), (8, "b"), (9, None)], "decision_id long, memory_id string")
    men = spark.createDataFrame([("a", "rare"), ("d", "rare"), *[(f"m{i}", "other") for i in range(40)]], "item string, entity string")
    got = {}
    for x in context.context_lists(hits, items, ev, men, "q").collect():
        got.setdefault(x.ranking, []).append((x["rank"], x.id))
    assert {k: sorted(v) for k, v in got.items()} == {
        "retrieval": [(1, "a"), (2, "b")], "recency": [(1, "a"), (2, "b")], "graph": [(1, "d")], "name": [(1, "c")], "decisions": [(1, "decision/7"), (2, "decision/8")],
    }


def test_pins_beat_judgements_of_items(spark):
    res = spark.createDataFrame([(1, "a", [0, 2], 1, "k.md"), (1, "x", [0], 2, "k.pdf"), (1, "b", [], 3, "k.md")], "q long, id string, chunks array<int>, rank int, key string")
    j = spark.createDataFrame([(1, "a", 2, "relevant"), (1, "a", None, "not_relevant"), (1, "a", 5, "missing"), (1, "b", None, "relevant"), (1, "x", None, "relevant")], "q long, id string, ordinal int, verdict string")
    found, good = context.judged(res, j, "q", rel.glob_excluded("key", ["*.pdf"]))
    assert rows(found, "id", "rank") == [("a#0", 1), ("a#2", 1), ("b", 2)]
    assert rows(good, "id") == [("a#2",), ("a#5",), ("b",), ("x",)]
    m = evaluate.ir_metrics(found, good, "q", "id").first()
    assert m.recall == 0.5 and m.mrr == 1.0
    assert evaluate.worst(evaluate.ir_metrics(found, good, "q", "id"), "q", 3).count() == 1


def test_steps_of_a_run(spark):
    h = spark.createDataFrame([(1, 1, "m1", "s", [1, 2]), (1, 2, "m2", "s", [2, 3]), (1, 3, "m1", "t", None), (2, 1, None, None, [])], "run long, at int, item string, grp string, parts array<bigint>")
    assert rows(evaluate.hops_of(h, "run", ["at"], "item", "grp", "parts"), "run", "hop", "returned", "new", "used_id", "borrowed_term") == [
        (1, 1, 2, 2, False, False), (1, 2, 2, 1, False, True), (1, 3, 0, 0, True, False), (2, 1, 0, 0, False, False)
    ]
    assert [one(spark, evaluate.answer_verdict(F.lit(r), F.lit(b))) for r, b in ((0.4, False), (0.7, False), (0.9, True), (0.9, False))] == ["ungrounded", "partial", "partial", "grounded"]


def test_order_by_stretches_of_numbers(spark):
    df = spark.createDataFrame([("k", i * 40_000, f"v{i}") for i in range(6)] + [("k", None, "x"), (None, 5, "n")], "k string, seq long, v string")
    got = {x.seq: x.before for x in ordered.with_previous(df, ["k"], "seq", "v", value="v", out="before").where("k = 'k'").collect()}
    assert got == {0: None, **{i * 40_000: f"v{i - 1}" for i in range(1, 6)}}
    sums = {x.seq: x.s for x in ordered.running_sum(df.dropna(subset=["seq"]), ["k"], "seq", "v", "seq", "s").where("k = 'k'").collect()}
    assert sums[200_000] == 600_000 and sums[0] == 0


def test_trailing_counts_of_a_hot_key(spark):
    ts = [D + timedelta(seconds=s) for s in (0, 0, 59, 60, 3599, 3600, 3661, 7300)]
    df = spark.createDataFrame([("hot", i, t) for i, t in enumerate(ts)] + [(None, 90, D), ("hot", 91, None)], "k string, id int, at timestamp")
    got = {x.id: x.in_window for x in folds.trailing_count(df, "k", "at", 60).collect()}
    want = {i: sum(timedelta(0) <= t - u <= timedelta(seconds=60) for u in ts) for i, t in enumerate(ts)}
    assert got == {**want, 90: 1, 91: None}


def test_user_facets(spark):
    p = spark.createDataFrame([(1, 5, 2), (2, 4, 4)], "grp long, support long, against long")
    g = spark.createDataFrame([(1, 1, 3), (2, 9, 1), (3, 6, 4), (4, 0, 0), (5, 2, 0)], "grp long, held long, broke long")
    w = spark.createDataFrame([(0.5,), (0.45,), (0.4,), (0.05,), (0.2,), (None,)], "weekend_share double")
    pairs = spark.createDataFrame([(1, 2, 3), (1, 3, 2)], "a long, b long, n long")
    assert rows(context.user_facets(p, g, w, pairs)) == [
        ("group:1", "weak", 3, 1), ("group:2", "strong", 9, 1), ("pair:1+2", "together", 3, 0), ("pattern:1", "recurs", 5, 2), ("rhythm:weekends", "worked", 3, 1)
    ]
    none = context.user_facets(p.where("false"), g.where("false"), w.where("false"), pairs.where("false"))
    assert none.count() == 0
