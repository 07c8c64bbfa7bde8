import random

import numpy as np
from hypothesis import given, settings, strategies as st

from tessera.functions.normal import normal_form
from tessera.llm.splitting import cut_tables, split_texts

ALPHABET = "ab c.\ńd。、x"


def valid(text, cuts, limit, overlap):
    assert cuts[0] == 0 and cuts[-1] == len(text)
    assert (np.diff(cuts) > 0).all() or len(text) == 0
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        assert b - (max(0, a - overlap) if i else a) <= limit


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=400), max_size=5), st.sampled_from([(20, 5), (50, 0), (10, 9), (200, 20)]))
def test_pieces_cover_text_within_limit(texts, sizes):
    limit, overlap = sizes
    for t, c in zip(texts, cut_tables(texts, limit, overlap)):
        valid(t, c, limit, overlap)
        assert cut_tables([t], limit, overlap)[0].tolist() == c.tolist()


def test_natural_ends_are_preferred():
    text = "\n\n".join("word " * 30 + "end." for _ in range(30))
    cuts = cut_tables([text])[0]
    assert all(text[c - 2 : c] == "\n\n" for c in cuts[1:-1])
    text = "A first sentence of words. " * 200
    assert all(text[c - 2 : c] == ". " for c in cut_tables([text])[0][1:-1])
    text = "番目の文。" * 1000
    assert all(text[c - 1] == "。" for c in cut_tables([text])[0][1:-1])


def test_run_without_boundary_is_cut_hard():
    cuts = cut_tables(["x" * 5000])[0].tolist()
    assert cuts == [0, 2000, 3800, 5000]


def test_rows(spark):
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdef", k=rng.randint(1, 9))) for _ in range(3000))
    rows = [("a", long, "x"), ("a", long, "x"), ("b", None, "x"), ("c", "", "x"), ("d", "short", "x"), ("e", "y" * 2000, "x"), ("f", "z" * 2001, "x"), (None, "w" * 2500, "x"), ("g", "q" * 1990 + " " * 600, "x")]
    df = spark.createDataFrame(rows, "memory_id string, content string, piece string")
    out = split_texts(df, "memory_id", "content").collect()
    by = {}
    for r in out:
        by.setdefault(r.memory_id, []).append(r)
    assert set(by) == {"a", "f", None}
    pieces = sorted(by["a"], key=lambda r: r.piece)
    assert [p.piece for p in pieces] == list(range(len(pieces)))
    text = pieces[0].content + "".join(p.content[200:] for p in pieces[1:])
    assert text == normal_form(long)
    assert all(p.content[:200] == text[p.start : p.start + 200] and len(p.content) <= 2000 for p in pieces)
    assert {r.memory_id for r in split_texts(df, "memory_id", "content", pieces=False).collect()} == {"a", "f", None}
    assert split_texts(df.where("false"), "memory_id", "content").count() == 0


def test_hard_cuts_equal_a_plain_loop():
    """Runs of letters and combining marks: the cuts of the squared table are those of one step after another."""
    rng = random.Random(6)
    marks = "́̂️‍"
    texts = ["".join(rng.choice("xyz") + "".join(rng.choices(marks, k=rng.choice([0, 0, 1, 3]))) for _ in range(rng.randint(1, 900))) for _ in range(20)]
    texts += ["x" * 50 + "́" * 400, "plain words before " + "q" * 700 + " and after"]
    limit, overlap = 150, 30
    for t, cuts in zip(texts, cut_tables(texts, limit, overlap)):
        valid(t, cuts, limit, overlap)
        if " " in t:
            continue
        at, want = 0, [0]
        while len(t) - at > (limit if at == 0 else limit - overlap):
            at += limit if at == 0 else limit - overlap
            back = next((p for p in range(at, at - 32, -1) if t[p] not in marks), at)
            at = back
            want.append(at)
        assert cuts.tolist() == [*want, len(t)]
