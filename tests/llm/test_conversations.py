from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.llm import conversations as c

MESSAGE = "session_id string, ordinal int, role string, content string, title string, turn int"
AT = datetime(2026, 1, 1)


def messages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 99) for r in rows], MESSAGE)


def sessions(spark, ids):
    return spark.createDataFrame([(i, "t") for i in ids], "session_id string, title string")


def verdicts(spark, rows, ids):
    return {r.session_id: r.dropped for r in c.session_verdicts(messages(spark, rows), sessions(spark, ids)).collect()}


def test_each_rule(spark):
    ok = [("ok", 0, "user", "a"), ("ok", 3, " Assistant\n", "b"), ("ok", 3, "assistant", "b"), ("ok", 0, "USER", "a")]
    cases = {
        "noreply": [(0, "user", "a")],
        "start": [(0, "assistant", "a"), (1, "assistant", "b")],
        "first": [(0, "assistant", "a")],
        "twice": [(0, "user", "a"), (1, "user", "b"), (2, "assistant", "c")],
        "role": [(0, "user", "a"), (1, "tool", "b")],
        "norole": [(0, "user", "a"), (1, None, "b")],
        "noordinal": [(0, "user", "a"), (1, "assistant", "b"), (None, "user", "c")],
        "blank": [(0, "user", "​ ⁠"), (1, "assistant", "b")],
        "nbsp": [(0, "user", " "), (1, "assistant", "b")],
        "null": [(0, "user", None), (1, "assistant", "b")],
        "empty_text": [(0, "user", ""), (1, "assistant", "b")],
        "two": [(0, "user", "a"), (1, "assistant", "b"), (1, "assistant", "B")],
    }
    rows = ok + [(k, *r) for k, rs in cases.items() for r in rs] + [(None, 0, "user", "x"), ("unlisted", 0, "user", "x")]
    got = verdicts(spark, rows, ["ok", "ok", "none", None, *cases])
    assert got.pop("ok") is None and got.pop("none") == "empty"
    assert got.pop("noreply") == "no_reply" and got.pop("first") == "no_reply"
    assert set(got) == set(cases) - {"noreply", "first"} and set(got.values()) == {"broken"}


def test_order_across_ranges(spark, monkeypatch):
    """Ranges of ordinals are checked apart; their seams count too."""
    monkeypatch.setattr(c, "RANGE", 4)
    good = [("g", i, ("user", "assistant")[i % 2], f"t{i}") for i in range(10)]
    seam = [("s", i, ("user", "assistant")[(i + (i >= 4)) % 2], f"t{i}") for i in range(11)]
    assert verdicts(spark, good + seam, ["g", "s"]) == {"g": None, "s": "broken"}
    out = c.conversations(messages(spark, good[::-1] + good), sessions(spark, ["g"])).orderBy("turn").collect()
    assert [(r.turn, r.content, r.role) for r in out] == [(i, f"t{i}", ("user", "assistant")[i % 2]) for i in range(10)]


def test_empty_tables(spark):
    assert verdicts(spark, [], ["a"]) == {"a": "empty"}
    assert verdicts(spark, [("a", 0, "user", "x")], []) == {}
    assert c.conversations(messages(spark, []), sessions(spark, [])).count() == 0


def test_split_at_calibrated_gap(spark):
    rows, t = [], AT
    for part in range(4):
        for i in range(6):
            rows.append(("ch", f"{part}-{i}", t))
            t += timedelta(seconds=20 + i)
        t += timedelta(hours=5)
    rows += [("ch", "x", None), (None, "y", AT)]
    m = spark.createDataFrame(rows, "channel string, id string, at timestamp")
    gap = c.calibrated_gap(m, "channel", "at", "id")
    assert 30 < gap < 5 * 3600
    parts = {r.id: r.part for r in c.split_at_gaps(m, "channel", "at", "id", gap).collect()}
    assert parts == {f"{p}-{i}": p for p in range(4) for i in range(6)}
    assert c.calibrated_gap(m.where("false"), "channel", "at", "id") is None


@pytest.mark.parametrize(("text", "seen"), [("a", True), (".", True), ("\t\n", False), ("﻿", False), ("⠀", False), ("é", True)])
def test_visible(spark, text, seen):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(c.visible("t")).first()[0] is seen


def test_rebuilt_sessions(spark):
    """Two sittings in one channel, roles missing in both, a repeated delivery, a one-sided part, unusable rows."""
    sec = lambda n: AT + timedelta(seconds=n)
    rows = [
        ("ch", "1", sec(0), "User ", "q1", None), ("ch", "1b", sec(0), "user", "q1", None), ("ch", "2", sec(20), None, "a1", None), ("ch", "3", sec(45), "tool", "q2", None), ("ch", "4", sec(70), "assistant", "a2", None),
        ("ch", "5", sec(40_000), None, "q3", None), ("ch", "6", sec(40_025), "assistant", "a3", None), ("ch", "7", sec(40_050), "", "hinted", "assistant"),
        ("one", "8", sec(0), "user", "hello", None), ("one", "9", sec(30), "user", "anyone", None),
        ("none", "10", sec(0), None, "x", None), ("none", "11", sec(21), None, "y", None),
        (None, "12", sec(0), "user", "x", None), ("ch", "13", None, "user", "x", None), ("ch", "14", sec(1), "user", "  ", None), ("ch", "15", sec(1), "user", None, None),
    ]
    m = spark.createDataFrame(rows, "channel string, id string, at timestamp, role string, content string, part string")
    out = c.rebuilt_sessions(m.withColumnRenamed("part", "said"), "channel", "at", "id", "role", "content", F.col("said"))
    got = [(r.channel, r.part, r.turn, r.role, r.inferred, r.content) for r in out.orderBy("channel", "part", "turn").collect()]
    assert got == [
        ("ch", 0, 0, "user", False, "q1"), ("ch", 0, 1, "assistant", True, "a1"), ("ch", 0, 2, "user", True, "q2"), ("ch", 0, 3, "assistant", False, "a2"),
        ("ch", 1, 0, "user", True, "q3"), ("ch", 1, 1, "assistant", False, "a3"), ("ch", 1, 2, "assistant", True, "hinted"),
        ("none", 0, 0, "user", True, "x"), ("none", 0, 1, "assistant", True, "y"),
    ]
    assert c.rebuilt_sessions(m.where("false"), "channel", "at", "id", "role", "content").count() == 0
