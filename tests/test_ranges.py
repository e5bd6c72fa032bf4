"""Running sums and rows before by ranges, against loops, with one key that holds half of all rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from atlasloom import common
from atlasloom.operators import history, state


@pytest.fixture()
def rows():
    rnd = random.Random(7)
    return [(rnd.choice(["hot", "hot", "hot", "a", "b", None]), rnd.choice([None, *range(40)]), n, rnd.choice([None, 1, 2, 3])) for n in range(900)]


def test_running(spark, rows):
    df = spark.createDataFrame(rows, "k string, at int, no int, v int")
    got = {r.no: (r.s, r.n) for r in common.running(df, ["k"], [F.col("at").desc_nulls_last(), F.col("no")], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    want, sums = {}, {}
    for k, at, no, v in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
        s, n = sums.get(k, (0, 0))
        want[no] = sums[k] = (s + (v or 0), n + 1)
    assert got == want
    assert common.running(df.limit(0), ["k"], [F.col("no")], {"s": F.col("v")}).count() == 0


def test_previous(spark, rows):
    df = spark.createDataFrame(rows, "k string, at int, no int, v int")
    got = {r.no: r.before for r in common.previous(df, ["k"], [F.col("no")], "v", "before").collect()}
    want, last = {}, {}
    for k, _, no, v in rows:
        want[no] = last.get(k)
        last[k] = v
    assert got == want


def test_a_session_of_half_of_all_rows(spark):
    rows = [(n, f"m{n}", "hot" if n % 2 else f"s{n % 20}", "user", f"not w{n - 2}" if n % 4 == 1 else f"w{n} says", f"2025-01-01 {n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d}", None) for n in range(800)]
    m = history.current_messages(spark.createDataFrame(rows, "row_id long, id string, session_id string, role string, content string, created_at string, node_refs string"))
    got = {r.row_id for r in history.recent(m, 30).collect()}
    want = set()
    for s in {r[2] for r in rows}:
        used = 0
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: -r[0]):
            used += -(-len(r[4]) // 4)
            if used <= 30:
                want.add(r[0])
    assert got == want
    assert {r.row_id: r.negated for r in history.corrections(m).collect()} == {n: f"w{n - 2}" for n in range(800) if n % 4 == 1 and n > 1}


def test_scratch(spark):
    with common.scratch(spark):
        path = common.written(spark.range(3))
        assert os.path.exists(path.replace("file:", ""))
    assert not os.path.exists(path.replace("file:", ""))


def test_updates(spark):
    base = spark.createDataFrame([("a", 1, "x", "d"), ("b", 4, None, "d"), ("c", 2, "z", "d")], "id string, version long, title string, note string")
    ch = spark.createDataFrame([("a", "y", None), ("b", None, "e"), ("c", "z", None), ("none", "q", None)], "id string, title string, note string")
    got = {r.id: (r.version, r.title, r.note, r.reembed) for r in state.updated(base, ch, ["title", "note"], ["title"]).collect()}
    assert got == {"a": (2, "y", "d", True), "b": (5, None, "e", False), "c": (2, "z", "d", False)}


def test_truncated_and_cascaded(spark):
    m = spark.createDataFrame([("s", 1, 10, "a"), ("s", 2, 10, "b"), ("s", 3, 10, "c"), ("s", 4, None, "d"), ("t", 5, 1, "e"), (None, 6, 1, "f")], "session_id string, row_id int, sent int, content string")
    e = spark.createDataFrame([("s", 2, "new"), ("gone", 9, "x")], "session_id string, row_id int, content string")
    assert sorted((r.row_id, r.content) for r in state.truncated(m, e).collect()) == [(1, "a"), (2, "new"), (4, "d"), (5, "e"), (6, "f")]
    p = spark.createDataFrame([("s",), ("t",)], "session_id string")
    left, rest = state.cascaded(p, m, p.filter("session_id = 's'"), "session_id", "session_id")
    assert [r.session_id for r in left.collect()] == ["t"] and sorted(r.row_id for r in rest.collect()) == [5, 6]


def test_as_of(spark):
    h = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 5, "z"), ("b", 3, None), (None, 1, "n")], "id string, at int, v string")
    q = spark.createDataFrame([("a", 0, 1), ("a", 4, 2), ("a", 4, 3), ("a", 9, 4), ("b", 3, 5), ("c", 1, 6), (None, 1, 7), ("a", None, 8)], "id string, t int, no int")
    got = {r.no: r.was for r in state.as_of(h, q, "id", "t", "at", F.col("v"), "was").collect()}
    assert got == {1: None, 2: "x", 3: "x", 4: "z", 5: None, 6: None, 7: None, 8: None}


def test_changes(spark):
    rnd = random.Random(2)

    def longest(a, b):
        if not a or not b:
            return 0
        return longest(a[1:], b[1:]) + 1 if a[0] == b[0] else max(longest(a[1:], b), longest(a, b[1:]))

    for _ in range(60):
        a, b = ([rnd.choice("xyz") for _ in range(rnd.randint(0, 7))] for _ in range(2))
        c = state.changes(" ".join(a), " ".join(b))
        assert [t for k, t in c if k != "added"] == a and [t for k, t in c if k != "removed"] == b
        assert sum(k == "same" for k, _ in c) == longest(a, b)
    lines = "\n".join("w " * 40 for _ in range(20))
    assert state.changes(lines, lines + "\nnew") == [("same", "w " * 40)] * 20 + [("added", "new")]
    assert state.changes("a\n" * 400, "b") == [("removed", "a\n" * 400), ("added", "b")]
    df = spark.createDataFrame([("k", "a b", "b c"), ("n", None, None), ("n", None, "x")], "id string, o string, n string")
    got = [(r.id, r.place, r.kind, r.text) for r in state.text_changes(df, ["id"], "o", "n").orderBy("id", "place").collect()]
    assert got == [("k", 0, "removed", "a"), ("k", 1, "same", "b"), ("k", 2, "added", "c"), ("n", 0, "added", "x")]
