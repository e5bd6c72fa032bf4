import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlasloom.llm import chunking as c


def whole(text, limit, overlap):
    """The pieces in order overlap or touch, and together are the text."""
    data, at = text.encode(), 0
    for a, b in c.ranges(data, limit, overlap):
        assert a <= at < b and at - a <= 4 * overlap
        at = b
    assert at == len(data)


def size(t):
    return -(-len(t.encode()) // 4)


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 9))) + r.choice(["", "", "", ".", ",", ".\n\n"]) for _ in range(n))


def test_pieces_fit_and_hold_the_whole():
    for t in (prose(900), "x" * 9000, "漢字かな" * 700, "🧠👩‍💻" * 500, "\n" * 5000, "a\r\n" * 2000, prose(400) + "é" * 3000):
        got = c.pieces(t, 100, 16)
        assert len(got) > 1 and all(size(p) <= 100 for p in got)
        whole(t, 100, 16)


def test_small_stays():
    assert c.pieces("", 10, 2) == [""] and c.pieces("abcd" * 10, 10, 2) == ["abcd" * 10]


def test_cuts_at_natural_boundaries():
    t = prose(2000, 1)
    data = t.encode()
    ends = c.cuts(data, 400, 800)[:-1]
    assert all(data[e - 1 : e] in (b"\n", b" ") for e in ends)


def test_nearest_boundary_and_overlap_in_any_script():
    t = "漢字かな、" * 2000
    got = c.pieces(t, 100, 16)
    assert all(p.endswith("、") for p in got[:-1]) and all(p.startswith("漢") for p in got[1:])
    # a strong boundary at the edge of the window doesn't win against a weaker one at the landmark
    marks = c.Marks("".join(prose(60, k).replace("\n\n", " ") + "\n\n" for k in range(60)).encode())
    ends = marks.cuts(400, 800)[:-1]
    assert len({min(i for i, e in enumerate(marks.ends) if end in e) for end in ends}) > 1


def test_many_models(spark):
    m = spark.createDataFrame([(f"m{i}", 10 + i, 2) for i in range(c.MODELS + 5)], "model string, chunk_max_tokens int, chunk_overlap_tokens int")
    df = spark.createDataFrame([("a", prose(400))], "id string, t string")
    assert c.split_oversized(df, m, ["id"], "t").select("model").distinct().count() == c.MODELS + 5


def test_edits_stay_local():
    t = prose(6000, 2)
    a = [e for e in c.cuts(t.encode(), 400, 1000)]
    at = t.index(" ", 1000)
    edited = t[:at] + " inserted words here" + t[at:]
    shift = len(edited.encode()) - len(t.encode())
    b = c.cuts(edited.encode(), 400, 1000)
    same = {e + shift for e in a if e > 15000} & set(b)
    assert len(same) > 0.8 * len([e for e in a if e > 15000])


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400), st.integers(3, 30), st.integers(0, 40))
def test_any_text(t, limit, overlap):
    got = c.pieces(t, limit, overlap)
    assert all(size(p) <= max(limit, 3) for p in got)
    if t:
        whole(t, limit, overlap)


def test_table(spark):
    m = spark.createDataFrame([("s", 10, 2), ("l", 100, 8), (None, 5, 1), ("z", None, 1)], "model string, chunk_max_tokens int, chunk_overlap_tokens int")
    rows = [("a", prose(50), "s", 1), ("a", prose(50), "s", 1), ("b", None, "l", 2), ("c", "", "s", 3), (None, prose(300), "l", 4), ("d", prose(50), "none", 5)]
    df = spark.createDataFrame(rows, "id string, t string, model string, tokens int")
    own = c.split_oversized(df, m, ["id"], "t", own_model="model").collect()
    assert {(r.id, r.model) for r in own} == {("a", "s"), (None, "l")}
    every = c.split_oversized(df, m, ["id"], "t").filter("piece = 0").groupBy("id", "model").count().collect()
    assert {(r.id, r.model): r["count"] for r in every} == {("a", "s"): 2, ("d", "s"): 1, (None, "s"): 1, (None, "l"): 1}
    assert c.split_oversized(df.limit(0), m, ["id"], "t").count() == 0
    assert c.split_oversized(df, m.limit(0), ["id"], "t").count() == 0
