"""Rows, columns, kinds and chunks of blocks on pages."""

import random

from pyspark.sql import functions as F

from atlasloom.functions import text as tx
from atlasloom.operators import pages

BOX = "block_id long, job_id string, page_index int, block_index int, x double, y double, width double, height double"


def test_rows_by_anchor(spark):
    ys = [(1, 10.0), (2, 15.0), (3, 19.0), (4, 26.0), (5, 31.0)]  # each near the one before, not to the first of its row
    df = spark.createDataFrame([(i, "j", 0, i, float(i), y, 50.0, 12.0) for i, y in ys], BOX)
    assert {r.block_id: r.row for r in pages.visual_rows(df).collect()} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}
    assert pages.visual_rows(df.limit(0)).count() == 0


def test_two_columns(spark):
    rows = [(0, 50.0, 60.0, 500.0, 20.0)]  # a wide title
    rows += [(10 + k, 50.0, 100.0 + 14 * k, 230.0, 12.0) for k in range(6)] + [(20 + k, 320.0, 100.0 + 14 * k, 230.0, 12.0) for k in range(6)]
    rows += [(1, 50.0, 30.0, 100.0, 10.0), (2, 300.0, 770.0, 20.0, 10.0)]  # running head and foot
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, "j", 0, 0, x, y, w, h) for i, x, y, w, h in rows], BOX)
    got = [r.block_id for r in pages.column_order(df, 612.0, 792.0, gap=40.0).orderBy("place").collect()]
    assert got == [1, 0, *range(10, 16), *range(20, 26), 2]
    # one hanging block on the right makes no column
    lone = spark.createDataFrame([(k, "j", 0, 0, 50.0, 100.0 + 14 * k, 230.0, 12.0) for k in range(6)] + [(9, "j", 0, 0, 320.0, 142.0, 230.0, 12.0)], BOX)
    assert [r.block_id for r in pages.column_order(lone, 612.0, 792.0, gap=40.0).orderBy("place").collect()] == [0, 1, 2, 3, 9, 4, 5]


def test_kinds(spark):
    cases = [
        ("We the people", 12.0, "Body", None), ("BILL OF RIGHTS", 18.0, "Heading", 1), ("Chapter 3", 12.0, "Heading", 3), ("2 Overview", 15.0, "Heading", 2), ("• First", 12.0, "ListItem", None), ("(1) Second", 12.0, "ListItem", None),
        ("2) Third", 12.0, "ListItem", None), ("1.5 metres", 12.0, "Body", None), ("a | b | 3", 12.0, "Table", None), ("x = a + b - c / d", 30.0, "Body", None), ("(12)", 30.0, "Body", None), ("Algorithm 2 Search", 30.0, "Body", None), (None, 12.0, "Body", None),
        *[("plain text", 12.0, "Body", None)] * 12,
    ]
    df = spark.createDataFrame([(i, "j", 0, i, 50.0, 100.0 + 20 * i, 400.0, h, t) for i, (t, h, _, _) in enumerate(cases)] + [(100, "j", 0, 100, 280.0, 770.0, 30.0, 10.0, "page foot")], BOX + ", text string")
    got = {r.block_id: (r.kind, r.level) for r in pages.block_types(df, 612.0, 2000.0).collect()}
    assert [got[i] for i in range(len(cases))] == [(k, v) for _, _, k, v in cases]
    assert {r.block_id: r.kind for r in pages.block_types(df, 612.0, 792.0).collect()}[100] == "Footer"


def chunked(sizes, target, overlap):
    """The greedy rule in a loop."""
    out, now = [], []
    for i, n in enumerate(sizes):
        if now and sum(sizes[j] for j in now) + n > target:
            out.append(now)
            keep, used = [], 0
            for j in reversed(now):
                if used + sizes[j] > overlap:
                    break
                keep.insert(0, j)
                used += sizes[j]
            now = keep
        now = [*now, i]
    return [*out, now] if now else out


def test_chunks_against_a_loop(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for job in ("a", "b", None):
        sizes = [rnd.choice([0, 3, 8, 15, 40, 70]) for _ in range(60)]
        for i, n in enumerate(sizes):
            rows.append((i + (1000 if job == "b" else 5000 if job is None else 0), job, i // 4, i % 4, "x" * 4 * n if n else None, "x", "Heading" if i % 9 == 0 else "Body", None if i % 3 else 0.5, False))
        want[job] = [(c[0] % 1000, c[-1] % 1000) for c in chunked(sizes, 100, 30)]
    rows.append((900, "a", 0, 9, "foot", "foot", "Footer", 1.0, False))
    df = spark.createDataFrame(rows, "block_id long, job_id string, page_index int, block_index int, formatted_text string, recognized_text string, block_type string, confidence double, fragment boolean")
    got = {}
    for r in pages.block_chunks(df, 100, 30).orderBy("job_id", "chunk_index").collect():
        got.setdefault(r.job_id, []).append((r.first_block % 1000, r.last_block % 1000))
        assert r.confidence is None or r.confidence == 0.5
    assert got == want
    assert pages.block_chunks(df.limit(0)).count() == 0


def test_heads_lines_and_hosts(spark):
    df = spark.createDataFrame([("Dr. No met Mr. X. Then he left! More.",), ("no end",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.summary_head(F.col("t"), 5)).collect()] == ["Dr. No met Mr. X. Then he left!", "no end", "", None]
    lines = spark.createDataFrame([("12\nName: Ann\n  A line that says it \nx",), ("Page 3\n-- 4 --",), (None,), ("y" * 90,)], "t string")
    assert [r[0] for r in lines.select(tx.content_line(F.col("t"))).collect()] == ["A line that says it", None, None, "y" * 77 + "..."]
    urls = [("http://localhost:11434/api", True), ("https://127.0.0.1", True), ("http://[::1]:80/", True), ("http://user@localhost/x", True), ("https://localhost.example.org", False), ("http://10.0.0.1", False), ("not a url", False), (None, False)]
    got = spark.createDataFrame(urls, "u string, want boolean").filter(tx.local_endpoint(F.col("u")) != F.col("want")).count()
    assert got == 0
    cut = spark.createDataFrame([("abcdefgh", "abcd"), ("ab", "ab"), ("漢字", "漢"), ("🧠🧠", "🧠"), (None, None), ("", "")], "t string, want string")
    assert cut.filter(~tx.truncated(F.col("t"), 1).eqNullSafe(F.col("want"))).count() == 0
    assert spark.range(1).select(tx.without_count(F.lit("A title (2/5)"))).first()[0] == "A title"
