import random

from atlasloom.llm import conversations as c

A = "assistant"


def frame(spark, rows):
    """(session, role, content[, created_at]) in order of arrival."""
    data = [(n, f"m{n}", r[0], r[1], r[2], r[3] if len(r) > 3 else f"2025-01-01 00:{n // 60:02d}:{n % 60:02d}", 0) for n, r in enumerate(rows)]
    return spark.createDataFrame(data, "row_id long, id string, session_id string, role string, content string, created_at string, blank int")


def found(spark, ids, rows):
    s = spark.createDataFrame([(i,) for i in ids], "id string")
    return {r.session_id: r.fault for r in c.faults(s, frame(spark, rows)).collect()}


def test_faults(spark):
    rows = [
        ("ok", " User", "q"), ("ok", "SYSTEM", None), ("ok", A, "a"), ("ok", "user", None), ("ok", A, "b"),
        ("stray", "user", "q"), ("stray", A, "a"),
        ("role", "user", "q"), ("role", "usr", "a"),
        ("null_role", "user", "q"), ("null_role", None, "a"),
        ("time", "user", "q"), ("time", A, "a", "pending"),
        ("opens", "system", "x"), ("opens", A, "hi"), ("opens", "user", "q"), ("opens", A, "a"),
        ("blank", "user", "​ \xa0"), ("blank", A, "\n"), ("blank", "system", "text"),
        ("end", "user", "q"), ("end", A, "a"), ("end", "user", "q2"),
        ("hollow", "user", "q"), ("hollow", A, " "), ("hollow", "user", "q2"), ("hollow", A, "a"),
        ("late", "user", "q"), ("late", A, " "), ("late", "system", "s"), ("late", A, "a"),
        ("run", "user", "q"), ("run", "system", "s"), ("run", "user", "q2"), ("run", A, "a"),
    ]
    got = found(spark, ["ok", "role", "null_role", "time", "opens", "blank", "end", "hollow", "late", "run", "nothing", None], rows)
    assert got == {"stray": "broken", "role": "broken", "null_role": "broken", "time": "broken", "opens": "broken", "blank": "empty", "end": "missing_reply", "hollow": "missing_reply", "nothing": "empty"}


def test_order_and_deliveries(spark):
    rows = [("s", A, "a", "2025-01-01T02:00:00.000+01:00"), ("s", "user", "q", "2025-01-01 00:30:00"), ("s", "system", "tie 1", "2025-01-01T01:00:00.000Z")]
    df = frame(spark, rows)
    again = df.filter("row_id = 1").selectExpr("row_id + 10 as row_id", "id", "session_id", "'usr' as role", "content", "created_at", "blank")
    s = spark.createDataFrame([("s",)], "id string")
    got = sorted(c.conversations(s, df.unionByName(again)).collect(), key=lambda r: r.part)
    assert [(t.role, t.content) for r in got for t in r.turns] == [("user", "q"), (A, "a"), ("system", "tie 1")]


def test_against_walk(spark):
    rnd = random.Random(5)
    rows = [(f"s{rnd.choice([0, 0, 0, 1, 2, 3, 4])}", rnd.choice(["user", A, A, "system"]), rnd.choice(["x", "x", "x", ""])) for _ in range(400)]
    rows = [(f"t{i}", "user", "q") for i in range(3)] + rows
    want = {}
    for sid in {r[0] for r in rows}:
        mine = [(r, t) for s, r, t in rows if s == sid and r != "system"]
        if mine and mine[0][0] == A:
            want[sid] = "broken"
        elif not any(t for _, t in mine):
            want[sid] = "empty"
        else:
            for i, (r, _) in enumerate(mine):
                if r == "user" and (i + 1 == len(mine) or mine[i + 1][0] == A):
                    replies = []
                    for r2, t2 in mine[i + 1 :]:
                        if r2 == "user":
                            break
                        replies.append(t2)
                    if not any(replies):
                        want[sid] = "missing_reply"
    assert found(spark, {r[0] for r in rows}, rows) == want


def test_long_session_in_parts(spark):
    rows = [("s", "user" if n % 2 == 0 else A, f"{n}", f"2025-01-{1 + n // 1440:02d} {n // 60 % 24:02d}:{n % 60:02d}:00") for n in range(2600)]
    rows += [(f"t{k}", "user" if n % 2 == 0 else A, f"{n}") for k in range(40) for n in range(4)]
    s = spark.createDataFrame([("s",), *((f"t{k}",) for k in range(40))], "id string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "7", "40"):  # however the rows are dealt
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = sorted(c.conversations(s, frame(spark, rows), 1000).collect(), key=lambda r: (r.session_id, r.part))
            assert [(r.session_id, r.part, r.parts, len(r.turns)) for r in got] == [("s", 0, 3, 1000), ("s", 1, 3, 1000), ("s", 2, 3, 600), *((f"t{k}", 0, 1, 4) for k in sorted(range(40), key=str))]
            assert [t.content for r in got[:3] for t in r.turns] == [str(n) for n in range(2600)]
            assert all([t.content for t in r.turns] == ["0", "1", "2", "3"] for r in got[3:])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_empty(spark):
    s = spark.createDataFrame([], "id string")
    assert c.faults(s, frame(spark, [("x", "user", "q")]).limit(0)).count() == 0
    assert c.conversations(s, frame(spark, [("x", "user", "q")]).limit(0)).count() == 0
