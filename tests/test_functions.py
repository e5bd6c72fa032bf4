from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlasloom.functions import priority, privacy
from atlasloom.functions import text as tx


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_tiers(spark):
    rows = [("open", "locked", None, "locked"), ("redacted", "open", None, "redacted"), ("open", "locked", "redacted", "redacted"), ("odd", None, None, "open"), (None, "local_only", "open", "local_only")]
    df = spark.createDataFrame(rows, "n string, s string, v string, want string")
    assert df.filter(privacy.strictest(F.col("n"), F.col("s"), F.col("v")) != F.col("want")).count() == 0


def test_policies(spark):
    want = {"open": ("full", "full", "full", "full"), "local_only": ("omit", "full", "full", "full"), "locked": ("stub", "stub", "full", "full"), "redacted": ("omit", "omit", "omit", "omit")}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    t = F.col("t")
    got = {r[0]: tuple(r[1:]) for r in df.select("t", privacy.policy(t, "cloud"), privacy.policy(t, "local"), privacy.policy(t, "local", True), privacy.policy(t, "unrestricted")).collect()}
    assert got == want


def test_scores(spark):
    cases = [(0, 0, "standard", 0.1), (50, 0, "standard", 0.8), (50, 0, "slow", 1.0), (50, 0, "fast", 0.4), (0, 0, "pinned", 1.0), (3, 100, "slow", 0.5), (3, 4, "slow", 0.5), (3, 0, "slow", 0.3)]
    df = spark.createDataFrame(cases, "n long, links long, p string, want double")
    assert df.filter(F.abs(priority.score(F.col("n"), F.col("links"), F.col("p")) - F.col("want")) > 1e-9).count() == 0


def test_rollover(spark):
    arr = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<bigint>")
    r = one(spark, priority.pushed(arr([3, 2, 1]), F.lit(5), F.lit(True)), priority.pushed(arr([5, 3]), F.lit(0), F.lit(True)), priority.pushed(arr([1] * 95), F.lit(2), F.lit(True)), priority.pushed(arr([5, 3]), F.lit(3), F.lit(False)), priority.pushed(F.lit(None).cast("array<bigint>"), F.lit(3), F.lit(False)))
    assert r[0] == [5, 3, 2, 1] and r[1] == [0, 5, 3] and len(r[2]) == 90 and r[3] == [5, 3] and r[4] == []
    r = one(spark, priority.total(priority.pushed(arr([1] * 40), F.lit(2), F.lit(True)), 30), priority.total(priority.pushed(arr([1] * 40), F.lit(2), F.lit(True)), 90))
    assert tuple(r) == (31, 42)


def test_malformed_priority(spark):
    df = spark.createDataFrame([("{score:",), ("",), (None,), ('{"score":0.5,"access_history":[1,2]}',)], "j string")
    assert [r.p.access_history if r.p else None for r in df.select(priority.parsed(F.col("j")).alias("p")).collect()][-1] == [1, 2]


def test_words(spark):
    r = one(spark, tx.tokens(F.lit("The Quick-quick isn't Über 42!")), tx.tokens(F.lit(None).cast("string")), tx.jaccard(tx.tokens(F.lit("apple banana")), tx.tokens(F.lit("banana orange"))), tx.jaccard(tx.tokens(F.lit("")), tx.tokens(F.lit(""))), tx.overlap(tx.tokens(F.lit("")), tx.tokens(F.lit("the"))))
    assert r[0] == ["42", "quick", "über"] and r[1] == [] and abs(r[2] - 1 / 3) < 1e-9 and r[3] == 0.0 and r[4] == 1.0


def test_classes(spark):
    df = spark.createDataFrame([(0.9, "update"), (0.85, "flag"), (0.5, "flag"), (0.49, "new")], "s double, want string")
    assert df.filter(tx.similarity_class(F.col("s")) != F.col("want")).count() == 0


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(y)).cast("float") for y in x])
    none = F.lit(None).cast("array<float>")
    r = one(spark, tx.cosine(v(1, 2), v(1, 2)), tx.cosine(v(1, 0), v(-1, 0)), tx.cosine(v(1, 0), v(0, 1)), tx.cosine(v(0, 0), v(1, 1)), tx.cosine(v(1), v(1, 1)), tx.cosine(none, v(1)), tx.cosine(v(1, 0), v(2**-0.5, 2**-0.5)), tx.cosine(v(float("nan")), v(1)))
    for got, want in zip(r, [1, -1, 0, 0, 0, 0, 0.70710678, 0]):
        assert abs(got - want) < 1e-6


def test_corrections(spark):
    cases = [("Actually, it is green", None, "actually", None), ("wait, no", None, "wait,", None), ("I meant green", "x", "i meant", None), ("It is not blue, it's green", "My favorite color is blue", None, "blue"), ("tell me more", "about blue", None, None), ("factually wrong", None, None, None)]
    df = spark.createDataFrame(cases, "m string, p string, phrase string, neg string")
    got = df.select(tx.correction(F.col("m")).eqNullSafe(F.col("phrase")), tx.negated(F.col("m"), F.col("p")).eqNullSafe(F.col("neg")), "m", tx.correction(F.col("m"))).collect()
    assert all(r[0] and r[1] for r in got), got


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from(["apple", "pear", "plum", "fig", "the", "Kiwi"]), max_size=8), st.lists(st.sampled_from(["apple", "pear", "plum", "fig", "the", "Kiwi"]), max_size=8))
def test_jaccard_is_symmetric(spark, a, b):
    x, y = tx.tokens(F.lit(" ".join(a))), tx.tokens(F.lit(" ".join(b)))
    r = one(spark, tx.jaccard(x, y), tx.jaccard(y, x))
    sa, sb = ({w.lower() for w in s} - {"the"} for s in (a, b))
    assert r[0] == r[1] and abs(r[0] - (len(sa & sb) / len(sa | sb) if sa and sb else 0)) < 1e-12


def test_titles_marks_fences(spark):
    r = one(spark, tx.title(F.lit("x" * 41)), tx.title(F.lit(" short ")), tx.xml(F.lit("<a & \"b\" 'c'>"), True), tx.xml(F.lit("<a & b>")), tx.unfenced(F.lit('```json\n{"a":1}\n```')), tx.estimate(F.lit("Hi")), tx.estimate(F.lit(None).cast("string")), tx.sentences(F.lit("One. Two! Three")), tx.collapsed(F.lit("a   b \n c")))
    assert tuple(r) == ("x" * 40 + "...", "short", "&lt;a &amp; &quot;b&quot; &apos;c&apos;&gt;", "&lt;a &amp; b&gt;", '{"a":1}', 1, 0, ["One.", "Two!", "Three"], "a b\nc")
