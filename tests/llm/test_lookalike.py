from atlasloom.llm import lookalike as k

SAME = [
    ("Ｆｕｌｌ　ｗｉｄｔｈ１", "Full width1"), ("ﬁne ﬂow oﬀ", "fine flow off"), ("a b c", "a b c"), ("café", "café"), ("ze​ro⁠", "zero"), ("раѕѕ", "pass"), ("Αlpha", "Alpha"),
    ("non‑breaking", "non-breaking"), ("soft­hyphen", "softhyphen"), ("line\r\nend", "line\nend"), ("a b  \n", "a b"), ("ё", "ë"), ("﻿x", "x"), ("ｶﾞ", "ガ"), ("K", "K"), ("a‍z", "az"),
    ("ᎪᏴᏟ", "ABC"), ("ⲟⲥ", "oc"), ("ꓮꓐ", "AB"), ("ɩ", "i"), ("Ӏ", "I"), ("ρ", "p"),
]
DIFFERENT = ["x²", "x2", "₁", "1", "①", "½", "1/2", "é", "e", "E", "ñ", "n", "👩‍💻", "👩💻", "❤️", "💙", "™", "TM", "ª", "a", "й", "и", "a  b", "a b"]


def form(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.form for r in k.one_form(df, "doc_id", "text").collect()}


def test_same(spark):
    got = form(spark, [t for pair in SAME for t in pair])
    for i, pair in enumerate(SAME):
        assert got[2 * i] == got[2 * i + 1], pair


def test_different(spark):
    got = form(spark, DIFFERENT)
    assert len(set(got.values())) == len(DIFFERENT)


def test_stable(spark):
    texts = [t for pair in SAME for t in pair] + DIFFERENT
    once = form(spark, texts)
    twice = form(spark, [once[i] for i in range(len(texts))])
    assert once == twice


def test_pairs(spark):
    rows = [(1, "pass"), (2, "раѕѕ"), (3, "pass"), (4, None), (5, ""), (6, "​"), (7, " "), (8, "ｐass"), (9, "Pass")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.a, r.b) for r in k.same_look(df, "doc_id", "text").collect()}
    assert got == {(1, 2), (2, 3), (1, 8), (2, 8), (3, 8)}
    assert k.same_look(df.limit(0), "doc_id", "text").count() == 0


def test_nulls_and_long(spark):
    df = spark.createDataFrame([(None, "ｘ" * 300_000), (1, None), (1, None)], "doc_id long, text string")
    got = [(r.doc_id, r.form and len(r.form)) for r in k.one_form(df, "doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(None, 300_000), (1, None), (1, None)], key=str)


def test_no_character_is_reserved(spark):
    """The private characters that stand for a joiner meanwhile stay what they are, with and without joiners beside them."""
    texts = [f"x{a}{b}y" for a in "\ue0ff\ue0fe\ue0fd" for b in "\ue0ff\ue0fe\ue0fd"] + ["x\ue0ffy", "👩\u200d💻 \ue0ff\ue0fd", "👩\u200d💻\ue0ff\ue0fe"]
    got = form(spark, texts)
    assert [got[i] for i in range(len(texts))] == texts


def test_hot_form(spark):
    """A form with many copies is dealt to several tasks and loses no pair."""
    rows = [(i, "pass" if i % 3 else "раѕѕ") for i in range(60)] + [(1, "pass")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if (a % 3 == 0) != (b % 3 == 0)}
    for share in (7, 1000):
        got = [(r.a, r.b) for r in k.same_look(df, "doc_id", "text", share).collect()]
        assert len(got) == len(want) and set(got) == want
