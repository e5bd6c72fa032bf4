import pytest

from atlasloom.llm import scans

BASE = ["the careful editor moved every meeting to the morning", "a window was open and the lantern was broken again", "the archive needs a careful index before the meeting", "well-known words and two-step plans stay as they are", "every editor found the window and the archive broken"]


def frame(spark, pages):
    rows, n = [], 0
    for page, texts in enumerate(pages):
        for k, t in enumerate(texts):
            rows.append((n, "job", page, k, t, "Body"))
            n += 1
    return spark.createDataFrame(rows, "block_id long, job_id string, page_index int, block_index int, text string, block_type string")


@pytest.fixture(scope="module")
def result(spark):
    pages = [
        [f"{10} Field Handbook", *BASE, "the rneeting was moved to the vvindow", "10"],
        [f"11 Field Handbook", *BASE, "the arch-\nive needs a well-\nknown in­\ndex of two-\nor three-step plans", "11"],
        [f"12  Fielcl Handbook\nthe editor moved on", *BASE, "every meeting was bro-", "p. l2 of 30"],
        ["Field Handbook 13", "ken again and the lan|ern was open", *BASE, "- 13 -"],
    ]
    df = scans.blocks((frame(spark, pages), "text"))
    ids = {(r.page_index, r.block_index): r.block_id for r in df.collect()}
    return ids, df


def test_noise(spark, result):
    ids, df = result
    got = {(r.block_id, r.noise) for r in scans.noise(df).collect()}
    want = {(ids[p, 0], "running_header") for p in range(4)}
    want |= {(ids[0, 7], "page_number"), (ids[1, 7], "page_number"), (ids[2, 7], "page_number"), (ids[3, 7], "page_number"), (ids[2, 7], "misread")}
    want |= {(ids[0, 6], "misread"), (ids[1, 6], "hyphenation"), (ids[2, 6], "hyphenation"), (ids[3, 1], "misread")}
    assert want <= got
    assert {g for g in got - want if g[1] != "misread"} == set()


def test_paragraphs(spark, result):
    ids, df = result
    got = {r.block_id: r.text for r in scans.paragraphs(df).collect()}
    assert got[ids[0, 6]] == "the meeting was moved to the window"
    assert got[ids[1, 6]] == "the archive needs a well-known index of two- or three-step plans"
    assert got[ids[2, 6]] == "every meeting was broken" and got[ids[3, 1]].startswith("again and the")
    assert got[ids[2, 0]] == "the editor moved on"
    assert ids[0, 0] not in got and ids[3, 7] not in got


def test_distance():
    assert scans.distance("rneeting", "meeting") == scans.CHEAP and scans.distance("mvoice", "invoice") == scans.CHEAP
    assert scans.distance("dog", "cat") > 1 and scans.distance("same", "same") == 0


def test_dirty(spark):
    df = spark.createDataFrame([(1, "j", 0, 0, None), (1, "j", 0, 0, None), (2, None, None, None, ""), (3, "j", 0, 1, "x " * 50_000)], "block_id long, job_id string, page_index int, block_index int, text string")
    assert scans.blocks((df, "text")).count() == 3
    assert scans.noise(scans.blocks((df, "text"))).count() == 0
    assert scans.noise(scans.blocks((df.limit(0), "text"))).count() == 0


def test_numbers_in_other_scripts(spark):
    pages = [
        [f"Руководство по архиву {n}", "会議は12日に開かれた。", "Каждый редактор нашёл окно 3", "Η συνάντηση έγινε στις 12.", BASE[0], BASE[n - 11], foot]
        for n, foot in ((12, "стр. 12 из 30"), (13, "第13页"), (14, "14 ページ"), (15, "- 15 -"))
    ]
    # alone on its page a paragraph is both head and foot
    texts = ["会議は12日に開かれた。", "Встреча была 12 мая.\nВсе пришли.", "Το έτος 1821", "第 I 章の始まり"]
    df = scans.blocks((frame(spark, [*pages, *([t] for t in texts)]), "text"))
    ids = {(r.page_index, r.block_index): r.block_id for r in df.collect()}
    got = {(r.block_id, r.noise) for r in scans.noise(df).collect() if r.noise != "misread"}
    assert got == {(ids[p, 0], "running_header") for p in range(4)} | {(ids[p, 6], "page_number") for p in range(4)}
    kept = {r.block_id: r.text for r in scans.paragraphs(df).collect()}
    assert [kept[ids[p, 0]] for p in range(4, 8)] == [t.replace("\n", " ") for t in texts]
    assert all(kept[ids[p, k]] == pages[p][k] for p in range(4) for k in (1, 2, 3))


def test_whole(spark):
    texts = ["One begins", "and goes on", "over the page.", "Two stands alone.", "Three is", "long"]
    rows = [(job, k // 2, k % 2, 100 * j + k, t, t[0].islower()) for j, job in enumerate(["a", "b", None]) for k, t in enumerate(texts)]
    # a job whose rows lie in many ranges, one paragraph of five blocks after the other
    rows += [("c", k // 7, k % 7, 1000 + k, f"W{k}" if k % 5 == 0 else f"w{k}", k % 5 != 0) for k in range(203)]
    df = spark.createDataFrame(rows, "job_id string, page_index int, block_index int, block_id long, text string, goes_on boolean")
    got = {(r.job_id, r.block_id): (r.page_index, r.block_index, r.text, r.blocks) for r in scans.whole(df).collect()}
    want = {}
    for j, job in enumerate(["a", "b", None]):
        want |= {(job, 100 * j): (0, 0, "One begins and goes on over the page.", 3), (job, 100 * j + 3): (1, 1, "Two stands alone.", 1), (job, 100 * j + 4): (2, 0, "Three is long", 2)}
    for k in range(0, 203, 5):
        of = range(k, min(k + 5, 203))
        want["c", 1000 + k] = (k // 7, k % 7, " ".join(f"w{i}" if i % 5 else f"W{i}" for i in of), len(of))
    assert got == want
    assert scans.whole(df.limit(0)).count() == 0
