import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from atlasloom.operators import history, knowledge, pages, similarity, state
from atlasloom.sources import files
from atlasloom.streaming import live


def test_vectors(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(60, None), (61, [0.0] * 6), (62, [1.0, 2.0]), (63, [])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {(r.query_id, r.place): r.id for r in similarity.nearest_join(df.filter("id % 20 = 0 and id < 60"), df, 4).collect()}
    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0
    for q in (0, 20, 40):
        best = sorted((-round(cos(rows[q][1], v), 6), i) for i, v in rows if i != q and v and len(v) == 6)[:4]
        assert [got[q, k + 1] for k in range(4)] == [i for _, i in best]
    top = similarity.nearest_to(df, rows[3][1], 1).first()
    assert top.id == 3 and abs(top.similarity - 1) < 1e-6
    assert similarity.nearest_to(df, rows[3][1], 0).count() == 0


def test_word_sets_against_brute_force(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rnd.sample(words, rnd.randint(1, 6)))) for i in range(120)] + [(120, None), (121, ""), (122, "the and"), (123, "w1 w2 w3"), (124, "w3 w2 w1 w1")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r for r in similarity.closest_words(df, df).collect()}
    sets = {i: set(t.split()) - {"the", "and"} if t else set() for i, t in rows}
    for i, s in sets.items():
        best = sorted((-len(s & o) / len(s | o), j) for j, o in sets.items() if j != i and s and o and len(s & o) / len(s | o) >= 0.5)
        if best:
            assert got[i].best_id == best[0][1] and abs(got[i].similarity + best[0][0]) < 1e-9, i
        else:
            assert got[i].best_id is None and got[i]["class"] == "new"


def messages(spark, rows):
    df = spark.createDataFrame([(n, f"m{n}", s, r, c, t, None) for n, (s, r, c, t) in enumerate(rows)], "row_id long, id string, session_id string, role string, content string, created_at string, node_refs string")
    return history.current_messages(df)


def test_history_window(spark):
    m = messages(spark, [("s", "user", "a" * 40, "2025-01-01 00:00:00"), ("s", "assistant", "b" * 20, "2025-01-01 00:00:01"), ("s", "user", "c" * 8, "2025-01-01 00:00:02"), ("t", "user", "漢" * 8, "2025-01-01 00:00:00")])
    ids = lambda b: sorted(r.row_id for r in history.recent(m, b).collect())
    assert ids(20) == [0, 1, 2, 3] and ids(8) == [1, 2, 3] and ids(1) == []


def test_instants(spark):
    cases = [("2025-01-01 00:00:00", 1735689600), ("2025-01-01T00:00:00.000Z", 1735689600), ("2025-01-01T01:00:00.000+01:00", 1735689600), ("0000-00-00 00:00:00", None), ("", None), ("pending", None), (None, None), ("2025-13-01 00:00:00", None)]
    df = spark.createDataFrame(cases, "t string, want long")
    assert df.filter(~F.unix_seconds(history.instant(F.col("t"))).eqNullSafe(F.col("want"))).count() == 0


def test_tiers_of_deleted_containers(spark):
    n = spark.createDataFrame([("n", "v", "s", None), ("m", "gone", None, "local_only")], "id string, vault_id string, sub_vault_id string, privacy_tier string")
    b = spark.createDataFrame([("v", "open", None), ("s", "redacted", datetime(2025, 1, 1))], "id string, privacy_tier string, deleted_at timestamp")
    assert {r.id: r.effective_tier for r in knowledge.with_tiers(n, b).collect()} == {"n": "redacted", "m": "local_only"}
    assert {r.id: r.effective_tier for r in knowledge.with_tiers(n, b, live_only=True).collect()} == {"n": "open", "m": "local_only"}


def test_private_references(spark):
    m = messages(spark, [("s", "user", "x", "2025-01-01 00:00:00")] * 3).drop("node_refs")
    m = m.withColumn("node_refs", F.when(F.col("row_id") == 0, '["n1"]').when(F.col("row_id") == 1, "[").otherwise('["n2"]'))
    t = spark.createDataFrame([("n1", "locked"), ("n2", "open")], "id string, effective_tier string")
    assert sorted(r.row_id for r in history.without_private(m, t).collect()) == [1, 2]


def test_pages(spark):
    rows = [(1, "j", 0, 0.0, 0.0, 10.0, 10.0), (2, "j", 0, 0.0, 12.0, 10.0, 10.0), (3, "j", 0, 0.0, 60.0, 10.0, 10.0), (4, "j", 0, 1.0, 61.0, 9.0, 9.0)]
    b = spark.createDataFrame(rows, "block_id long, job_id string, page_index int, x double, y double, width double, height double")
    assert {r.block_id: r.band for r in pages.bands(b, 18.0).collect()} == {1: 0, 2: 0, 3: 1, 4: 1}
    assert sorted(r.block_id for r in pages.uncovered(b).collect()) == [1, 2, 3]
    assert pages.medians(b).first().height == 10.0
    assert pages.bands(b.limit(0), 18.0).count() == 0


def test_char_weighted_confidence(spark):
    b = spark.createDataFrame([("j", 0, "a" * 200, "Body", 0.95, False), ("j", 0, "x", "Table", 0.01, False), ("k", 0, "x", "Body", None, None)], "job_id string, page_index int, recognized_text string, block_type string, confidence double, fragment boolean")
    got = {r.job_id: r.confidence for r in pages.jobs(b).collect()}
    assert got["j"] > 0.9 and got["k"] is None


def test_state(spark):
    base = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "id string, n int, t string")
    ch = spark.createDataFrame([("b", None, "y"), ("c", 3, None)], "id string, n int, t string")
    assert sorted(map(tuple, state.upserted(base, ch, ["id"]).collect())) == [("a", 1, None), ("b", 2, "y"), ("c", 3, None)]
    diff = {r.id: (r.change, r["columns"]) for r in state.difference(base, ch, "id", ["n", "t"]).collect()}
    assert diff == {"a": ("removed", None), "b": ("changed", "n,t"), "c": ("added", None)}
    f = spark.createDataFrame([(f"f{i}", 30, i) for i in range(3)], "name string, bytes long, made long")
    assert [r.name for r in state.retained(f, 10, 50).collect()] == ["f2"]
    assert sorted(r.name for r in state.retained(f, 2, 500).collect()) == ["f1", "f2"]


def test_snapshots(spark, tmp_path):
    p = str(tmp_path / "t")
    files.snapshot(spark.range(3), p, 1)
    files.snapshot(spark.range(5), p, 2)
    assert files.versions(spark, p) == [1, 2] and files.at_version(spark, p).count() == 5 and files.at_version(spark, p, 1).count() == 3
    with pytest.raises(Exception):
        files.snapshot(spark.range(1), p, 2)
    with pytest.raises(ValueError):
        files.read(spark, p, "csv")


def test_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"light": {"dims": 384, "max_tokens": 512}, "standard": {"dims": 768}}')
    got = {r.model: r.settings for r in files.registry(spark, str(tmp_path / "r.json")).collect()}
    assert got["light"]["dims"] == "384" and set(got) == {"light", "standard"}


def stream(spark, tmp_path, df, name):
    p = str(tmp_path / name)
    df.repartition(1).write.parquet(p)
    return spark.readStream.schema(df.schema).parquet(p)


def run(q, mode, name):
    s = q.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    s.awaitTermination(120)
    return s


def test_stream_equals_batch(spark, tmp_path):
    from atlasloom.operators import usage

    ev = spark.createDataFrame([(i, datetime(2025, 1, 1, i % 5, i % 60), i % 3, "a" if i % 2 else "b", 1.0 * i) for i in range(40)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    run(live.touch_windows(stream(spark, tmp_path, ev, "ev"), "1 hour", "1 day"), "complete", "w")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, usage.tumbling(ev, "1 hour").collect()))


def test_triggers(spark, tmp_path):
    rows = [("s", i, datetime(2025, 1, 1, 0, i)) for i in range(20)] + [("t", 100 + i, datetime(2025, 1, 1, 0, 0, i)) for i in range(14)]
    df = spark.createDataFrame(rows, "session_id string, row_id long, sent timestamp")
    run(live.extraction_triggers(stream(spark, tmp_path, df, "m")), "append", "trig")
    got = sorted((r.session_id, r.row_id) for r in spark.table("trig").collect())
    assert got == [("s", 5), ("s", 11), ("s", 17), ("t", 105)]
