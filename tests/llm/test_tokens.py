import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from atlasloom.llm import packing, tokens

PATH = os.path.join(tokens.TOKENIZERS, "byte_bpe_50k")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH + ".tiktoken"), reason="no vocabulary")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH + ".json")
    t.encode_special_tokens = True
    e = tokens.Encoder(PATH + ".tiktoken")

    def run(texts):
        own = [np.frombuffer(x, "<i4").tolist() for x in e.encode(texts)]
        ref = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
        return own, ref

    return run


def test_fixed(both):
    own, ref = both(["", " ", "  a  b\n\n c \n d   e", "<|endoftext|> x", "a\xa0 b", "don't 's x's", "aaaa" * 3000, "x \t y", "\r\n\r\n  foo", "日本語のテキスト。", "\x1c a\x1fb", "👩‍💻 ok", "1234567 ½"])
    assert own == ref


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabcXY'12.!é漢\xa0 "), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_any(both, texts):
    own, ref = both(texts)
    assert own == ref


def test_table(spark):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, None, 6), (3, "", 7), (3, "", 7), (None, "x", 1)], "doc_id long, text string, key int")
    got = sorted(((r.doc_id, r.ids) for r in tokens.encode(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(1, [15496, 995]), (2, []), (3, []), (3, []), (None, [87])], key=str)
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0
    assert {r.doc_id: r.tokens for r in tokens.count(df, "doc_id", "text").collect()}[1] == 2


def test_sum_of_squares():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 700, 5000))[::-1]
    got = packing.sum_of_squares(sizes, 1000)
    fill = np.bincount(got, weights=sizes)
    assert fill.max() <= 1000 and len(fill) <= sizes.sum() / 1000 * 1.02 + 1
    assert packing.sum_of_squares(np.array([], int), 10).tolist() == []
    assert packing.sum_of_squares(np.array([10, 10, 5, 5, 0]), 10).tolist() == [0, 1, 2, 2, 0]


def test_pack(spark):
    rows = [(i, n) for i, n in enumerate([5000, 2048, 2047, 1, 1024, 1024, 0, 0, 4096, 300, 900])] + [(None, 7), (99, None), (1, 2048)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    for shard in (1000, 4):  # one shard, and several that are dealt anew
        got = packing.pack(df, "doc_id", "tokens", 2048, shard).collect()
        per, of = {}, {}
        for r in got:
            per[r.container_id] = per.get(r.container_id, 0) + r["size"]
            of.setdefault(r.doc_id, []).append((r.piece, r["size"]))
        assert max(per.values()) <= 2048 and sum(per.values()) == sum(n or 0 for _, n in rows)
        assert sorted(of[0]) == [(0, 2048), (1, 2048), (2, 904)] and sorted(of[8]) == [(0, 2048), (1, 2048)] and of[99] == [(0, 0)] and len(of[1]) == 2
        assert len(per) <= -(-sum(per.values()) // 2048) + (1 if shard == 1000 else 4)
    assert packing.pack(df.limit(0), "doc_id", "tokens", 2048).count() == 0


def test_shards_in_tasks_of_their_own(spark):
    """Small rows too: shards aren't put together into one task, and items that leave every container open end the dealing."""
    df = spark.range(4000).selectExpr("id as doc_id", "cast(1100 + id % 7 as long) as tokens")
    got = packing.pack(df, "doc_id", "tokens", 2048, 500)
    assert got.count() == got.select("container_id").distinct().count() == 4000
    small = packing.pack(spark.range(4000).selectExpr("id as doc_id", "cast(1 + id * 37 % 900 as long) as tokens"), "doc_id", "tokens", 2048, 500)
    total, used = small.agg({"size": "sum"}).first()[0], small.select("container_id").distinct().count()
    assert used <= total / 2048 * 1.02 + 2
