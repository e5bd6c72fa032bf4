"""Similarity of a set of queries against all rows, in blocks: vectors and word sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import cut
from ..functions import text as tx

#: Rows of a block of vectors.
BLOCK = 4096
#: Ranges of sizes at most.
CLASSES = 64


def nearest_to(vectors: DataFrame, query: list[float], most: int) -> DataFrame:
    """(id, similarity): the ``most`` rows of (id, embedding) nearest to one vector; ties by id. No rows for ``most`` = 0."""
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    fit = vectors.filter(F.size("embedding") == len(query))
    return fit.select("id", tx.cosine(F.col("embedding"), q).alias("similarity")).orderBy(F.col("similarity").desc(), "id").limit(most)


def nearest_join(queries: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """(query_id, id, similarity, place): for each of ``queries`` the ``most`` nearest other rows, exact.

    Both have (id, embedding). Every block of queries meets every block of rows in a task of its own,
    which passes on only its best; ties go to the lesser id. Null and unequal vectors never match.
    """
    blocks = max(1, -(-rows.count() // BLOCK))
    asks = max(1, -(-queries.count() // BLOCK))
    kind = rows.schema["id"].dataType.simpleString()
    q = queries.filter("embedding is not null").select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(asks)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb"))
    # names of its own: both sides may come from one table
    r = rows.filter("embedding is not null").select(F.col("id").alias("r_id"), F.col("embedding").alias("r_embedding"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("r_rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asks - 1).cast("long"))).alias("r_qb"))

    def unit(x: pd.Series) -> np.ndarray:
        m = np.array(list(x), dtype=np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.nan_to_num(np.divide(m, n, out=np.zeros_like(m), where=n > 0))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "id": [], "similarity": []})]
        if left.empty or right.empty:
            return out[0]
        right = right.rename(columns={"r_id": "id", "r_embedding": "embedding"}).sort_values("id")
        for size, some in left.groupby(left["embedding"].map(len)):
            other = right[right["embedding"].map(len) == size]
            if size == 0 or other.empty:
                continue
            ids, b = other["id"].to_numpy(), unit(other["embedding"])
            for at in range(0, len(some), 256):
                part = some.iloc[at : at + 256]
                s = np.clip(unit(part["embedding"]) @ b.T, -1.0, 1.0)
                s[part["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
                k = min(most, s.shape[1])
                top = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :k]
                keep = np.isfinite(np.take_along_axis(s, top, 1))
                out.append(pd.DataFrame({"query_id": np.repeat(part["id"].to_numpy(), k)[keep.ravel()], "id": ids[top].ravel()[keep.ravel()], "similarity": np.take_along_axis(s, top, 1).ravel()[keep.ravel()]}))
        return pd.concat(out)

    best = q.groupBy("qb", "rb").cogroup(r.groupBy("r_qb", "r_rb")).applyInPandas(meet, f"query_id {kind}, id {kind}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "id")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def _classes(cuts: list[int] | None, n: int, block: int) -> tuple[list[tuple[int, float]], int]:
    """Ranges of sizes that hold about as many of ``n`` sets each, and the blocks of a range; few sets are one range."""
    want = max(1, min(CLASSES, -(-n // block)))
    starts = sorted({0, *((cuts[i * CLASSES // want - 1] + 1) for i in range(1, want))}) if cuts else [0]
    ends = [x - 1.0 for x in starts[1:]] + [float("inf")]
    return list(zip(starts, ends)), max(1, -(-n // len(starts) // block))


def closest_words(rows: DataFrame, queries: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, best_id, similarity, class): for each id of ``queries`` the row of the most similar word set.

    ``rows`` is (id, text), ``queries`` (id). Rows with the same set are one class, so copies never
    meet in pairs. Sets lie in ranges of sizes, and only ranges meet whose sizes allow the similarity at
    all: the smaller set has to be ``least`` of the larger one. Each block of asked sets meets each block
    of such sets in a task of its own, as matrices over the words that the asked sets have (as 64-bit
    hashes), and passes on one row per set. Only similarities of
    ``least`` or more count. The least id wins ties; a row is never its own match; without a match best_id
    and similarity are null and the class is 'new'.
    """
    kind = rows.schema["id"].dataType.simpleString()
    # the words of a text are a variable here, so they are made once for both
    made = F.get(F.transform(F.array(tx.tokens(F.col("text"))), lambda t: F.struct(F.sha2(F.concat_ws(" ", t), 256).alias("set"), F.transform(t, lambda w: F.xxhash64(w)).alias("words"))), F.lit(0))
    sets = cut(rows.select("id", made.alias("s")).select("id", "s.set", "s.words")).filter("size(words) > 0")
    wanted = queries.select("id").distinct().withColumn("wanted", F.lit(True))
    reps = sets.join(wanted, "id", "left").groupBy("set").agg(F.min("id").alias("rep"), F.first("words").alias("words"), F.max(F.coalesce("wanted", F.lit(False))).alias("wanted"))
    reps = cut(reps.withColumn("size", F.size("words")))
    cuts = F.array(*[F.lit(i / CLASSES) for i in range(1, CLASSES)])
    seen = reps.agg(
        F.count("*").alias("sets"), F.count_if(F.col("wanted")).alias("asks"),
        F.percentile_approx("size", cuts, 1000).alias("all"), F.percentile_approx(F.when(F.col("wanted"), F.col("size")), cuts, 1000).alias("asked"),
    ).first()
    one, other = _classes(seen["asked"], seen["asks"], BLOCK // 8), _classes(seen["all"], seen["sets"], BLOCK)
    fits = [[i for i, (lo, hi) in enumerate(other[0]) if hi >= least * a and b >= least * lo] for a, b in one[0]]
    back = [[i for i, f in enumerate(fits) if k in f] for k in range(len(other[0]))]
    deal = lambda d, n: F.pmod(F.xxhash64("set", F.lit(d)), F.lit(n)).cast("int")
    kind_of = lambda ranges: F.size(F.filter(F.array(*[F.lit(lo) for lo, _ in ranges]), lambda lo: lo <= F.col("size"))) - 1

    def places(lists: list[list[int]], n: int) -> Column:
        """One row for each block of each class that the class ``c`` meets by ``lists``."""
        met = F.get(F.array(*[F.array(*map(F.lit, x)).cast("array<int>") for x in lists]), F.col("c"))
        return F.explode(F.flatten(F.transform(met, lambda c: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.concat_ws("/", c, k)))))

    q = reps.filter("wanted").withColumn("c", kind_of(one[0])).withColumn("own", F.concat_ws("/", "c", deal(1, one[1])))
    q = q.withColumn("at", places(fits, other[1])).select("set", "words", F.concat_ws("-", "own", "at").alias("meet"))
    r = reps.withColumn("c", kind_of(other[0])).withColumn("own", F.concat_ws("/", "c", deal(2, other[1])))
    r = r.withColumn("at", places(back, one[1])).select(F.col("set").alias("r_set"), "rep", F.col("words").alias("r_words"), F.concat_ws("-", "at", "own").alias("r_meet"))

    def table(words: pd.Series, vocabulary: np.ndarray) -> np.ndarray:
        flat = np.concatenate(list(words)).astype(np.int64)
        row = np.repeat(np.arange(len(words)), words.map(len))
        at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
        have = vocabulary[at] == flat
        out = np.zeros((len(words), len(vocabulary)), np.float32)
        out[row[have], at[have]] = 1
        return out

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if not (left.empty or right.empty):
            right = right.sort_values("rep").reset_index(drop=True)
            size = right["r_words"].map(len).to_numpy()
            for a in range(0, len(left), 64):
                some = left.iloc[a : a + 64]
                n = some["words"].map(len).to_numpy()[:, None]
                vocabulary = np.unique(np.concatenate(list(some["words"])).astype(np.int64))
                one = table(some["words"], vocabulary)
                best: dict[str, tuple[float, object]] = {}
                step = max(16, 8_000_000 // len(vocabulary))
                for b in range(0, len(right), step):
                    part = right.iloc[b : b + step]
                    shared = (one @ table(part["r_words"], vocabulary).T).astype(np.float64)
                    s = shared / (n + size[None, b : b + step] - shared)
                    s[some["set"].to_numpy()[:, None] == part["r_set"].to_numpy()[None, :]] = -1
                    for k, (i, name) in enumerate(zip(s.argmax(1), some["set"])):
                        if s[k, i] >= least and s[k, i] > best.get(name, (0.0,))[0]:
                            best[name] = (s[k, i], part["rep"].iloc[i])
                out += [(name, rep, s) for name, (s, rep) in best.items()]
        return pd.DataFrame(out, columns=["set", "best_id", "similarity"])

    found = q.groupBy("meet").cogroup(r.groupBy("r_meet")).applyInPandas(meet, f"set string, best_id {kind}, similarity double")
    order = Window.partitionBy("set").orderBy(F.col("similarity").desc(), "best_id")
    best = found.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")
    # a copy is the best match there can be: the least id of the class that isn't the row itself
    firsts = Window.partitionBy("set").orderBy("id")
    two = sets.select("set", "id").withColumn("k", F.row_number().over(firsts)).filter("k <= 2").groupBy("set").agg(F.min("id").alias("one"), F.max("id").alias("two"))
    asked = sets.select("id", "set").join(wanted.select("id"), "id", "left_semi")
    out = queries.select("id").join(asked, "id", "left").join(two, "set", "left").join(best, "set", "left")
    copy = F.when(F.col("one") != F.col("id"), F.col("one")).when(F.col("two") != F.col("id"), F.col("two"))
    s = F.when(copy.isNotNull(), 1.0).otherwise(F.col("similarity"))
    return out.select("id", F.coalesce(copy, F.col("best_id")).alias("best_id"), s.alias("similarity"), F.coalesce(tx.similarity_class(s), F.lit("new")).alias("class"))
