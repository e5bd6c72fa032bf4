"""Filling containers of a fixed capacity, by sum of squares.

A document goes where the squared counts of open containers per residual gap become smallest.
Documents are dealt to shards of a bounded number of documents, packed one at a time, largest first, in
as many tasks as there are shards; the containers that stay open are dealt anew to fewer shards until one
is left or dealing anew no longer helps, so no task ever holds more than a shard and little space is lost
between shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut

#: Documents that one task packs.
SHARD = 65_536
#: A container is dealt anew if more than this part of it is unused.
OPEN = 0.01
#: Dealing anew goes on while a round leaves at most this part of its items in open containers.
SHRINKS = 0.95


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each size in the given order; sizes of 0 lie in container 0 and take no space."""
    counts = np.zeros(capacity + 1, np.int64)  # open containers by gap
    open_: dict[int, list[int]] = {}
    out, made = np.zeros(len(sizes), np.int64), 0
    never = np.iinfo(np.int64).max
    for k, s in enumerate(map(int, sizes)):
        if s == 0:
            continue
        # gap h becomes h - s: the change of the sum of squares, by h from s on
        change = 2 * (counts[: capacity + 1 - s] - counts[s:]) + 2
        change[0] = 1 - 2 * counts[s]
        change[counts[s:] == 0] = never
        change[capacity - s] = 2 * counts[capacity - s] + 1 if s < capacity else 0  # a new container
        h = int(change.argmin()) + s
        if h == capacity:
            b, made = made, made + 1
        else:
            b = open_[h].pop()
            counts[h] -= 1
        if h > s:
            counts[h - s] += 1
            open_.setdefault(h - s, []).append(b)
        out[k] = b
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int, shard: int = SHARD) -> DataFrame:
    """(key, piece int, size, container_id): every item in one container, unless it is larger than ``capacity``.

    A larger item is cut into pieces of exactly ``capacity``, each a container of its own, and the
    rest, which is packed like an item. Null and negative sizes count as 0; items of size 0 share a
    container. Repeated rows are packed each for itself, null keys like others, other columns are
    dropped. An empty table gives an empty result.
    """
    spark, kind = items.sparkSession, items.schema[key].dataType.simpleString()
    n = F.greatest(F.coalesce(items[size].cast("long"), F.lit(0)), F.lit(0))
    cutting = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("long"))
    left = cut(
        items.select(items[key].alias("key"), n.alias("n"))
        .select("key", "n", F.explode(cutting).alias("piece"))
        .select("key", F.col("piece").cast("int").alias("piece"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("size"))
        .select("*", F.monotonically_increasing_id().alias("row"))
    )
    layout = f"key {kind}, piece int, size bigint, row bigint, shard bigint, local bigint, gap bigint"

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "row"], ascending=[False, True], kind="stable")
        pdf["local"] = sum_of_squares(pdf["size"].to_numpy(), capacity)
        pdf["gap"] = capacity - pdf.groupby("local")["size"].transform("sum")
        return pdf[["key", "piece", "size", "row", "shard", "local", "gap"]]

    out, turn, n, before = [], 0, left.count(), None
    while True:
        shards = max(1, -(-n // shard))
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(shards)))
        # small rows: without a number of its own Spark would put many shards into one task
        packed = cut(dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(run, layout))
        name = F.lit(turn << 56).bitwiseOR(F.shiftleft("shard", 24)).bitwiseOR(F.col("local"))
        named = lambda d, name=name: d.select("key", "piece", "size", name.alias("container_id"))
        again = packed.filter(F.col("gap") > OPEN * capacity)
        before, n = n, 0 if shards == 1 else again.count()
        if n == 0 or n > SHRINKS * before:  # one shard, all closed, or items that only fit so
            out.append(named(packed))
            break
        out.append(named(packed.filter(F.col("gap") <= OPEN * capacity)))
        left, turn = again.select("key", "piece", "size", "row"), turn + 1
    result = out[0]
    for o in out[1:]:
        result = result.union(o)
    return result.withColumnRenamed("key", key)
