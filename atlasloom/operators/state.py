"""Changes as pure functions over tables, and snapshots of them; nothing is updated in place."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import newest


def upserted(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of those with the same keys; a null in a change keeps the old value."""
    rest = [c for c in base.columns if c not in keys]
    new = changes.select(*keys, *[changes[c].alias(f"__{c}") for c in rest if c in changes.columns], F.lit(True).alias("__new"))
    out = base.withColumn("__old", F.lit(True)).join(new, keys, "full")
    return out.select(*[F.col(c) if c in keys else (F.coalesce(f"__{c}", c).alias(c) if c in changes.columns else F.col(c)) for c in base.columns])


def without(base: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(keys_df.select(*keys).distinct(), keys, "left_anti")


def soft_deleted(base: DataFrame, ids: DataFrame, when) -> DataFrame:
    """Rows of ``ids`` get ``deleted_at``, unless they have one."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return base.join(hit, "id", "left").withColumn("deleted_at", F.when(F.col("__hit") & F.col("deleted_at").isNull(), when).otherwise(F.col("deleted_at"))).select(base.columns)


def last_write(rows: DataFrame, keys: list[str], stamp: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row per key, the one written last; of several the least by the columns of ``ties``."""
    return newest(rows, keys, [F.col(stamp).desc_nulls_last(), *map(F.col, ties)])


def difference(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change, columns): rows 'added', 'removed' or 'changed' between two snapshots, with the names of the changed columns."""
    o = old.select(F.col(key).alias("__k"), *[F.col(c).alias(f"o_{c}") for c in columns])
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in columns])
    j = n.join(o, n[key] == o["__k"], "full")
    names = F.array_compact(F.array(*[F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), F.lit(c)) for c in columns]))
    change = F.when(F.col("__k").isNull(), "added").when(F.col(key).isNull(), "removed").when(F.size(names) > 0, "changed")
    out = j.select(F.coalesce(key, "__k").alias(key), change.alias("change"), F.when(change == "changed", F.array_join(names, ",")).alias("columns"))
    return out.filter("change is not null")


def history_changes(nodes: DataFrame) -> DataFrame:
    """(id, version, changed): what each version of a node changed against the one before; repeated rows count once."""
    one = newest(nodes, ["id", "version"], [])
    w = Window.partitionBy("id").orderBy("version")
    cols = ["title", "summary", "detail", "privacy_tier", "is_archived"]
    lagged = one.select("id", "version", *cols, F.lag("version").over(w).alias("__v"), *[F.lag(c).over(w).alias(f"l_{c}") for c in cols])
    names = F.array_compact(F.array(*[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in cols]))
    return lagged.filter("__v is not null").select("id", "version", F.array_join(names, ",").alias("changed"))


def updated(base: DataFrame, changes: DataFrame, columns: list[str], content: list[str]) -> DataFrame:
    """``base`` (id, version, ..) after partial updates: non-null values of ``changes`` (id, columns..) count, ``version`` grows by one.

    ``reembed`` says whether a column of ``content`` changed; rows without a change keep their version. One row per id in both.
    """
    new = changes.select(F.col("id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    j = base.join(new, base["id"] == new["__id"], "left")
    after = {c: F.coalesce(f"__{c}", c) for c in columns}
    differs = lambda names: functools.reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(after[c]) for c in names], F.lit(False))
    changed = F.coalesce("__hit", F.lit(False)) & differs(columns)
    kept = [after[c].alias(c) if c in after else (F.col("version") + F.when(changed, 1).otherwise(0)).alias("version") if c == "version" else F.col(c) for c in base.columns]
    return j.select(*kept, (changed & differs([c for c in columns if c in content])).alias("reembed"))


def truncated(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """``messages`` (session_id, row_id, sent, content, ..) after ``edits`` (session_id, row_id, content), one per session: the message gets the new text, those behind it go.

    The edited messages are one narrow row per session, so sessions of any size stay dealt as they are.
    """
    at = edits.select("session_id", "row_id", "content").join(messages.select("session_id", "row_id", "sent"), ["session_id", "row_id"])
    at = at.select(F.col("session_id").alias("__s"), F.col("row_id").alias("__r"), F.col("sent").alias("__at"), F.col("content").alias("__text"))
    j = messages.join(at, messages["session_id"] == at["__s"], "left")
    behind = F.coalesce((F.col("sent") > F.col("__at")) | (F.col("sent").eqNullSafe(F.col("__at")) & (F.col("row_id") > F.col("__r"))), F.lit(False))
    edited = F.coalesce(F.col("row_id") == F.col("__r"), F.lit(False))
    return j.filter(~behind).select(*[F.when(edited, F.col("__text")).otherwise(F.col("content")).alias("content") if c == "content" else F.col(c) for c in messages.columns])


def cascaded(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, reference: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents of ``gone`` (key) and without the children that refer to one of them."""
    dead = gone.select(F.col(key).alias("__gone")).distinct()
    return parents.join(dead, parents[key] == dead["__gone"], "left_anti"), children.join(dead, children[reference] == dead["__gone"], "left_anti")


def as_of(history: DataFrame, asked: DataFrame, key: str, when: str, stamp: str, value: Column, name: str) -> DataFrame:
    """``asked`` with ``value`` of the row of ``history`` that held at ``when``: the last of the key written at or before it, as ``name``; null before the first.

    The distinct questions (key, when) meet the key's versions, which are few, and go back as one row each.
    """
    h = history.select(F.col(key).alias("__k"), F.col(stamp).alias("__at"), value.alias("__v"))
    q = asked.select(F.col(key).alias("__q"), F.col(when).alias("__when")).distinct()
    held = q.join(h, (q["__q"] == h["__k"]) & (h["__at"] <= q["__when"])).groupBy("__q", "__when").agg(F.max(F.struct("__at", "__v")).alias("__h"))
    return asked.join(held, asked[key].eqNullSafe(held["__q"]) & asked[when].eqNullSafe(held["__when"]), "left").select(*[asked[c] for c in asked.columns], F.col("__h.__v").alias(name))


def retained(files: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """Of (name, bytes, made) the newest up to ``most`` files and ``most_bytes`` in all; the newest always stays.

    Only the newest ``most`` reach the one window, so it never holds more rows than that.
    """
    files = files.orderBy(F.col("made").desc(), "name").limit(most)
    w = Window.orderBy(F.col("made").desc(), "name").rowsBetween(Window.unboundedPreceding, 0)
    k = files.withColumn("__n", F.count("*").over(w)).withColumn("__b", F.sum("bytes").over(w))
    return k.filter((F.col("__n") == 1) | ((F.col("__n") <= most) & (F.col("__b") <= most_bytes))).drop("__n", "__b")


#: Words, then lines, that are compared one by one; longer texts are compared by lines, still longer ones as a whole.
COMPARED = 300


def changes(old: str | None, new: str | None, most: int = COMPARED) -> list[tuple[str, str]]:
    """(kind, text) stretches that turn ``old`` into ``new``: 'same', 'removed' and 'added', with as much the same as can be."""
    for parts in (lambda t: re.findall(r"\S+", t or ""), lambda t: (t or "").splitlines()):
        a, b = parts(old), parts(new)
        if len(a) <= most and len(b) <= most:
            break
    else:
        a, b = [old or ""], [new or ""]
    # the longest common subsequence of what follows each pair of places
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("same", a[i]))
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or table[i + 1][j] >= table[i][j + 1]):
            out.append(("removed", a[i]))
            i += 1
        else:
            out.append(("added", b[j]))
            j += 1
    return out


def text_changes(df: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """(keys.., place, kind, text): the changes of each pair of texts in order; null counts as empty, equal keys repeat."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["c"] = [changes(o, n) for o, n in zip(b["__old"], b["__new"])]
            e = b[[*keys, "c"]].explode("c").dropna(subset=["c"])
            e["place"] = e.groupby(level=0).cumcount()
            e["kind"], e["text"] = e["c"].str[0], e["c"].str[1]
            yield e[[*keys, "place", "kind", "text"]]

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(old).alias("__old"), F.col(new).alias("__new")).mapInPandas(run, f"{kinds}, place int, kind string, text string")
