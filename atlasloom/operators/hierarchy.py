"""Parent-child rows to full hierarchies by peeling.

Every round removes the leaves (rows without children left), which send their subtree size to their
parent. A tree of depth d would take d rounds, so a round also splices out some rows that have a
single child, never two neighbours: the child takes over the edge, with the spliced ids noted on it.
Rounds then grow with the logarithm of the rows, however deep the chains are. Rows on a circle never
become leaves; splicing shrinks each circle to one row that is its own parent, the residue. Going
through the rounds backwards gives every row its path, depth and root from the row it hung on.

Descendants come out as rows (ancestor, descendant, steps), never as one list per ancestor: a root
may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..common import cut, newest, strip, written


def current_links(*tables: tuple[DataFrame, str]) -> DataFrame:
    """(id, parent) of the current rows over all ``tables`` of (rows with id and updated_at, name of the parent column).

    Of rows with the same id the greatest updated_at counts (null is the least), ties fall to the
    least content hash. Surrounding white space of a parent doesn't count; blank is no parent. Rows
    with a null id are dropped. Other columns are ignored, whatever their names.
    """
    links = None
    for df, parent in tables:
        part = df.select(F.col("id").cast("string"), F.col(parent).cast("string").alias("parent"), F.col("updated_at"))
        links = part if links is None else links.unionByName(part)
    one = newest(links, ["id"], [F.col("updated_at").desc_nulls_last()])
    return one.select("id", F.nullif(strip("parent"), F.lit("")).alias("parent"))


def _draw(col):
    """A number by which neighbours differ, new in each round."""
    return F.xxhash64(F.col(col), F.col("turn"))


def _event(key: str, own: list[tuple[str, str, Column]], fewer=None, more=None, child=None, when=None) -> Column:
    """What one row tells another, or itself: ``own`` passes a row on, the numbers change it."""
    n = lambda x: F.lit(None).cast("bigint") if x is None else x.cast("bigint")
    e = F.struct(F.col(key).alias("no"), *[v.alias(c) for c, _, v in own], n(fewer).alias("fewer"), n(more).alias("more"), n(child).alias("child"))
    return e if when is None else F.when(when, e)


def _peel(left: DataFrame, with_path: bool) -> DataFrame:
    """One round: rows of ``left`` with what their neighbours sent them; ``off`` marks those that go now.

    Rows are numbers, so the aggregate that gathers the messages is one by hash.
    """
    way = ["id", "via"] if with_path else []
    above = left.select(F.col("no").alias("up"), *[F.col(c).alias(f"a_{c}") for c in ("up", "kids", "steps", "size", *way)])
    seen = left.join(above, "up", "left")
    leaf = F.col("kids") == 0
    # the parent has this child alone and isn't the top; of neighbours the one with the least draw goes
    middle = (F.col("kids") > 0) & (F.col("a_kids") == 1) & F.col("a_up").isNotNull()
    no_circle_of_its_own = (F.col("a_up") != F.col("up")) & (F.col("up") != F.col("no"))
    least = (_draw("up") < _draw("a_up")) & ((F.col("kids") != 1) | (_draw("up") < _draw("no")))
    ok = middle & no_circle_of_its_own & least
    seen = seen.withColumn("splice", F.coalesce(ok, F.lit(False)))
    splice = F.col("splice")
    own = [
        ("turn", "bigint", F.col("turn") + 1),
        ("up", "bigint", F.when(splice, F.col("a_up")).otherwise(F.col("up"))),
        ("lost", "bigint", F.col("lost")),
        ("steps", "bigint", F.when(splice, F.col("a_steps") + F.col("steps")).otherwise(F.col("steps"))),
        ("size", "bigint", F.col("size")),
        ("kids", "bigint", F.col("kids")),
    ]
    own += [("id", "string", F.col("id")), ("via", "array<string>", F.when(splice, F.concat("a_via", F.array("a_id"), "via")).otherwise(F.col("via")))] if with_path else []
    none = [(c, kind, F.lit(None).cast(kind)) for c, kind, _ in own]
    one = F.lit(1)
    events = F.array(
        _event("no", own),
        _event("up", none, one, F.col("size"), when=leaf & F.col("up").isNotNull()),  # a leaf goes
        _event("up", none, child=F.col("no"), when=splice),  # the row between is told that it goes
        _event("a_up", none, None, F.col("a_size"), when=splice),  # and its size goes on
    )
    got = seen.select(F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("e.*").groupBy("no")
    summed = got.agg(*[F.max(c).alias(c) for c, _, _ in own], *[F.sum(c).alias(c) for c in ("fewer", "more")], F.max("child").alias("child"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return summed.select(
        "no", "turn", "up", "lost", "steps", (F.col("size") + z("more")).alias("size"), (F.col("kids") - z("fewer")).alias("kids"), *way,
        "child", ((F.col("kids") == 0) | F.col("child").isNotNull()).alias("off"),
    )


def _written_counting(df: DataFrame, what) -> tuple[DataFrame, int]:
    """``df`` cut, and for how many of its rows ``what`` holds, without a job of its own."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(what).alias("n")))
    return out, seen.get["n"]


def hierarchy(links: DataFrame, with_path: bool = True) -> DataFrame:
    """(id, parent, root_id, depth, state, subtree, path) for unique ids in (id, parent).

    state: 'cycle' on a circle (a row that is its own parent included), 'below_cycle' if the
    ancestors lead into one, 'orphan' if the topmost row refers to an id that isn't there, else
    'tree'. root_id: the topmost row, for circles the least id on it. depth: steps to the root, for
    'below_cycle' to the first id on the circle, for 'cycle' 0. path: ids from the root (for
    'below_cycle' from the circle's first met id; for 'cycle' the id alone) to the row, left out
    unless ``with_path``. subtree: how many rows hang below, the row included; null on a circle. An
    empty input gives an empty result.
    """
    spark = links.sparkSession
    # rows get numbers, which are written so that they stay the same
    base = cut(links.select("id", "parent", F.monotonically_increasing_id().alias("no")))
    above = base.select(F.col("id").alias("parent"), F.col("no").alias("up"))
    linked = base.join(above, "parent", "left").select("no", "up", (F.col("up").isNull() & F.col("parent").isNotNull()).cast("bigint").alias("lost"), *(["id"] if with_path else []))
    null, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    way = lambda c: [c.alias("id")] if with_path else []
    # every row tells itself what it is, and its parent that it has a child
    zero = F.lit(0).cast("bigint")
    itself = F.struct("no", "up", "lost", zero.alias("kid"), *way(F.col("id") if with_path else text))
    parent = F.struct(F.col("up").alias("no"), null.alias("up"), null.alias("lost"), F.lit(1).cast("bigint").alias("kid"), *way(text))
    told = F.filter(F.array(itself, F.when(F.col("up").isNotNull(), parent)), lambda e: e.isNotNull())
    sums = [F.max("up").alias("up"), F.max("lost").alias("lost"), F.sum("kid").alias("kids")]
    sums += [F.max("id").alias("id")] if with_path else []
    start = linked.select(F.explode(told).alias("e")).select("e.*").groupBy("no").agg(*sums)
    one = F.lit(1).cast("bigint")
    start = start.select("no", F.lit(0).cast("bigint").alias("turn"), "up", "lost", one.alias("steps"), one.alias("size"), "kids", *(["id", F.array().cast("array<string>").alias("via")] if with_path else []))
    at_work = F.col("up").isNull() | (F.col("up") != F.col("no"))
    left, n = _written_counting(start, at_work)
    gone: list[DataFrame] = []
    while n:
        after, n = _written_counting(_peel(left, with_path), ~F.col("off") & at_work)
        gone.append(after.filter("off"))
        left = after.filter("not off").drop("child", "off")
    # what is left are circles, each one row that is its own parent
    path = (lambda col: [col.alias("path")]) if with_path else (lambda col: [])
    rings = left.select("no", null.alias("root"), F.col("no").alias("ring"), F.lit(True).alias("on"), F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("lost"), null.alias("subtree"), *path(F.array("id") if with_path else None))
    done, layout = [written(rings)], rings.schema
    for out in reversed(gone):
        have = spark.read.schema(layout).parquet(*done)  # one scan, however many rounds
        # every row hangs on a row that went later; a spliced row also asks the child it had
        up = have.select(F.col("no").alias("up"), F.struct(*[c for c in have.columns if c != "no"]).alias("p"))
        child = have.select(F.col("no").alias("child"), F.col("on").alias("c_on"), F.col("subtree").alias("c_subtree"))
        got = out.join(up, "up", "left").join(child, "child", "left")
        on = F.coalesce("c_on", F.lit(False))
        first = F.col("up").isNull()
        new = got.select(
            "no",
            F.when(first, F.col("no")).otherwise(F.col("p.root")).alias("root"),
            F.col("p.ring").alias("ring"),
            on.alias("on"),
            F.when(first | on, 0).otherwise(F.col("p.depth") + F.col("steps")).cast("bigint").alias("depth"),
            F.when(first, F.col("lost")).otherwise(F.col("p.lost")).alias("lost"),
            F.when(on, None).otherwise(F.col("size") + F.coalesce("c_subtree", F.lit(0))).alias("subtree"),
            *path(F.when(first | on, F.array("id")).otherwise(F.concat("p.path", "via", F.array("id"))) if with_path else None),
        )
        done.append(written(new))
    have = spark.read.schema(layout).parquet(*done).join(base, "no")
    # the root of a circle is the least id on it
    names = base.select(F.col("no").alias("root"), F.col("id").alias("root_id"))
    least = have.filter("on").groupBy(F.col("ring").alias("root")).agg(F.min("id").alias("root_id"))
    roots = names.unionByName(least.select((-F.col("root") - 1).alias("root"), "root_id"))
    state = F.when(F.col("on"), "cycle").when(F.col("ring").isNotNull(), "below_cycle").when(F.col("lost") == 1, "orphan").otherwise("tree")
    rooted = have.withColumn("root", F.coalesce(-F.col("ring") - 1, "root")).join(roots, "root")
    return rooted.select("id", "parent", "root_id", "depth", state.alias("state"), "subtree", *path(F.col("path")))


def descendants(tree: DataFrame) -> DataFrame:
    """(id, descendant_id, steps): one row for each pair of a row and one below it, from the paths of ``hierarchy``.

    Rows on circles have no proper descendants among the circle, only those that hang below it.
    """
    up = tree.select("id", F.posexplode("path").alias("at", "above"), F.size("path").alias("n"))
    return up.filter(F.col("at") < F.col("n") - 1).select(F.col("above").alias("id"), F.col("id").alias("descendant_id"), (F.col("n") - 1 - F.col("at")).cast("long").alias("steps"))
