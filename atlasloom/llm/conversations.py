"""Rebuilding conversations from message rows.

Messages are dealt by ranges of (session, instant, row_id), so that a session of any size spreads over
many tasks, and sorted inside them. A finite-state automaton walks each stretch of a session from all
its states at once; what it makes of a stretch is a small row, and the rows of a session in order give
the verdict.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import cut, newest

ROLES = ("user", "assistant", "system")
#: Turns in one row of the result; longer sessions come in parts of so many.
TURNS = 10_000
# states: nothing open; a run of user messages waits; it waits and an empty reply came
IDLE, ASKED, HOLLOW = 0, 1, 2


def blank(col: Column) -> Column:
    """Null or nothing but white space and invisible characters."""
    return col.isNull() | col.rlike(r"(?U)^[\s\p{Z}\p{Cc}\p{Cf}͏ᅟᅠ឴឵⠀ㅤ︀-️ﾠ]*$")


def instant(col: Column) -> Column:
    """The instant of a date and time in any of the stored notations, the plain one in UTC; else null."""
    text = F.trim(col)
    form = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?) ?(Z|z|[+-]\d{2}(?::?\d{2})?)?$"
    zone = F.regexp_extract(text, form, 3)
    zone = F.when(zone.rlike(r"^[+-]\d{4}$"), F.regexp_replace(zone, r"(\d{2})$", ":$1")).when(zone.rlike(r"^[+-]\d{2}$"), F.concat(zone, F.lit(":00"))).when(zone.rlike("^[+-]"), zone).otherwise(F.lit("Z"))
    whole = F.concat(F.regexp_extract(text, form, 1), F.lit("T"), F.regexp_extract(text, form, 2), zone)
    return F.when(text.rlike(form), whole.try_cast("timestamp"))


def turns(messages: DataFrame, with_content: bool = True) -> DataFrame:
    """(session_id, row_id, at, role, blank[, content]) of the current messages: of an id the row with the least row_id.

    Rows without an id are messages of their own; rows without a session belong to none and are dropped.
    """
    m = messages.filter("session_id is not null").select(
        F.coalesce(F.concat(F.lit("i"), messages["id"]), F.concat(F.lit("r"), messages["row_id"])).alias("id"),
        "session_id",
        "row_id",
        instant(messages["created_at"]).alias("at"),
        F.coalesce(F.lower(F.regexp_replace("role", r"(?U)^\s+|\s+$", "")), F.lit("")).alias("role"),
        blank(messages["content"]).alias("blank"),
        *(["content"] if with_content else []),
    )
    return newest(m, ["id"], [F.col("row_id").asc_nulls_last()]).drop("id")


def _ranged(df: DataFrame) -> DataFrame:
    keys = ["session_id", "at", "row_id"]
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def step(state: int, role: str, is_blank: bool) -> tuple[int, bool]:
    """The automaton: the next state, and whether a question stays without a reply."""
    if role == "user":
        return ASKED, state == HOLLOW
    if role == "assistant":
        return (IDLE if not is_blank else (IDLE if state == IDLE else HOLLOW)), False
    return state, False


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["session_id", "at", "row_id", "n", "bad", "said", "opener", *[f"{k}{s}" for s in (0, 1, 2) for k in "ef"]]
    kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), *[pa.int32(), pa.bool_()] * 3]
    rows: list[list] = []
    now = None
    for b in batches:
        for sid, at, row_id, role, is_blank in zip(*(b.column(i).to_pylist() for i in range(5))):
            if now is None or now[0] != sid:
                now = [sid, at, row_id, 0, False, False, None, IDLE, False, ASKED, False, HOLLOW, False]
                rows.append(now)
            now[3] += 1
            if role not in ROLES or at is None:
                now[4] = True
            if role in ("user", "assistant"):
                now[5] = now[5] or not is_blank
                if now[6] is None:
                    now[6] = role
                for s in (7, 9, 11):
                    now[s], lost = step(now[s], role, is_blank)
                    now[s + 1] = now[s + 1] or lost
        if len(rows) > 10_000:  # the last goes on in the next batch
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[:-1]), kinds)], names)
            rows = rows[-1:]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


STRETCH = "session_id string, at timestamp, row_id bigint, n bigint, bad boolean, said boolean, opener string, e0 int, f0 boolean, e1 int, f1 boolean, e2 int, f2 boolean"


def faults(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, fault): each session of either table to drop, with the first fault that holds.

    'broken': the id isn't in ``sessions``, a role isn't user, assistant or system, a created_at is
    no date and time, or an assistant opens; 'empty': no user or assistant message has text;
    'missing_reply': a run of user messages isn't followed by a reply with text before the next user
    message or the end. Null session ids are dropped; a session without messages is 'empty'.
    """
    parts = _ranged(turns(messages, with_content=False).select("session_id", "at", "row_id", "role", "blank")).mapInArrow(_stretches, STRETCH)
    listed = parts.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("at", "row_id", "bad", "said", "opener", "e0", "f0", "e1", "f1", "e2", "f2"))).alias("parts"))
    start = F.struct(F.lit(IDLE).alias("state"), F.lit(False).alias("lost"))

    def on(acc, p):
        pick = lambda k: F.when(acc["state"] == 0, p[f"{k}0"]).when(acc["state"] == 1, p[f"{k}1"]).otherwise(p[f"{k}2"])
        return F.struct(pick("e").alias("state"), (acc["lost"] | pick("f")).alias("lost"))

    seen = listed.select(
        "session_id",
        F.exists("parts", lambda p: p["bad"]).alias("bad"),
        F.exists("parts", lambda p: p["said"]).alias("said"),
        F.try_element_at(F.filter(F.transform("parts", lambda p: p["opener"]), lambda o: o.isNotNull()), F.lit(1)).alias("opener"),
        F.aggregate("parts", start, on).alias("end"),
    )
    known = sessions.filter("id is not null").select(F.col("id").alias("session_id"), F.lit(True).alias("known")).distinct()
    both = known.join(seen, "session_id", "full")
    fault = (
        F.when(F.col("known").isNull() | F.coalesce("bad", F.lit(False)) | (F.coalesce("opener", F.lit("")) == "assistant"), "broken")
        .when(~F.coalesce("said", F.lit(False)), "empty")
        .when(F.col("end.lost") | (F.col("end.state") != IDLE), "missing_reply")
    )
    return both.select("session_id", fault.alias("fault")).filter("fault is not null")


def conversations(sessions: DataFrame, messages: DataFrame, most: int = TURNS) -> DataFrame:
    """(session_id, part, parts, turns array<struct<role, content>>): the whole sessions in order, one row each.

    Only a session of more than ``most`` turns comes in several parts, cut at multiples of ``most``, so
    that no row has to hold more; parts count from 0. How the rows were dealt to tasks doesn't show.
    Sessions with a fault are left out, an empty table gives an empty result.
    """
    bad = faults(sessions, messages)
    good = turns(messages).join(bad, "session_id", "left_anti")
    # in the order of the ranges every row has a number; a session's ranges are small rows that carry its count on
    dealt = cut(_ranged(good.select("session_id", "at", "row_id", "role", "content")).select("session_id", "role", "content", F.monotonically_increasing_id().alias("no")))
    dealt = dealt.withColumn("range", F.shiftright("no", 33))
    ranges = dealt.groupBy("session_id", "range").agg(F.min("no").alias("first"), F.count("*").alias("n"))
    all_ = Window.partitionBy("session_id")
    before = all_.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("session_id", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.ceil(F.sum("n").over(all_) / most).cast("int").alias("parts"))
    numbered = dealt.join(carried, ["session_id", "range"]).select("session_id", "parts", (F.col("no") + F.col("shift")).alias("turn"), "role", "content")
    listed = numbered.groupBy("session_id", F.floor(F.col("turn") / most).cast("int").alias("part"), "parts").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("t"))
    return listed.select("session_id", "part", "parts", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"))
