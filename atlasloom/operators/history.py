"""Conversations as a table: windows of history, earlier messages, corrections, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import newest, previous, running
from ..functions import text as tx


def instant(text: Column) -> Column:
    """The instant of the stored notations: plain in UTC, or with Z or an offset; else null."""
    t = F.trim(text)
    form = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
    return F.when(t.rlike(form), F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z"))).try_cast("timestamp"))


def current_messages(messages: DataFrame) -> DataFrame:
    """Of a message id the row that arrived first, with its instant ``sent`` and plain ``speaker``."""
    one = newest(messages, ["id"], [F.col("row_id").asc_nulls_last()])
    return one.withColumn("sent", instant(F.col("created_at"))).withColumn("speaker", F.lower(F.regexp_replace("role", r"(?U)^\s+|\s+$", "")))


def recent(messages: DataFrame, budget: int) -> DataFrame:
    """(session_id, row_id, tokens, used): the newest messages of each session whose estimated tokens fit into ``budget`` together.

    The sum only grows, so taking all rows within it is the same as stopping at the first that
    overflows. Rows without an instant come last in age order. Ties go to the greater row_id.
    """
    cost = messages.select("session_id", "row_id", "sent", tx.estimate(F.col("content")).alias("tokens"))
    used = running(cost, ["session_id"], [F.col("sent").desc_nulls_last(), F.col("row_id").desc()], {"used": F.col("tokens")})
    return used.filter(F.col("used") <= budget).select("session_id", "row_id", "tokens", "used")


def latest(messages: DataFrame, speaker: str = "user") -> DataFrame:
    """(session_id, row_id, content): the last message of ``speaker`` in each session, without a window."""
    some = messages.filter((F.col("speaker") == speaker) & F.col("sent").isNotNull())
    return some.groupBy("session_id").agg(F.max_by(F.struct("row_id", "content"), F.struct("sent", "row_id")).alias("m")).select("session_id", "m.row_id", "m.content")


def corrections(messages: DataFrame) -> DataFrame:
    """(row_id, session_id, phrase, negated): user messages that correct: by a phrase, or by negating a content word of the user message before."""
    said = messages.filter((F.col("speaker") == "user") & F.col("content").isNotNull() & F.col("sent").isNotNull()).select("row_id", "session_id", "sent", "content")
    seen = previous(said, ["session_id"], [F.col("sent"), F.col("row_id")], "content", "before")
    phrase = tx.correction(F.col("content"))
    out = seen.select("row_id", "session_id", phrase.alias("phrase"), F.when(phrase.isNull(), tx.negated(F.col("content"), F.col("before"))).alias("negated"))
    return out.filter("phrase is not null or negated is not null")


def references(messages: DataFrame) -> DataFrame:
    """(row_id, session_id, sent, position, node_id): the nodes that messages refer to; malformed lists count as empty."""
    refs = F.from_json("node_refs", "array<string>")
    return messages.select("row_id", "session_id", "sent", F.posexplode(refs).alias("position", "node_id")).filter("node_id is not null")


def without_private(messages: DataFrame, tiered: DataFrame) -> DataFrame:
    """Messages that refer to no locked or redacted node."""
    closed = tiered.filter("effective_tier in ('locked', 'redacted')").select(F.col("id").alias("node_id"))
    bad = references(messages).join(closed, "node_id", "left_semi").select("row_id").distinct()
    return messages.join(bad, "row_id", "left_anti")


def context(messages: DataFrame, tiered: DataFrame, scope: str, budget: int, unlocked: bool = False) -> DataFrame:
    """(session_id, position, node_id, policy, tokens, used, text): the blocks that go into a session's prompt.

    Nodes come in the order in which the session first refers to them; each is shown in full, as a
    stub or not at all by its tier; blocks are added while their estimated tokens fit into ``budget``.
    A first block that is larger than the budget alone is cut to it and stays the only one.
    """
    from ..functions import privacy

    first = references(messages).groupBy("session_id", "node_id").agg(F.min(F.struct("sent", "row_id", "position")).alias("first"))
    live = tiered.filter("deleted_at is null and not is_archived").select(F.col("id").alias("node_id"), "title", "summary", "detail", "effective_tier")
    got = first.join(live, "node_id").withColumn("policy", privacy.policy(F.col("effective_tier"), scope, unlocked)).filter("policy <> 'omit'")
    full = F.concat_ws("\n", F.concat(F.lit('<document title="'), tx.xml(F.col("title"), True), F.lit('">')), tx.xml(F.col("summary")), tx.xml(F.col("detail")), F.lit("</document>"))
    block = F.when(F.col("policy") == "full", full).otherwise(F.concat(F.lit("[private note: "), F.coalesce("title", F.lit("")), F.lit("]")))
    # a block is never longer than the budget shows of it
    cost = got.select("session_id", "node_id", "policy", "first", tx.estimate(block).alias("tokens"), tx.truncated(block, budget).alias("text"))
    used = running(cost, ["session_id"], [F.col("first"), F.col("node_id")], {"position": F.lit(1).cast("bigint"), "used": F.col("tokens")})
    alone = (F.col("position") == 1) & (F.col("used") > budget)
    kept = used.filter((F.col("used") <= budget) | alone)
    return kept.select("session_id", F.col("position").cast("int").alias("position"), "node_id", "policy", F.when(alone, F.lit(budget).cast("bigint")).otherwise(F.col("tokens")).alias("tokens"), F.when(alone, F.lit(budget).cast("bigint")).otherwise(F.col("used")).alias("used"), "text")
