"""Priority by use, retrieval by vectors and priority, and uses over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import priority, text as tx


def scores(nodes: DataFrame) -> DataFrame:
    """(id, profile, score, bar): the score of each node from its stored counts."""
    p = nodes.select("id", priority.parsed(F.col("priority")).alias("p"))
    profile = F.when(F.col("p.pinned"), "pinned").otherwise(F.coalesce("p.profile", F.lit("standard")))
    s = priority.score(F.col("p.access_count_30active"), F.col("p.link_count"), profile)
    return p.select("id", profile.alias("profile"), s.alias("score"), priority.bar(s).alias("bar"))


def refreshed(nodes: DataFrame) -> DataFrame:
    """(id, active, history, uses30, uses90, score): all nodes after one period.

    A vault is active if any of its nodes was touched; its nodes push their touches, others keep
    their history. The active vaults are one small aggregate, joined back by vault.
    """
    p = nodes.select("id", "vault_id", priority.parsed(F.col("priority")).alias("p"))
    used = p.groupBy("vault_id").agg((F.max(F.coalesce("p.session_touches", F.lit(0))) > 0).alias("active"))
    j = p.join(used, "vault_id", "left").withColumn("active", F.coalesce("active", F.lit(False)))
    h = j.select("id", "active", "p", priority.pushed(F.col("p.access_history"), F.col("p.session_touches"), F.col("active")).alias("history"))
    uses30 = F.when(F.col("active"), priority.total(F.col("history"), 30)).otherwise(F.coalesce("p.access_count_30active", F.lit(0)))
    uses90 = F.when(F.col("active"), priority.total(F.col("history"), 90)).otherwise(F.coalesce("p.access_count_90active", F.lit(0)))
    profile = F.when(F.col("p.pinned"), "pinned").otherwise(F.coalesce("p.profile", F.lit("standard")))
    return h.select("id", "active", "history", uses30.alias("uses30"), uses90.alias("uses90"), priority.score(uses30, F.col("p.link_count"), profile).alias("score"))


def retrieved(chunks: DataFrame, scored: DataFrame, query: list[float], budget: int) -> DataFrame:
    """(node_id, relevance, weight, tokens, used): nodes by their best chunk times priority, as many as fit into ``budget`` tokens.

    Only narrow rows reach the final ordering, and only those within the budget are returned.
    """
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    per = chunks.filter(F.size("embedding") == len(query)).select("node_id", "text", tx.cosine(F.col("embedding"), q).alias("relevance"))
    best = per.groupBy("node_id").agg(F.max(F.struct(F.col("relevance"), tx.estimate(F.col("text")).alias("tokens"))).alias("b"))
    w = best.join(scored.select(F.col("id").alias("node_id"), "score"), "node_id").select("node_id", "b.relevance", (F.col("b.relevance") * F.col("score")).alias("weight"), "b.tokens")
    # every row costs a token at least, so only the best ``budget`` rows can fit
    top = w.filter("tokens > 0").orderBy(F.round("weight", 9).desc(), "node_id").limit(budget)
    order = Window.orderBy(F.round("weight", 9).desc(), "node_id").rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("used", F.sum("tokens").over(order)).filter(F.col("used") <= budget)


def touches(events: DataFrame) -> DataFrame:
    """(user_id, day, touches, value): events per user and day."""
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("touches"), F.sum("value").alias("value"))


def tumbling(events: DataFrame, width: str) -> DataFrame:
    """(start, event_type, events, value): counts per time window."""
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "events", "value")


def visits(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, events): runs of a user's events with less than ``gap`` between them."""
    return events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), "events")


def throttled(events: DataFrame, width: str) -> DataFrame:
    """(event_type, start, event_id): the last event of each type and time window, the final one always among them."""
    return events.groupBy("event_type", F.window("ts", width)).agg(F.max(F.struct("ts", "event_id")).alias("e")).select("event_type", F.col("window.start").alias("start"), "e.event_id")
