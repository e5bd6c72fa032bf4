"""The same operations on streams: windows with late rows, throttling, and the extraction trigger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def touch_windows(events: DataFrame, width: str, late: str) -> DataFrame:
    """Events per type and window; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "events", "value")


def visits(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of a user's events: a trailing debounce, as the last row of a run is final once the gap has passed."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), "events")


def deliveries(messages: DataFrame, late: str) -> DataFrame:
    """Messages without repeated deliveries of an id within ``late``."""
    return messages.withWatermark("sent", late).dropDuplicatesWithinWatermark(["id"])


def fires(count: int, last: float | None, rows: list[tuple[float, int]], messages: int, seconds: float) -> tuple[int, float | None, list[int]]:
    """The trigger over messages in order: it fires at a message if ``messages`` came since it last fired and ``seconds`` passed."""
    out = []
    for when, row in rows:
        count += 1
        if count >= messages and (last is None or when - last >= seconds):
            out.append(row)
            count, last = 0, when
    return count, last, out


def extraction_triggers(messages: DataFrame, count: int = 6, seconds: float = 120.0) -> DataFrame:
    """(session_id, row_id): when a session is due for extraction, from (session_id, row_id, sent).

    State per session is two numbers, so a session of any length costs the same. Within a batch the
    rows of a session are ordered by instant; null instants are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, -1.0)
        rows = pd.concat(list(batches)).dropna(subset=["sent"]).sort_values(["sent", "row_id"])
        when = [(t.timestamp(), int(r)) for t, r in zip(rows["sent"], rows["row_id"])]
        n, last_, out = fires(n, None if last < 0 else last, when, count, seconds)
        state.update((n, -1.0 if last_ is None else last_))
        yield pd.DataFrame({"session_id": [key[0]] * len(out), "row_id": out})

    return messages.groupBy("session_id").applyInPandasWithState(step, "session_id string, row_id bigint", "n int, last double", "append", GroupStateTimeout.NoTimeout)
