"""Usage-relative priority: time goes on only in vaults that are used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The greatest score of a profile (others as standard), and the length of a history.
CAPS = {"pinned": 1.0, "slow": 1.0, "fast": 0.4}
STANDARD_CAP = 0.8
HISTORY = 90
#: The stored JSON; malformed text gives nulls.
SCHEMA = "struct<score:double,profile:string,pinned:boolean,access_count_30active:bigint,access_count_90active:bigint,access_history:array<bigint>,session_touches:bigint,link_count:bigint,frozen:boolean>"


def parsed(text: Column) -> Column:
    return F.from_json(text, SCHEMA)


def score(uses30: Column, links: Column, profile: Column) -> Column:
    """Tenth of the uses in 30 active periods, at least 0.1, plus 0.05 per link up to 0.2, capped by profile."""
    cap = F.lit(STANDARD_CAP)
    for name, most in CAPS.items():
        cap = F.when(profile == name, most).otherwise(cap)
    base = F.least(F.greatest(F.coalesce(uses30, F.lit(0)) / 10.0, F.lit(0.1)), F.lit(1.0))
    bonus = F.least(F.greatest(F.coalesce(links, F.lit(0)) * 0.05, F.lit(0.0)), F.lit(0.2))
    return F.when(profile == "pinned", 1.0).otherwise(F.least(base + bonus, cap))


def pushed(history: Column, touches: Column, active: Column) -> Column:
    """The history after a period: an active vault pushes the touches to the front, a frozen one keeps it."""
    have = F.coalesce(history, F.array().cast("array<bigint>"))
    return F.when(active, F.slice(F.concat(F.array(F.coalesce(touches, F.lit(0)).cast("long")), have), 1, HISTORY)).otherwise(have)


def total(history: Column, most: int) -> Column:
    return F.aggregate(F.slice(history, 1, most), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def bar(value: Column) -> Column:
    return F.when(value < 0.4, "low").when(value < 0.8, "medium").otherwise("high")
