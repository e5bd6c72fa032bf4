"""Privacy tiers as column expressions: the strictest wins, unknown and null count as open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tiers from the least to the most strict.
TIERS = ("open", "local_only", "locked", "redacted")


def rank(tier: Column) -> Column:
    out = F.lit(0)
    for n, t in enumerate(TIERS[1:], 1):
        out = F.when(tier == t, n).otherwise(out)
    return out


def of_rank(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), n + 1)


def strictest(*tiers: Column) -> Column:
    """The strictest of ``tiers``, never null."""
    return of_rank(F.greatest(*[F.coalesce(rank(t), F.lit(0)) for t in tiers]) if len(tiers) > 1 else F.coalesce(rank(tiers[0]), F.lit(0)))


def policy(tier: Column, scope: str, unlocked: bool = False) -> Column:
    """What a prompt may hold of a record: 'full', 'stub' or 'omit'; scope is cloud, local or unrestricted."""
    n = F.coalesce(rank(tier), F.lit(0))
    if scope == "cloud":
        return F.when(n == 0, "full").when(n == 2, "stub").otherwise("omit")
    if scope == "local":
        return F.when(n == 3, "omit").when((n == 2) & F.lit(not unlocked), "stub").otherwise("full")
    return F.when(n == 3, "omit").otherwise("full")


def label(tier: Column, title: Column) -> Column:
    """The title to show without a key."""
    n = rank(tier)
    return F.when(n == 3, "[redacted]").when(n == 2, F.concat(F.lit("[locked] "), title)).otherwise(title)
