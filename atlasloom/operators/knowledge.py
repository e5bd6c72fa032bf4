"""The knowledge base as tables: current rows, containers, effective tiers, search and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import newest
from ..functions import privacy


def current_nodes(nodes: DataFrame) -> DataFrame:
    """The row of the greatest version per id; null versions are the least, null ids are dropped."""
    return newest(nodes, ["id"], [F.col("version").desc_nulls_last()])


def containers(vaults: DataFrame, sub_vaults: DataFrame) -> DataFrame:
    """Vaults and sub-vaults as one table of current rows: (id, kind, parent_id, name, privacy_tier, priority_profile, sort_order, created_at, updated_at, deleted_at)."""
    shared = ["name", "privacy_tier", "priority_profile", "sort_order", "created_at", "updated_at", "deleted_at"]
    both = vaults.select("id", F.lit("vault").alias("kind"), F.col("parent_vault_id").alias("parent_id"), *shared).unionByName(sub_vaults.select("id", F.lit("sub_vault").alias("kind"), F.col("vault_id").alias("parent_id"), *shared))
    return newest(both, ["id"], [F.col("updated_at").desc_nulls_last()])


def with_tiers(nodes: DataFrame, boxes: DataFrame, live_only: bool = False) -> DataFrame:
    """``nodes`` with ``effective_tier``, the strictest of node, sub-vault and vault.

    A missing container counts as open. ``live_only`` lets deleted containers count as missing, which
    is how prompts are assembled. The container tables join by id; Spark broadcasts them if small.
    """
    some = boxes.filter("deleted_at is null") if live_only else boxes
    v = some.select(F.col("id").alias("__v"), F.col("privacy_tier").alias("__vt"))
    s = some.select(F.col("id").alias("__s"), F.col("privacy_tier").alias("__st"))
    out = nodes.join(v, nodes["vault_id"] == F.col("__v"), "left").join(s, nodes["sub_vault_id"] == F.col("__s"), "left")
    return out.withColumn("effective_tier", privacy.strictest(nodes["privacy_tier"], F.col("__st"), F.col("__vt"))).drop("__v", "__vt", "__s", "__st")


def matching(tiered: DataFrame, words: str) -> Column:
    """Whether a node shows ``words`` in title or summary, any case; of locked and redacted ones only the title is searched."""
    low = words.lower()
    closed = tiered["effective_tier"].isin("locked", "redacted")
    return F.coalesce(F.contains(F.lower(tiered["title"]), F.lit(low)), F.lit(False)) | (~closed & F.coalesce(F.contains(F.lower(tiered["summary"]), F.lit(low)), F.lit(False)))


def search_with_ancestors(tiered: DataFrame, words: str) -> DataFrame:
    """(id, kind, hits): nodes that match, and every container above one with the number of its hits."""
    hits = tiered.filter(matching(tiered, words))
    up = hits.select(F.explode(F.array_distinct(F.filter(F.array("vault_id", "sub_vault_id"), lambda x: x.isNotNull()))).alias("id"))
    return hits.select("id", F.lit("node").alias("kind"), F.lit(1).cast("long").alias("hits")).unionByName(up.groupBy("id").agg(F.count("*").alias("hits")).select("id", F.lit("container").alias("kind"), "hits"))


def coverage(tiered: DataFrame, chunks: DataFrame, models: DataFrame) -> DataFrame:
    """(model, covered, total, share): live nodes that aren't redacted, and how many have a first primary vector of the model."""
    live = tiered.filter("deleted_at is null and effective_tier <> 'redacted'").select(F.col("id").alias("node_id"))
    total = live.agg(F.count("*").alias("total"))
    have = chunks.filter("chunk_type = 'primary' and chunk_index = 0 and embedding is not null").select("node_id", "model").distinct()
    per = have.join(live, "node_id", "left_semi").groupBy("model").agg(F.count("*").alias("covered"))
    out = models.select("model").distinct().join(per, "model", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("model", F.coalesce("covered", F.lit(0)).alias("covered"), "total", F.when(F.col("total") == 0, 0.0).otherwise(F.coalesce("covered", F.lit(0)) / F.col("total")).alias("share"))


def container_paths(tree: DataFrame, boxes: DataFrame) -> DataFrame:
    """(id, path, tier): the names from the root down as one line, and the strictest tier on the way.

    ``tree`` is the hierarchy with paths. Names of redacted containers are masked. One aggregate by
    id over the steps of all paths; a path is as long as the tree is deep.
    """
    b = boxes.select(F.col("id").alias("step"), "name", "privacy_tier")
    steps = tree.select("id", F.posexplode("path").alias("place", "step")).join(b, "step")
    shown = F.when(F.col("privacy_tier") == "redacted", "[redacted]").otherwise(F.coalesce("name", F.lit("")))
    got = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", shown.alias("name")))).alias("p"), F.max(privacy.rank(F.col("privacy_tier"))).alias("n"))
    return got.select("id", F.array_join(F.transform("p", lambda x: x["name"]), " / ").alias("path"), privacy.of_rank(F.coalesce("n", F.lit(0))).alias("tier"))
