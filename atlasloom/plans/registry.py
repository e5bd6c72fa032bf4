"""Registered queries of the core, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import strip, table
from ..functions import privacy
from ..functions import text as tx
from . import documents, upkeep
from ..operators import hierarchy, history, knowledge, pages, similarity, state, usage


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return word_set_join(spark, d)


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.current_links((table(spark, d, "vault_records"), "parent_vault_id"), (table(spark, d, "sub_vaults"), "vault_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(_links(spark, d), with_path=False).select("id", "root_id", "depth", "state")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every id with its path from the root as one line, and how many rows hang below it."""
    tree = hierarchy.hierarchy(_links(spark, d))
    return tree.select("id", "root_id", "depth", "state", F.array_join("path", "/").alias("path"), "subtree")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(_links(spark, d)))


QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants}
_LINKS = r"""
    WITH RECURSIVE u AS (SELECT id, parent_vault_id AS p, updated_at FROM vault_records UNION ALL SELECT id, vault_id, updated_at FROM sub_vaults),
    cur AS (SELECT id, nullif(regexp_replace(p, '^[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+|[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+$', '', 'g'), '') AS p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS k FROM u) WHERE k = 1),
    link AS (SELECT c.id, a.id AS up, c.p IS NOT NULL AND a.id IS NULL AS lost FROM cur c LEFT JOIN cur a ON a.id = c.p),
    down AS (SELECT id, id AS root_id, 0 AS depth, lost FROM link WHERE up IS NULL UNION ALL SELECT l.id, d.root_id, d.depth + 1, d.lost FROM link l JOIN down d ON l.up = d.id),
    rest AS (SELECT id, up FROM link WHERE id NOT IN (SELECT id FROM down)),
    reach AS (SELECT id, up AS met FROM rest UNION SELECT r.id, l.up FROM reach r JOIN rest l ON l.id = r.met),
    ring AS (SELECT id FROM reach WHERE id = met),
    least AS (SELECT r.id, min(r.met) AS root_id FROM reach r WHERE r.id IN (SELECT id FROM ring) GROUP BY r.id),
    below AS (SELECT id, root_id, 0 AS depth FROM least UNION ALL SELECT r.id, b.root_id, b.depth + 1 FROM rest r JOIN below b ON r.up = b.id WHERE r.id NOT IN (SELECT id FROM ring))
"""
SQL = {
    "p2_found": _LINKS
    + """
    SELECT id, root_id, CAST(depth AS BIGINT) AS depth, CASE WHEN lost THEN 'orphan' ELSE 'tree' END AS state FROM down
    UNION ALL SELECT id, root_id, CAST(depth AS BIGINT), CASE WHEN id IN (SELECT id FROM ring) THEN 'cycle' ELSE 'below_cycle' END FROM below
    """,
    "p2_paths": _LINKS
    + """
    , pairs AS (SELECT up AS id, id AS descendant_id FROM link WHERE up IS NOT NULL AND id NOT IN (SELECT id FROM ring)
        UNION ALL SELECT l.up, p.descendant_id FROM pairs p JOIN link l ON l.id = p.id WHERE l.up IS NOT NULL AND p.id NOT IN (SELECT id FROM ring)),
    sizes AS (SELECT id, count(*) + 1 AS n FROM pairs GROUP BY id),
    way AS (SELECT id, id AS path FROM link WHERE up IS NULL OR id IN (SELECT id FROM ring) UNION ALL SELECT l.id, w.path || '/' || l.id FROM link l JOIN way w ON l.up = w.id WHERE l.id NOT IN (SELECT id FROM ring)),
    found AS (SELECT id, root_id, depth, CASE WHEN lost THEN 'orphan' ELSE 'tree' END AS state FROM down UNION ALL SELECT id, root_id, depth, CASE WHEN id IN (SELECT id FROM ring) THEN 'cycle' ELSE 'below_cycle' END FROM below)
    SELECT f.id, f.root_id, CAST(f.depth AS BIGINT) AS depth, f.state, w.path, CASE WHEN f.state <> 'cycle' THEN coalesce(s.n, 1) END AS subtree FROM found f JOIN way w ON w.id = f.id LEFT JOIN sizes s ON s.id = f.id
    """,
    "p2_descendants": _LINKS
    + """
    , pairs AS (SELECT up AS id, id AS descendant_id, 1 AS steps FROM link WHERE up IS NOT NULL AND id NOT IN (SELECT id FROM ring)
        UNION ALL SELECT l.up, p.descendant_id, p.steps + 1 FROM pairs p JOIN link l ON l.id = p.id WHERE l.up IS NOT NULL AND p.id NOT IN (SELECT id FROM ring))
    SELECT id, descendant_id, CAST(steps AS BIGINT) AS steps FROM pairs
    """,
}


# ---- the knowledge base -------------------------------------------------------------------------


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.current_nodes(table(spark, d, "nodes"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.containers(table(spark, d, "vault_records"), table(spark, d, "sub_vaults"))


def _tiered(spark: SparkSession, d: str, live_only: bool = False) -> DataFrame:
    return knowledge.with_tiers(_nodes(spark, d), _boxes(spark, d), live_only)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return history.current_messages(table(spark, d, "session_messages"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "node_chunks").withColumn("written", history.instant(F.col("computed_at")))
    return state.last_write(c, ["node_id", "chunk_type", "chunk_index", "model"], "written", ("text", "embedding"))


#: Fixed value: characters of a summary at import.
LONGEST_SUMMARY = 120
#: A fixed question to search by, in the space of the stored vectors.
ASKED = [0.4, -0.1, 0.3, 0.2, -0.5, 0.1, 0.6, -0.2]


def active_nodes(spark, d):
    return _nodes(spark, d).filter("deleted_at is null and not is_archived").select("id", "vault_id", "sub_vault_id", "node_type", "created_at")


def all_containers(spark, d):
    return _boxes(spark, d).select("id", "kind", F.coalesce("privacy_tier", F.lit("open")).alias("tier"), F.coalesce("priority_profile", F.lit("standard")).alias("profile"), "sort_order")


def effective_tiers(spark, d):
    return _tiered(spark, d).select("id", "effective_tier")


def prompt_policies(spark, d):
    t = _tiered(spark, d, live_only=True)
    e = F.col("effective_tier")
    return t.select("id", privacy.policy(e, "cloud").alias("cloud"), privacy.policy(e, "local").alias("local"), privacy.policy(e, "local", True).alias("unlocked"), privacy.policy(e, "unrestricted").alias("free"), privacy.label(e, F.col("title")).alias("label"))


def word_search(spark, d):
    return knowledge.search_with_ancestors(_tiered(spark, d), "timeline")


def vector_coverage(spark, d):
    return knowledge.coverage(_tiered(spark, d), table(spark, d, "node_chunks"), table(spark, d, "embedding_models"))


def vector_search(spark, d):
    live = _tiered(spark, d).filter("deleted_at is null and not is_archived").select("id")
    c = _chunks(spark, d).filter("chunk_type = 'primary' and chunk_index = 0 and model = 'host-embed'").select(F.col("node_id").alias("id"), "embedding")
    return similarity.nearest_to(c.join(live, "id", "left_semi"), ASKED, 50).select("id", F.round("similarity", 6).alias("similarity"))


def vector_join(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return similarity.nearest_join(rows.filter("id % 50 = 0"), rows, 5).select("query_id", "id", "place", F.round("similarity", 6).alias("similarity"))


def word_set_join(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return similarity.closest_words(docs, docs.filter("id % 50 = 0")).select("id", "best_id", F.round("similarity", 9).alias("similarity"), "class")


def summary_overlap(spark, d):
    return _nodes(spark, d).select("id", F.round(tx.overlap(tx.tokens(F.col("summary")), tx.tokens(F.col("detail"))), 9).alias("overlap"))


def chunk_integrity(spark, d):
    """Whether a stored piece is held by its node's detail, whatever the line ends, and whether the node's summary is too long for an import."""
    plain = lambda c: F.regexp_replace(c, "\\r\\n?", "\n")
    n = _nodes(spark, d).select(F.col("id").alias("node_id"), "detail", F.coalesce(F.length("summary") > LONGEST_SUMMARY, F.lit(False)).alias("long_summary"))
    c = _chunks(spark, d).filter("chunk_type = 'detail'").select("node_id", "chunk_index", "model", "text")
    held = F.coalesce(F.contains(plain(F.col("detail")), plain(F.col("text"))), F.lit(False))
    return c.join(n, "node_id").select("node_id", "chunk_index", "model", held.alias("held"), "long_summary")


def stale_vectors(spark, d):
    n = _nodes(spark, d).select(F.col("id").alias("node_id"), "updated_at")
    c = _chunks(spark, d).select("node_id", "model", "written")
    return c.join(n, "node_id", "left").groupBy("model").agg(F.count("*").alias("vectors"), F.count_if(F.col("updated_at") > F.col("written")).alias("stale"), F.count_if(F.col("updated_at").isNull()).alias("lost"))


def chunk_chain(spark, d):
    w = Window.partitionBy("node_id", "chunk_type", "model").orderBy("chunk_index")
    c = _chunks(spark, d).select("node_id", "chunk_type", "model", "chunk_index")
    return c.withColumn("next_index", F.lead("chunk_index").over(w)).filter("next_index is not null").withColumn("gap", F.col("next_index") - F.col("chunk_index") > 1)


def container_totals(spark, d):
    n = _nodes(spark, d).filter("deleted_at is null")
    per = n.select(F.explode(F.array_distinct(F.array_compact(F.array("vault_id", "sub_vault_id")))).alias("id"), "is_archived", "updated_at").groupBy("id").agg(F.count("*").alias("nodes"), F.count_if("is_archived").alias("archived"), F.max("updated_at").alias("latest"))
    kids = _boxes(spark, d).filter("deleted_at is null").groupBy(strip("parent_id").alias("id")).agg(F.count("*").alias("children"), (F.max("sort_order") + 1).alias("next_order"))
    return per.join(kids, "id", "full").select("id", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("archived", F.lit(0)).alias("archived"), "latest", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("next_order", F.lit(0)).alias("next_order")).filter("id is not null and id <> ''")


def priority_scores(spark, d):
    return usage.scores(_nodes(spark, d)).select("id", "profile", F.round("score", 9).alias("score"), "bar")


def priority_refresh(spark, d):
    r = usage.refreshed(_nodes(spark, d))
    return r.select("id", "active", F.size("history").alias("periods"), "uses30", "uses90", F.round("score", 9).alias("score"))


def retrieval(spark, d):
    live = _tiered(spark, d).filter("deleted_at is null and not is_archived and effective_tier <> 'redacted'")
    r = usage.retrieved(_chunks(spark, d).filter("model = 'host-embed'"), usage.scores(live), ASKED, 2000)
    return r.select("node_id", F.round("relevance", 6).alias("relevance"), F.round("weight", 6).alias("weight"), "tokens", "used")


def version_changes(spark, d):
    return state.history_changes(table(spark, d, "nodes"))


def snapshot_difference(spark, d):
    n = _nodes(spark, d).select("id", "title", "summary", "detail", "is_archived", "created_at", "version", "updated_at")
    cut_off = F.to_timestamp(F.lit("2026-01-01"))
    old = knowledge.current_nodes(table(spark, d, "nodes").filter(F.col("updated_at") < cut_off)).select("id", "title", "summary", "detail", "is_archived")
    return state.difference(old, n.select("id", "title", "summary", "detail", "is_archived"), "id", ["title", "summary", "detail", "is_archived"])


def last_vectors(spark, d):
    return _chunks(spark, d).select("node_id", "chunk_type", "chunk_index", "model", F.unix_micros("written").alias("written_us"))


# ---- conversations ------------------------------------------------------------------------------


def history_window(spark, d):
    return history.recent(_messages(spark, d), 4000)


def latest_question(spark, d):
    return history.latest(_messages(spark, d))


def corrections(spark, d):
    return history.corrections(_messages(spark, d))


def message_references(spark, d):
    r = history.references(_messages(spark, d))
    live = _nodes(spark, d).select(F.col("id").alias("node_id"), (F.col("deleted_at").isNotNull() | F.col("is_archived")).alias("off"))
    return r.join(live, "node_id", "left").select("row_id", "node_id", F.when(F.col("off").isNull(), "missing").when(F.col("off"), "orphaned").otherwise("active").alias("status"))


def backlinks(spark, d):
    return history.references(_messages(spark, d)).groupBy("node_id").agg(F.count("*").alias("links"), F.count_distinct("session_id").alias("sessions"))


def public_messages(spark, d):
    return history.without_private(_messages(spark, d), _tiered(spark, d)).groupBy("session_id").agg(F.count("*").alias("messages"))


def prompt_context(spark, d):
    return history.context(_messages(spark, d), _tiered(spark, d, live_only=True), "cloud", 8000)


def session_totals(spark, d):
    s = table(spark, d, "sessions").filter("id is not null").groupBy("id").agg(F.max("message_count").alias("claimed"))
    m = _messages(spark, d).groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("messages"), F.count_if(F.col("speaker") == "user").alias("asked"), F.min("sent").alias("first"), F.max("sent").alias("last"))
    return s.join(m, "id", "left").select("id", "claimed", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("asked", F.lit(0)).alias("asked"), (F.unix_seconds("last") - F.unix_seconds("first")).alias("seconds"))


def empty_sessions(spark, d):
    s = table(spark, d, "sessions").filter("id is not null").groupBy("id").agg(F.max("started_at").alias("started_at"))
    none = s.join(_messages(spark, d).select(F.col("session_id").alias("id")), "id", "left_anti")
    newest_ = none.agg(F.max(F.struct("started_at", "id")).alias("n"))
    return none.crossJoin(F.broadcast(newest_)).select("id", (F.col("id") == F.col("n.id")).alias("kept"))


def session_titles(spark, d):
    m = _messages(spark, d).filter("speaker = 'user' and trim(content) <> '' and sent is not null")
    first = m.groupBy("session_id").agg(F.min_by("content", F.struct("sent", "row_id")).alias("content"))
    return first.select("session_id", tx.title(F.col("content")).alias("title"))


# ---- texts, pages, events -----------------------------------------------------------------------


def document_profile(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.size(tx.tokens(t)).alias("words"), F.size(tx.sentences(t)).alias("sentences"), tx.estimate(t).alias("tokens"),
        F.coalesce(F.length(t) == F.col("n_chars"), F.lit(False)).alias("right_length"),
    )


def page_bands(spark, d):
    return pages.bands(_boxed(spark, d), 18.0)


def _boxed(spark, d):
    return documents.boxed(spark, d)


def page_medians(spark, d):
    return pages.medians(_boxed(spark, d))


def page_margins(spark, d):
    return pages.margins(_boxed(spark, d), 792.0)


def uncovered_blocks(spark, d):
    return pages.uncovered(_boxed(spark, d))


def page_markdown(spark, d):
    return pages.joined(documents.ingested(spark, d).select("block_id", "job_id", "page_index", "block_index", "block_type", "formatted_text"))


def job_totals(spark, d):
    j = pages.jobs(documents.ingested(spark, d))
    return j.withColumn("confidence", F.round("confidence", 9))


def daily_touches(spark, d):
    t = usage.touches(table(spark, d, "events"))
    return t.select("user_id", "day", "touches", F.round("value", 4).alias("value"))


def hourly_events(spark, d):
    t = usage.tumbling(table(spark, d, "events"), "1 hour")
    return t.select("start", "event_type", "events", F.round("value", 4).alias("value"))


def user_visits(spark, d):
    return usage.visits(table(spark, d, "events"), "30 minutes")


def throttled_events(spark, d):
    return usage.throttled(table(spark, d, "events"), "10 minutes")


QUERIES |= {
    f.__name__: f
    for f in (
        active_nodes, all_containers, effective_tiers, prompt_policies, word_search, vector_coverage, vector_search, vector_join, word_set_join, summary_overlap,
        chunk_integrity, stale_vectors, chunk_chain, container_totals, priority_scores, priority_refresh, retrieval, version_changes, snapshot_difference, last_vectors,
        history_window, latest_question, corrections, message_references, backlinks, public_messages, prompt_context, session_totals, empty_sessions, session_titles,
        document_profile, page_bands, page_medians, page_margins, uncovered_blocks, page_markdown, job_totals, daily_touches, hourly_events, user_visits, throttled_events,
    )
}

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOP)


def _words(x: str) -> str:
    return r"list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(X, '')), '[^\p{L}\p{N}'']+'), lambda w: w <> '' AND NOT list_contains([STOP], w))))".replace("X", x).replace("STOP", _STOP)


_CUR = "cur AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS k FROM nodes WHERE id IS NOT NULL) WHERE k = 1)"
_BOX = """box0 AS (SELECT id, 'vault' AS kind, parent_vault_id AS parent_id, name, privacy_tier, priority_profile, sort_order, updated_at, deleted_at FROM vault_records
    UNION ALL SELECT id, 'sub_vault', vault_id, name, privacy_tier, priority_profile, sort_order, updated_at, deleted_at FROM sub_vaults),
    box AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS k FROM box0 WHERE id IS NOT NULL) WHERE k = 1)"""
_RANK = "coalesce(list_position(['local_only', 'locked', 'redacted'], {0}), 0)"


def _tier(live: bool) -> str:
    cond = " AND {0}.deleted_at IS NULL" if live else ""
    g = ", ".join(_RANK.format(c) for c in ("c.privacy_tier", "v.privacy_tier", "s.privacy_tier"))
    return f"""{_CUR}, {_BOX}, tier AS (SELECT c.*, ['open', 'local_only', 'locked', 'redacted'][greatest({g}) + 1] AS effective_tier
        FROM cur c LEFT JOIN box v ON v.id = c.vault_id{cond.format('v')} LEFT JOIN box s ON s.id = c.sub_vault_id{cond.format('s')})"""


_SENT = r"CASE WHEN regexp_matches({0}, '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}') THEN try_cast(CASE WHEN regexp_matches({0}, '(Z|[+-]\d{{2}}:\d{{2}})$') THEN {0} ELSE {0} || 'Z' END AS TIMESTAMPTZ) END"
_MSG = f"msg AS (SELECT * EXCLUDE (k), {_SENT.format('created_at')} AS sent, lower(trim(role)) AS speaker FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_id) AS k FROM session_messages WHERE id IS NOT NULL) WHERE k = 1)"
_REF = "ref AS (SELECT row_id, session_id, sent, unnest(range(len(l))) AS position, unnest(l) AS node_id FROM (SELECT row_id, session_id, sent, CAST(json(node_refs) AS VARCHAR[]) AS l FROM msg WHERE json_valid(node_refs)))"
_CHUNK = f"chunk AS (SELECT * EXCLUDE (k) FROM (SELECT *, {_SENT.format('computed_at')} AS written, row_number() OVER (PARTITION BY node_id, chunk_type, chunk_index, model ORDER BY {_SENT.format('computed_at')} DESC NULLS LAST, text, embedding) AS k FROM node_chunks) WHERE k = 1)"
_ASK = "CAST([" + ", ".join(map(str, ASKED)) + "] AS FLOAT[])"
_DBL = "list_transform({0}, lambda z: CAST(z AS DOUBLE))"
_COS = "coalesce(list_cosine_similarity(" + _DBL.format("{0}") + ", " + _DBL.format("{1}") + "), 0)"
_PRI = "p AS (SELECT *, CASE WHEN json_valid(priority) AND priority LIKE '{{%' THEN priority ELSE '{{}}' END AS j FROM {0})"
_PROFILE = "CASE WHEN coalesce(CAST(j ->> 'pinned' AS BOOLEAN), false) THEN 'pinned' ELSE coalesce(j ->> 'profile', 'standard') END"


def _score(uses: str, links: str = "coalesce(CAST(j ->> 'link_count' AS BIGINT), 0)") -> str:
    return f"CASE WHEN {_PROFILE} = 'pinned' THEN 1.0 ELSE least(least(greatest({uses} / 10.0, 0.1), 1.0) + least({links} * 0.05, 0.2), CASE {_PROFILE} WHEN 'slow' THEN 1.0 WHEN 'fast' THEN 0.4 ELSE 0.8 END) END"


_TB = "tb AS (SELECT DISTINCT block_id, job_id, page_index, block_index, bbox.x AS x, bbox.y AS y, bbox.width AS width, bbox.height AS height FROM text_blocks)"
_USES30 = "coalesce(CAST(j ->> 'access_count_30active' AS BIGINT), 0)"
_USES90 = "coalesce(CAST(j ->> 'access_count_90active' AS BIGINT), 0)"
_BAR = "CASE WHEN score < 0.4 THEN 'low' WHEN score < 0.8 THEN 'medium' ELSE 'high' END"

SQL |= {
    "active_nodes": f"WITH {_CUR} SELECT id, vault_id, sub_vault_id, node_type, created_at FROM cur WHERE deleted_at IS NULL AND NOT is_archived",
    "all_containers": f"WITH {_BOX} SELECT id, kind, coalesce(privacy_tier, 'open') AS tier, coalesce(priority_profile, 'standard') AS profile, sort_order FROM box",
    "effective_tiers": f"WITH {_tier(False)} SELECT id, effective_tier FROM tier",
    "prompt_policies": f"""WITH {_tier(True)} SELECT id, CASE effective_tier WHEN 'open' THEN 'full' WHEN 'locked' THEN 'stub' ELSE 'omit' END AS cloud,
        CASE effective_tier WHEN 'redacted' THEN 'omit' WHEN 'locked' THEN 'stub' ELSE 'full' END AS local, CASE effective_tier WHEN 'redacted' THEN 'omit' ELSE 'full' END AS unlocked,
        CASE effective_tier WHEN 'redacted' THEN 'omit' ELSE 'full' END AS free, CASE effective_tier WHEN 'redacted' THEN '[redacted]' WHEN 'locked' THEN '[locked] ' || title ELSE title END AS label FROM tier""",
    "word_search": f"""WITH {_tier(False)}, hit AS (SELECT * FROM tier WHERE coalesce(contains(lower(title), 'timeline'), false) OR (effective_tier NOT IN ('locked', 'redacted') AND coalesce(contains(lower(summary), 'timeline'), false)))
        SELECT id, 'node' AS kind, CAST(1 AS BIGINT) AS hits FROM hit UNION ALL
        SELECT id, 'container', count(*) FROM (SELECT id AS n, vault_id AS id FROM hit WHERE vault_id IS NOT NULL UNION SELECT id, sub_vault_id FROM hit WHERE sub_vault_id IS NOT NULL) GROUP BY id""",
    "vector_coverage": f"""WITH {_tier(False)}, live AS (SELECT id FROM tier WHERE deleted_at IS NULL AND effective_tier <> 'redacted'),
        have AS (SELECT model, count(DISTINCT node_id) AS c FROM node_chunks WHERE chunk_type = 'primary' AND chunk_index = 0 AND embedding IS NOT NULL AND node_id IN (SELECT id FROM live) GROUP BY model)
        SELECT m.model, coalesce(c, 0) AS covered, (SELECT count(*) FROM live) AS total, coalesce(c, 0) / (SELECT count(*) FROM live) AS share FROM embedding_models m LEFT JOIN have USING (model)""",
    "vector_search": f"""WITH {_CUR}, {_CHUNK} SELECT node_id AS id, round({_COS.format('embedding', _ASK)}, 6) AS similarity FROM chunk
        WHERE chunk_type = 'primary' AND chunk_index = 0 AND model = 'host-embed' AND node_id IN (SELECT id FROM cur WHERE deleted_at IS NULL AND NOT is_archived)
        ORDER BY {_COS.format('embedding', _ASK)} DESC, node_id LIMIT 50""",
    "vector_join": f"""SELECT query_id, id, place, round(s, 6) AS similarity FROM (SELECT q.vec_id AS query_id, r.vec_id AS id, {_COS.format('q.embedding', 'r.embedding')} AS s,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS.format('q.embedding', 'r.embedding')}, 12) DESC, r.vec_id) AS place
        FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0) WHERE place <= 5""",
    "word_set_join": f"""WITH t AS (SELECT doc_id AS id, {_words('text')} AS w FROM documents), q AS (SELECT * FROM t WHERE id % 50 = 0),
        m AS (SELECT q.id, t.id AS o, len(list_intersect(q.w, t.w)) AS i, len(q.w) + len(t.w) AS n FROM q JOIN t ON t.id <> q.id AND len(q.w) > 0 AND len(t.w) > 0),
        b AS (SELECT id, o, i / (n - i) AS s, row_number() OVER (PARTITION BY id ORDER BY i / (n - i) DESC, o) AS k FROM m WHERE i / (n - i) >= 0.5)
        SELECT q.id, b.o AS best_id, round(b.s, 9) AS similarity, CASE WHEN b.s > 0.85 THEN 'update' WHEN b.s >= 0.5 THEN 'flag' ELSE 'new' END AS class FROM q LEFT JOIN b ON b.id = q.id AND b.k = 1""",
    "summary_overlap": f"""WITH {_CUR}, w AS (SELECT id, {_words('summary')} AS a, {_words('detail')} AS b FROM cur), c AS (SELECT *, len(list_intersect(a, b)) AS i FROM w)
        SELECT id, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE i / (len(a) + len(b) - i) END, 9) AS overlap FROM c""",
    "chunk_integrity": f"WITH {_CUR}, {_CHUNK} SELECT c.node_id, c.chunk_index, c.model, coalesce(contains(regexp_replace(n.detail, '\\r\\n?', chr(10), 'g'), regexp_replace(c.text, '\\r\\n?', chr(10), 'g')), false) AS held, coalesce(length(n.summary) > 120, false) AS long_summary FROM chunk c JOIN cur n ON n.id = c.node_id WHERE c.chunk_type = 'detail'",
    "stale_vectors": f"""WITH {_CUR}, {_CHUNK} SELECT c.model, count(*) AS vectors, count(*) FILTER (n.updated_at > CAST(c.written AT TIME ZONE 'UTC' AS TIMESTAMP)) AS stale, count(*) FILTER (n.updated_at IS NULL) AS lost
        FROM chunk c LEFT JOIN cur n ON n.id = c.node_id GROUP BY c.model""",
    "chunk_chain": f"""WITH {_CHUNK}, l AS (SELECT node_id, chunk_type, model, chunk_index, lead(chunk_index) OVER (PARTITION BY node_id, chunk_type, model ORDER BY chunk_index) AS next_index FROM chunk)
        SELECT *, next_index - chunk_index > 1 AS gap FROM l WHERE next_index IS NOT NULL""",
    "container_totals": rf"""WITH {_CUR}, {_BOX}, u AS (SELECT id AS n, vault_id AS id, is_archived, updated_at FROM cur WHERE deleted_at IS NULL AND vault_id IS NOT NULL UNION SELECT id, sub_vault_id, is_archived, updated_at FROM cur WHERE deleted_at IS NULL AND sub_vault_id IS NOT NULL),
        per AS (SELECT id, count(*) AS nodes, count(*) FILTER (is_archived) AS archived, max(updated_at) AS latest FROM u GROUP BY id),
        kids AS (SELECT regexp_replace(parent_id, '^[\s\x{{A0}}\x{{3000}}]+|[\s\x{{A0}}\x{{3000}}]+$', '', 'g') AS id, count(*) AS children, max(sort_order) + 1 AS next_order FROM box WHERE deleted_at IS NULL GROUP BY 1)
        SELECT coalesce(per.id, kids.id) AS id, coalesce(nodes, 0) AS nodes, coalesce(archived, 0) AS archived, latest, coalesce(children, 0) AS children, coalesce(next_order, 0) AS next_order
        FROM per FULL JOIN kids ON per.id = kids.id WHERE coalesce(per.id, kids.id) <> ''""",
    "priority_scores": f"WITH {_CUR}, {_PRI.format('cur')}, s AS (SELECT id, {_PROFILE} AS profile, {_score(_USES30)} AS score FROM p) SELECT id, profile, round(score, 9) AS score, {_BAR} AS bar FROM s",
    "priority_refresh": f"""WITH {_CUR}, {_PRI.format('cur')}, h AS (SELECT *, coalesce(CAST(j ->> 'session_touches' AS BIGINT), 0) AS t, coalesce(CAST(j -> 'access_history' AS BIGINT[]), []) AS hist FROM p),
        a AS (SELECT *, max(t) OVER (PARTITION BY vault_id) > 0 AS active FROM h), n AS (SELECT *, CASE WHEN active THEN list_concat([t], hist)[1:90] ELSE hist END AS nh FROM a),
        s AS (SELECT *, CASE WHEN active THEN coalesce(list_sum(nh[1:30]), 0) ELSE {_USES30} END AS u30, CASE WHEN active THEN coalesce(list_sum(nh), 0) ELSE {_USES90} END AS u90 FROM n)
        SELECT id, active, len(nh) AS periods, CAST(u30 AS BIGINT) AS uses30, CAST(u90 AS BIGINT) AS uses90, round({_score('u30')}, 9) AS score FROM s""",
    "retrieval": f"""WITH {_tier(False)}, {_CHUNK}, live AS (SELECT * FROM tier WHERE deleted_at IS NULL AND NOT is_archived AND effective_tier <> 'redacted'), {_PRI.format('live')},
        s AS (SELECT id, {_score(_USES30)} AS score FROM p), b AS (SELECT node_id, {_COS.format('embedding', _ASK)} AS r, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS t FROM chunk WHERE model = 'host-embed'),
        best AS (SELECT node_id, r, t FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY r DESC, t DESC) AS k FROM b) WHERE k = 1),
        w AS (SELECT best.*, r * score AS weight FROM best JOIN s ON s.id = best.node_id WHERE t > 0), o AS (SELECT *, sum(t) OVER (ORDER BY round(weight, 9) DESC, node_id ROWS UNBOUNDED PRECEDING) AS used FROM w)
        SELECT node_id, round(r, 6) AS relevance, round(weight, 6) AS weight, t AS tokens, used FROM o WHERE used <= 2000""",
    "version_changes": """WITH one AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id, version) AS k FROM nodes) WHERE k = 1),
        l AS (SELECT *, lag(version) OVER w AS v, lag(title) OVER w AS a, lag(summary) OVER w AS b, lag(detail) OVER w AS c, lag(privacy_tier) OVER w AS e, lag(is_archived) OVER w AS f FROM one WINDOW w AS (PARTITION BY id ORDER BY version))
        SELECT id, version, array_to_string(list_filter([CASE WHEN a IS DISTINCT FROM title THEN 'title' END, CASE WHEN b IS DISTINCT FROM summary THEN 'summary' END, CASE WHEN c IS DISTINCT FROM detail THEN 'detail' END, CASE WHEN e IS DISTINCT FROM privacy_tier THEN 'privacy_tier' END, CASE WHEN f IS DISTINCT FROM is_archived THEN 'is_archived' END], lambda x: x IS NOT NULL), ',') AS changed
        FROM l WHERE v IS NOT NULL""",
    "snapshot_difference": f"""WITH {_CUR}, old AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS k FROM nodes WHERE id IS NOT NULL AND updated_at < TIMESTAMP '2026-01-01') WHERE k = 1),
        j AS (SELECT n.id, o.id IS NULL AS added, array_to_string(list_filter([CASE WHEN o.title IS DISTINCT FROM n.title THEN 'title' END, CASE WHEN o.summary IS DISTINCT FROM n.summary THEN 'summary' END, CASE WHEN o.detail IS DISTINCT FROM n.detail THEN 'detail' END, CASE WHEN o.is_archived IS DISTINCT FROM n.is_archived THEN 'is_archived' END], lambda x: x IS NOT NULL), ',') AS c FROM cur n LEFT JOIN old o ON o.id = n.id)
        SELECT id, CASE WHEN added THEN 'added' ELSE 'changed' END AS change, CASE WHEN NOT added THEN c END AS columns FROM j WHERE added OR c <> ''""",
    "last_vectors": f"WITH {_CHUNK} SELECT node_id, chunk_type, chunk_index, model, epoch_us(written) AS written_us FROM chunk",
    "history_window": f"""WITH {_MSG}, c AS (SELECT session_id, row_id, CAST(ceil(octet_length(encode(coalesce(content, ''))) / 4.0) AS BIGINT) AS tokens, sent FROM msg),
        u AS (SELECT session_id, row_id, tokens, sum(tokens) OVER (PARTITION BY session_id ORDER BY sent DESC NULLS LAST, row_id DESC ROWS UNBOUNDED PRECEDING) AS used FROM c) SELECT * FROM u WHERE used <= 4000""",
    "latest_question": f"WITH {_MSG} SELECT session_id, row_id, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sent DESC, row_id DESC) AS k FROM msg WHERE speaker = 'user' AND sent IS NOT NULL) WHERE k = 1",
    "corrections": f"""WITH {_MSG}, s AS (SELECT row_id, session_id, content, lag(content) OVER (PARTITION BY session_id ORDER BY sent, row_id) AS before FROM msg WHERE speaker = 'user' AND content IS NOT NULL AND sent IS NOT NULL),
        w AS (SELECT *, list_transform(regexp_split_to_array(lower(content), '\\s+'), lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) AS a,
            list_filter(list_transform(regexp_split_to_array(lower(coalesce(before, '')), '\\s+'), lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda x: x <> '' AND NOT list_contains([{_STOP}], x)) AS b FROM s),
        f AS (SELECT row_id, session_id, CASE {' '.join(f"WHEN regexp_matches(lower(content), '(^|[^\\p{{L}}\\p{{N}}]){p.replace(chr(39), chr(39) * 2)}([^\\p{{L}}\\p{{N}}]|$)') THEN '{p.replace(chr(39), chr(39) * 2)}'" for p in tx.CORRECTIONS)} END AS phrase,
            list_filter(list_transform(range(1, len(a)), lambda i: CASE WHEN a[i] IN ('not', 'no') THEN a[i + 1] END), lambda x: list_contains(b, x))[1] AS n FROM w)
        SELECT row_id, session_id, phrase, CASE WHEN phrase IS NULL THEN n END AS negated FROM f WHERE phrase IS NOT NULL OR n IS NOT NULL""",
    "message_references": f"WITH {_CUR}, {_MSG}, {_REF} SELECT r.row_id, r.node_id, CASE WHEN n.id IS NULL THEN 'missing' WHEN n.deleted_at IS NOT NULL OR n.is_archived THEN 'orphaned' ELSE 'active' END AS status FROM ref r LEFT JOIN cur n ON n.id = r.node_id",
    "backlinks": f"WITH {_MSG}, {_REF} SELECT node_id, count(*) AS links, count(DISTINCT session_id) AS sessions FROM ref GROUP BY node_id",
    "public_messages": f"""WITH {_tier(False)}, {_MSG}, {_REF} SELECT session_id, count(*) AS messages FROM msg WHERE row_id NOT IN (SELECT row_id FROM ref WHERE node_id IN (SELECT id FROM tier WHERE effective_tier IN ('locked', 'redacted'))) GROUP BY session_id""",
    "prompt_context": f"""WITH {_tier(True)}, {_MSG}, {_REF}, f AS (SELECT session_id, node_id, row_number() OVER (PARTITION BY session_id, node_id ORDER BY sent NULLS FIRST, row_id, position) AS k, sent, row_id, position FROM ref),
        g AS (SELECT f.*, CASE WHEN effective_tier = 'open' THEN 'full' ELSE 'stub' END AS policy, CASE WHEN effective_tier = 'open'
            THEN array_to_string(list_filter(['<document title="' || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '">', replace(replace(replace(summary, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), replace(replace(replace(detail, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</document>'], lambda x: x IS NOT NULL), chr(10))
            ELSE concat('[private note: ', coalesce(title, ''), ']') END AS block FROM f JOIN tier t ON t.id = f.node_id WHERE k = 1 AND deleted_at IS NULL AND NOT is_archived AND effective_tier IN ('open', 'locked')),
        c AS (SELECT session_id, node_id, policy, block, CAST(ceil(octet_length(encode(block)) / 4.0) AS BIGINT) AS tokens, row_number() OVER w AS position, sum(CAST(ceil(octet_length(encode(block)) / 4.0) AS BIGINT)) OVER w AS used FROM g
            WINDOW w AS (PARTITION BY session_id ORDER BY sent NULLS FIRST, row_id, position, node_id ROWS UNBOUNDED PRECEDING))
        SELECT session_id, position, node_id, policy, least(tokens, 8000) AS tokens, least(used, 8000) AS used,
            CASE WHEN used <= 8000 THEN block ELSE substring(block, 1, (SELECT max(i) FROM range(8000, 32001) t(i) WHERE octet_length(encode(substring(block, 1, i))) <= 32000)) END AS text
        FROM c WHERE used <= 8000 OR position = 1""",
    "session_totals": f"""WITH {_MSG}, s AS (SELECT id, max(message_count) AS claimed FROM sessions WHERE id IS NOT NULL GROUP BY id), m AS (SELECT session_id, count(*) AS n, count(*) FILTER (speaker = 'user') AS a, min(sent) AS f, max(sent) AS l FROM msg GROUP BY session_id)
        SELECT id, claimed, coalesce(n, 0) AS messages, coalesce(a, 0) AS asked, CAST(floor(epoch(l)) - floor(epoch(f)) AS BIGINT) AS seconds FROM s LEFT JOIN m ON m.session_id = s.id""",
    "empty_sessions": f"""WITH {_MSG}, s AS (SELECT id, max(started_at) AS started_at FROM sessions WHERE id IS NOT NULL GROUP BY id), e AS (SELECT * FROM s WHERE id NOT IN (SELECT session_id FROM msg WHERE session_id IS NOT NULL))
        SELECT id, row_number() OVER (ORDER BY started_at DESC NULLS LAST, id DESC) = 1 AS kept FROM e""",
    "session_titles": f"""WITH {_MSG}, f AS (SELECT session_id, trim(content) AS t, row_number() OVER (PARTITION BY session_id ORDER BY sent, row_id) AS k FROM msg WHERE speaker = 'user' AND trim(content) <> '' AND sent IS NOT NULL)
        SELECT session_id, CASE WHEN length(t) > 40 THEN substring(t, 1, 40) || '...' ELSE t END AS title FROM f WHERE k = 1""",
    "page_bands": f"""WITH {_TB}, g AS (SELECT *, CASE WHEN y - max(y + height) OVER (PARTITION BY job_id, page_index ORDER BY y, x, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 18 THEN 1 ELSE 0 END AS n FROM tb)
        SELECT block_id, CAST(sum(n) OVER (PARTITION BY job_id, page_index ORDER BY y, x, block_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS band FROM g""",
    "page_medians": f"WITH {_TB} SELECT job_id, page_index, count(*) AS blocks, quantile_disc(height, 0.5) AS height, quantile_disc(width, 0.5) AS width FROM tb GROUP BY job_id, page_index",
    "page_margins": f"WITH {_TB} SELECT block_id, CASE WHEN y + height / 2 <= 792 * 0.08 THEN 'header' WHEN y + height / 2 >= 792 * 0.92 THEN 'footer' ELSE 'body' END AS place FROM tb",
    "uncovered_blocks": f"""WITH {_TB} SELECT block_id FROM tb b WHERE NOT EXISTS (SELECT 1 FROM tb o WHERE o.job_id = b.job_id AND o.page_index = b.page_index AND o.block_id < b.block_id
        AND greatest(least(b.x + b.width, o.x + o.width) - greatest(b.x, o.x), 0) * greatest(least(b.y + b.height, o.y + o.height) - greatest(b.y, o.y), 0) > 0.35 * least(b.width * b.height, o.width * o.height))""",
    "page_markdown": """WITH b AS (SELECT DISTINCT block_id, job_id, page_index, block_index, block_type, formatted_text FROM ingest_blocks),
        s AS (SELECT *, row_number() OVER w AS k, lag(block_type) OVER w AS l FROM b WINDOW w AS (PARTITION BY job_id, page_index ORDER BY block_index, block_id))
        SELECT job_id, page_index, string_agg(CASE WHEN k = 1 THEN '' WHEN block_type = 'ListItem' AND l = 'ListItem' THEN chr(10) ELSE chr(10) || chr(10) END || coalesce(formatted_text, ''), '' ORDER BY k) AS markdown FROM s GROUP BY job_id, page_index""",
    "job_totals": """WITH b AS (SELECT DISTINCT * FROM ingest_blocks), c AS (SELECT *, greatest(length(coalesce(recognized_text, '')), 1) AS n, CASE WHEN confidence IS NOT NULL THEN least(greatest(confidence, 0.0), 1.0) END AS f FROM b)
        SELECT job_id, count(*) AS blocks, count(DISTINCT page_index) AS pages, count(*) FILTER (block_type = 'Table') AS tables, coalesce(bool_or(fragment), false) AS fragments, round(sum(f * n) / sum(n) FILTER (f IS NOT NULL), 9) AS confidence FROM c GROUP BY job_id""",
    "daily_touches": "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS touches, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "hourly_events": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "user_visits": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, k""",
    "throttled_events": "SELECT event_type, start, event_id FROM (SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_id, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 10 MINUTE, ts) ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
}
SQL["document_profile"] = rf"""SELECT doc_id, len({_words('text')}) AS words,
    len(list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.?!])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')) AS sentences,
    CAST(ceil(octet_length(encode(coalesce(text, ''))) / 4.0) AS BIGINT) AS tokens, coalesce(length(text) = n_chars, false) AS right_length FROM documents"""


# ---- more of the same tables --------------------------------------------------------------------


def container_paths(spark, d):
    return knowledge.container_paths(hierarchy.hierarchy(_links(spark, d)), _boxes(spark, d))


def node_languages(spark, d):
    lang = F.get_json_object("meta", "$.lang")
    return _nodes(spark, d).groupBy(F.coalesce(lang, F.lit("unknown")).alias("lang")).agg(F.count("*").alias("nodes"), F.count_if(F.col("meta").isNull()).alias("without_meta"))


def session_scopes(spark, d):
    s = table(spark, d, "sessions").filter("id is not null").select("id", "scope_json").distinct()
    scoped = s.select("id", F.explode(F.array_distinct(F.from_json("scope_json", "array<string>"))).alias("box"))
    b = _boxes(spark, d).select(F.col("id").alias("box"), privacy.rank(F.col("privacy_tier")).alias("n"))
    return scoped.join(b, "box", "left").groupBy("id").agg(F.count("*").alias("scopes"), F.count_if(F.col("n").isNull()).alias("missing"), privacy.of_rank(F.coalesce(F.max("n"), F.lit(0))).alias("tier"))


def session_sources(spark, d):
    return history.references(_messages(spark, d)).select("session_id", "node_id").distinct()


def title_completion(spark, d):
    n = _nodes(spark, d).filter(F.contains(F.lower("title"), F.lit("how to")) & F.col("deleted_at").isNull())
    return n.select("id", "title").orderBy("title", "id").limit(8)


def recent_sessions(spark, d):
    s = table(spark, d, "sessions").filter("id is not null").groupBy("id").agg(F.max("started_at").alias("started_at"))
    return s.orderBy(F.col("started_at").desc_nulls_last(), "id").limit(20)


def repeated_deliveries(spark, d):
    m = table(spark, d, "session_messages").filter("id is not null").groupBy("id").agg(F.count("*").alias("rows"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))
    return m.filter("rows > 1")


def time_notations(spark, d):
    kind = F.when(F.col("created_at").isNull(), "null").when(F.col("created_at").rlike("Z$"), "zulu").when(F.col("created_at").rlike(r"[+-]\d{2}:\d{2}$"), "offset").when(F.col("created_at").rlike(r"^\d{4}-"), "plain").otherwise("other")
    m = table(spark, d, "session_messages").select(kind.alias("kind"), history.instant(F.col("created_at")).alias("t"))
    return m.groupBy("kind").agg(F.count("*").alias("rows"), F.count("t").alias("readable"))


def vector_profile(spark, d):
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    c = table(spark, d, "node_chunks").select("model", "chunk_type", F.size("embedding").alias("n"), F.sqrt(sq).alias("norm"))
    return c.groupBy("model", "chunk_type").agg(F.count("*").alias("vectors"), F.min("n").alias("least_dims"), F.max("n").alias("most_dims"), F.round(F.avg("norm"), 6).alias("norm"), F.count_if(F.col("norm") == 0).alias("zero"))


def node_sizes(spark, d):
    m = table(spark, d, "embedding_models").select("model", "chunk_max_tokens")
    n = _nodes(spark, d).select(tx.estimate(F.col("detail")).alias("tokens"))
    sizes = n.groupBy("tokens").agg(F.count("*").alias("nodes"))  # few sizes, so the models meet sizes, not nodes
    j = sizes.join(m, sizes["tokens"] > m["chunk_max_tokens"], "inner")
    return j.groupBy("model").agg(F.sum("nodes").alias("too_large"), F.sum(F.col("nodes") * F.ceil(F.col("tokens") / F.col("chunk_max_tokens"))).alias("least_pieces"))


def sliding_events(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour", "30 minutes"), "event_type").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "event_type", "events")


def event_keys(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("events"), F.min("ts").alias("first"))


def page_extents(spark, d):
    return pages.extents(_boxed(spark, d))


def reading_order(spark, d):
    return pages.reading_order(_boxed(spark, d))


def job_pages(spark, d):
    b = table(spark, d, "ingest_blocks").groupBy("job_id", "block_type").agg(F.array_join(F.array_sort(F.collect_set("page_index")), ",").alias("pages"))
    return b


QUERIES |= {
    f.__name__: f
    for f in (
        container_paths, node_languages, session_scopes, session_sources, title_completion, recent_sessions, repeated_deliveries, time_notations, vector_profile, node_sizes,
        sliding_events, event_keys, page_extents, reading_order, job_pages,
    )
}

SQL |= {
    "container_paths": _LINKS.rstrip()
    + f""", {_BOX}, way AS (SELECT id, id AS step, 0 AS up FROM link UNION ALL SELECT w.id, l.up, w.up + 1 FROM way w JOIN link l ON l.id = w.step WHERE l.up IS NOT NULL AND w.step NOT IN (SELECT id FROM ring))
        SELECT w.id, string_agg(CASE WHEN b.privacy_tier = 'redacted' THEN '[redacted]' ELSE coalesce(b.name, '') END, ' / ' ORDER BY w.up DESC) AS path,
        ['open', 'local_only', 'locked', 'redacted'][max({_RANK.format('b.privacy_tier')}) + 1] AS tier FROM way w JOIN box b ON b.id = w.step GROUP BY w.id""",
    "node_languages": f"WITH {_CUR} SELECT coalesce(CASE WHEN json_valid(meta) THEN meta ->> 'lang' END, 'unknown') AS lang, count(*) AS nodes, count(*) FILTER (meta IS NULL) AS without_meta FROM cur GROUP BY 1",
    "session_scopes": f"""WITH {_BOX}, s AS (SELECT DISTINCT id, scope_json FROM sessions WHERE id IS NOT NULL AND json_valid(scope_json) AND scope_json LIKE '[%'), e AS (SELECT id, unnest(list_distinct(CAST(json(scope_json) AS VARCHAR[]))) AS box FROM s)
        SELECT e.id, count(*) AS scopes, count(*) FILTER (b.id IS NULL) AS missing, ['open', 'local_only', 'locked', 'redacted'][coalesce(max(CASE WHEN b.id IS NOT NULL THEN {_RANK.format('b.privacy_tier')} END), 0) + 1] AS tier FROM e LEFT JOIN box b ON b.id = e.box GROUP BY e.id""",
    "session_sources": f"WITH {_MSG}, {_REF} SELECT DISTINCT session_id, node_id FROM ref",
    "title_completion": f"WITH {_CUR} SELECT id, title FROM cur WHERE contains(lower(title), 'how to') AND deleted_at IS NULL ORDER BY title, id LIMIT 8",
    "recent_sessions": "SELECT id, max(started_at) AS started_at FROM sessions WHERE id IS NOT NULL GROUP BY id ORDER BY 2 DESC NULLS LAST, id LIMIT 20",
    "repeated_deliveries": 'SELECT id, count(*) AS "rows", min(row_id) AS "first", max(row_id) AS "last" FROM session_messages WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1',
    "time_notations": f"""SELECT CASE WHEN created_at IS NULL THEN 'null' WHEN regexp_matches(created_at, 'Z$') THEN 'zulu' WHEN regexp_matches(created_at, '[+-]\\d{{2}}:\\d{{2}}$') THEN 'offset' WHEN regexp_matches(created_at, '^\\d{{4}}-') THEN 'plain' ELSE 'other' END AS kind,
        count(*) AS "rows", count({_SENT.format('created_at')}) AS readable FROM session_messages GROUP BY 1""",
    "vector_profile": f"""SELECT model, chunk_type, count(*) AS vectors, min(len(embedding)) AS least_dims, max(len(embedding)) AS most_dims, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS norm,
        count(*) FILTER (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) = 0) AS zero FROM node_chunks GROUP BY model, chunk_type""",
    "node_sizes": f"""WITH {_CUR}, s AS (SELECT CAST(ceil(octet_length(encode(coalesce(detail, ''))) / 4.0) AS BIGINT) AS tokens FROM cur)
        SELECT model, count(*) AS too_large, CAST(sum(ceil(tokens / chunk_max_tokens)) AS BIGINT) AS least_pieces FROM s JOIN embedding_models ON tokens > chunk_max_tokens GROUP BY model""",
    "sliding_events": """WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) SELECT start, event_type, count(*) AS events FROM w GROUP BY 1, 2""",
    "event_keys": """SELECT event_type, CAST(CASE WHEN json_valid(props) THEN props ->> 'k' END AS BIGINT) AS k, count(*) AS events, min(ts) AS "first" FROM events GROUP BY 1, 2""",
    "page_extents": f"WITH {_TB} SELECT job_id, page_index, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM tb GROUP BY 1, 2",
    "reading_order": f"WITH {_TB} SELECT block_id, row_number() OVER (PARTITION BY job_id, page_index ORDER BY floor(y / 15), x, block_id) AS place FROM tb",
    "job_pages": "SELECT job_id, block_type, array_to_string(list_sort(list(DISTINCT page_index)), ',') AS pages FROM ingest_blocks GROUP BY 1, 2",
}

QUERIES |= documents.QUERIES
SQL |= documents.SQL
QUERIES |= upkeep.QUERIES
SQL |= upkeep.sql(_CUR, _BOX, _MSG, _REF, _CHUNK, _tier(False), _words, _RANK)
