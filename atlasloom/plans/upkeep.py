"""Queries that keep the knowledge base current: what has to be embedded anew, changes as tables, links, titles, hygiene; with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..common import table
from ..functions import marks, priority, privacy
from ..functions import text as tx
from ..operators import history, knowledge, pages, similarity, state
from . import documents

NEW_YEAR = "2026-01-01"
MODEL = "host-embed"


def _nodes(spark, d):
    return knowledge.current_nodes(table(spark, d, "nodes"))


def _boxes(spark, d):
    return knowledge.containers(table(spark, d, "vault_records"), table(spark, d, "sub_vaults"))


def _messages(spark, d):
    return history.current_messages(table(spark, d, "session_messages"))


def _chunks(spark, d):
    c = table(spark, d, "node_chunks").withColumn("written", history.instant(F.col("computed_at")))
    return state.last_write(c, ["node_id", "chunk_type", "chunk_index", "model"], "written", ("text", "embedding"))


# ---- vectors ------------------------------------------------------------------------------------


def stale_reasons(spark, d):
    """Vectors by model: whose node's content changed after they were computed, whose effective tier did, whose node is gone."""
    n = table(spark, d, "nodes")
    content = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in ("title", "summary", "detail", "privacy_tier", "vault_id", "sub_vault_id", "deleted_at")])
    now = _nodes(spark, d).select("id", content.alias("content"), "vault_id", "sub_vault_id")
    c = _chunks(spark, d).select(F.col("node_id").alias("id"), "model", "written").join(now, "id", "left")
    # of several rows of one instant the greatest hash stands for it on both sides
    c = state.as_of(n.filter("updated_at is not null"), c, "id", "written", "updated_at", content, "held")
    tier = privacy.rank(F.col("privacy_tier"))
    both = table(spark, d, "vault_records").select("id", "updated_at", "privacy_tier").unionByName(table(spark, d, "sub_vaults").select("id", "updated_at", "privacy_tier"))
    ends = _boxes(spark, d).select(F.col("id").alias("box"), tier.alias("now"))
    for box in ("vault_id", "sub_vault_id"):
        was = state.as_of(both.select(F.col("id").alias(box), "updated_at", "privacy_tier"), c, box, "written", "updated_at", tier, f"was_{box}")
        c = was.join(ends.select(F.col("box").alias(box), F.col("now").alias(f"now_{box}")), box, "left")
    moved = lambda b: F.col(f"was_{b}").isNotNull() & (F.col(f"was_{b}") != F.col(f"now_{b}"))
    return c.groupBy("model").agg(
        F.count("*").alias("vectors"), F.count_if(F.col("content").isNotNull() & ~F.col("content").eqNullSafe(F.col("held"))).alias("by_content"),
        F.count_if(moved("vault_id") | moved("sub_vault_id")).alias("by_tier"), F.count_if(F.col("content").isNull()).alias("lost"),
    )


def reembed_queue(spark, d):
    """Active nodes that have no first primary vector of the model yet."""
    have = table(spark, d, "node_chunks").filter((F.col("model") == MODEL) & (F.col("chunk_type") == "primary") & (F.col("chunk_index") == 0) & F.col("embedding").isNotNull()).select(F.col("node_id").alias("id"))
    todo = _nodes(spark, d).filter("deleted_at is null and not is_archived").select("id", "updated_at").join(have, "id", "left_anti")
    return todo.orderBy("updated_at", "id")


def pooled_vectors(spark, d):
    """The mean of a node's vectors of a model, of length 1; the zero vector becomes the first axis."""
    c = _chunks(spark, d).filter("size(embedding) > 0").select("node_id", "model", F.posexplode("embedding").alias("axis", "v"))
    mean = c.groupBy("node_id", "model", "axis").agg(F.avg(F.col("v").cast("double")).alias("v"))
    norm = mean.groupBy("node_id", "model").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    unit = F.when(F.col("norm") > 0, F.col("v") / F.col("norm")).otherwise(F.when(F.col("axis") == 0, 1.0).otherwise(0.0))
    return mean.join(norm, ["node_id", "model"]).select("node_id", "model", "axis", F.round(unit, 6).alias("v"))


def primary_pieces(spark, d):
    """Title and summary of each node as one text within the size of the models that it has vectors of."""
    n = _nodes(spark, d).select(F.col("id").alias("node_id"), F.concat_ws("\n\n", "title", F.nullif("summary", F.lit(""))).alias("text"))
    m = table(spark, d, "embedding_models").select("model", F.col("chunk_max_tokens").cast("bigint").alias("most"))
    pairs = table(spark, d, "node_chunks").select("node_id", "model").distinct()
    j = pairs.join(n, "node_id").join(m, "model")
    return j.select("node_id", "model", F.least(tx.estimate(F.col("text")), F.col("most")).alias("tokens"), (tx.estimate(F.col("text")) > F.col("most")).alias("cut"))


def version_similarity(spark, d):
    """How alike the two last versions of a node are: 1 for the same text, else by their words; blank texts by the empty set."""
    cols = ["id", "version", "title", "summary"]
    n = state.last_write(table(spark, d, "nodes").select(*cols, "updated_at"), ["id", "version"], "updated_at", ("title", "summary"))
    now = _nodes(spark, d).select("id", F.col("version").alias("last"))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    both = n.join(now, "id").select("id", "last", "version", text.alias("t"))
    old = both.filter("version < last").groupBy("id").agg(F.max_by("t", "version").alias("old"))
    new = both.filter("version = last").select("id", F.col("t").alias("new"))
    same = (F.trim("new") != "") & (F.col("new") == F.col("old"))
    s = F.when(same, 1.0).otherwise(tx.jaccard(tx.tokens(F.col("new")), tx.tokens(F.col("old"))))
    return new.join(old, "id").select("id", F.round(s, 9).alias("similarity"))


# ---- changes ------------------------------------------------------------------------------------


def version_diffs(spark, d):
    """What each version's summary changed against the one before, in words: kept, removed and added ones."""
    n = state.last_write(table(spark, d, "nodes").select("id", "version", "summary", "updated_at"), ["id", "version"], "updated_at", ("summary",))
    w = Window.partitionBy("id").orderBy("version")
    both = n.select("id", "version", "summary", F.lag("summary").over(w).alias("old"), F.lag("version").over(w).alias("before")).filter("before is not null")
    c = state.text_changes(both, ["id", "version"], "old", "summary").groupBy("id", "version").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("same", "removed", "added")])
    # how many stay the same has no SQL; both sums are the texts' words
    return c.select("id", "version", (F.col("same") + F.col("removed")).alias("words_before"), (F.col("same") + F.col("added")).alias("words"))


def node_neighbours(spark, d):
    """For every node whose number is divisible by 50, by its first primary vector, the ten nearest of all others."""
    live = _nodes(spark, d).filter("deleted_at is null and not is_archived").select("id")
    c = _chunks(spark, d).filter((F.col("model") == MODEL) & (F.col("chunk_type") == "primary") & (F.col("chunk_index") == 0)).select(F.col("node_id").alias("id"), "embedding")
    rows = c.join(live, "id", "left_semi")
    asked = rows.filter(F.conv(F.right("id", F.lit(8)), 16, 10).cast("bigint") % 50 == 0)
    return similarity.nearest_join(asked, rows, 10).select("query_id", "id", "place", F.round("similarity", 6).alias("similarity"))


def partial_updates(spark, d):
    """Archived nodes get a mark in their title, the others keep all: version and whether to embed anew."""
    n = _nodes(spark, d).select("id", "version", "title", "summary", "is_archived")
    changes = n.filter("is_archived").select("id", F.concat(F.lit("[archived] "), "title").alias("title"))
    return state.updated(n, changes, ["title"], ["title", "summary"]).select("id", "version", "title", "reembed")


def merged_snapshot(spark, d):
    """The rows before the new year with all later changes put in: the current table again."""
    cols = ["id", "title", "summary", "is_archived", "deleted_at"]
    n = table(spark, d, "nodes")
    old = knowledge.current_nodes(n.filter(F.col("updated_at") < F.to_timestamp(F.lit(NEW_YEAR)))).select(*cols)
    new = knowledge.current_nodes(n).filter(F.col("updated_at") >= F.to_timestamp(F.lit(NEW_YEAR))).select(*cols)
    return state.upserted(old, new, ["id"]).select("id", "title", "is_archived")


def soft_deletes(spark, d):
    """Archived nodes are marked as deleted at the new year, unless they are already."""
    n = _nodes(spark, d).select("id", "is_archived", "deleted_at")
    return state.soft_deleted(n, n.filter("is_archived"), F.to_timestamp(F.lit(NEW_YEAR))).select("id", "deleted_at")


def without_archived(spark, d):
    n = _nodes(spark, d).select("id", "is_archived", "vault_id")
    return state.without(n, n.filter("is_archived"), ["id"]).groupBy("vault_id").agg(F.count("*").alias("nodes"))


def merged_meta(spark, d):
    """The nodes' JSON with a field put in or replaced; malformed JSON counts as empty."""
    have = F.coalesce(F.from_json("meta", "map<string,string>"), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(have, lambda k, v: k != "reviewed"), F.create_map(F.lit("reviewed"), F.lit("yes")))
    return _nodes(spark, d).select("id", F.size(merged).alias("fields"), F.element_at(merged, "lang").alias("lang"), F.element_at(merged, "reviewed").alias("reviewed"))


def touched_nodes(spark, d):
    """A node is touched by each message that refers to it: the count, and when it was last looked at."""
    r = history.references(_messages(spark, d)).groupBy("node_id").agg(F.count("*").alias("touches"), F.max("sent").alias("sent"))
    n = _nodes(spark, d).select("id", "last_accessed")
    return n.join(r, n["id"] == r["node_id"]).select("id", "touches", F.unix_micros(F.greatest(F.col("last_accessed").cast("timestamp"), F.col("sent"))).alias("last_us"))


def edited_sessions(spark, d):
    """Every session after its first question is asked anew: what stays, by speaker."""
    m = _messages(spark, d).filter("session_id is not null")
    first = m.filter("speaker = 'user' and sent is not null").groupBy("session_id").agg(F.min_by("row_id", F.struct("sent", "row_id")).alias("row_id")).withColumn("content", F.lit("asked anew"))
    kept = state.truncated(m.select("session_id", "row_id", "sent", "speaker", "content"), first)
    return kept.groupBy("session_id").agg(F.count("*").alias("kept"), F.count_if(F.col("content") == "asked anew").alias("edited"))


def kept_messages(spark, d):
    """Sessions that began before the new year are deleted with their messages: what stays."""
    s = table(spark, d, "sessions").filter("id is not null").groupBy("id").agg(F.max("started_at").alias("started_at"))
    old = s.filter(F.col("started_at") < F.to_timestamp(F.lit(NEW_YEAR)))
    left, messages = state.cascaded(s, _messages(spark, d), old, "id", "session_id")
    return messages.join(left.select(F.col("id").alias("session_id"), F.lit(True).alias("known")), "session_id", "left").groupBy(F.coalesce("known", F.lit(False)).alias("known"), "speaker").agg(F.count("*").alias("messages"))


def profile_changes(spark, d):
    """Nodes whose priority profile follows their use: many uses slow, few fast; pinned and frozen ones stay."""
    p = _nodes(spark, d).filter("deleted_at is null").select("id", priority.parsed(F.col("priority")).alias("p"))
    now = F.coalesce("p.profile", F.lit("standard"))
    n = F.coalesce("p.access_count_30active", F.lit(0))
    new = F.when(n >= 7, "slow").when(n <= 2, "fast").otherwise("standard")
    free = (now != "pinned") & ~F.coalesce("p.frozen", F.lit(False))
    return p.filter(free & (new != now)).select("id", now.alias("profile"), new.alias("new_profile"))


# ---- links and searches -------------------------------------------------------------------------


def wikilinks(spark, d):
    """Links between notes, with the node of that title, if any; of several the greatest id."""
    links = table(spark, d, "documents").select("doc_id", F.explode(marks.wikilinks(F.col("text"))).alias("target"))
    titles = _nodes(spark, d).filter("deleted_at is null").groupBy(F.lower("title").alias("key")).agg(F.max("id").alias("node_id"))
    return links.join(titles, F.lower("target") == F.col("key"), "left").select("doc_id", "target", "node_id")


def live_backlinks(spark, d):
    """References of messages to nodes that exist, by the kind of node."""
    n = _nodes(spark, d).select(F.col("id").alias("node_id"), F.coalesce("node_type", F.lit("none")).alias("node_type"))
    return history.references(_messages(spark, d)).join(n, "node_id").groupBy("node_type").agg(F.count("*").alias("links"), F.count_distinct("node_id").alias("nodes"))


def extractable_sessions(spark, d):
    """Sessions that have three or more messages left when those that refer to closed nodes are dropped."""
    tiered = knowledge.with_tiers(_nodes(spark, d), _boxes(spark, d))
    return history.without_private(_messages(spark, d), tiered).groupBy("session_id").agg(F.count("*").alias("messages")).filter("messages >= 3")


def document_hits(spark, d):
    """Stored pieces that hold a word, promoted to the document that their node was imported from, or to the node."""
    hits = _chunks(spark, d).filter(F.contains(F.lower("text"), F.lit("timeline"))).select("node_id", "chunk_type", "chunk_index", "model")
    n = _nodes(spark, d).filter("deleted_at is null").select(F.col("id").alias("node_id"), "source")
    return hits.join(n, "node_id").groupBy(F.coalesce("source", "node_id").alias("document")).agg(F.count_distinct("node_id").alias("nodes"), F.count("*").alias("pieces"))


# ---- pages and texts ----------------------------------------------------------------------------


def sparse_pages(spark, d):
    """Pages with so little on them that their scan is read instead: fewer than two blocks, or less than a hundredth of the area."""
    b = documents.boxed(spark, d)
    area = F.sum(F.col("width") * F.col("height")) / (documents.WIDTH * documents.HEIGHT)
    return b.groupBy("job_id", "page_index").agg(F.count("*").alias("blocks"), F.round(area, 9).alias("share"), ((F.count("*") < 2) | (area < 0.01)).alias("sparse"))


def job_confidence(spark, d):
    """The mean confidence of a job's pages, 1 where none has any, within 0 and 1; whether a section of it has tables."""
    b = documents.ingested(spark, d)
    page = b.groupBy("job_id", "page_index").agg(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("c"), F.bool_or(F.coalesce(F.col("block_type") == "Table", F.lit(False))).alias("t"))
    return page.groupBy("job_id").agg(F.round(F.least(F.greatest(F.coalesce(F.avg("c"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0)), 9).alias("confidence"), F.bool_or("t").alias("tables"))


def session_tokens(spark, d):
    """Tokens of a session as stored and by a quarter of its characters."""
    return _messages(spark, d).filter("session_id is not null").groupBy("session_id").agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("stored"), F.ceil(F.sum(F.length(F.coalesce("content", F.lit("")))) / 4).cast("bigint").alias("estimated"))


def chunk_titles(spark, d):
    """A title for each chunk of an imported job: its first line that says something, else its heading, and its number."""
    c = pages.block_chunks(documents.ingested(spark, d)).select("job_id", "part", "chunk_index", "heading", "text")
    total = c.groupBy("job_id", "part").agg(F.count("*").alias("of"))
    j = c.join(total, ["job_id", "part"])
    n = (F.col("chunk_index") + 1).cast("string")
    line = F.coalesce(tx.content_line(F.col("text")), tx.content_line(F.col("heading")), F.concat(F.lit("Chunk "), n))
    suffix = F.when(F.col("of") > 1, F.concat(F.lit(" ("), n, F.lit("/"), F.col("of").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit(" ("), n, F.lit(")")))
    title = F.concat("job_id", F.lit(" · "), line, suffix)
    return j.select("job_id", "part", "chunk_index", title.alias("title"), tx.without_count(title).alias("base"))


def summary_heads(spark, d):
    return _nodes(spark, d).select("id", tx.summary_head(F.col("detail"), 120).alias("head"))


def block_markdown(spark, d):
    """Headings with their signs, list items with one bullet, else the text in one line."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce("recognized_text", F.lit("")), r"\s*\n\s*", " "), r"^\s+|\s+$", "")
    item = F.concat(F.lit("- "), F.regexp_replace(t, r"^[•◦▪*-]\s*", ""))
    level = F.least(F.greatest(F.coalesce("heading_level", F.lit(1)), F.lit(1)), F.lit(6))
    shown = F.when(F.col("block_type") == "Heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), t)).when(F.col("block_type") == "ListItem", item).otherwise(t)
    return documents.ingested(spark, d).select("block_id", shown.alias("markdown"))


def text_hygiene(spark, d):
    """Signs of careless extraction: a blank before a mark that belongs to the word before, behind an opening one, or doubled."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", t.rlike(r" [,.;:!?)\]}]").alias("space_before"), t.rlike(r"[(\[{] ").alias("space_behind"), F.contains(t, F.lit("  ")).alias("doubled"))


def steering_texts(spark, d):
    """Messages that try to steer a model, quoted phrases aside, and labels of their words for drawings."""
    m = _messages(spark, d).select("row_id", marks.steers(F.col("content")).alias("steers"), F.length(marks.whitened(F.coalesce("content", F.lit("")))).alias("plain"))
    return m.groupBy("steers").agg(F.count("*").alias("messages"), F.sum("plain").alias("plain"))


QUERIES = {
    f.__name__: f
    for f in (
        stale_reasons, reembed_queue, pooled_vectors, primary_pieces, version_similarity, partial_updates, merged_snapshot, soft_deletes, without_archived, merged_meta, touched_nodes, edited_sessions,
        kept_messages, profile_changes, wikilinks, live_backlinks, extractable_sessions, document_hits, sparse_pages, job_confidence, session_tokens, chunk_titles, summary_heads, block_markdown,
        text_hygiene, steering_texts, version_diffs, node_neighbours,
    )
}


def sql(cur: str, box: str, msg: str, ref: str, chunk: str, tier: str, words, rank: str) -> dict[str, str]:
    """The SQL of the queries, over the common parts of the registry."""
    con = "md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({{0}}{c} AS VARCHAR), chr(1))" for c in ("title", "summary", "detail", "privacy_tier", "vault_id", "sub_vault_id", "deleted_at")) + "))"
    at = "CAST(c.written AT TIME ZONE 'UTC' AS TIMESTAMP)"
    trim = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    line = lambda x: rf"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '\r?\n'), lambda z: {trim('z')}), lambda z: length(z) >= 4 AND NOT regexp_matches(lower(z), '^(due:|name:|student:|page )|due date') AND regexp_matches(z, '\p{{L}}'))[1]"
    cut = lambda x: f"CASE WHEN length({x}) > 80 THEN left({x}, 77) || '...' ELSE {x} END"
    return {
        "stale_reasons": f"""WITH {cur}, {box}, {chunk}, rows AS (SELECT id, updated_at, max({con.format('')}) AS h FROM nodes WHERE updated_at IS NOT NULL GROUP BY 1, 2),
            boxes AS (SELECT id, updated_at, max({rank.format('privacy_tier')}) AS r FROM (SELECT id, updated_at, privacy_tier FROM vault_records UNION ALL SELECT id, updated_at, privacy_tier FROM sub_vaults) GROUP BY 1, 2),
            k AS (SELECT c.model, n.id IS NULL AS lost, {con.format('n.')} AS now, (SELECT arg_max(h, updated_at) FROM rows r WHERE r.id = c.node_id AND r.updated_at <= {at}) AS held,
                (SELECT arg_max(r, updated_at) FROM boxes b WHERE b.id = n.vault_id AND b.updated_at <= {at}) AS v, (SELECT arg_max(r, updated_at) FROM boxes b WHERE b.id = n.sub_vault_id AND b.updated_at <= {at}) AS s,
                (SELECT {rank.format('privacy_tier')} FROM box b WHERE b.id = n.vault_id) AS nv, (SELECT {rank.format('privacy_tier')} FROM box b WHERE b.id = n.sub_vault_id) AS ns
                FROM chunk c LEFT JOIN cur n ON n.id = c.node_id)
            SELECT model, count(*) AS vectors, count(*) FILTER (NOT lost AND now IS DISTINCT FROM held) AS by_content, count(*) FILTER ((v IS NOT NULL AND v <> nv) OR (s IS NOT NULL AND s <> ns)) AS by_tier, count(*) FILTER (lost) AS lost FROM k GROUP BY model""",
        "version_diffs": """WITH v AS (SELECT id, version, coalesce(summary, '') AS s FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, version ORDER BY updated_at DESC NULLS LAST, summary) = 1),
            l AS (SELECT id, version, s, lag(s) OVER (PARTITION BY id ORDER BY version) AS o FROM v)
            SELECT id, version, len(regexp_extract_all(o, '\\S+')) AS words_before, len(regexp_extract_all(s, '\\S+')) AS words FROM l WHERE o IS NOT NULL AND (o <> '' OR s <> '')""",
        "node_neighbours": f"""WITH {cur}, {chunk}, r AS (SELECT node_id AS id, embedding AS e FROM chunk WHERE model = '{MODEL}' AND chunk_type = 'primary' AND chunk_index = 0 AND embedding IS NOT NULL AND node_id IN (SELECT id FROM cur WHERE deleted_at IS NULL AND NOT is_archived)),
            j AS (SELECT q.id AS query_id, r.id, coalesce(list_cosine_similarity(list_transform(q.e, lambda z: CAST(z AS DOUBLE)), list_transform(r.e, lambda z: CAST(z AS DOUBLE))), 0) AS s FROM r q JOIN r ON r.id <> q.id AND len(r.e) = len(q.e) WHERE CAST('0x' || right(q.id, 8) AS BIGINT) % 50 = 0)
            SELECT query_id, id, place, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS place FROM j) WHERE place <= 10""",
        "reembed_queue": f"""WITH {cur} SELECT id, updated_at FROM cur WHERE deleted_at IS NULL AND NOT is_archived
            AND id NOT IN (SELECT node_id FROM node_chunks WHERE model = '{MODEL}' AND chunk_type = 'primary' AND chunk_index = 0 AND embedding IS NOT NULL AND node_id IS NOT NULL)""",
        "pooled_vectors": f"""WITH {chunk}, e AS (SELECT node_id, model, unnest(range(len(embedding))) AS axis, unnest(embedding) AS v FROM chunk WHERE len(embedding) > 0),
            m AS (SELECT node_id, model, axis, avg(CAST(v AS DOUBLE)) AS v FROM e GROUP BY 1, 2, 3), n AS (SELECT node_id, model, sqrt(sum(v * v)) AS norm FROM m GROUP BY 1, 2)
            SELECT node_id, model, CAST(axis AS INTEGER) AS axis, round(CASE WHEN norm > 0 THEN v / norm WHEN axis = 0 THEN 1.0 ELSE 0.0 END, 6) AS v FROM m JOIN n USING (node_id, model)""",
        "primary_pieces": f"""WITH {cur}, p AS (SELECT DISTINCT node_id, model FROM node_chunks), t AS (SELECT id AS node_id, CAST(ceil(octet_length(encode(concat_ws(chr(10) || chr(10), title, nullif(summary, '')))) / 4.0) AS BIGINT) AS n FROM cur)
            SELECT node_id, model, least(n, chunk_max_tokens) AS tokens, n > chunk_max_tokens AS cut FROM p JOIN t USING (node_id) JOIN embedding_models USING (model)""",
        "version_similarity": f"""WITH {cur}, v AS (SELECT id, version, coalesce(title, '') || ' ' || coalesce(summary, '') AS t FROM nodes QUALIFY row_number() OVER (PARTITION BY id, version ORDER BY updated_at DESC NULLS LAST, title, summary) = 1),
            o AS (SELECT v.id, arg_max(v.t, v.version) FILTER (v.version < cur.version) AS o, max(v.t) FILTER (v.version = cur.version) AS n FROM v JOIN cur ON cur.id = v.id GROUP BY 1),
            w AS (SELECT id, o, n, {words('n')} AS a, {words('o')} AS b FROM o WHERE o IS NOT NULL)
            SELECT id, round(CASE WHEN trim(n) <> '' AND n = o THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 9) AS similarity FROM w""",
        "partial_updates": f"WITH {cur} SELECT id, version + CASE WHEN is_archived AND title IS NOT NULL THEN 1 ELSE 0 END AS version, CASE WHEN is_archived THEN '[archived] ' || title ELSE title END AS title, coalesce(is_archived AND title IS NOT NULL, false) AS reembed FROM cur",
        "merged_snapshot": f"""WITH {cur}, old AS (SELECT * FROM nodes WHERE id IS NOT NULL AND updated_at < TIMESTAMP '{NEW_YEAR}' QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1), new AS (SELECT * FROM cur WHERE updated_at >= TIMESTAMP '{NEW_YEAR}')
            SELECT coalesce(n.id, o.id) AS id, coalesce(n.title, o.title) AS title, coalesce(n.is_archived, o.is_archived) AS is_archived FROM old o FULL JOIN new n ON n.id = o.id""",
        "soft_deletes": f"WITH {cur} SELECT id, CASE WHEN is_archived AND deleted_at IS NULL THEN TIMESTAMP '{NEW_YEAR}' ELSE deleted_at END AS deleted_at FROM cur",
        "without_archived": f"WITH {cur} SELECT vault_id, count(*) AS nodes FROM cur WHERE NOT coalesce(is_archived, false) GROUP BY 1",
        "merged_meta": f"""WITH {cur}, j AS (SELECT id, CASE WHEN json_valid(meta) AND meta LIKE '{{%' THEN meta ELSE '{{}}' END AS m FROM cur)
            SELECT id, CAST(len(list_filter(json_keys(m), lambda k: k <> 'reviewed')) + 1 AS INTEGER) AS fields, m ->> 'lang' AS lang, 'yes' AS reviewed FROM j""",
        "touched_nodes": f"""WITH {cur}, {msg}, {ref}, r AS (SELECT node_id, count(*) AS touches, max(sent) AS sent FROM ref GROUP BY 1)
            SELECT id, touches, epoch_us(CASE WHEN last_accessed IS NULL THEN sent WHEN sent IS NULL THEN last_accessed::TIMESTAMPTZ ELSE greatest(last_accessed::TIMESTAMPTZ, sent) END) AS last_us FROM cur JOIN r ON r.node_id = cur.id""",
        "edited_sessions": f"""WITH {msg}, f AS (SELECT session_id, arg_min(row_id, (sent, row_id)) AS r FROM msg WHERE speaker = 'user' AND sent IS NOT NULL AND session_id IS NOT NULL GROUP BY 1), a AS (SELECT f.session_id, f.r, m.sent AS at FROM f JOIN msg m ON m.row_id = f.r)
            SELECT m.session_id, count(*) AS kept, count(*) FILTER (m.row_id = a.r) AS edited FROM msg m LEFT JOIN a ON a.session_id = m.session_id WHERE m.session_id IS NOT NULL AND NOT coalesce(m.sent > a.at OR (m.sent = a.at AND m.row_id > a.r), false) GROUP BY 1""",
        "kept_messages": f"""WITH {msg}, s AS (SELECT id, max(started_at) AS t FROM sessions WHERE id IS NOT NULL GROUP BY 1)
            SELECT s.id IS NOT NULL AS known, speaker, count(*) AS messages FROM msg m LEFT JOIN s ON s.id = m.session_id WHERE NOT coalesce(s.t < TIMESTAMP '{NEW_YEAR}', false) GROUP BY 1, 2""",
        "profile_changes": f"""WITH {cur}, p AS (SELECT id, CASE WHEN json_valid(priority) AND priority LIKE '{{%' THEN priority ELSE '{{}}' END AS j FROM cur WHERE deleted_at IS NULL),
            q AS (SELECT id, coalesce(j ->> 'profile', 'standard') AS profile, coalesce(CAST(j ->> 'access_count_30active' AS BIGINT), 0) AS n, coalesce(CAST(j ->> 'frozen' AS BOOLEAN), false) AS frozen FROM p),
            w AS (SELECT *, CASE WHEN n >= 7 THEN 'slow' WHEN n <= 2 THEN 'fast' ELSE 'standard' END AS new_profile FROM q) SELECT id, profile, new_profile FROM w WHERE profile <> 'pinned' AND NOT frozen AND profile <> new_profile""",
        "wikilinks": rf"""WITH {cur}, l AS (SELECT doc_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]', 1), lambda x: trim(x)), lambda x: x <> ''))) AS target FROM documents),
            t AS (SELECT lower(title) AS k, max(id) AS node_id FROM cur WHERE deleted_at IS NULL GROUP BY 1) SELECT doc_id, target, node_id FROM l LEFT JOIN t ON t.k = lower(target)""",
        "live_backlinks": f"WITH {cur}, {msg}, {ref} SELECT coalesce(node_type, 'none') AS node_type, count(*) AS links, count(DISTINCT node_id) AS nodes FROM ref JOIN cur ON cur.id = ref.node_id GROUP BY 1",
        "extractable_sessions": f"""WITH {tier}, {msg}, {ref} SELECT session_id, count(*) AS messages FROM msg WHERE row_id NOT IN (SELECT row_id FROM ref WHERE node_id IN (SELECT id FROM tier WHERE effective_tier IN ('locked', 'redacted'))) GROUP BY 1 HAVING count(*) >= 3""",
        "document_hits": f"WITH {cur}, {chunk} SELECT coalesce(n.source, c.node_id) AS document, count(DISTINCT c.node_id) AS nodes, count(*) AS pieces FROM chunk c JOIN cur n ON n.id = c.node_id AND n.deleted_at IS NULL WHERE contains(lower(c.text), 'timeline') GROUP BY 1",
        "sparse_pages": "WITH tb AS (SELECT DISTINCT block_id, job_id, page_index, bbox FROM text_blocks) SELECT job_id, page_index, count(*) AS blocks, round(sum(bbox.width * bbox.height) / (612.0 * 792.0), 9) AS share, count(*) < 2 OR sum(bbox.width * bbox.height) / (612.0 * 792.0) < 0.01 AS sparse FROM tb GROUP BY 1, 2",
        "job_confidence": """WITH ib AS (SELECT DISTINCT block_id, job_id, page_index, block_type, confidence FROM ingest_blocks), p AS (SELECT job_id, page_index, avg(confidence) FILTER (confidence > 0) AS c, bool_or(coalesce(block_type = 'Table', false)) AS t FROM ib GROUP BY 1, 2)
            SELECT job_id, round(least(greatest(coalesce(avg(c), 1.0), 0.0), 1.0), 9) AS confidence, bool_or(t) AS tables FROM p GROUP BY 1""",
        "session_tokens": f"WITH {msg} SELECT session_id, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS stored, CAST(ceil(sum(length(coalesce(content, ''))) / 4.0) AS BIGINT) AS estimated FROM msg WHERE session_id IS NOT NULL GROUP BY 1",
        "chunk_titles": f"""WITH ch AS (SELECT * FROM ({documents.SQL['block_chunks']})), f AS (SELECT *, count(*) OVER (PARTITION BY job_id, part) AS n, {line('text')} AS a, {line('heading')} AS b FROM ch),
            t AS (SELECT job_id, part, chunk_index, job_id || ' · ' || coalesce({cut('a')}, {cut('b')}, 'Chunk ' || (chunk_index + 1)) || CASE WHEN n > 1 THEN ' (' || (chunk_index + 1) || '/' || n || ')' ELSE ' (' || (chunk_index + 1) || ')' END AS title FROM f)
            SELECT *, regexp_replace(title, '\\s*\\(\\d+(?:/\\d+)?\\)\\s*$', '') AS base FROM t""",
        "summary_heads": rf"""WITH {cur}, h AS (SELECT id, regexp_replace(detail, '(^|\s)({'|'.join(tx.ABBREVIATIONS)}|[A-Z]{{1,2}})\.', '\1\2' || chr(1), 'g') AS t FROM cur), e AS (SELECT id, t, regexp_extract(t, '^((?s:.{{119,}}?)[.?!])', 1) AS x FROM h)
            SELECT id, replace(CASE WHEN x = '' THEN t ELSE x END, chr(1), '.') AS head FROM e""",
        "block_markdown": rf"""WITH ib AS (SELECT DISTINCT block_id, block_type, heading_level, {trim(chr(32) + "regexp_replace(coalesce(recognized_text, ''), '" + chr(92) + "s*" + chr(92) + "n" + chr(92) + "s*', ' ', 'g')")} AS t FROM ingest_blocks)
            SELECT block_id, CASE WHEN block_type = 'Heading' THEN repeat('#', least(greatest(coalesce(heading_level, 1), 1), 6)::INTEGER) || ' ' || t WHEN block_type = 'ListItem' THEN '- ' || regexp_replace(t, '^[•◦▪*-]\s*', '') ELSE t END AS markdown FROM ib""",
        "text_hygiene": r"SELECT doc_id, regexp_matches(coalesce(text, ''), ' [,.;:!?)\]}]') AS space_before, regexp_matches(coalesce(text, ''), '[(\[{] ') AS space_behind, contains(coalesce(text, ''), '  ') AS doubled FROM documents",
        "steering_texts": rf"""WITH {msg}, b AS (SELECT regexp_replace(lower(coalesce(content, '')), '["“„«][^"”“»\n]*["”“»]', ' ', 'g') AS t, length(regexp_replace(coalesce(content, ''), '[^\p{{L}}\p{{N}} \-]', '', 'g')) AS plain FROM msg)
            SELECT {' OR '.join(f"contains(t, '{p}')" for p in marks.STEERING)} AS steers, count(*) AS messages, CAST(sum(plain) AS BIGINT) AS plain FROM b GROUP BY 1""",
    }
