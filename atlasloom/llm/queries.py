"""Registered queries of the text operators, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import newest, table
from ..operators import history
from . import chunking, conversations, lookalike, packing, pii, scans, tokens


def _nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The current rows of nodes: the greatest version of an id."""
    return newest(table(spark, d, "nodes").select("id", "version", *columns), ["id"], [F.col("version").desc_nulls_last()])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Oversized texts by model: those that the splitting cuts."""
    models = table(spark, d, "embedding_models")
    nodes = chunking.split_oversized(_nodes(spark, d, "detail"), models, ["id"], "detail", with_text=False)
    chunks = chunking.split_oversized(table(spark, d, "node_chunks").select("node_id", "chunk_type", "chunk_index", "model", "text"), models, ["node_id", "chunk_type", "chunk_index"], "text", own_model="model", with_text=False)
    first = lambda df: df.filter("piece = 0 and pieces > 1")
    a = first(nodes).select(F.col("id").alias("node_id"), F.lit("node").alias("chunk_type"), F.lit(-1).cast("long").alias("chunk_index"), "model")
    b = first(chunks).select("node_id", "chunk_type", F.col("chunk_index").cast("long").alias("chunk_index"), "model")
    return a.unionByName(b).distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all oversized texts: of nodes by each model, of stored pieces by their own."""
    models = table(spark, d, "embedding_models")
    nodes = chunking.split_oversized(_nodes(spark, d, "detail"), models, ["id"], "detail")
    stored = table(spark, d, "node_chunks").select("node_id", "chunk_type", "chunk_index", "model", "text", history.instant(F.col("computed_at")).alias("written"))
    chunks = chunking.split_oversized(newest(stored, ["node_id", "chunk_type", "chunk_index", "model"], [F.col("written").desc_nulls_last()]), models, ["node_id", "chunk_type", "chunk_index"], "text", own_model="model")
    a = nodes.select(F.col("id").alias("node_id"), F.lit("node").alias("chunk_type"), F.lit(-1).alias("source_index"), "model", F.col("piece").alias("chunk_index"), F.col("piece_text").alias("text"))
    b = chunks.select("node_id", "chunk_type", F.col("chunk_index").cast("int").alias("source_index"), "model", F.col("piece").alias("chunk_index"), F.col("piece_text").alias("text"))
    return a.unionByName(b)


def p1_check(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold for the pieces of nodes: all oversized texts there, no piece too large or foreign to its text, first and last at its ends."""
    n = _nodes(spark, d, "detail").select(F.col("id").alias("node_id"), "detail")
    models = table(spark, d, "embedding_models").select("model", "chunk_max_tokens")
    p = p1_pieces(spark, d).filter("chunk_type = 'node'").join(models, "model").join(n, "node_id")
    large = F.ceil(F.octet_length("text") / chunking.TOKEN) > F.col("chunk_max_tokens")
    per = p.groupBy("node_id", "model").agg(
        F.count_if(large).alias("large"), F.count_if(~F.contains("detail", "text")).alias("foreign"),
        F.count_if((F.col("chunk_index") == 0) & F.startswith("detail", "text")).alias("first"), F.max_by(F.endswith("detail", "text"), "chunk_index").alias("last"),
    )
    return per.agg(F.count("*").alias("texts"), F.coalesce(F.sum("large"), F.lit(0)).alias("too_large"), F.coalesce(F.sum("foreign"), F.lit(0)).alias("foreign"), F.count_if((F.col("first") != 1) | ~F.col("last")).alias("open_ends"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(field_name, row_key, text) of the current messages and nodes."""
    m = newest(table(spark, d, "session_messages").select("id", "row_id", "content"), ["id"], [F.col("row_id").asc_nulls_last()])
    n = _nodes(spark, d, "summary", "detail")
    both = F.explode(F.array(F.struct(F.lit("summary").alias("f"), F.col("summary").alias("t")), F.struct(F.lit("detail").alias("f"), F.col("detail").alias("t")))).alias("x")
    return m.select(F.lit("content").alias("field_name"), F.col("id").alias("row_key"), F.col("content").alias("text")).unionByName(
        n.select("id", both).select(F.col("x.f").alias("field_name"), F.col("id").alias("row_key"), F.col("x.t").alias("text"))
    )


def _names(spark: SparkSession, d: str) -> pii.Model:
    """What all rows of both tables show about names, straight from the scans: no row has to move for it."""
    m, n = table(spark, d, "session_messages"), table(spark, d, "nodes")
    return pii.learn(m.select(F.col("content").alias("text")).union(n.select(F.explode(F.array("summary", "detail")))), "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d).select(F.struct("field_name", "row_key").alias("key"), "text")
    return pii.find(t, "key", "text", _names(spark, d)).select("key.field_name", "key.row_key", "pii_kind", "start_at")


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d).select(F.struct("field_name", "row_key").alias("key"), "text")
    return pii.redacted(t, "key", "text", _names(spark, d)).select("key.field_name", "key.row_key", "text")


def p3_check(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold for the redacted texts: as many as there are texts, and as many new placeholders as found occurrences."""
    signs = lambda c: F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[(?:EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME)\]"), F.lit(0)))
    was = _texts(spark, d).select("field_name", "row_key", signs(F.col("text")).alias("was"))
    now = p3_redacted(spark, d).select("field_name", "row_key", signs(F.col("text")).alias("now"))
    found = p3_found(spark, d).groupBy("field_name", "row_key").agg(F.count("*").alias("found"))
    j = was.join(now, ["field_name", "row_key"], "full").join(found, ["field_name", "row_key"], "full")
    return j.agg(F.count("*").alias("texts"), F.count_if(~(F.col("now") - F.col("was")).eqNullSafe(F.coalesce("found", F.lit(0)))).alias("unlike"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.faults(table(spark, d, "sessions"), table(spark, d, "session_messages"))


def p4_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "sessions"), table(spark, d, "session_messages"))


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    """The same turn by turn."""
    c = p4_conversations(spark, d).select("session_id", "part", F.posexplode("turns").alias("at", "t"))
    return c.select("session_id", (F.col("part") * conversations.TURNS + F.col("at")).cast("long").alias("turn"), "t.role", "t.content")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return scans.blocks((table(spark, d, "ingest_blocks"), "recognized_text", "formatted_text"), (table(spark, d, "text_blocks"), "text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(_blocks(spark, d))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Continuous paragraphs of each job, also those that run over a block or page end."""
    return scans.whole(scans.paragraphs(_blocks(spark, d)))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold for the ids: their bytes in order are the text's."""
    t = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("was"))
    back = tokens.decode(p6_ids(spark, d), "doc_id", "ids").select("doc_id", F.sha2("bytes", 256).alias("now"))
    return t.join(back, "doc_id", "full").agg(F.count("*").alias("documents"), F.count_if(~F.col("was").eqNullSafe(F.col("now"))).alias("unlike"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.count(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "tokens", 2048)


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold for the containers: all documents there, none overfull, none cut that fits."""
    c = p7_containers(spark, d)
    fill = c.groupBy("container_id").agg(F.sum("size").alias("fill")).agg(F.count_if(F.col("fill") > 2048).alias("overfull"))
    per = c.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("size").alias("size"))
    docs = per.agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= 2048)).alias("cut"))
    return docs.crossJoin(F.broadcast(fill)).select("documents", "overfull", "cut")  # one row each


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look(table(spark, d, "documents"), "doc_id", "text").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.one_form(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("form").alias("text"))


QUERIES = {
    "p1_found": p1_found, "p1_pieces": p1_pieces, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_conversations": p4_conversations, "p4_turns": p4_turns,
    "p5_found": p5_found, "p5_paragraphs": p5_paragraphs, "p6_ids": p6_ids, "p7_containers": p7_containers, "p8_found": p8_found, "p8_forms": p8_forms,
    "p1_check": p1_check, "p3_check": p3_check, "p6_check": p6_check, "p7_check": p7_check,
}

SQL = {
    "p1_found": """
        WITH n AS (SELECT id, detail FROM (SELECT id, detail, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS k FROM nodes WHERE id IS NOT NULL) WHERE k = 1)
        SELECT DISTINCT n.id AS node_id, 'node' AS chunk_type, CAST(-1 AS BIGINT) AS chunk_index, m.model AS model
        FROM n JOIN embedding_models m ON ceil(octet_length(encode(n.detail)) / 4.0) > m.chunk_max_tokens
        UNION
        SELECT DISTINCT c.node_id, c.chunk_type, CAST(c.chunk_index AS BIGINT), c.model
        FROM node_chunks c JOIN embedding_models m ON c.model = m.model WHERE ceil(octet_length(encode(c.text)) / 4.0) > m.chunk_max_tokens
    """,
    "p4_found": r"""
        WITH c AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_id) AS k FROM session_messages) WHERE k = 1
        ), m AS (
            SELECT session_id, row_id, coalesce(lower(trim(role)), '') AS role,
                CASE WHEN regexp_matches(created_at, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}')
                     THEN try_cast(CASE WHEN regexp_matches(created_at, '(Z|[+-]\d{2}:\d{2})$') THEN created_at ELSE created_at || 'Z' END AS TIMESTAMPTZ) END AS t,
                content IS NULL OR regexp_matches(content, '^[\s\x{A0}\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{AD}\x{3000}]*$') AS blank
            FROM c
        ), o AS (
            SELECT *, row_number() OVER w AS pos, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS users
            FROM m WINDOW w AS (PARTITION BY session_id ORDER BY t, row_id)
        ), talk AS (SELECT * FROM o WHERE role IN ('user', 'assistant')),
        runs AS (
            SELECT *, lead(role) OVER (PARTITION BY session_id ORDER BY pos) AS next_role FROM talk
        ), asked AS (
            SELECT session_id, users FROM runs WHERE role = 'user' AND (next_role IS NULL OR next_role = 'assistant')
        ), lost AS (
            SELECT DISTINCT a.session_id FROM asked a WHERE NOT EXISTS (
                SELECT 1 FROM talk t WHERE t.session_id = a.session_id AND t.users = a.users AND t.role = 'assistant' AND NOT t.blank)
        ), per AS (
            SELECT session_id, bool_or(role NOT IN ('user', 'assistant', 'system') OR t IS NULL) AS bad,
                bool_or(role IN ('user', 'assistant') AND NOT blank) AS said,
                arg_min(role, pos) FILTER (role <> 'system') AS opener
            FROM o GROUP BY session_id
        ), s AS (SELECT DISTINCT id FROM sessions),
        ids AS (SELECT id FROM s UNION SELECT session_id FROM per)
        SELECT session_id, fault FROM (
            SELECT ids.id AS session_id, CASE
                WHEN s.id IS NULL OR coalesce(per.bad, false) OR coalesce(per.opener, '') = 'assistant' THEN 'broken'
                WHEN NOT coalesce(per.said, false) THEN 'empty'
                WHEN lost.session_id IS NOT NULL THEN 'missing_reply' END AS fault
            FROM ids LEFT JOIN s ON s.id = ids.id LEFT JOIN per ON per.session_id = ids.id LEFT JOIN lost ON lost.session_id = ids.id)
        WHERE fault IS NOT NULL
    """,
}

# the turns of the sessions without a fault, in order
_TALK, _FAULT = SQL["p4_found"].rsplit("SELECT session_id, fault FROM", 1)
SQL["p4_turns"] = f"""{_TALK.rstrip()}, bad AS (SELECT session_id FROM{_FAULT.rsplit("WHERE", 1)[0]} WHERE fault IS NOT NULL),
        said AS (SELECT c.row_id, c.content FROM c)
        SELECT o.session_id, o.pos - 1 AS turn, o.role, said.content FROM o JOIN said ON said.row_id = o.row_id WHERE o.session_id IS NOT NULL AND o.session_id NOT IN (SELECT session_id FROM bad)"""
SQL["p7_check"] = "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS cut FROM documents"
# the operator's own expressions, over the whole table at once
_FORMS = f"WITH batch AS (SELECT doc_id AS n, text FROM documents), changed AS ({lookalike.query()}), form AS (SELECT d.doc_id, d.text AS spelling, CASE WHEN c.n IS NULL THEN d.text ELSE c.text END AS text FROM documents d LEFT JOIN changed c ON c.n = d.doc_id)"
SQL["p8_forms"] = f"{_FORMS} SELECT doc_id, text FROM form"
SQL["p8_found"] = rf"""{_FORMS}, seen AS (SELECT * FROM form WHERE regexp_matches(text, '[^\s\p{{C}}\p{{Z}}\x{{200B}}-\x{{200F}}\x{{2060}}]'))
    SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM seen a JOIN seen b ON a.text = b.text AND a.doc_id < b.doc_id AND a.spelling <> b.spelling"""
SQL["p1_check"] = """WITH n AS (SELECT id, detail FROM (SELECT id, detail, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS k FROM nodes WHERE id IS NOT NULL) WHERE k = 1)
    SELECT count(*) AS texts, CAST(0 AS BIGINT) AS too_large, CAST(0 AS BIGINT) AS "foreign", CAST(0 AS BIGINT) AS open_ends
    FROM n JOIN embedding_models m ON ceil(octet_length(encode(n.detail)) / 4.0) > m.chunk_max_tokens"""
SQL["p3_check"] = """SELECT (SELECT count(DISTINCT id) FROM session_messages) + 2 * (SELECT count(DISTINCT id) FROM nodes) AS texts, CAST(0 AS BIGINT) AS unlike"""
SQL["p6_check"] = "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS unlike FROM documents"
