"""Queries of imported pages: rows, columns, kinds of blocks, chunks; with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import newest, table
from ..operators import pages

WIDTH, HEIGHT = 612.0, 792.0


def boxed(spark, d, *more: str):
    """One row per block of text_blocks with its box; repeated rows are one."""
    box = [F.col(f"bbox.{c}").alias(c) for c in ("x", "y", "width", "height")]
    return newest(table(spark, d, "text_blocks").select("block_id", "job_id", "page_index", "block_index", *more, *box), ["block_id"], [])


def ingested(spark, d):
    """One row per block of ingest_blocks; repeated rows are one."""
    return newest(table(spark, d, "ingest_blocks"), ["block_id"], [])


def page_rows(spark, d):
    return pages.visual_rows(boxed(spark, d))


def page_gaps(spark, d):
    return pages.column_gaps(boxed(spark, d)).select("job_id", "page_index", F.round("gap", 6).alias("gap"), F.round("middle", 6).alias("middle"))


def page_headings(spark, d):
    return pages.headings(boxed(spark, d, "text"))


def column_order(spark, d):
    return pages.column_order(boxed(spark, d), WIDTH, HEIGHT)


def block_types(spark, d):
    return pages.block_types(boxed(spark, d, "text"), WIDTH, HEIGHT)


def merged_headings(spark, d):
    return pages.merged_headings(ingested(spark, d))


def block_chunks(spark, d):
    return pages.block_chunks(ingested(spark, d)).withColumn("confidence", F.round("confidence", 9))


QUERIES = {f.__name__: f for f in (page_rows, page_gaps, page_headings, column_order, block_types, merged_headings, block_chunks)}

_TB = """tb AS (SELECT DISTINCT block_id, job_id, page_index, block_index, text, bbox.x AS x, bbox.y AS y, bbox.width AS width, bbox.height AS height FROM text_blocks)"""
_ROWS = """srt AS (SELECT *, row_number() OVER (PARTITION BY job_id, page_index ORDER BY y, x, block_id) AS i FROM tb),
    reach AS (SELECT job_id, page_index, greatest(quantile_disc(height, 0.5), 1.0) * 0.6 AS r FROM tb GROUP BY 1, 2),
    walk AS (SELECT job_id, page_index, i, block_id, y AS anchor, 1 AS row FROM srt WHERE i = 1
        UNION ALL SELECT s.job_id, s.page_index, s.i, s.block_id, CASE WHEN abs(s.y - w.anchor) > r.r THEN s.y ELSE w.anchor END, CASE WHEN abs(s.y - w.anchor) > r.r THEN w.row + 1 ELSE w.row END
        FROM walk w JOIN srt s ON s.job_id = w.job_id AND s.page_index = w.page_index AND s.i = w.i + 1 JOIN reach r ON r.job_id = w.job_id AND r.page_index = w.page_index)"""
_BANDS = """bnd0 AS (SELECT *, CASE WHEN y - max(y + height) OVER (PARTITION BY job_id, page_index ORDER BY y, x, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 18 THEN 1 ELSE 0 END AS n FROM tb),
    bnd AS (SELECT block_id, CAST(sum(n) OVER (PARTITION BY job_id, page_index ORDER BY y, x, block_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS band FROM bnd0)"""
_IB = """ib AS (SELECT DISTINCT block_id, job_id, page_index, block_index, recognized_text, formatted_text, block_type, heading_level, confidence, fragment FROM ingest_blocks)"""
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_HEAD = _TRIM.format(r"regexp_replace(regexp_replace(shown, '(^|\n)[ \t]*#+[ \t]*', '\1', 'g'), '\s*\n\s*', ' ', 'g')")

SQL = {
    "page_rows": f"WITH RECURSIVE {_TB}, {_ROWS} SELECT block_id, row FROM walk",
    "page_gaps": f"""WITH {_TB}, e AS (SELECT *, max(x + width) OVER (PARTITION BY job_id, page_index ORDER BY x, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM tb)
        SELECT job_id, page_index, round(gap, 6) AS gap, round(middle, 6) AS middle FROM (SELECT job_id, page_index, x - e AS gap, (x + e) / 2 AS middle, row_number() OVER (PARTITION BY job_id, page_index ORDER BY x - e DESC, x) AS k FROM e WHERE x - e > 0) WHERE k = 1""",
    "page_headings": f"""WITH {_TB}, l AS (SELECT *, height / (1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))) AS line FROM tb), u AS (SELECT job_id, page_index, quantile_disc(line, 0.5) AS usual FROM l GROUP BY 1, 2),
        r AS (SELECT block_id, line / usual AS r FROM l JOIN u USING (job_id, page_index) WHERE usual > 0) SELECT block_id, CASE WHEN r >= 1.55 THEN 1 WHEN r >= 1.3 THEN 2 ELSE 3 END AS level FROM r WHERE r >= 1.15""",
    "column_order": f"""WITH RECURSIVE {_TB}, {_ROWS}, {_BANDS},
        b AS (SELECT tb.*, bnd.band, walk.row, width > 612 * 0.65 AS wide, CASE WHEN height <= 792 * 0.025 AND width <= 612 * 0.35 AND y + height / 2 <= 792 * 0.08 THEN -1
            WHEN height <= 792 * 0.025 AND width <= 612 * 0.35 AND y + height / 2 >= 792 * 0.92 THEN 1 ELSE 0 END AS edge FROM tb JOIN bnd USING (block_id) JOIN walk USING (block_id)),
        nar AS (SELECT * FROM b WHERE edge = 0 AND NOT wide),
        g0 AS (SELECT *, max(x + width) OVER (PARTITION BY job_id, page_index, band ORDER BY x, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM nar),
        g AS (SELECT job_id, page_index, band, x - e AS gap, (x + e) / 2 AS split FROM g0 WHERE x - e > 0 QUALIFY row_number() OVER (PARTITION BY job_id, page_index, band ORDER BY x - e DESC, x) = 1),
        u AS (SELECT job_id, page_index, band, quantile_disc(width, 0.5) AS usual FROM nar GROUP BY 1, 2, 3),
        sp AS (SELECT g.* FROM g JOIN u USING (job_id, page_index, band) WHERE gap >= least(612 * 0.03, usual * 0.5)),
        rw AS (SELECT job_id, page_index, band, row, bool_or(x + width / 2 < split) AND bool_or(x >= split) AS twin, count(*) FILTER (x + width / 2 < split) AS ls, count(*) FILTER (x >= split) AS rs FROM nar JOIN sp USING (job_id, page_index, band) GROUP BY 1, 2, 3, 4),
        ok AS (SELECT job_id, page_index, band FROM rw GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND ((count(*) FILTER (twin) >= 2 AND count(*) FILTER (twin) >= 0.25 * count(*)) OR (sum(ls) >= 2 AND sum(rs) >= 2 AND count(*) FILTER (twin) >= 1))),
        f AS (SELECT b.*, CASE WHEN edge <> 0 OR wide OR split IS NULL THEN 0 WHEN x < split THEN 1 ELSE 2 END AS col FROM b LEFT JOIN (SELECT sp.* FROM sp JOIN ok USING (job_id, page_index, band)) s USING (job_id, page_index, band))
        SELECT block_id, band, col, row_number() OVER (PARTITION BY job_id, page_index ORDER BY edge, band, col, y, x, block_id) AS place FROM f""",
    "block_types": rf"""WITH {_TB}, l0 AS (SELECT *, {_TRIM.format("coalesce(text, '')")} AS t FROM tb), l AS (SELECT *, height / (1 + length(t) - length(replace(t, chr(10), ''))) AS line FROM l0),
        u AS (SELECT job_id, page_index, quantile_disc(line, 0.5) AS usual FROM l GROUP BY 1, 2),
        s AS (SELECT *, CASE WHEN usual > 0 THEN line / usual ELSE 1 END AS r, length(t) AS n, length(t) - length(regexp_replace(t, '[^\p{{L}}\p{{N}}\s]', '', 'g')) AS signs, length(t) - length(regexp_replace(t, '[=+\-−*/^_∑∫]', '', 'g')) AS sums,
            regexp_matches(t, '(?i)^(ARTICLE|SECTION|CHAPTER|TITLE |PART )') OR (regexp_matches(t, '^[0-9]') AND regexp_matches(t, ' Introduction| Summary| Overview|(?i:AMENDMENT)')) AS kw FROM l JOIN u USING (job_id, page_index)),
        h AS (SELECT *, n <= 60 AND n >= 3 AND NOT regexp_matches(t, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]') AS caps, height <= 792 * 0.025 AND width <= 612 * 0.35 AND NOT kw AS small FROM s),
        v AS (SELECT *, CASE WHEN r >= 1.55 OR (n <= 60 AND r >= 1.4 AND (caps OR kw)) THEN 1 WHEN r >= 1.3 OR (n <= 60 AND r >= 1.2 AND (caps OR kw)) THEN 2 WHEN r >= 1.15 OR (n <= 60 AND kw) THEN 3 END AS lv FROM h),
        k AS (SELECT block_id, lv, CASE WHEN regexp_matches(t, '(?i)^algorithm\s+\S*[0-9]') OR regexp_matches(t, '^\([0-9]+(\.[0-9]+)*[a-z]?\)$') OR (n > 10 AND signs > 0.25 * n) OR (n > 0 AND n < 80 AND sums > 3) THEN 'Body'
            WHEN small AND y + height <= 792 * 0.08 THEN 'Header' WHEN small AND y >= 792 * 0.92 THEN 'Footer' WHEN lv IS NOT NULL THEN 'Heading'
            WHEN regexp_matches(t, '^[•\-*◦▪]') OR regexp_matches(t, '^([0-9][^.)]{{0,3}}|\([^.)]{{0,3}})[.)]( |$)') THEN 'ListItem'
            WHEN contains(t, '|') OR (contains(t, chr(10)) AND length(t) - length(replace(t, chr(9), '')) > 2) THEN 'Table' ELSE 'Body' END AS kind FROM v)
        SELECT block_id, kind, CASE WHEN kind = 'Heading' THEN lv END AS level FROM k""",
    "merged_headings": f"""WITH {_IB}, l AS (SELECT *, CASE WHEN block_type = 'Heading' AND NOT coalesce(fragment, false) THEN coalesce(heading_level, 0) END AS lv FROM ib),
        n AS (SELECT *, CASE WHEN lv IS NOT NULL AND lv IS NOT DISTINCT FROM lag(lv) OVER (PARTITION BY job_id, page_index ORDER BY block_index, block_id) THEN 0 ELSE 1 END AS nw FROM l),
        r AS (SELECT *, sum(nw) OVER (PARTITION BY job_id, page_index ORDER BY block_index, block_id ROWS UNBOUNDED PRECEDING) AS run FROM n)
        SELECT arg_min(block_id, (block_index, block_id)) AS block_id, lv AS level, count(*) AS blocks, string_agg(trim(coalesce(recognized_text, '')), ' ' ORDER BY block_index, block_id) AS text FROM r WHERE lv IS NOT NULL GROUP BY job_id, page_index, run, lv""",
    "block_chunks": rf"""WITH RECURSIVE {_IB}, b AS (SELECT *, page_index // {pages.PAGES} AS part, coalesce(formatted_text, '') AS shown FROM ib WHERE block_type IS NULL OR block_type NOT IN ('Header', 'Footer')),
        c AS (SELECT *, CAST(ceil(octet_length(encode(shown)) / 4.0) AS BIGINT) AS tokens, row_number() OVER w AS i, sum(CAST(ceil(octet_length(encode(shown)) / 4.0) AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS cum,
            CASE WHEN block_type = 'Heading' AND NOT coalesce(fragment, false) THEN nullif({_HEAD}, '') END AS head
            FROM b WINDOW w AS (PARTITION BY job_id, part ORDER BY page_index, block_index, block_id)),
        h AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY job_id, part ORDER BY i ROWS UNBOUNDED PRECEDING) AS heading FROM c),
        ends AS (SELECT job_id, part, i AS e, cum FROM c UNION ALL SELECT DISTINCT job_id, part, 0, 0 FROM c),
        starts AS (SELECT p.job_id, p.part, p.e, p.cum, coalesce(min(x.i) FILTER (p.cum - (x.cum - x.tokens) <= 60), p.e + 1) AS s FROM ends p LEFT JOIN c x ON x.job_id = p.job_id AND x.part = p.part AND x.i <= p.e GROUP BY 1, 2, 3, 4),
        base AS (SELECT s.*, coalesce((SELECT max(y.cum) FROM c y WHERE y.job_id = s.job_id AND y.part = s.part AND y.i = s.s - 1), 0) AS bottom FROM starts s),
        nxt AS (SELECT t.job_id, t.part, t.e, t.s, max(CASE WHEN y.i = t.e + 1 OR y.cum - t.bottom <= 350 THEN y.i END) AS e2 FROM base t JOIN c y ON y.job_id = t.job_id AND y.part = t.part AND y.i > t.e GROUP BY 1, 2, 3, 4),
        orbit AS (SELECT job_id, part, 0 AS k, s, e2 AS e FROM nxt WHERE e = 0 UNION ALL SELECT n.job_id, n.part, o.k + 1, n.s, n.e2 FROM orbit o JOIN nxt n ON n.job_id = o.job_id AND n.part = o.part AND n.e = o.e)
        SELECT o.job_id, CAST(o.part AS INTEGER) AS part, o.k AS chunk_index, arg_min(h.block_id, h.i) AS first_block, arg_max(h.block_id, h.i) AS last_block, CAST(count(*) AS INTEGER) AS blocks, CAST(sum(h.tokens) AS BIGINT) AS tokens,
            max(h.heading) FILTER (h.i = o.e) AS heading, coalesce(bool_or(h.block_type = 'Table'), false) AS tables, array_to_string(list_sort(list(DISTINCT h.page_index)), ',') AS pages,
            round(sum(least(greatest(h.confidence, 0.0), 1.0) * greatest(length(coalesce(h.recognized_text, '')), 1)) / sum(greatest(length(coalesce(h.recognized_text, '')), 1)) FILTER (h.confidence IS NOT NULL), 9) AS confidence,
            string_agg(CASE WHEN h.i = o.s THEN '' WHEN h.block_type = 'ListItem' AND p.block_type = 'ListItem' THEN chr(10) ELSE chr(10) || chr(10) END || h.shown, '' ORDER BY h.i) AS text
        FROM orbit o JOIN h ON h.job_id = o.job_id AND h.part = o.part AND h.i BETWEEN o.s AND o.e LEFT JOIN h p ON p.job_id = h.job_id AND p.part = h.part AND p.i = h.i - 1 GROUP BY o.job_id, o.part, o.k""",
}
