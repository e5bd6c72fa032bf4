"""Blocks on pages: bands, medians, margins, overlaps, joined text and job totals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bands(blocks: DataFrame, gap: float) -> DataFrame:
    """(block_id, band): vertical bands of a page; a new one begins where a block starts more than ``gap`` below all above it."""
    order = Window.partitionBy("job_id", "page_index").orderBy("y", "x", "block_id")
    bottom = F.max(F.col("y") + F.col("height")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(F.col("y") - bottom > gap, 1).otherwise(0)
    return blocks.withColumn("__new", cut).withColumn("band", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("block_id", "band")


def medians(blocks: DataFrame) -> DataFrame:
    """(job_id, page_index, blocks, height, width): the lower middle height and width of a page's blocks."""
    mid = lambda c: F.expr(f"percentile_disc(0.5) within group (order by {c})")
    return blocks.groupBy("job_id", "page_index").agg(F.count("*").alias("blocks"), mid("height").alias("height"), mid("width").alias("width"))


def margins(blocks: DataFrame, page_height: float, share: float = 0.08) -> DataFrame:
    """(block_id, place): 'header' and 'footer' for blocks within the outer ``share`` of a page, else 'body'."""
    y = F.col("y") + F.col("height") / 2
    return blocks.select("block_id", F.when(y <= page_height * share, "header").when(y >= page_height * (1 - share), "footer").otherwise("body").alias("place"))


def uncovered(blocks: DataFrame, share: float = 0.35) -> DataFrame:
    """(block_id): blocks that no earlier block of the page overlaps by more than ``share`` of the smaller area.

    An anti-join by page; pages hold few blocks however many a job has.
    """
    b = blocks.select("job_id", "page_index", F.col("block_id").alias("o_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("width").alias("ow"), F.col("height").alias("oh"))
    w = F.greatest(F.least(F.col("x") + F.col("width"), F.col("ox") + F.col("ow")) - F.greatest("x", "ox"), F.lit(0.0))
    h = F.greatest(F.least(F.col("y") + F.col("height"), F.col("oy") + F.col("oh")) - F.greatest("y", "oy"), F.lit(0.0))
    least = F.least(F.col("width") * F.col("height"), F.col("ow") * F.col("oh"))
    hit = (blocks["job_id"] == b["job_id"]) & (blocks["page_index"] == b["page_index"]) & (F.col("o_id") < F.col("block_id")) & (w * h > share * least)
    return blocks.join(b, hit, "left_anti").select("block_id")


def joined(blocks: DataFrame) -> DataFrame:
    """(job_id, page_index, markdown): a page's blocks as Markdown, list items on lines of their own, others apart."""
    order = Window.partitionBy("job_id", "page_index").orderBy("block_index", "block_id")
    both = (F.col("block_type") == "ListItem") & (F.lag("block_type").over(order) == "ListItem")
    sep = F.when(F.row_number().over(order) == 1, "").when(both, "\n").otherwise("\n\n")
    parts = blocks.withColumn("__part", F.concat(sep, F.coalesce("formatted_text", F.lit(""))))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "block_id", "__part"))), lambda x: x["__part"]), "")
    return parts.groupBy("job_id", "page_index").agg(whole.alias("markdown"))


def jobs(blocks: DataFrame) -> DataFrame:
    """(job_id, blocks, pages, tables, fragments, confidence): totals of a job; confidence is the mean weighted by characters, null if no block has one."""
    n = F.greatest(F.length(F.coalesce("recognized_text", F.lit(""))), F.lit(1))
    c = F.when(F.col("confidence").isNotNull(), F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)))
    return blocks.groupBy("job_id").agg(
        F.count("*").alias("blocks"),
        F.count_distinct("page_index").alias("pages"),
        F.count_if(F.col("block_type") == "Table").alias("tables"),
        F.coalesce(F.bool_or("fragment"), F.lit(False)).alias("fragments"),
        (F.sum(c * n) / F.sum(F.when(c.isNotNull(), n))).alias("confidence"),
    )


def extents(blocks: DataFrame) -> DataFrame:
    """(job_id, page_index, x, y, width, height): the box around all blocks of a page."""
    return blocks.groupBy("job_id", "page_index").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"))


def column_gaps(blocks: DataFrame) -> DataFrame:
    """(job_id, page_index, gap, middle): the widest gap between the merged x-intervals of a page; pages without a gap give nothing."""
    order = Window.partitionBy("job_id", "page_index").orderBy("x", "block_id")
    end = F.max(F.col("x") + F.col("width")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = blocks.withColumn("__end", end).withColumn("gap", F.col("x") - F.col("__end")).filter("gap > 0")
    best = gaps.groupBy("job_id", "page_index").agg(F.max_by(F.struct("gap", ((F.col("x") + F.col("__end")) / 2).alias("middle")), F.struct("gap", -F.col("x"))).alias("g"))
    return best.select("job_id", "page_index", "g.gap", "g.middle")


def reading_order(blocks: DataFrame, line: float = 15.0) -> DataFrame:
    """(block_id, place): blocks of a page by lines of ``line`` points, then from left to right."""
    order = Window.partitionBy("job_id", "page_index").orderBy(F.floor(F.col("y") / line), "x", "block_id")
    return blocks.select("block_id", F.row_number().over(order).alias("place"))


def headings(blocks: DataFrame) -> DataFrame:
    """(block_id, level): blocks whose lines are taller than the page's lower median line."""
    from ..functions import marks

    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    tall = blocks.select("block_id", "job_id", "page_index", (F.col("height") / lines).alias("line"))
    mid = tall.groupBy("job_id", "page_index").agg(F.expr("percentile_disc(0.5) within group (order by line)").alias("usual"))
    return tall.join(mid, ["job_id", "page_index"]).select("block_id", marks.heading_level(F.col("line"), F.col("usual")).alias("level")).filter("level is not null")


def visual_rows(blocks: DataFrame, ratio: float = 0.6) -> DataFrame:
    """(block_id, row): rows of a page from its top; a block joins the row whose first block's y is near, within ``ratio`` of the usual height.

    The first block of a row is its anchor, so the rows are a fold over the page's blocks in order; a
    page holds few blocks.
    """
    first = F.array_sort(F.collect_list(F.struct("y", "x", "block_id")))
    page = blocks.groupBy("job_id", "page_index").agg(first.alias("b"), F.expr("percentile_disc(0.5) within group (order by height)").alias("usual"))
    reach = F.greatest(F.col("usual"), F.lit(1.0)) * ratio
    start = F.struct(F.lit(0).alias("row"), F.lit(None).cast("double").alias("y"), F.array().cast("array<struct<block_id:bigint,row:int>>").alias("done"))

    def step(acc, x):
        new = acc["y"].isNull() | (F.abs(x["y"] - acc["y"]) > F.col("usual_reach"))
        row = acc["row"] + F.when(new, 1).otherwise(0)
        return F.struct(row.alias("row"), F.when(new, x["y"]).otherwise(acc["y"]).alias("y"), F.concat(acc["done"], F.array(F.struct(x["block_id"].cast("bigint").alias("block_id"), row.alias("row")))).alias("done"))

    folded = page.withColumn("usual_reach", reach).select(F.explode(F.aggregate("b", start, step)["done"]).alias("r"))
    return folded.select("r.block_id", "r.row")


def column_order(blocks: DataFrame, width: float, height: float, gap: float = 18.0) -> DataFrame:
    """(block_id, band, col, place): blocks of a page in reading order of one or two columns.

    Bands follow one another from the top. In a band the widest gap between the x-intervals of blocks
    that aren't as wide as the page parts two columns, if it is wide enough and rows have blocks on both
    sides. Wide blocks come first, then the left column, then the right one. Running heads and feet stand
    before and after all bands.
    """
    page = ["job_id", "page_index"]
    compact = (F.col("height") <= height * 0.025) & (F.col("width") <= width * 0.35)
    middle = F.col("y") + F.col("height") / 2
    edge = F.when(compact & (middle <= height * 0.08), -1).when(compact & (middle >= height * 0.92), 1).otherwise(0)
    b = blocks.join(bands(blocks, gap), "block_id").join(visual_rows(blocks), "block_id").withColumn("edge", edge).withColumn("wide", F.col("width") > width * 0.65)
    narrow = b.filter("edge = 0 and not wide")
    by = Window.partitionBy(*page, "band").orderBy("x", "block_id").rowsBetween(Window.unboundedPreceding, -1)
    gaps = narrow.withColumn("end", F.max(F.col("x") + F.col("width")).over(by)).withColumn("gap", F.col("x") - F.col("end")).filter("gap > 0")
    usual = narrow.groupBy(*page, "band").agg(F.expr("percentile_disc(0.5) within group (order by width)").alias("usual"))
    best = gaps.groupBy(*page, "band").agg(F.max_by(F.struct("gap", ((F.col("x") + F.col("end")) / 2).alias("split")), F.struct("gap", -F.col("x"))).alias("g"))
    split = best.join(usual, [*page, "band"]).filter(F.col("g.gap") >= F.least(F.lit(width * 0.03), F.col("usual") * 0.5)).select(*page, "band", "g.split")
    sides = narrow.join(split, [*page, "band"]).withColumn("l", F.col("x") + F.col("width") / 2 < F.col("split")).withColumn("r", F.col("x") >= F.col("split"))
    rows = sides.groupBy(*page, "band", "row").agg((F.bool_or("l") & F.bool_or("r")).alias("both"), F.count_if("l").alias("ls"), F.count_if("r").alias("rs"))
    seen = rows.groupBy(*page, "band").agg(F.count("*").alias("n"), F.count_if("both").alias("two"), F.sum("ls").alias("ls"), F.sum("rs").alias("rs"))
    ok = (F.col("n") >= 2) & (((F.col("two") >= 2) & (F.col("two") >= 0.25 * F.col("n"))) | ((F.col("ls") >= 2) & (F.col("rs") >= 2) & (F.col("two") >= 1)))
    parted = split.join(seen.filter(ok).select(*page, "band"), [*page, "band"])
    col = F.when((F.col("edge") != 0) | F.col("wide") | F.col("split").isNull(), 0).when(F.col("x") < F.col("split"), 1).otherwise(2)
    all_ = b.join(parted, [*page, "band"], "left").withColumn("col", col)
    order = Window.partitionBy(*page).orderBy("edge", "band", "col", "y", "x", "block_id")
    return all_.select("block_id", "band", "col", F.row_number().over(order).alias("place"))


#: Words that begin a heading, what makes a numbered line one, signs of list items, signs of formulas.
HEADING_WORDS = ("ARTICLE", "SECTION", "CHAPTER", "TITLE ", "PART ")
NUMBERED_HEADING = (" Introduction", " Summary", " Overview")
BULLETS = "•\\-*◦▪"
FORMULA_SIGNS = "=+\\-−*/^_∑∫"
#: How much taller than usual the three levels of headings are, and with a sign of a heading.
HEADING_RATIOS = ((1, 1.55, 1.4), (2, 1.30, 1.20), (3, 1.15, 0.0))


def block_types(blocks: DataFrame, width: float, height: float) -> DataFrame:
    """(block_id, kind, level): Heading with its level, ListItem, Table, Header, Footer or Body, by the height of a line against the page's usual one and by the text.

    Formulas and labels of algorithms are Body however tall. Null texts count as empty.
    """
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    lined = blocks.withColumn("t", t).withColumn("line", F.col("height") / F.size(F.split("t", "\n")))
    usual = lined.groupBy("job_id", "page_index").agg(F.expr("percentile_disc(0.5) within group (order by line)").alias("usual"))
    b = lined.join(usual, ["job_id", "page_index"])
    n, t = F.length("t"), F.col("t")
    signs = lambda form: n - F.length(F.regexp_replace(t, form, ""))
    fragment = t.rlike(r"(?i)^algorithm\s+\S*[0-9]") | t.rlike(r"^\([0-9]+(\.[0-9]+)*[a-z]?\)$") | ((n > 10) & (signs(r"[^\p{L}\p{N}\s]") > 0.25 * n)) | ((n > 0) & (n < 80) & (signs(f"[{FORMULA_SIGNS}]") > 3))
    keyword = t.rlike(f"(?i)^({'|'.join(HEADING_WORDS)})") | (t.rlike("^[0-9]") & t.rlike(f"{'|'.join(NUMBERED_HEADING)}|(?i:AMENDMENT)"))
    short = n <= 60
    caps = short & (n >= 3) & ~t.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]")
    ratio = F.when(F.col("usual") > 0, F.col("line") / F.col("usual")).otherwise(1.0)
    level = F.lit(None).cast("int")
    for k, tall, marked in reversed(HEADING_RATIOS):
        level = F.when((ratio >= tall) | (short & (ratio >= marked) & ((caps if marked else F.lit(False)) | keyword)), k).otherwise(level)
    compact = (F.col("height") <= height * 0.025) & (F.col("width") <= width * 0.35) & ~keyword
    item = t.rlike(f"^[{BULLETS}]") | t.rlike(r"^(?:[0-9][^.)]{0,3}|\([^.)]{0,3})[.)]( |$)")
    table = F.contains(t, F.lit("|")) | (F.contains(t, F.lit("\n")) & (signs("\t") > 2))
    kind = (
        F.when(fragment, "Body")
        .when(compact & (F.col("y") + F.col("height") <= height * 0.08), "Header")
        .when(compact & (F.col("y") >= height * 0.92), "Footer")
        .when(level.isNotNull(), "Heading")
        .when(item, "ListItem")
        .when(table, "Table")
        .otherwise("Body")
    )
    return b.select("block_id", kind.alias("kind"), F.when(kind == "Heading", level).alias("level"))


def merged_headings(blocks: DataFrame) -> DataFrame:
    """(block_id, level, blocks, text): headings of a page that follow one another on the same level as one, under the first one's id."""
    order = Window.partitionBy("job_id", "page_index").orderBy("block_index", "block_id")
    head = (F.col("block_type") == "Heading") & ~F.coalesce("fragment", F.lit(False))
    level = F.when(head, F.coalesce("heading_level", F.lit(0)))
    new = F.when(level.isNotNull() & level.eqNullSafe(F.lag(level).over(order)), 0).otherwise(1)
    runs = blocks.withColumn("level", level).withColumn("new", new).withColumn("run", F.sum("new").over(order)).filter("level is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "block_id", F.trim(F.coalesce("recognized_text", F.lit(""))).alias("t")))), lambda x: x["t"]), " ")
    one = runs.groupBy("job_id", "page_index", "run", "level").agg(F.min(F.struct("block_index", "block_id")).alias("first"), F.count("*").alias("blocks"), text.alias("text"))
    return one.select("first.block_id", "level", "blocks", "text")


#: Pages that one go of the chunking takes; chunks don't run over its end, so a job of any size is many goes.
PAGES = 32
CHUNK = "job_id string, part int, chunk_index int, first_block bigint, last_block bigint, blocks int, tokens bigint, heading string, tables boolean, pages string, confidence double, text string"


def _chunks(group: tuple, b: pd.DataFrame, target: int, overlap: int) -> pd.DataFrame:
    """Greedy chunks of the blocks of one go, in order, each beginning with the last blocks of the one before."""
    b = b.sort_values(["page_index", "block_index", "block_id"]).reset_index(drop=True)
    sizes, out = b["tokens"].tolist(), []
    first, held, at = 0, 0, 0
    for at, n in enumerate(sizes):
        if held + n > target and at > first:
            out.append((first, at - 1))
            back, held = at, 0
            while back > first and held + sizes[back - 1] <= overlap:
                back -= 1
                held += sizes[back]
            first = back
        held += n
    if sizes:
        out.append((first, at))
    heads = b["heading"].ffill()
    rows = []
    for k, (i, j) in enumerate(out):
        part = b.iloc[i : j + 1]
        kinds = part["block_type"].tolist()
        text = "".join(("" if m == 0 else "\n" if t == kinds[m - 1] == "ListItem" else "\n\n") + x for m, (t, x) in enumerate(zip(kinds, part["shown"])))
        sure = part.dropna(subset=["confidence"])
        weight = sure["chars"].sum()
        mean = float((sure["confidence"].clip(0, 1) * sure["chars"]).sum() / weight) if weight else None
        rows.append((group[0], group[1], k, part["block_id"].iloc[0], part["block_id"].iloc[-1], len(part), int(part["tokens"].sum()), None if pd.isna(heads[j]) else heads[j], "Table" in kinds, ",".join(map(str, sorted(set(part["page_index"])))), mean, text))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])


def block_chunks(blocks: DataFrame, target: int = 350, overlap: int = 60, margins: bool = False) -> DataFrame:
    """(job_id, part, chunk_index, first_block, last_block, blocks, tokens, heading, tables, pages, confidence, text): imported blocks packed into chunks.

    Blocks are taken in page order while their estimated tokens stay within ``target`` (50 at least), a
    larger block alone or behind the overlap; each chunk begins with the last whole blocks of the one
    before that fit into ``overlap`` (half of the target at most). Running heads and feet are left out
    unless ``margins``. The heading is the last one up to the chunk's end. ``PAGES`` pages make a part.
    """
    target = max(50, target)
    overlap = min(overlap, target // 2)
    body = blocks if margins else blocks.filter(~F.coalesce(F.col("block_type").isin("Header", "Footer"), F.lit(False)))
    bare = F.regexp_replace(F.regexp_replace("shown", r"(^|\n)[ \t]*#+[ \t]*", "$1"), r"\s*\n\s*", " ")
    head = (F.col("block_type") == "Heading") & ~F.coalesce("fragment", F.lit(False))
    shown = body.withColumn("shown", F.coalesce("formatted_text", F.lit("")))
    rows = shown.select(
        "job_id", F.floor(F.col("page_index") / PAGES).cast("int").alias("part"), "page_index", "block_index", "block_id", "block_type", "shown", "confidence",
        F.ceil(F.octet_length("shown") / 4).cast("bigint").alias("tokens"),
        F.greatest(F.length(F.coalesce("recognized_text", F.lit(""))), F.lit(1)).alias("chars"),
        F.when(head, F.nullif(F.regexp_replace(bare, r"^\s+|\s+$", ""), F.lit(""))).alias("heading"),
    )

    def run(group: tuple, b: pd.DataFrame) -> pd.DataFrame:
        return _chunks(group, b, target, overlap)

    return rows.groupBy("job_id", "part").applyInPandas(run, CHUNK)
