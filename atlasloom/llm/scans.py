"""Noise in text from scanned pages: found by kind, and repaired into clean paragraphs.

A lexicon of all words with their counts tells real words from misread ones. A symmetric-delete index
over the words, folded so that shapes a scanner confuses fall together, proposes corrections; a weighted
edit distance with confusion pairs and the counts of neighbouring words pick among them.

Every text is cut into words once (``prepared``). The index works on distinct words; only words with a
candidate go on as occurrences, and of the neighbours only counts under 64-bit hashes move. Everything is
joined by word, by block or by page; no job is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import cut, newest

#: Shapes that a scanner takes for one another (right, misread).
CONFUSED = (
    ("m", "rn"), ("n", "ri"), ("d", "cl"), ("h", "li"), ("u", "ii"), ("w", "vv"), ("in", "m"), ("l", "1"), ("l", "|"), ("l", "I"), ("l", "!"), ("i", "l"), ("i", "1"), ("i", "!"), ("i", "|"), ("i", "j"),
    ("o", "0"), ("O", "0"), ("s", "5"), ("S", "5"), ("g", "9"), ("g", "q"), ("b", "6"), ("B", "8"), ("z", "2"), ("Z", "2"), ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("a", "ä"), ("I", "1"), ("I", "l"), ("I", "|"), ("I", "!"),
    ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("ffi", "ﬃ"), ("ffl", "ﬄ"), ("st", "ﬆ"), ("nn", "rm"), ("li", "h"), ("rn", "m"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("vv", "w"),
    ("1", "l"), ("1", "I"), ("1", "|"), ("1", "!"), ("0", "O"), ("5", "S"), ("8", "B"), ("9", "g"), ("6", "b"), ("2", "Z"),
)
#: Words after which a hanging hyphen belongs to the word before.
HANGING = ("or", "and", "to", "und", "oder", "bis", "ou", "et", "o", "y", "e", "и", "или")
MARKS = "-‐¬­"
CHEAP, FAR = 0.3, 0.75
#: How many times more often the right word must stand in the corpus, without and with support by its neighbours.
RATIO, RATIO_NEAR = 6.0, 1.5
#: Places from here on are of words that don't stand in the text as one.
ASIDE = 1_000_000_000
#: So many of the most frequent words without a candidate are set aside before anything moves; a shortcut, not a bound on results.
USUAL = 4_096
#: Folded words longer than this are indexed by their halves instead of by all their deletions: one edit leaves a half as it is.
LONG = 48
#: Neither letter nor digit of any script.
NONE = r"[^\p{L}\p{N}]"
#: Words for the page before and after its number, and for the number of pages after it.
PAGE = r"(?:(?:page|seite|página|pág|страница|стр|σελίδα|σελ|p|s)\.? ?|с\. ?|(?:第|ページ|頁|页) ?)"
PAGE_AFTER = r"(?: ?(?:ページ|頁|页|쪽))"
PAGES = rf"(?: ?(?:of|/|von|de|sur|из|από|[,，/]? ?共) ?[0-9lIO]{{1,5}}{PAGE_AFTER}?)"
#: A word: letters, digits and strokes with a letter among them; one before the sign of a break isn't whole.
BROKEN = "\x01"
WORD = rf"(?<![\p{{L}}\p{{M}}\p{{N}}|])(?:[\p{{M}}\p{{N}}|]|!(?=\p{{L}}))*+\p{{L}}(?:[\p{{L}}\p{{M}}\p{{N}}|]|!(?=\p{{L}}))*+(?!{BROKEN})"
#: A mark at the end of a line or of the block, with the rest of the word on the next line.
BREAK = rf"[{MARKS}][ \t]*(?:\r?\n[ \t]*\S*|$)"
#: Ligature signs and their letters.
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st"))
#: How Markdown begins what is a paragraph of its own.
MARKDOWN = r"^\s*(?:#{1,6} |[-*+•] |\d{1,3}[.)] |\||>)"


def blocks(*tables: tuple[DataFrame, str] | tuple[DataFrame, str, str]) -> DataFrame:
    """(block_id, job_id, page_index, block_index, text, alone) over tables of (rows, name of the text column[, name of the Markdown column]), one row per block_id.

    Repeated rows are one; of different rows under one id the one with the least content hash stays.
    A null text is read from the Markdown, without its signs, if there is any; else it counts as empty.
    ``alone`` says that the Markdown makes the block a heading, a list item, a quotation or a table row.
    """
    out = None
    for df, text, *markdown in tables:
        shown = df[markdown[0]] if markdown else F.lit(None).cast("string")
        bare = F.regexp_replace(F.regexp_replace(shown, MARKDOWN, ""), r"[*_`]{1,3}(\S)", "$1")
        part = df.select(F.col("block_id").cast("long").alias("block_id"), "job_id", "page_index", "block_index", F.coalesce(df[text], bare, F.lit("")).alias("text"), F.coalesce(shown.rlike(MARKDOWN), F.lit(False)).alias("alone"))
        out = part if out is None else out.unionByName(part)
    return newest(out, ["block_id"], [])


def fold(word: Column) -> Column:
    """Words that a scanner may confuse get the same form: letters become their strokes."""
    w = F.regexp_replace(F.translate(F.lower(word), "0159|!6ä8q", "olsgllbabg"), "[ﬁ]", "fi")
    for a, b in (("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st"), ("m", "rn"), ("n", "rl"), ("d", "cl"), ("h", "ll"), ("u", "ll"), ("w", "vv"), ("i", "l"), ("j", "l"), ("e", "c"), ("t", "f"), ("2", "z")):
        w = F.replace(w, F.lit(a), F.lit(b))
    return w


def prepared(df: DataFrame) -> DataFrame:
    """``df`` (see ``blocks``) with what the later steps need of each text, so that no text is read by patterns twice.

    words and compounds in order, the stretches over broken line ends, the first line and whether it is
    all, whether it looks like a page's number and its trimmed text then, the first word, and the last
    one if a mark ends it.
    """
    text = F.col("text")
    number = rf"^{NONE}*{PAGE}?(?:[0-9lIOoS|]{{1,6}}|[ivxlcIVXLC]{{1,7}}){PAGE_AFTER}?{PAGES}?{NONE}*$"
    marked = text.rlike(f"[{MARKS}]")
    opened = F.when(marked, F.regexp_replace(text, BREAK, f"{BROKEN} ")).otherwise(text)
    none = F.array().cast("array<string>")
    some = lambda when, form, col=text: F.when(when, F.regexp_extract_all(col, F.lit(form), F.lit(0))).otherwise(none)
    # no word for a page is as long as nine letters, so most texts are told apart at once
    looks = ~text.rlike(r"\p{L}{9}") & text.rlike(r"(?iu)" + number)
    return df.withColumn("opened", opened).select(
        *df.columns,
        F.regexp_extract_all("opened", F.lit(WORD), F.lit(0)).alias("words"),
        some(text.rlike(r"\p{L}[-‐]\p{L}"), r"(?<!\p{L})\p{L}++(?:[-‐]\p{L}++)+", F.lower("opened")).alias("compounds"),
        some(text.rlike(rf"[{MARKS}][ \t]*\r?\n"), rf"(?<!\S)\S*\p{{L}}[{MARKS}][ \t]*\r?\n[ \t]*[\p{{L}}|!0-9]\S*").alias("breaks"),
        F.regexp_extract(text, r"^[ \t]*([^\r\n]*)", 1).alias("line"),
        looks.alias("looks_number"),
        F.when(looks, F.trim(text)).alias("short"),
        F.regexp_extract(text, r"^\s*(\S+)", 1).alias("first_word"),
        F.when(marked & text.rlike(rf"\p{{L}}[{MARKS}]\s*$"), F.regexp_extract(text, r"(?<!\S)(\S+)\s*$", 1)).alias("last_word"),
    ).withColumn("all_line", text == F.col("line"))


def distance(wrong: str, right: str) -> float:
    """The least cost of reading ``right`` as ``wrong``: confused shapes are cheap, other edits cost 1; 9 beyond 1.2."""
    a, b = right.lower(), wrong.lower()
    # equal ends cost nothing either way
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    k = max(0, k - 2)  # a confusion may take in equal neighbours
    a, b = a[k:], b[k:]
    row = {(0, 0): 0.0}
    for i in range(len(a) + 1):
        for j in range(max(0, i - 4), min(len(b), i + 4) + 1):
            c = row.get((i, j))
            if c is None or c > 1.2:
                continue
            step = [(i + 1, j + 1, 0.0 if i < len(a) and j < len(b) and a[i] == b[j] else 1.0), (i + 1, j, 1.0), (i, j + 1, 1.0)]
            step += [(i + x, j + y, CHEAP) for (x, y), set_ in _BY_LENGTH.items() if (a[i : i + x], b[j : j + y]) in set_]
            for x, y, cost in step:
                if x <= len(a) and y <= len(b) and c + cost < row.get((x, y), 9.0):
                    row[x, y] = c + cost
    return row.get((len(a), len(b)), 9.0)


_BY_LENGTH: dict[tuple[int, int], set[tuple[str, str]]] = {}
for _r, _w in CONFUSED:
    _BY_LENGTH.setdefault((len(_r), len(_w)), set()).add((_r.lower(), _w.lower()))


def _deletes(key: Column, long: int | None = None) -> Column:
    """Hashes of ``key`` and of its forms with one character less; beyond ``long`` those of its halves."""
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), lambda i: F.xxhash64(F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.length(key)))))
    half = (F.length(key) / 2).cast("int")
    halves = F.array(F.xxhash64(F.lit("<"), F.substring(key, F.lit(1), half)), F.xxhash64(F.lit("<"), F.substring(key, F.lit(1), half - 1)), F.xxhash64(F.lit(">"), F.right(key, half)), F.xxhash64(F.lit(">"), F.right(key, half - 1)))
    more = F.when(F.length(key) <= 2, F.array().cast("array<bigint>")).when(F.lit(long is None) | (F.length(key) <= (long or 0)), without).otherwise(halves)
    return F.array_distinct(F.concat(F.array(F.xxhash64(key)), more))


def _weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["cost"] = [distance(w, r) for w, r in zip(b["word"], b["right"])]
        yield b[b["cost"] <= FAR]


def candidates(lexicon: DataFrame) -> DataFrame:
    """(word, n, right, m, cost): the known words that each word of (word, n) may be a misreading of.

    Words meet by the hash of a folded form with at most one character less, so a form of many words
    is a matter of distinct words; Spark splits a form that gets large. Very short forms have to be equal.
    """
    index = lexicon.withColumn("key", fold(F.col("word"))).select("word", "n", F.length("word").alias("size"), F.explode(_deletes(F.col("key"), LONG)).alias("form"))
    good = index.filter((F.col("n") >= 2) & ~F.col("word").rlike(r"[0-9|!ﬀ-ﬆ]")).select(F.col("word").alias("right"), F.col("n").alias("m"), F.col("size").alias("right_size"), "form")
    near = (F.col("word") != F.col("right")) & (F.col("m") >= RATIO_NEAR * F.col("n")) & (F.abs(F.col("size") - F.col("right_size")) <= 2) & (F.lower("word") != F.lower("right"))
    pairs = index.join(good, "form").filter(near).select("word", "n", "right", "m").distinct()
    return pairs.mapInPandas(_weigh, "word string, n bigint, right string, m bigint, cost double")


def odd(word: Column) -> Column:
    """One odd character among letters: a digit or stroke, a ligature sign."""
    return word.rlike(r"[ﬀ-ﬆ]") | ((F.length(F.regexp_replace(word, r"[^\p{L}]", "")) >= 3) & word.rlike(r"(?<![0-9|!])[01569|!](?![0-9|!])") & ~word.rlike(r"[0-9]{2}|[23478]"))


def _pair(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b))


def corrections(lexicon: DataFrame, texts: DataFrame, aside: DataFrame) -> DataFrame:
    """(block_id, at, word, right): the misread words of ``texts`` (block_id, words) and of ``aside`` (block_id, at, word); right is null where no known word fits.

    A word with one odd character among letters is misread in any case. Other words are if a known word
    within the cheap distance is much more frequent, or somewhat more frequent and more usual between the
    two neighbours. ``at`` is the number of the word among the block's words.
    """
    cand = cut(candidates(lexicon))
    strange = lexicon.filter(odd(F.col("word"))).select("word")
    suspects = cut(cand.select("word").union(strange).distinct())
    usual = lexicon.join(suspects, "word", "left_anti").orderBy(F.col("n").desc(), "word").limit(USUAL).select("word")
    none = F.array(F.lit(None).cast("string"))
    w = F.col("words")
    rows = F.arrays_zip(w.alias("word"), F.concat(none, w).alias("before"), F.slice(F.concat(w, none), 2, F.greatest(F.size(w), F.lit(1))).alias("after"))
    tokens = texts.select("block_id", F.posexplode(rows).alias("at", "x")).select("block_id", "at", "x.word", "x.before", "x.after").filter("word is not null")
    # the usual words are a table of a fixed number of rows
    few = tokens.join(F.broadcast(usual), "word", "left_anti").join(suspects, "word", "left_semi")
    few = few.unionByName(aside.select("block_id", "at", "word"), allowMissingColumns=True).join(suspects, "word", "left_semi")
    met = cut(few.join(cand, "word", "left"))
    # how usual the word and its candidate are between the neighbours
    col = F.col
    sides = ((col("before"), col("right"), False), (col("right"), col("after"), False), (col("before"), col("word"), True), (col("word"), col("after"), True))
    sums = F.array(*[F.struct(_pair(a, b).alias("pair"), F.lit(own).alias("own")) for a, b, own in sides])
    asked = met.filter("right is not null").select("block_id", "at", "right", F.explode(sums).alias("s")).select("block_id", "at", "right", "s.pair", "s.own").filter("pair is not null")
    beside = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1)))
    count = texts.select(F.explode(beside).alias("pair")).groupBy("pair").agg(F.count("*").alias("c"))
    part = lambda own: F.sum(F.when(F.col("own") == own, F.col("c")).otherwise(0))
    seen = asked.join(count, "pair").groupBy("block_id", "at", "right").agg(part(False).alias("support"), part(True).alias("own"))
    got = met.join(seen, ["block_id", "at", "right"], "left").fillna(0, ["support", "own"])
    ratio = F.col("m") / F.col("n")
    # short words have real words near them: both signs together
    short = F.length("word") <= 3
    near = F.col("support") > F.col("own")
    sure = F.col("right").isNotNull() & F.when(short, (ratio >= 4 * RATIO) & near).otherwise((ratio >= RATIO) | ((ratio >= RATIO_NEAR) & near))
    score = 4 * F.coalesce("cost", F.lit(0.0)) - F.log1p("support") - F.log(F.coalesce("m", F.lit(1)))
    found = got.filter(sure | odd(F.col("word"))).groupBy("block_id", "at").agg(F.min(F.struct(score.alias("score"), F.coalesce("right", F.lit("")).alias("right"), "word")).alias("b"))
    return found.select("block_id", "at", "b.word", F.nullif("b.right", F.lit("")).alias("right"))


def layout(texts: DataFrame) -> DataFrame:
    """The narrow columns of ``prepared`` with ``pos`` and ``of`` on the page, and whether a block is ``outer``: head or foot, page numbers aside."""
    page = Window.partitionBy("job_id", "page_index")
    order = page.orderBy("block_index", "block_id")
    number = F.col("looks_number")
    return (
        texts.select("block_id", "job_id", "page_index", "block_index", "line", "all_line", "looks_number", "short", "first_word", "last_word")
        .withColumn("pos", F.row_number().over(order))
        .withColumn("of", F.count("*").over(page))
        .withColumn("outer", (F.col("pos") == 1) | (F.col("pos") == F.col("of")) | ((F.col("pos") == 2) & F.lag(number).over(order)) | ((F.col("pos") == F.col("of") - 1) & F.lead(number).over(order)))
    )


def _header_key(line: Column) -> Column:
    """The line without page numbers at its ends, as strokes."""
    before, after = r"(?:(?:page|seite|p|s)\. |(?:стр|с|σελ)\. ?|第 ?)?", f"{PAGE_AFTER}?"
    number = r"[0-9lIOoSB|!]{1,5}"
    bare = F.regexp_replace(line, rf"(?iu)^\s*[\[(–—-]*\s*{before}{number}{after}\s*[\])|–—-]*[\s　]+(?=\S{{2}})|[\s　]+[\[(|–—-]*\s*{before}{number}{after}\s*[\])|–—-]*\s*$", " ")
    return F.regexp_replace(fold(bare), r"[^\p{L}\p{N}]+", "")


def _stretches(key: Column) -> Column:
    """Hashes of a third of ``key`` from either end; a line that is longer or shorter by one shares the lengths."""
    thirds = F.array_distinct(F.array((F.length(key) / 3).cast("int"), ((F.length(key) + 1) / 3).cast("int")))
    return F.array_distinct(F.flatten(F.transform(thirds, lambda n: F.array(F.xxhash64(F.lit("<"), F.left(key, n)), F.xxhash64(F.lit(">"), F.right(key, n))))))


def running_headers(lay: DataFrame) -> DataFrame:
    """(block_id, line): blocks that are or begin with a line at the head or foot of two or more pages of their job.

    Lines are counted by job and form, never compared in pairs: the first and last page of a form say
    whether it stands on two. A line counts with the forms of its strokes that lack one, so a misreading
    beyond the folding still meets the others; only lines that share a third with another page's have to.
    """
    outer = lay.filter("outer and not looks_number").select("block_id", "job_id", "page_index", "line", _header_key(F.col("line")).alias("key"))
    lines = cut(outer).filter(F.length("key") >= 4)
    span = (F.min("page_index").alias("lo"), F.max("page_index").alias("hi"))
    wider = (F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    keys = lines.groupBy("job_id", "key").agg(*span)
    thirds = keys.select("job_id", "key", "lo", "hi", F.explode(_stretches(F.col("key"))).alias("part"))
    shared = thirds.groupBy("job_id", "part").agg(*wider).filter("lo < hi").select("job_id", "part")
    near = cut(thirds.join(shared, ["job_id", "part"], "left_semi").select("job_id", "key", "lo", "hi").distinct())
    forms = F.when(F.length("key") >= 10, _deletes(F.col("key"))).otherwise(F.array(F.xxhash64("key")))
    seen = near.select("job_id", "key", "lo", "hi", F.explode(forms).alias("form"))
    often = seen.groupBy("job_id", "form").agg(*wider).filter("lo < hi").select("job_id", "form")
    running = seen.join(often, ["job_id", "form"], "left_semi").select("job_id", "key").distinct()
    return lines.join(running, ["job_id", "key"], "left_semi").select("block_id", "line")


def page_numbers(lay: DataFrame) -> DataFrame:
    """(block_id, bare, value, misread): blocks that are nothing but the page's number, in any notation.

    A bare number counts if it goes with the pages: most of the job's bare numbers at the page ends
    lie as far from their page_index, or it is the only one and no table cell in the middle of a page.
    """
    n = lay.filter("looks_number").withColumn("t", F.col("short"))
    bare = F.regexp_replace(F.regexp_replace("t", rf"(?iu){PAGES}{NONE}*$", ""), rf"(?iu)^{NONE}*{PAGE}?|{PAGE_AFTER}?{NONE}*$", "")
    n = n.withColumn("bare", bare)
    digits = F.translate(F.col("bare"), "lIOoS|", "110051")
    n = n.withColumn("value", F.when(digits.rlike("^[0-9]{1,6}$") & F.col("bare").rlike("[0-9]"), digits.cast("long"))).withColumn("roman", F.lower(F.col("bare")).rlike("^(?:x{0,3})(?:ix|iv|v?i{0,3})$") & (F.length("bare") > 0))
    decorated = F.col("t") != F.col("bare")
    n = n.filter(F.col("value").isNotNull() | F.col("roman")).withColumn("gap", F.col("value") - F.col("page_index"))
    at_end = (F.col("pos") == 1) | (F.col("pos") == F.col("of"))
    votes = n.filter(at_end & F.col("gap").isNotNull()).groupBy("job_id", "gap").agg(F.count("*").alias("votes"))
    only = votes.groupBy("job_id").agg(F.sum("votes").alias("all"))
    votes = votes.join(only, "job_id").filter("votes >= 2 or all = 1").select("job_id", "gap", F.lit(True).alias("goes"))
    n = n.join(votes, ["job_id", "gap"], "left")
    ok = (decorated & at_end) | (F.col("roman") & at_end) | F.coalesce("goes", F.lit(False)) & at_end | (decorated & F.col("t").rlike(r"(?iu)page|seite|p\.|\[|стр|σελ|第|ページ|頁|页|쪽"))
    return n.filter(ok).select("block_id", "bare", "value", (F.col("bare").rlike("[lIOoS|]") & F.col("bare").rlike("[0-9]")).alias("misread"))


def misread_numbers(numbers: DataFrame, headers: DataFrame) -> DataFrame:
    """(block_id, word, right): page numbers with a wrong character, in blocks of their own and in running headers.

    The index is over the numbers that the pages have and their order asks for; a number meets its
    reading by the folded form, and the weighted distance has to be that of confused shapes.
    """
    strange = r"(?<![\p{L}\p{N}|])(?:[0-9]*[lIO|][0-9]+|[0-9]+[lIO|][0-9]*)(?![\p{L}\p{N}|])"
    inside = headers.select("block_id", "line", F.explode(F.regexp_extract_all("line", F.lit(strange), F.lit(0))).alias("word"))
    digits = F.translate(F.col("word"), "lIOoS|", "110051")
    wrong = numbers.filter("misread").select("block_id", F.col("bare").alias("word")).unionByName(inside.select("block_id", "word"))
    known = numbers.filter("value is not null").select(F.col("value").cast("string").alias("right")).union(wrong.select(digits)).distinct()
    form = lambda c: F.xxhash64(fold(F.col(c)))
    pairs = wrong.select("word").distinct().withColumn("form", form("word")).join(known.withColumn("form", form("right")), "form").filter("word <> right")
    sure = pairs.select("word", F.lit(1).cast("long").alias("n"), "right", F.lit(1).cast("long").alias("m")).mapInPandas(_weigh, "word string, n bigint, right string, m bigint, cost double")
    return wrong.join(sure.groupBy("word").agg(F.min_by("right", F.struct("cost", "right")).alias("right")), "word").select("block_id", "word", "right")


def broken_words(texts: DataFrame, lay: DataFrame, lexicon: DataFrame, furniture: DataFrame) -> DataFrame:
    """(block_id, no, left, mark, right, at_end, split): words over the end of a line or of the block; split if the mark isn't part of the word."""
    inside = texts.filter("size(breaks) > 0").select("block_id", F.posexplode("breaks").alias("no", "s"), F.lit(False).alias("at_end"))
    # the next block with running text, on the same page or the next one
    body = lay.join(furniture, "block_id", "left_anti").filter(~F.col("looks_number"))
    follow = Window.partitionBy("job_id", "page_index").orderBy("block_index", "block_id")
    first = body.groupBy("job_id", "page_index").agg(F.min_by("first_word", F.struct("block_index", "block_id")).alias("next_page"))
    linked = body.withColumn("next", F.lead("first_word").over(follow)).filter("last_word is not null")
    linked = linked.join(first.select("job_id", (F.col("page_index") - 1).alias("page_index"), "next_page"), ["job_id", "page_index"], "left")
    tail = linked.select("block_id", F.lit(-1).alias("no"), F.concat("last_word", F.lit("\n"), F.coalesce("next", "next_page", F.lit(""))).alias("s"), F.lit(True).alias("at_end"))
    cutting = rf"^(\S*?)([\p{{L}}\p{{M}}|!0-9]+)([{MARKS}])[ \t]*\r?\n[ \t]*([\p{{L}}\p{{M}}|!0-9]*)(\S*)$"
    part = lambda i: F.regexp_extract("s", cutting, i)
    w = inside.unionByName(tail).select("block_id", "no", "at_end", part(2).alias("left"), part(3).alias("mark"), part(4).alias("right")).filter("left <> ''")
    w = cut(w.withColumn("l", F.lower("left")).withColumn("r", F.lower("right")))
    pieces = F.transform(F.col("compounds"), lambda c: F.split(c, "[-‐]"))
    two = F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.concat_ws("-", F.get(p, i), F.get(p, i + 1)))))
    comp = texts.filter("size(compounds) > 0").select(F.explode(two).alias("key")).groupBy("key").agg(F.count("*").alias("k"))
    known = lexicon.groupBy(F.lower("word").alias("key")).agg(F.sum("n").alias("k")).unionByName(comp)
    asked = F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in (("nj", F.concat("l", "r")), ("nc", F.concat_ws("-", "l", "r")), ("nl", F.col("l")), ("nr", F.col("r")))])
    asked = w.select("l", "r").distinct().select("l", "r", F.explode(asked).alias("a")).select("l", "r", "a.kind", "a.key")
    counts = asked.join(known, "key").groupBy("l", "r").agg(*[F.sum(F.when(F.col("kind") == k, F.col("k")).otherwise(0)).alias(k) for k in ("nj", "nc", "nl", "nr")])
    w = w.join(counts, ["l", "r"], "left").fillna(0, ["nj", "nc", "nl", "nr"])
    soft = F.col("mark").isin("¬", "­")
    split = (
        F.when(soft, True)
        .when(F.col("r").isin(*HANGING) & (F.col("nl") > 0), False)
        .when(F.col("nj") > F.col("nc"), True)
        .when(F.col("nc") > 0, False)
        .when((F.col("nl") >= 5) & (F.col("nr") >= 5), False)
        .otherwise(True)
    )
    return w.select("block_id", "no", "left", "mark", "right", "at_end", split.alias("split"))


def analyse(df: DataFrame) -> dict[str, DataFrame]:
    """All findings over ``df`` (see ``blocks``) by kind."""
    texts = cut(prepared(df))
    lexicon = cut(texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    lay = cut(layout(texts))
    headers = cut(running_headers(lay))
    numbers = cut(page_numbers(lay))
    furniture = cut(headers.join(lay.filter("all_line").select("block_id"), "block_id", "left_semi").select("block_id").unionByName(numbers.select("block_id")).distinct())
    broken = cut(broken_words(texts, lay, lexicon, furniture))
    # broken words that aren't known even when whole may be misread as well
    whole = broken.filter("split and right <> ''").select("block_id", (F.lit(ASIDE) + F.col("no")).cast("int").alias("at"), F.concat("left", "right").alias("word"))
    aside = cut(whole.join(lexicon.select("word"), "word", "left_anti"))
    wider = lexicon.unionByName(aside.groupBy("word").agg(F.count("*").alias("n")))
    misread = corrections(wider, texts, aside)
    return {"texts": texts, "lexicon": lexicon, "layout": lay, "headers": headers, "numbers": numbers, "broken": broken, "misread": misread, "furniture": furniture}


def noise(df: DataFrame) -> DataFrame:
    """(block_id, noise): one row for each block and kind; empty texts and tables give nothing."""
    a = analyse(df)
    kind = lambda d, k: d.select("block_id", F.lit(k).alias("noise"))
    return (
        kind(a["broken"].filter("split"), "hyphenation")
        .unionByName(kind(a["misread"], "misread"))
        .unionByName(kind(misread_numbers(a["numbers"], a["headers"]), "misread"))
        .unionByName(kind(a["headers"], "running_header"))
        .unionByName(kind(a["numbers"], "page_number"))
        .distinct()
    )


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import regex

    word, broken = regex.compile(WORD), regex.compile(BREAK)
    for b in batches:
        out = []
        for text, fixes, seams, header, taken in zip(b["text"], b["fixes"], b["seams"], b["header"], b["taken"]):
            # what goes at the start: a header line, the end of a word that the block before has
            start = 0
            for head in (header, taken):
                if head is not None and text[start:].lstrip().startswith(head.strip()):
                    start = text.index(head.strip(), start) + len(head.strip())
            # misread words by their number among the words that aren't broken
            at = {int(f["at"]): f["right"] for f in (fixes if fixes is not None else ())}
            if at:
                # the sign of a break takes the place of what it hides, so places stay those of the text
                opened = broken.sub(lambda m: BROKEN + " " * (len(m[0]) - 1), text)
                parts, end = [], start
                for k, m in enumerate(word.finditer(opened)):
                    if k in at and m.start() >= start:
                        parts += [text[end : m.start()], at[k]]
                        end = m.end()
                text = "".join([*parts, text[end:]])
            else:
                text = text[start:]
            for s in seams if seams is not None else ():
                end = r"\s*$" if s["at_end"] else rf"[ \t]*\r?\n[ \t]*{regex.escape(s['right'])}"
                to = s["whole"] if s["split"] else s["left"] + s["mark"] + ("" if s["at_end"] else " " * (s["right"].lower() in HANGING) + s["right"])
                text = regex.sub(rf"(?<![\p{{L}}\p{{N}}]){regex.escape(s['left'])}{s['mark']}{end}", lambda m, to=to: to, text)
            for a, c in LIGATURES:
                text = text.replace(a, c)
            out.append(regex.sub(r"\s*\r?\n\s*", " ", text).strip())
        b["clean"] = out
        b["seam"] = b["taken"].notna()
        yield b[["block_id", "job_id", "page_index", "block_index", "clean", "seam", "alone"]]


def paragraphs(df: DataFrame) -> DataFrame:
    """(job_id, page_index, block_index, block_id, text, goes_on): the clean paragraphs of each job, in page order by these keys.

    Lines are joined, broken words made whole, misread words replaced, headers and page numbers gone. A
    mark at the end of a line that belongs to its word stays, without a blank unless a word like 'and'
    follows. A word broken at the end of a block is made whole there and leaves the next block. ``goes_on``
    says that a paragraph begins in the middle of a sentence and that its Markdown doesn't set it apart;
    ``whole`` joins such rows. Blocks without text left are dropped.
    """
    a = analyse(df)
    broken, misread = a["broken"], a["misread"].filter("right is not null")
    right = misread.select("block_id", (F.col("at") - ASIDE).alias("no"), F.col("right").alias("better"))
    seams = broken.join(right, ["block_id", "no"], "left")
    # all that is to be done to a block comes in one row
    layout_ = {"fix": "struct<at:int,right:string>", "seam": "struct<left:string,mark:string,right:string,at_end:boolean,split:boolean,whole:string>", "header": "string", "taken": "string"}

    def mark(df: DataFrame, key: str = "block_id", **what: Column) -> DataFrame:
        return df.select(F.col(key).alias("block_id"), *[what.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in layout_.items()])

    whole_word = F.coalesce("better", F.concat("left", "right")).alias("whole")
    marks = mark(misread.filter(F.col("at") < ASIDE - 1), fix=F.struct("at", "right"))
    marks = marks.unionByName(mark(seams, seam=F.struct("left", "mark", "right", "at_end", "split", whole_word)))
    marks = marks.unionByName(mark(a["headers"], header=F.col("line")))
    # the part of a word that a block gave to the one before it
    follow = Window.partitionBy("job_id", "page_index").orderBy("block_index", "block_id")
    body = a["layout"].join(a["furniture"], "block_id", "left_anti").filter(~F.col("looks_number"))
    first = body.groupBy("job_id", "page_index").agg(F.min_by("block_id", F.struct("block_index", "block_id")).alias("next_page"))
    after = body.withColumn("next", F.lead("block_id").over(follow)).filter("last_word is not null")
    after = after.join(first.select("job_id", (F.col("page_index") - 1).alias("page_index"), "next_page"), ["job_id", "page_index"], "left")
    after = after.select("block_id", F.coalesce("next", "next_page").alias("to"))
    marks = marks.unionByName(mark(broken.filter("at_end and split and right <> ''").join(after, "block_id"), "to", taken=F.col("right")))
    per = marks.groupBy("block_id").agg(F.collect_list("fix").alias("fixes"), F.collect_list("seam").alias("seams"), F.max("header").alias("header"), F.max("taken").alias("taken"))
    kept = a["texts"].select("block_id", "job_id", "page_index", "block_index", "text", "alone").join(a["numbers"].select("block_id"), "block_id", "left_anti").join(per, "block_id", "left")
    clean = kept.mapInPandas(_repair, "block_id bigint, job_id string, page_index int, block_index int, clean string, seam boolean, alone boolean")
    goes_on = (F.col("clean").rlike(r"^\p{Ll}") & ~F.col("alone")) | F.col("seam")
    return clean.filter("clean <> ''").select("job_id", "page_index", "block_index", "block_id", F.col("clean").alias("text"), goes_on.alias("goes_on"))


def whole(rows: DataFrame) -> DataFrame:
    """(job_id, page_index, block_index, block_id, text, blocks): paragraphs in one row each, over the rows of ``paragraphs``.

    A row that goes on belongs to the one before it in its job, also over the end of a page; the keys are
    those of the first block. Rows are dealt by ranges, and a job's ranges are small rows whose counts are
    carried on, so only the blocks of one paragraph meet in a task.
    """
    keys = ["page_index", "block_index", "block_id"]
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # ranges are found by a look at the rows, which would repair them twice
    dealt = cut(cut(rows).repartitionByRange(n, "job_id", *keys).withColumn("part", F.spark_partition_id()))
    starts = F.when(F.col("goes_on"), 0).otherwise(1)
    ranges = dealt.groupBy("job_id", "part").agg(F.sum(starts).alias("starts"))
    earlier = Window.partitionBy("job_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(F.col("job_id").alias("job"), F.col("part").alias("range"), F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("job_id", "part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    numbered = dealt.withColumn("start", F.sum(starts).over(inside)).join(carried, (F.col("part") == F.col("range")) & F.col("job_id").eqNullSafe(F.col("job")))
    grouped = numbered.groupBy("job_id", (F.col("carried") + F.col("start")).alias("paragraph")).agg(F.array_sort(F.collect_list(F.struct(*keys, "text"))).alias("b"))
    # a hyphen that stays at the end of a block has its word go on at once
    joined = F.replace(F.regexp_replace(F.array_join("b.text", BROKEN), rf"(?<=\p{{L}}[-‐]){BROKEN}(?!(?:{'|'.join(HANGING)})\b)(?=\p{{L}})", ""), F.lit(BROKEN), F.lit(" "))
    return grouped.select("job_id", *(F.col("b")[0][k].alias(k) for k in keys), joined.alias("text"), F.size("b").alias("blocks"))
