"""Text as column expressions: words, sets of words, estimates of tokens, titles, marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that carry no content.
STOP = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot
could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he
he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me
more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll
she's should shouldn't so some such than that that's the their theirs them themselves then there there's these they they'd they'll
they're they've this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's
where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split()
#: Phrases by which a user corrects what was said; the first that stands in a text counts.
CORRECTIONS = ("actually", "actually,", "wait,", "wait", "i meant", "not that", "correction", "correction:", "to clarify", "scratch that", "never mind", "nevermind", "no wait", "i was wrong", "let me correct", "that's wrong", "that's not right", "i misspoke")


def tokens(text: Column) -> Column:
    """The set of content words, in lower case, sorted; null gives an empty set."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}']+")
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in ["", *STOP]])))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def overlap(a: Column, b: Column) -> Column:
    """As ``jaccard``, but two empty sets are the same."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def similarity_class(s: Column) -> Column:
    return F.when(s > 0.85, "update").when(s >= 0.5, "flag").otherwise("new")


def cosine(a: Column, b: Column) -> Column:
    """In double over float vectors, within -1 and 1; 0 for empty, unequal, zero and NaN vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    c = dot(a, b) / norm
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0) & ~F.isnan(norm) & ~F.isnan(dot(a, b))
    return F.when(ok, F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)


def estimate(text: Column) -> Column:
    """Tokens of a text by its bytes: a quarter of them, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def sentences(text: Column) -> Column:
    """Parts that end with . ? or ! before white space, trimmed, without empty ones."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.?!])(?=\s)")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def title(text: Column, most: int = 40) -> Column:
    """The first ``most`` characters, with dots if more follow."""
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def collapsed(text: Column) -> Column:
    """Runs of blanks in a line become one, line ends stay."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?m)^ | $", "")


def xml(text: Column, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;")) if attribute else out


def correction(text: Column) -> Column:
    """The first correcting phrase that stands in ``text`` as whole words, else null."""
    low, out = F.lower(text), F.lit(None).cast("string")
    for p in reversed(CORRECTIONS):
        out = F.when(low.rlike(rf"(?<![\p{{L}}\p{{N}}]){p}(?![\p{{L}}\p{{N}}])"), p).otherwise(out)
    return out


def negated(text: Column, previous: Column) -> Column:
    """The first content word of ``previous`` that ``text`` negates ('not word', 'no word'), else null."""
    clean = lambda t: F.transform(F.split(F.lower(F.coalesce(t, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    now = clean(text)
    before = F.array_except(clean(previous), F.array(*[F.lit(w) for w in ["", *STOP]]))
    after = F.zip_with(now, F.slice(now, F.lit(2), F.size(now)), lambda w, n: F.when(w.isin("not", "no"), n))
    return F.when(F.lower(text).rlike(r"(?<![\p{L}\p{N}])not?(?![\p{L}\p{N}])"), F.get(F.array_intersect(after, before), F.lit(0)))


def unfenced(text: Column) -> Column:
    """JSON of a model's answer without the code fence around it."""
    return F.trim(F.regexp_replace(text, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))


def truncated(text: Column, budget: int) -> Column:
    """The head of ``text`` that fits into ``budget`` estimated tokens: a quarter of the bytes each, cut between characters."""
    most = 4 * budget
    data = F.encode(text, "UTF-8")
    # bytes that begin a character, two hexadecimal digits each; one that goes on behind the cut is left out
    starts = F.length(F.regexp_replace(F.hex(F.substring(data, 1, most)), "([0-7C-F][0-9A-F])|[89AB][0-9A-F]", "$1")) / 2
    goes_on = F.hex(F.substring(data, most + 1, 1)).rlike("^[89AB]")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.left(text, (starts - F.when(goes_on, 1).otherwise(0)).cast("int")))


#: Words whose period ends no sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "vs", "etc", "Inc", "Ltd", "No")


def summary_head(text: Column, least: int) -> Column:
    """``text`` up to the first end of a sentence at or after ``least`` characters, all of it without one; periods of abbreviations end none."""
    held = F.regexp_replace(text, rf"(^|\s)({'|'.join(ABBREVIATIONS)}|[A-Z]{{1,2}})\.", "$1$2\x01")
    head = F.regexp_extract(held, rf"^((?s:.{{{max(0, least - 1)},}}?)[.?!])", 1)
    return F.replace(F.when(head == "", held).otherwise(head), F.lit("\x01"), F.lit("."))


def boilerplate(line: Column) -> Column:
    """Whether a trimmed line is too short to say anything, has no letter, or is a usual label of a page's head."""
    return (F.length(line) < 4) | F.lower(line).rlike(r"^(due:|name:|student:|page )|due date") | ~line.rlike(r"\p{L}")


def content_line(text: Column, most: int = 80) -> Column:
    """The first line of ``text`` that says something, cut with dots beyond ``most`` characters; null without one."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    line = F.get(F.filter(lines, lambda x: ~boilerplate(x)), F.lit(0))
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most - 3)), F.lit("..."))).otherwise(line)


def without_count(title: Column) -> Column:
    """A title without the '(2/5)' behind it."""
    return F.regexp_replace(title, r"\s*\(\d+(?:/\d+)?\)\s*$", "")


def local_endpoint(url: Column) -> Column:
    """Whether a URL leads to this machine: localhost or a loopback address; null and malformed ones don't."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    return (host == "localhost") | host.rlike(r"^127\.\d{1,3}\.\d{1,3}\.\d{1,3}$") | (host == "[::1]")
