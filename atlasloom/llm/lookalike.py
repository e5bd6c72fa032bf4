"""One consistent form for texts that look the same.

Each Arrow batch goes through DuckDB inside the task: one SQL expression of translate,
regexp_replace and nfc_normalize maps compatibility forms, invisible characters and look-alike
letters. The tables below the fixed values are made from Unicode's own decompositions by rule.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut

#: Letters that look like a Latin one, by script, and signs that look like another.
LOOK_FROM_TO = (
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"), ("ονρϲϳ", "ovpcj"),
    # Cyrillic
    ("АВЕКМНОРСТУХЅІЈҮԚԜԌѴӀ", "ABEKMHOPCTYXSIJYQWGVI"), ("аеорсухѕіјѵһԁԛԝүӏ", "aeopcyxsijvhdqwyl"),
    # Armenian
    ("ՕՍՏԼ", "OUSL"), ("օոսհցզյ", "onuhgqj"),
    # Cherokee
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᎩᏃ", "ABCDEGHJKLMPRSTVWYZ"),
    # Coptic
    ("ⲀⲂⲤⲈⲎⲒⲔⲘⲚⲞⲢⲦⲨⲬⲌ", "ABCEHIKMNOPTYXZ"), ("ⲟⲥⲣⲭ", "ocpx"),
    # Lisu
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
    # Latin letters of other alphabets and small capitals
    ("ɡɑɩⅼᴏᴠᴡᴢᴄꜱ", "gailovwzcs"),
    # signs
    ("‐‑‒∣ǀ∶‚․", "--–||:,."),
)
LOOK = {a: b for froms, tos in LOOK_FROM_TO for a, b in zip(froms, tos, strict=True)}
#: Characters without any look of their own; joiners are handled by their neighbours.
UNSEEN = "­͏؜ᅟᅠ឴឵᠎​‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯ㅤ﻿ﾠ￹￺￻"
#: Where joiners shape what is seen (Arabic, Indic scripts) and where they join emoji.
SHAPED = r"\x{0600}-\x{08FF}\x{0900}-\x{109F}\x{1780}-\x{17FF}"
EMOJI = r"\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2460}-\x{27BF}\x{2900}-\x{297F}\x{2B00}-\x{2BFF}\x{3030}\x{303D}\x{3297}\x{3299}\x{FE0F}\x{1F000}-\x{1FAFF}"
#: Rows of one form that a task pairs with all others of it.
SHARE = 1_000
#: Bytes that go through DuckDB at once.
AT_ONCE = 16_000_000
#: A joiner that stays is written as the first and the last of these meanwhile, the first itself as the first and the second.
ASIDE, ITSELF, JOINER = chr(0xE0FF), chr(0xE0FE), chr(0xE0FD)


@functools.cache
def tables() -> tuple[dict[str, str], dict[str, str]]:
    """Maps of one character to one, and of one to several."""
    one, more = {}, {}
    for n in range(0x80, 0x20000):
        c = chr(n)
        kind, _, rest = unicodedata.decomposition(c).rpartition("> ")
        to = "".join(chr(int(x, 16)) for x in rest.split()) if kind else ""
        if unicodedata.category(c) == "Zs":
            to = " "
        elif kind in ("<wide", "<narrow", "<noBreak"):
            to = to.strip(" ") or to
        elif kind == "<compat" and (0xFB00 <= n <= 0xFB17 or 0x2160 <= n <= 0x217F or n in (0x132, 0x133, 0xB5, 0x2024, 0x2025, 0x2026) or 0x1C4 <= n <= 0x1CC or 0x1F1 <= n <= 0x1F3):
            to = unicodedata.normalize("NFKC", c)
        else:
            to = ""
        base = to or unicodedata.normalize("NFD", c)
        seen = unicodedata.normalize("NFC", "".join(LOOK.get(x, x) for x in base))
        if seen != unicodedata.normalize("NFC", c):
            (one if len(seen) == 1 else more)[c] = seen
    return one, more


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@functools.cache
def query() -> str:
    """The SQL that brings ``text`` of the relation ``batch`` to the consistent form; null stays null."""
    one, more = tables()
    unseen = "".join(rf"\x{{{ord(c):04X}}}" for c in UNSEEN)
    steps = [
        # a mark of its own takes the look of its letter, whatever letter that is
        "nfc_normalize(text)",
        r"regexp_replace(text, '\r\n?|[\x{85}\x{2028}\x{2029}\x0B\x0C]', chr(10), 'g')",
        rf"regexp_replace(text, '[\x00-\x08\x0E-\x1F\x7F-\x{{9F}}{unseen}\x{{FE00}}-\x{{FE0E}}\x{{E0001}}\x{{E0100}}-\x{{E01EF}}]+', '', 'g')",
        rf"regexp_replace(text, '(^|[^{EMOJI}#*0-9])\x{{FE0F}}+', '\1', 'g')",
        # joiners between two emoji are put aside, twice as neighbours share an emoji
        f"replace(text, {_quote(ASIDE)}, {_quote(ASIDE + ITSELF)})",
        *[rf"regexp_replace(text, '([{EMOJI}])\x{{200D}}([{EMOJI}])', '\1{ASIDE}{JOINER}\2', 'g')"] * 2,
        rf"regexp_replace(text, '(^|[^{SHAPED}\x{{200C}}\x{{200D}}])[\x{{200C}}\x{{200D}}]+', '\1', 'g')",
        f"replace(replace(text, {_quote(ASIDE + JOINER)}, {_quote(chr(0x200D))}), {_quote(ASIDE + ITSELF)}, {_quote(ASIDE)})",
        f"translate(text, {_quote(''.join(one))}, {_quote(''.join(one.values()))})",
        f"CASE WHEN regexp_matches(text, '[{''.join(more)}]') THEN " + functools.reduce(lambda x, c: f"replace({x}, {_quote(c)}, {_quote(more[c])})", more, "text") + " ELSE text END",
        r"regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g')",
        r"regexp_replace(nfc_normalize(text), '\n+$', '')",
    ]
    # texts of nothing but these keep their form: ASCII, Latin-1 letters and signs, kana, Han
    odd = r"regexp_matches(text, '[^ -~\n\x{A1}-\x{AC}\x{AE}-\x{B4}\x{B6}-\x{FF}\x{3001}\x{3002}\x{3041}-\x{3094}\x{30A1}-\x{30FE}\x{4E00}-\x{9FFF}]| \n|[ \n]$')"
    joined = "regexp_matches(text, '[' || chr(8204) || chr(8205) || ']')"
    steps = [f"CASE WHEN {joined} THEN {e} ELSE text END" if "200D" in e else e for e in steps]
    ctes = [f"s0 AS (SELECT n, text FROM batch WHERE {odd})"] + [f"s{i} AS (SELECT n, {e} AS text FROM s{i - 1})" for i, e in enumerate(steps, 1)]
    return f"WITH {', '.join(ctes)} SELECT n, text FROM s{len(steps)}"


@functools.cache
def _engine():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
    con.execute("SET enable_progress_bar = false")
    return con


def _look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _engine()
    for whole in batches:
        few = max(1, whole.num_rows * AT_ONCE // max(AT_ONCE, whole.nbytes))  # texts may be very long
        for at in range(0, whole.num_rows, few):
            b = whole.slice(at, few)
            batch = pa.table({"n": pa.array(range(b.num_rows), pa.int64()), "text": b.column(1)})
            con.register("batch", batch)
            got = con.sql(query()).to_arrow_table()
            con.unregister("batch")
            texts = b.column(1).to_pylist()
            for n, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
                texts[n] = text
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["key", "text", "form"])


def one_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, form): ``form`` is equal for texts that look the same to a reader, different for others.

    Compatibility widths, ligatures and spaces of any width become the usual characters; combining
    marks join their letter; invisible characters, trailing white space and line-end variants go;
    look-alike letters become the Latin one. Case, accents, raised, lowered, circled and fraction
    signs, and emoji with their joiners stay. A null text stays null, an empty one empty; repeated
    rows and null keys stay; other columns are dropped; an empty table gives an empty result.
    """
    kind = df.schema[key].dataType.simpleString()
    out = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(_look, f"key {kind}, text string, form string")
    return out.withColumnRenamed("key", key) if key != "text" else out


def same_look(df: DataFrame, key: str, text: str, share: int = SHARE) -> DataFrame:
    """(a, b): pairs of keys a < b whose texts look the same but aren't the same characters.

    Texts that are null or show nothing are in no pair. Only forms with more than one spelling go
    into the join; a spelling stands once per copy, as the result asks for each pair of rows.
    """
    # texts travel as two 128-bit hashes
    h = lambda c, s: F.struct(F.xxhash64(c), F.xxhash64(F.lit(s), c))
    seen = one_form(df, key, text).filter(F.col("form").rlike(r"(?U)[^\s\p{C}\u200B-\u200F\u2060]"))
    keys = cut(seen.select(F.col(key).alias("k"), h(F.col("form"), "form").alias("form"), h(F.col("text"), "text").alias("spelling")))
    copies = keys.groupBy("form", "spelling").agg(F.count("*").alias("n"))
    # a form of many rows is dealt to several tasks, each with a share of one side
    several = copies.groupBy("form").agg(F.count("*").alias("spellings"), F.ceil(F.sum("n") / share).cast("int").alias("shares")).filter("spellings > 1").select("form", "shares")
    left = keys.distinct().join(several, "form")
    a = left.select("form", "spelling", F.col("k").alias("a"), F.pmod(F.xxhash64("k"), F.col("shares")).cast("int").alias("share"))
    b = left.select("form", F.col("spelling").alias("other"), F.col("k").alias("b"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    return a.join(b, ["form", "share"]).filter((F.col("spelling") != F.col("other")) & (F.col("a") < F.col("b"))).select("a", "b")
