"""Marks in notes and answers: links between notes, instructions hidden in texts, scaled boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wikilinks(text: Column) -> Column:
    """The trimmed targets of [[target]] and [[target|label]], in order, repeated ones once."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(found, lambda x: F.trim(x))), lambda x: x != "")


#: What a text says that wants to steer a model.
STEERING = ("ignore previous instructions", "disregard the above", "new system prompt")


def steers(text: Column) -> Column:
    """Whether a text holds such a phrase outside quotation marks; null doesn't."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\"“„«][^\"”“»\n]*[\"”“»]", " ")
    out = F.lit(False)
    for p in STEERING:
        out = out | F.contains(bare, F.lit(p))
    return out


def to_points(pixels: Column, page_points: Column, page_pixels: Column) -> Column:
    """A length in pixels of a page image as points of the page; null for an image without extent."""
    return F.when(page_pixels > 0, pixels * page_points / page_pixels)


def whitened(text: Column) -> Column:
    """Only letters, digits, blanks and hyphens stay, as for labels in drawings."""
    return F.regexp_replace(text, r"[^\p{L}\p{N} \-]", "")


def heading_level(height: Column, usual: Column) -> Column:
    """1 to 3 by how much taller a line is than the usual one, else null."""
    r = height / usual
    return F.when(usual > 0, F.when(r >= 1.55, 1).when(r >= 1.30, 2).when(r >= 1.15, 3))
