"""Splitting oversized texts at natural boundaries, by content-defined chunking.

A rolling hash over the text's bytes sets landmarks that depend on the nearby bytes alone. A cut snaps
from a landmark to the nearest natural boundary within the allowed sizes, weak kinds counting as farther
away, so an edit moves only the cuts next to it. Each piece also carries the end of the one before it as overlap.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A token is so many UTF-8 bytes.
TOKEN = 4
#: Bytes that a landmark depends on; a power of 2.
WINDOW = 32
#: Models that a text is tested against at a time; more are taken in several goes.
MODELS = 256
#: Natural boundaries from the strongest to the weakest: the cut falls after the match.
BOUNDARIES = (
    re.compile(rb"\n[ \t]*\r?\n+|\n(?=#{1,6} )"),
    re.compile(rb"\r?\n"),
    re.compile("(?:[.!?]|…)+(?:[\"')\\]]|»|”|’)*[ \\t]+|(?:。|！|？)+(?:」|』|）)*".encode()),
    re.compile("(?:[;:,]|—)[ \\t]+|、|，|；|：".encode()),
    re.compile(rb"[ \t]+|\xe3\x80\x80"),
)
#: By what part of the window a boundary of each kind counts as farther away than it is.
WEAKER = (0.0, 0.1, 0.15, 0.4, 0.7)
#: White space or a mark of any script after which a word may start.
PAUSE = re.compile(rb"[ \t\n]+|\xc2\xa0|\xe3\x80[\x80-\x82]|\xef\xbc[\x81\x8c\x9a\x9b\x9f]")
_GEAR = np.random.default_rng(20240607).integers(0, 2**32, 256, dtype=np.uint32)


def rolling(data: bytes) -> np.ndarray:
    """The hash of the ``WINDOW`` bytes that end at each place, by doubling the window."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:
        out = h.copy()
        out[width:] += h[:-width] << np.uint32(width)
        h, width = out, width * 2
    return h


def _starts(data: bytes) -> np.ndarray:
    """Where a character starts, the end included."""
    b = np.frombuffer(data, np.uint8)
    return np.append((b & 0xC0) != 0x80, True)


class Marks:
    """Landmarks, natural boundaries and character starts of one text; they don't depend on any size, so all models share them."""

    def __init__(self, data: bytes) -> None:
        self.data, self.hashes, self.starts = data, rolling(data), _starts(data)
        self.ends = [np.fromiter((m.end() for m in p.finditer(data)), np.int64) for p in BOUNDARIES]

    def cuts(self, least: int, most: int) -> list[int]:
        """Ends of consecutive stretches, each of ``least`` to ``most`` bytes but the last.

        In each window the landmark with the greatest hash counts, and the cut snaps to the boundary
        nearest to it, where a boundary of a weaker kind counts as farther away by its part of the window.
        Without any boundary the cut is the landmark itself, moved to the start of a character.
        """
        n, out, at = len(self.data), [], 0
        while n - at > most:
            low, high = at + least, at + most
            mark = low + int(self.hashes[low - 1 : high].argmax())
            cut, far = 0, float("inf")
            for e, weak in zip(self.ends, WEAKER):
                i = int(np.searchsorted(e, mark))
                for x in e[max(0, i - 1) : i + 1]:
                    if low <= x <= high and abs(int(x) - mark) + weak * (high - low) < far:
                        cut, far = int(x), abs(int(x) - mark) + weak * (high - low)
            if not cut:
                cut = mark
                while cut > at + 1 and not self.starts[cut]:
                    cut -= 1
                if not self.starts[cut] or cut <= at:  # a character wider than the window
                    cut = at + 1 + int(self.starts[at + 1 :].argmax())
            out.append(cut)
            at = cut
        return [*out, n]

    def ranges(self, limit: int, overlap: int) -> list[tuple[int, int]]:
        """Start and end of the pieces in bytes, each starting at or before the end of the one before."""
        data, top = self.data, limit * TOKEN
        if len(data) <= top:
            return [(0, len(data))]
        shared = max(0, min(overlap * TOKEN, top // 2))
        most = max(4, top - shared)
        out, at = [], 0
        for end in self.cuts(max(1, most // 2), most):
            start = at
            if at and shared:
                start = max(0, at - min(shared, top - (end - at)))
                while start < at and not self.starts[start]:
                    start += 1
                # rather at the start of a word, if one is near
                if start and not PAUSE.match(data, max(0, start - 3), start) and (m := PAUSE.search(data, start, min(at, start + shared // 3))):
                    start = m.end()
            out.append((start, end))
            at = end
        return out


def cuts(data: bytes, least: int, most: int) -> list[int]:
    return Marks(data).cuts(least, most) if len(data) > most else [len(data)]


def ranges(data: bytes, limit: int, overlap: int) -> list[tuple[int, int]]:
    return Marks(data).ranges(limit, overlap) if len(data) > limit * TOKEN else [(0, len(data))]


def pieces(text: str, limit: int, overlap: int) -> list[str]:
    """``text`` as pieces of at most ``limit`` tokens that share about ``overlap`` tokens; together they hold all of it."""
    data = text.encode("utf-8", "surrogatepass")
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in ranges(data, limit, overlap)]


def split_oversized(items: DataFrame, models: DataFrame, keys: list[str], text: str, own_model: str | None = None, with_text: bool = True) -> DataFrame:
    """(keys.., model, tokens, piece int, pieces int[, piece_text]): the pieces of each text that is too large for a model.

    ``models`` (model, chunk_max_tokens, chunk_overlap_tokens) is one row per model, a small table of settings. A text is checked
    against each model, or with ``own_model`` against the model that this column names. Texts that
    fit, null and empty ones and rows of unknown models give nothing; repeated rows repeat. Other
    columns are dropped whatever their names. The size test runs before any text goes to Python.
    """
    limits = models.filter("model is not null and chunk_max_tokens > 0").select("model", F.col("chunk_max_tokens").cast("int").alias("n"), F.coalesce(F.col("chunk_overlap_tokens").cast("int"), F.lit(0)).alias("o"))
    known = sorted({(m.model, m.n, m.o) for m in limits.distinct().collect()})
    if len(known) > MODELS:
        parts = [models.sparkSession.createDataFrame(known[i : i + MODELS], "model string, chunk_max_tokens int, chunk_overlap_tokens int") for i in range(0, len(known), MODELS)]
        return functools.reduce(DataFrame.unionByName, [split_oversized(items, part, keys, text, own_model, with_text) for part in parts])
    some = items.select(*[items[k].alias(f"k{i}") for i, k in enumerate(keys)], items[text].alias("text"), *([items[own_model].alias("__own")] if own_model else []))
    some = some.withColumn("tokens", F.ceil(F.octet_length("text") / TOKEN).cast("long"))
    # the models are configuration; a text goes to Python once, with the list of those it is too large for
    kind = "array<struct<model:string,limit:int,overlap:int>>"
    every = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(n).alias("limit"), F.lit(o).alias("overlap")) for m, n, o in known]).cast(kind) if known else F.array().cast(kind)
    over = F.filter(every, lambda x: (x["limit"] < F.col("tokens")) & (x["model"] == F.col("__own") if own_model else F.lit(True)))
    some = some.withColumn("limits", over).filter("size(limits) > 0")
    kinds = [items.schema[k].dataType.simpleString() for k in keys]
    width = len(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, models_, tokens, piece, of, texts = [], [], [], [], [], []
            size = 0
            for i, (t, n, limits) in enumerate(zip(b.column(width).to_pylist(), b.column(width + 1).to_pylist(), b.column(width + 2).to_pylist())):
                data = t.encode("utf-8", "surrogatepass")
                marks = Marks(data)
                for x in limits:
                    got = marks.ranges(x["limit"], x["overlap"] or 0)
                    for k, (start, end) in enumerate(got):
                        rows.append(i)
                        models_.append(x["model"])
                        tokens.append(n)
                        piece.append(k)
                        of.append(len(got))
                        texts.append(data[start:end].decode("utf-8", "surrogatepass") if with_text else None)
                        size += end - start
                if size > 8_000_000:
                    yield make(b, rows, models_, tokens, piece, of, texts)
                    rows, models_, tokens, piece, of, texts, size = [], [], [], [], [], [], 0
            if rows:
                yield make(b, rows, models_, tokens, piece, of, texts)

    def make(b, rows, models_, tokens, piece, of, texts) -> pa.RecordBatch:
        at = pa.array(rows, pa.int32())
        cols = [b.column(i).take(at) for i in range(width)]
        cols += [pa.array(models_, pa.string()), pa.array(tokens, pa.int64()), pa.array(piece, pa.int32()), pa.array(of, pa.int32())]
        names = [f"k{i}" for i in range(width)] + ["model", "tokens", "piece", "pieces"]
        if with_text:
            cols.append(pa.array(texts, pa.string()))
            names.append("piece_text")
        return pa.RecordBatch.from_arrays(cols, names)

    layout = ", ".join([*(f"k{i} {k}" for i, k in enumerate(kinds)), "model string, tokens bigint, piece int, pieces int", *(["piece_text string"] if with_text else [])])
    out = some.select(*[f"k{i}" for i in range(width)], "text", "tokens", "limits").mapInArrow(run, layout)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *out.columns[width:])
