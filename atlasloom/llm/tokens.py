"""Encoding whole tables with a byte-level BPE vocabulary.

Texts are split by the vocabulary's pattern in Arrow batches; words not seen before by the worker
are merged together: an index maps each adjacent pair to all its positions over all these words,
active ranks are applied in ascending order, and only the lists around a merged place change.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = os.environ.get("ATLASLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that goes with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers; beyond it starts anew, so its memory stays small on any corpus.
REMEMBER = 400_000
#: Characters encoded at a time, so that a batch of very long texts fits into a worker.
AT_ONCE = 4_000_000


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> "Encoder":
    return Encoder(path)


class Encoder:
    """Ids of texts by the rank file at ``path`` (base64 token, rank); special tokens don't exist here."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.word = regex.compile(PATTERN)
        # Where visible characters end and white space begins a word always ends, so texts fall apart
        # there; white space other than the usual six isn't told apart the same way, such texts stay whole.
        self.rare = re.compile(r"[^\S \t\n\r\f\v]")
        self.piece = re.compile(r"\s*\S+|\s+")
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, list[int]] = {}

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        if not (text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f")) and self.rare.search(text):
            return self.word.findall(text)
        if any(c in text for c in ("\n", "\t", "\r", "\f", "\v", "  ")):
            return self.piece.findall(text)
        first, *rest = text.split(" ")
        return [x for x in (first, *[" " + x for x in rest]) if x]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(self.pieces)
        if new:
            if len(self.pieces) + len(new) > REMEMBER:
                self.pieces, self.words = {}, {}
                new = set().union(*split)
            of = {p: self.word.findall(p) for p in new}
            missing = set().union(*of.values()).difference(self.words)
            if missing:
                missing = sorted(missing)
                self.words.update(zip(missing, self.merge([w.encode("utf-8", "surrogatepass") for w in missing])))
            for p, ws in of.items():
                self.pieces[p] = np.array([i for w in ws for i in self.words[w]], "<i4").tobytes()
        get = self.pieces.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """All ``words`` at once by the pair index."""
        rank = self.rank
        token: list[bytes | None] = []
        before: list[int] = []
        after: list[int] = []
        starts: list[int] = []
        for w in words:
            k = len(token)
            starts.append(k)
            token.extend(w[i : i + 1] for i in range(len(w)))
            before.extend(range(k - 1, k + len(w) - 1))
            after.extend(range(k + 1, k + len(w) + 1))
            if w:
                before[k], after[-1] = -1, -1
        where: dict[int, list[int]] = {}
        for i, j in enumerate(after):
            if j >= 0 and (r := rank.get(token[i] + token[j])) is not None:
                where.setdefault(r, []).append(i)
        active = list(where)
        heapq.heapify(active)
        name: dict[int, bytes] = {}
        while active:
            r = heapq.heappop(active)
            places = where.pop(r, None)
            if not places:
                continue
            places.sort()
            for i in places:
                left = token[i]
                if left is None or (j := after[i]) < 0:
                    continue
                both = left + token[j]
                if rank.get(both) != r:
                    continue  # another merge was here first
                token[i], token[j] = name.setdefault(r, both), None
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    if (q := rank.get(both + token[k])) is not None:
                        if q not in where:
                            where[q] = []
                            heapq.heappush(active, q)
                        where[q].append(i)
                if (h := before[i]) >= 0 and (q := rank.get(token[h] + both)) is not None:
                    if q not in where:
                        where[q] = []
                        heapq.heappush(active, q)
                    where[q].append(h)
        return [[rank[t] for t in token[a:b] if t is not None] for a, b in zip(starts, [*starts[1:], len(token)])]


def blocks(texts: list[str], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield a, i
            a, n = i, 0
        n += len(t)
    if a < len(texts):
        yield a, len(texts)


def _rank_file(vocabulary: str, folder: str) -> str:
    return os.path.join(folder, f"{vocabulary}.tiktoken")


def encode(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>): the ids of each text; a null or empty text gives an empty list, repeated rows repeat.

    Text that looks like a special token is ordinary text. Other columns are dropped whatever their
    names. An empty table gives an empty result; a null key stays null.
    """
    path, kind = _rank_file(vocabulary, folder), df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in blocks(texts):
                ids = e.encode(texts[i:j])
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("int32")
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), flat)], ["key", "ids"])

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, tokens bigint): the length of each text in tokens, by the same encoding; 0 for null or empty."""
    path, kind = _rank_file(vocabulary, folder), df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [len(x) // 4 for i, j in blocks(texts) for x in e.encode(texts[i:j])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["key", "tokens"])

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, tokens bigint").withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, bytes binary): the bytes that lists of ids stand for; a null or empty list gives none, an unknown id is an error."""
    path, kind = _rank_file(vocabulary, folder), df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {r: t for t, r in _encoder(path).rank.items()}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join([of[i] for i in x or ()]) for x in b.column(1).to_pylist()], pa.binary())], ["key", "bytes"])

    return df.select(df[key].alias("key"), df[ids].alias("ids")).mapInArrow(run, f"key {kind}, bytes binary").withColumnRenamed("key", key)
