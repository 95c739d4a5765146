"""Encoding of texts with a public byte-level BPE vocabulary (problem 7)."""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter, as they are never part of this repository.
TOKENIZERS = os.environ.get("COURTLANE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of the public vocabulary, which splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words up to so many bytes are merged by scanning, longer ones (a run of blanks, a line of Chinese) over a heap.
SHORT = 64
#: Texts of so many characters are split word by word, shorter ones at once.
LONG = 1 << 20
#: Words whose ids a worker remembers; it forgets all when they become more.
REMEMBERED = 200_000


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word. ``cuts`` holds the part boundaries, ``near`` the rank of the two parts from each boundary on; the least rank
    (the leftmost of equals) loses its middle boundary, and the ranks on either side are looked up again."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    none = 1 << 60
    cuts = list(range(len(word) + 1))
    near = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == none:
            break
        i = near.index(least)
        del cuts[i + 1], near[i]
        if i < len(near):
            near[i] = ranks.get(word[cuts[i] : cuts[i + 2]], none)
        if i:
            near[i - 1] = ranks.get(word[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word in n log n: the parts are a linked list, the candidate merges a heap by (rank, position)."""
    n = len(word)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # end of the part that starts at i, start of the part before it
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    live = [True] * n
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not live[i] or end[i] != mid or mid >= n or not live[mid] or end[mid] != stop:
            continue
        live[mid], end[i] = False, stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if prev[i] >= 0 and (r := ranks.get(word[prev[i] : stop])) is not None:
            heapq.heappush(heap, (r, prev[i], i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes whole texts; the strings of special tokens are ordinary text."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        self.ranks, self.split, self.seen = load_ranks(path), regex.compile(pattern), {}

    def __call__(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts both give an empty list."""
        if not text:
            return []
        out, seen = [], self.seen
        for word in self.split.findall(text) if len(text) < LONG else (m.group() for m in self.split.finditer(text)):
            ids = seen.get(word)
            if ids is None:
                raw = word.encode("utf-8", "surrogatepass")
                ids = merge_short(raw, self.ranks) if len(raw) <= SHORT else merge_long(raw, self.ranks)
                if len(raw) <= SHORT:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[word] = ids
            out += ids
        return out


def encoded(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep`` and ids (ARRAY<INT>) of every row of ``documents``; null and empty texts have an empty list.

    No shuffle: each task encodes its rows as they come, batch by batch, and the words repeat so much that most are looked up.
    """
    where = path or f"{TOKENIZERS}/{VOCABULARY}"
    slim = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(where)
        for part in parts:
            yield part.drop(columns="__text").assign(ids=[encode(t) for t in part["__text"]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInPandas(run, f"{fields}, ids array<int>")
