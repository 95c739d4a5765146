"""Held-out items that leak into documents (problem 8): containment search by windowed MinHash, verified exactly.

A whole-set MinHash can't find a 60-character stretch of an item in a document a hundred times as long. So the sets are the shingles of
every window as long as the stretch asked for: of each window the shingle with the least hash is kept. A stretch that a document
shares with an item is such a window of both, so both keep the same shingle, and none can be missed. Items are partitioned by
the size of the stretch they need, which is the size of the sets.

The kept shingles of the items set the bits of a filter of fixed size that goes to all tasks; documents pass only shingles that meet a set bit, each with
the characters around it. They meet the items' shingles in a join by hash, and a pair counts if the shingle and what lies around it agree over a whole
stretch. So nothing that grows with the items or the documents is collected or broadcast by hand.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlane.session import staged

#: Stretch of letters and digits that must be shared, and shingle size of the windows, by size class.
CLASSES = {"wide": (60, 30), "tight": (24, 12)}
#: Languages whose items need only the tight stretch.
TIGHT = ("zh",)
#: The filter over the items' kept shingles has 2**FILTER_BITS bits (8 MB), however many items there are; above some ten million shingles it lets more through.
FILTER_BITS = 26
#: Characters of documents that a task hashes at once; a longer text is taken in pieces that overlap by a stretch.
PIECE_CHARS = 1_000_000

_TAG, _OTHER, _OTHER_ASCII = re.compile(r"<[^<>]*>"), re.compile(r"[\W_]+"), re.compile(r"[^a-z0-9]+")


def plain(text: str | None) -> str:
    """Letters and digits of a text in order: without tags, case, accents and character width. Null gives an empty text."""
    if not text:
        return ""
    text = _TAG.sub("", text)
    if text.isascii():
        return _OTHER_ASCII.sub("", text.lower())
    flat = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return _OTHER.sub("", flat)


def _hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the texts in their concatenation, hash of the shingle at each character): a polynomial over ``size`` characters, mixed."""
    starts = np.cumsum([0, *map(len, texts)])
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(chars) - size + 1), dtype=np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + chars[i : i + len(h)]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return starts, h


def _minima(starts: np.ndarray, h: np.ndarray, stretch: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the least hash in every window that lies in one text, runs of equal ones once; minima by doubling."""
    windows = int(starts[-1]) - stretch + 1
    if windows < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    span, width = stretch - size + 1, 1
    while width < span:
        step = min(width, span - width)
        h = np.minimum(h[: len(h) - step], h[step:])
        width += step
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = owner[:windows] == owner[stretch - 1 :]
    owner, h = owner[:windows][whole], h[:windows][whole]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], h[fresh]


def kept_shingles(texts: list[str], stretch: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the shingle with the least hash in every window of ``stretch`` characters, each once per text."""
    return _minima(*_hashes(texts, size), stretch, size)


def in_pieces(texts: list[str], stretch: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(text numbers, offsets, pieces) of at most about two times PIECE_CHARS characters; every window of ``stretch`` characters of a text is whole in one of its pieces."""
    numbers, offsets, pieces, held = [], [], [], 0
    for n, text in enumerate(texts):
        for at in range(0, max(1, len(text) - stretch + 1), PIECE_CHARS):
            numbers.append(n)
            offsets.append(at)
            pieces.append(text[at : at + PIECE_CHARS + stretch - 1])
            held += len(pieces[-1])
            if held >= PIECE_CHARS:
                yield numbers, offsets, pieces
                numbers, offsets, pieces, held = [], [], [], 0
    if pieces:
        yield numbers, offsets, pieces


def anchored(texts: list[str], kind: str, passes: Callable[[np.ndarray], np.ndarray] | None = None) -> set[tuple[int, int, str, str, str]]:
    """(text number, hash, left, shingle, right) of the kept shingles whose hash ``passes``: each place of the shingle with the characters, as many as a
    stretch can reach, before and after it."""
    stretch, size = CLASSES[kind]
    side, out = stretch - size, set()
    for numbers, offsets, pieces in in_pieces(texts, stretch):
        starts, h = _hashes(pieces, size)
        kept = np.unique(_minima(starts, h, stretch, size)[1])
        if passes is not None:
            kept = kept[passes(kept)]
        if not len(kept):
            continue
        at = np.flatnonzero(kept[np.minimum(np.searchsorted(kept, h), len(kept) - 1)] == h)
        piece = np.searchsorted(starts, at, "right") - 1
        whole = at + size <= starts[piece + 1]
        for i, p in zip(at[whole].tolist(), piece[whole].tolist()):
            text, k = texts[numbers[p]], i - int(starts[p]) + offsets[p]
            out.add((numbers[p], int(h[i].view(np.int64)), text[max(0, k - side) : k], text[k : k + size], text[k + size : k + size + side]))
    return out


def shares(document: str, item: str, stretch: int) -> bool:
    """Whether both contain one string of ``stretch`` characters."""
    if len(document) < stretch or len(item) < stretch:
        return False
    short, long = sorted((document, item), key=len)
    have = {short[i : i + stretch] for i in range(len(short) - stretch + 1)}
    return any(long[i : i + stretch] in have for i in range(len(long) - stretch + 1))


def kind_of(lang: str | None) -> str:
    """The size class of an item."""
    return "tight" if (lang or "").strip().lower() in TIGHT else "wide"


def agree(a: tuple[str, str, str], b: tuple[str, str, str], stretch: int) -> bool:
    """Whether two places (left, shingle, right) agree over a whole stretch."""
    if a[1] != b[1]:
        return False
    common = lambda p, q: next((i for i, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q)))
    return common(a[0][::-1], b[0][::-1]) + len(a[1]) + common(a[2], b[2]) >= stretch


class Items:
    """Items held in memory, for the search of single texts; ``leaked_items`` does the same over tables."""

    def __init__(self, rows: list[tuple[int, str, str]]):
        self.of = {}
        for kind in CLASSES:
            mine = [(i, plain(t)) for i, lang, t in rows if kind_of(lang) == kind]
            self.of[kind] = defaultdict(set)
            for n, h, *place in anchored([t for _, t in mine], kind):
                self.of[kind][h].add((mine[n][0], *place))

    def found(self, texts: list[str]) -> list[tuple[int, int]]:
        """(text number, item) of all plain texts that share a stretch with an item."""
        out = set()
        for kind, have in self.of.items():
            known = np.array(sorted(have), dtype=np.int64).view(np.uint64)
            for n, h, *place in anchored(texts, kind, lambda kept, known=known: np.isin(kept, known)):
                out.update((n, i) for i, *other in have[h] if agree(place, other, CLASSES[kind][0]))
        return sorted(out)


_PLACE = "kind string, h long, left string, shingle string, right string"
#: Filters that this worker has already unpacked, by token.
_FILTERS: dict[str, np.ndarray] = {}


def _unpacked(token: str, words: list[tuple[int, int]]) -> np.ndarray:
    """The filter as an array of 64-bit words, unpacked once in a worker."""
    if token not in _FILTERS:
        _FILTERS.clear()
        bits = np.zeros(max(1, (1 << FILTER_BITS) >> 6), dtype=np.int64)
        if len(words):
            bits[[w for w, _ in words]] = [b for _, b in words]
        _FILTERS[token] = bits.view(np.uint64)
    return _FILTERS[token]


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and item_id of every document that shares an unbroken stretch with an item (60 letters and digits, 24 for items with lang zh).

    Null, empty and short texts on either side match nothing; a null doc_id or item_id is left out; repeated rows of an item or a document
    count once. Documents are read as they lie; only shingles that pass the items' filter are shuffled.
    """
    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()

    def item_places(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, kinds = part["item_id"].tolist(), [kind_of(x) for x in part["lang"]]
            for kind in CLASSES:
                at = [i for i, k in enumerate(kinds) if k == kind]
                rows = anchored([plain(part["text"].iloc[i]) for i in at], kind)
                yield pd.DataFrame([(ids[at[n]], kind, *place) for n, *place in rows], columns=["item_id", "kind", "h", "left", "shingle", "right"]).astype({"item_id": "int64", "h": "int64"})

    places = staged(known.mapInPandas(item_places, f"item_id long, {_PLACE}"), "items")
    bit = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    # at most 2**FILTER_BITS / 64 rows
    words = [(r.word, r.bits) for r in places.groupBy("kind", F.shiftright(bit, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(h & 63))) AS bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()]
    kinds = [r.kind for r in places.select("kind").distinct().collect()]
    sent, token = documents.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex

    def document_places(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, most = _unpacked(token, sent.value), np.uint64((1 << FILTER_BITS) - 1)
        passes = lambda kept: bits[(kept & most) >> np.uint64(6)] >> (kept & np.uint64(63)) & np.uint64(1) == 1
        for part in parts:
            ids, texts = part["doc_id"].tolist(), [plain(t) for t in part["text"]]
            rows = [(ids[n], kind, *place) for kind in kinds for n, *place in anchored(texts, kind, passes)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "h", "left", "shingle", "right"]).astype({"doc_id": "int64", "h": "int64"})

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    d, i = slim.mapInPandas(document_places, f"doc_id long, {_PLACE}"), places.select("item_id", "kind", "h", "shingle", F.col("left").alias("item_left"), F.col("right").alias("item_right"))
    j = d.join(i, ["kind", "h", "shingle"])
    # how many characters agree next to the shingle: as many as there are lengths at which the ends agree
    some = lambda a, b, cut: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), lambda n: (F.least(F.length(a), F.length(b)) >= n) & (cut(F.col(a), n) == cut(F.col(b), n))))
    around = some("left", "item_left", lambda c, n: F.substr(c, -n, n)) + some("right", "item_right", lambda c, n: F.substr(c, F.lit(1), n))
    need = F.coalesce(*[F.when(F.col("kind") == k, stretch - size) for k, (stretch, size) in CLASSES.items()])
    return j.where(around >= need).select("doc_id", "item_id").distinct()
