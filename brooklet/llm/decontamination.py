"""Benchmark decontamination by spaced-seed hashing.

Tokens are words cut at ASCII white space, normalised (NFKC, case-folded, stripped of all but letters and digits at both
ends); words with nothing left are skipped. Each fixed mask of MASKS looks at some places of a stretch of tokens and
ignores the others; its hash at every place of every benchmark item is joined with its hash at every place of every
document. Each hit gives a diagonal of a document and an item, and on it windows of WINDOW tokens (the whole item, if
it is shorter) are compared token by token: the document is contaminated if at least LEAST_SHARE of one agree. A window
may reach beyond the ends of the document, where nothing agrees, so cut excerpts count like those inside a text. Items
of seven tokens and more have masks of MORE_MASKS for their length besides, so that every way of replacing a quarter of a
window's tokens, or fewer, leaves a place where some mask hits (all patterns counted for windows of 7 to 20 tokens: recall
100 %); replacements cost nothing, insertions split a passage in two.

The index of the benchmark is broadcast in blocks of BLOCK_BYTES of item text at most. A larger benchmark takes one
pass over the documents for each block, one after another, each block's index given back before the next is sent; so no size of it
is too large, and the memory of a task is that of a slice and of one block. Hits are reduced to distinct diagonals HITS at a time.

Defined results: null, empty and white-space texts and items match nothing; items of fewer than seven tokens are only
found whole and unchanged; each row of documents with a matching item gives one row for each such item, repeated rows
included; items with equal text give a row each; an empty table of either kind gives no matches; extra columns, whatever
their names, are ignored (`contaminated`) or kept (`decontaminated`).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, broadcast_if_small, caching, in_arrow, slices, stored, texts_as_bytes, use_cache

#: Places that count are 1.
MASKS = ("1110111", "11010000111", "11011011", "1111000101", "10101111")
#: What they miss of a quarter of tokens replaced (so many of all patterns, by length of window) is found by these: 7 tokens
#: 6 of 7, 8: 24 of 28, 9: 17 of 36, 10: 5 of 45, 11: 1 of 55, 12: 23 of 220, 13: 3 of 286, 16: 18 of 1820, 17: 8 of 2380,
#: 18: 2 of 3060, 20: 10 of 15,504. Longer items have windows of 20.
MORE_MASKS = {
    7: ("11111", "1101011"), 8: ("1111", "110011", "110101"), 9: ("111101", "1100111", "110010011"), 10: ("110011101", "111110001"), 11: ("111111",),
    12: ("1100011011", "110101000011", "111001011", "11101011"), 13: ("111001011",), 16: ("1100000100111", "1111101"), 17: ("1110000100011",), 18: ("111111",), 20: ("111111",),
}
WINDOW, LEAST_SHARE = 20, 0.75
BLOCK_BYTES = 32 << 20
#: Pairs of equal hashes that are held at once (or those of one place, if they are more).
HITS = 1 << 20
_MIDDLE = 1 << 31
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")
_FACTORS = np.array([xxhash.xxh3_64_intdigest(str(k)) | 1 for k in range(64)], np.uint64)


class Tokens(dict):
    """Word -> hash of the normalised token, 0 if nothing is left; remembers up to CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode()
        token = _ENDS.sub("", unicodedata.normalize("NFKC", text).casefold())
        value = xxhash.xxh3_64_intdigest(token.encode()) or 1 if token else 0
        if len(self) < CACHE_WORDS and len(word) < 64:
            self[word] = value
        return value


TOKENS = Tokens()
caching("tokens", TOKENS.clear)


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, and the number of each one's word."""
    words = text.split()
    every = np.fromiter(map(TOKENS.__getitem__, words), np.uint64, len(words))
    at = np.flatnonzero(every)
    return every[at], at


def mask_hashes(flat: np.ndarray, mask: str) -> np.ndarray:
    n = len(flat) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(xxhash.xxh3_64_intdigest(mask)))
    for k, places in enumerate(p for p, x in enumerate(mask) if x == "1"):
        out += flat[places : places + n] * _FACTORS[k % 64]
    return out


def masks_of(length: int) -> tuple[str, ...]:
    """The masks that an item of this many tokens is looked for with."""
    if length < min(map(len, MASKS)):
        return ("1" * length,) if length else ()
    return (*MASKS, *MORE_MASKS.get(min(length, WINDOW), ()))


class Index:
    """Masks' hashes of some items (item_id, text)."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.ids = [i for i, _ in items]
        self.items = [tokens((t or "").encode())[0] for _, t in items]
        self.masks = [*MASKS, *sorted({m for t in self.items for m in masks_of(len(t))} - {*MASKS})]
        found, item, place = [], [], []
        for k, t in enumerate(self.items):
            for mask in self.masks:
                if mask in masks_of(len(t)):
                    h = mask_hashes(t, mask)
                    found.append(h)
                    item.append(np.full(len(h), k))
                    place.append(np.arange(len(h)))
        h, item, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found, item, place))
        h = h.astype(np.uint64)
        order = np.argsort(h, kind="stable")
        h, self.item, self.place = h[order], item[order].astype(np.int64), place[order].astype(np.int64)
        self.names, self.first = np.unique(h, return_index=True)
        self.count = np.diff(np.append(self.first, len(h)))
        bits = max(16, (16 * len(self.names)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.names >> self.shift).astype(np.int64)] = True

    def hits(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """item and diagonal (place in flat less place in the item) of the hits, each pair once."""
        found = [np.empty(0, np.int64)]
        for mask in self.masks:
            h = mask_hashes(flat, mask)
            at = np.flatnonzero(self.seen[(h >> self.shift).astype(np.int64)])
            k = np.searchsorted(self.names, h[at])
            good = k < len(self.names)
            at, k = at[good], k[good]
            good = self.names[k] == h[at]
            at, k = at[good], k[good]
            n = self.count[k]
            cuts = np.flatnonzero(np.diff((np.cumsum(n) - 1) // HITS)) + 1
            for at_, k_, n_ in zip(*(np.split(x, cuts) for x in (at, k, n)), strict=True):
                rows = np.repeat(self.first[k_] - np.cumsum(n_) + n_, n_) + np.arange(n_.sum())
                found.append(np.unique((self.item[rows] << 32) + (np.repeat(at_, n_) - self.place[rows] + _MIDDLE)))
        pairs = np.unique(np.concatenate(found))
        return pairs >> 32, (pairs & 0xFFFFFFFF) - _MIDDLE

    def matches(self, texts: list[bytes]) -> dict[int, list[tuple[int, float, int, int]]]:
        """For each matching text (by its number): item, best share of a window, and the words from and to of all windows that match."""
        use_cache("tokens")
        got = [tokens(t) for t in texts]
        flat = np.concatenate([g[0] for g in got]) if got else np.empty(0, np.uint64)
        ends = np.cumsum([len(g[0]) for g in got])
        if not len(self.names) or not len(flat):
            return {}
        item, diagonal = self.hits(flat)
        out: dict[int, dict[int, tuple[float, int, int]]] = defaultdict(dict)
        seen: set[tuple[int, int, int]] = set()
        for k, d in zip(item.tolist(), diagonal.tolist(), strict=True):
            own = self.items[k]
            # a diagonal may cross several texts; each is looked at by itself
            for text in range(int(np.searchsorted(ends, max(d, 0), "right")), len(ends)):
                begin = int(ends[text - 1]) if text else 0
                if begin >= d + len(own):
                    break
                if (k, d, text) in seen:
                    continue
                seen.add((k, d, text))
                low, high, width = max(d, begin), min(d + len(own), int(ends[text])), min(WINDOW, len(own))
                share = LEAST_SHARE if len(own) >= len(min(MASKS, key=len)) else 1.0
                if high - low < share * width:
                    continue
                first, last = max(low - d - width, 0), min(high - d + width, len(own))  # windows may reach beyond the text
                equal = np.zeros(last - first + 1, np.int64)
                equal[low - d - first + 1 : high - d - first + 1] = flat[low:high] == own[low - d : high - d]
                total = np.cumsum(equal)
                sums = total[width:] - total[:-width]
                windows = np.flatnonzero(sums >= share * width) + d + first
                if len(windows):
                    words = got[text][1]
                    span = int(words[max(windows[0], low) - begin]), int(words[min(windows[-1] + width, high) - begin - 1]) + 1
                    best, a, b = out[text].get(k, (0.0, span[0], span[1]))
                    out[text][k] = max(best, float(sums.max() / width)), min(a, span[0]), max(b, span[1])
        return {text: sorted((k, *v) for k, v in found.items()) for text, found in out.items()}


def blocks(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The items that have a text, and the number of blocks that they are cut into."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, 1 + total * 2 // block_bytes if total > block_bytes else 1


def index_of(items: DataFrame, block: int, number: int) -> Index:
    """Of one block, block_bytes at most."""
    rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == block) if number > 1 else items
    return Index(sorted(map(tuple, rows.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


MATCH = "doc_id long, item_id long, overlap double, from_word long, to_word long"


def contaminated(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """MATCH: a row for each document and each item it holds a passage of."""
    context = documents.sparkSession.sparkContext

    def found(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in slices(batches):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[text], own.ids[k], *rest) for text, items in own.matches(texts_as_bytes(batch.column("text"))).items() for k, *rest in items]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in MATCH.split(", ")])

        return documents.select("doc_id", "text").transform(in_arrow, run, MATCH)

    items, number = blocks(benchmark, block_bytes)
    if number == 1:
        return found(context.broadcast(index_of(items, 0, 1)))
    parts = []
    for block in range(number):
        shared = context.broadcast(index_of(items, block, number))
        parts.append(stored(found(shared), "contaminated"))
        shared.destroy()
    return reduce(DataFrame.union, parts)


def decontaminated(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a passage of the benchmark; all their columns as they were.

    With several blocks, each pass stores the digests of the texts that match; the documents then go by an anti-join of these.
    """
    context = documents.sparkSession.sparkContext

    def kept(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[list(shared.value.matches(texts_as_bytes(batch.column("text"))))] = False
                yield batch.filter(pa.array(keep))

        return rows.transform(in_arrow, run, rows.schema)

    def matching(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                texts = texts_as_bytes(batch.column("text"))
                yield pa.record_batch([pa.array([hashlib.md5(texts[k]).digest() for k in shared.value.matches(texts)], pa.binary())], ["_digest"])

        return documents.select("text").transform(in_arrow, run, "_digest binary")

    items, number = blocks(benchmark, block_bytes)
    if number == 1:
        return kept(documents, context.broadcast(index_of(items, 0, 1)))
    parts = []
    for block in range(number):
        shared = context.broadcast(index_of(items, block, number))
        parts.append(stored(matching(shared).distinct(), "matching"))
        shared.destroy()
    gone = stored(reduce(DataFrame.union, parts).distinct(), "matching")
    digest = F.unhex(F.md5(documents["text"].cast("binary")))
    return documents.join(broadcast_if_small(gone, gone.count()), digest == gone["_digest"], "left_anti").select(documents.columns)
