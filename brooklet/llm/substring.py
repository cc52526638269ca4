"""Substring dedup: removes words covered by a window of W consecutive words that also starts earlier in the corpus.

Method: suffix automata of reference shards, through which the rest is streamed for matching statistics. Automata of
the whole corpus could be broadcast to no machine, so references and what is held against them are routed to each other:

1. Anchors. Of the ANCHOR_WORDS-grams in a window the one with the least hash is its anchor, so equal windows have
   equal anchors (which of several equal grams is taken depends on their places, so that few stand for many windows).
   Anchors are counted through packed arrays, sixteen bytes each; those that occur once in the corpus need no look.
2. Pieces. The windows of one document that share a repeated anchor are a piece: W words and a few more. Pieces
   of an anchor go to one shard and are read there in the order of (doc_id, start). Each is streamed through the suffix
   automaton of the pieces before it; where the matching statistic is W or more, the window ending there is covered.
   A piece with a window that isn't known is then inserted, even if known windows around it cover all its words; in a
   piece that may repeat itself, insertion gives the statistic. A piece equal to an earlier one is covered throughout.
3. An anchor with more than HOT_ANCHOR occurrences (a line that a large part of the corpus shares, or a text with
   thousands of copies) is never gathered in one task: its windows are told apart by hash; each task finds the first of
   equal windows in what it has read, and only these meet. The result is the same. An anchor that one task meets
   OFTEN times in a million is taken for such a one from the start, so its places are not gathered to be counted either.

Words in pieces are compared by 48-bit hashes, 20 of which in a row must agree: two windows that differ in one word are
taken for equal with a probability of 2^-48. Windows of hot anchors go by 64-bit hashes.

Defined results: null, empty and white-space texts have no words; texts shorter than W words lose none; rows of equal
doc_id are ordered by the start of the window and then by a hash of the text (rows of equal doc_id and text are told
apart by nothing, and keep or lose the same words); a null doc_id counts as the least integer; extra columns are ignored
(`deduplicated`) or kept (`replaced`), whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, hashes, in_arrow, mixed, packed, runs, shingle_hashes, slices, slot_of, texts_as_bytes, unpacked

WINDOW, ANCHOR_WORDS = 20, 6
#: Occurrences of an anchor whose pieces one task gathers at most; bounds its automaton to some 10 MB.
HOT_ANCHOR = 1024
#: Anchors that a task holds before it passes them on, and how often one of these must be among them to be hot for that alone.
HELD_ANCHORS, OFTEN = 1_000_000, 64
#: Bytes of a word's hash in a piece.
WORD_BYTES = 6
_HOT = np.uint32(1 << 31)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class SuffixAutomaton:
    """Of several sequences of integers; sequences are added one by one."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[int]) -> list[int]:
        """Adds a sequence; for each place the length of the longest stretch ending there that was added before, or ends earlier in it."""
        following, link, length, last, out = self.next, self.link, self.length, 0, []
        for symbol in sequence:
            p = last
            if symbol in following[p]:
                q = following[p][symbol]
                last = q if length[q] == length[p] + 1 else self._cloned(p, q, symbol)
                out.append(length[last])
                continue
            last = len(following)
            following.append({})
            link.append(0)
            length.append(length[p] + 1)
            while p >= 0 and symbol not in following[p]:
                following[p][symbol] = last
                p = link[p]
            if p >= 0:
                q = following[p][symbol]
                link[last] = q if length[q] == length[p] + 1 else self._cloned(p, q, symbol)
            out.append(length[link[last]])
        return out

    def _cloned(self, p: int, q: int, symbol: int) -> int:
        following, link = self.next, self.link
        clone = len(following)
        following.append(dict(following[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        link[q] = clone
        while p >= 0 and following[p].get(symbol) == q:
            following[p][symbol] = clone
            p = link[p]
        return clone

    def statistics(self, sequence: list[int]) -> list[int]:
        """For each place the length of the longest stretch ending there that occurs in a sequence added before."""
        following, link, length = self.next, self.link, self.length
        state, matched, out = 0, 0, []
        for symbol in sequence:
            while state and symbol not in following[state]:
                state = link[state]
                matched = length[state]
            to = following[state].get(symbol)
            if to is not None:
                state = to
                matched += 1
            out.append(matched)
        return out


class Shard:
    """Pieces of one anchor, given in ascending (key, start, copy)."""

    def __init__(self, window: int) -> None:
        self.window, self.whole, self.waiting, self.automaton = window, set(), [], None

    def take(self, piece: bytes) -> list[tuple[int, int]]:
        """Takes a piece in; spans of its words that windows before it, or starting earlier in it, cover."""
        size = len(piece) // WORD_BYTES
        if piece in self.whole:
            return [(0, size)]
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :WORD_BYTES] = np.frombuffer(piece, np.uint8).reshape(-1, WORD_BYTES)
        symbols = wide.view("<u8").ravel().tolist()
        simple = len(set(symbols)) > size - self.window  # then no window occurs twice in the piece
        self.whole.add(piece)
        if simple and len(self.whole) == 1:
            self.waiting.append(symbols)
            return []
        if self.automaton is None:
            self.automaton = SuffixAutomaton()
        for other in self.waiting:
            self.automaton.add(other)
        self.waiting.clear()
        statistics = self.automaton.statistics(symbols)
        spans = self._spans(statistics)
        if min(statistics[self.window - 1 :]) >= self.window:  # every window is known; words may all be covered without that
            return spans
        if simple:
            self.waiting.append(symbols)
            return spans
        return self._spans(self.automaton.add(symbols))

    def _spans(self, statistics: list[int]) -> list[tuple[int, int]]:
        spans: list[tuple[int, int]] = []
        for at, n in enumerate(statistics):
            if n >= self.window:
                first = at + 1 - self.window
                if spans and first <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], at + 1)
                else:
                    spans.append((first, at + 1))
        return spans


class Anchors:
    """The anchors of some texts' windows. starts: where each text begins in the flat array of word hashes; for each run of
    windows with one anchor: name, text, place (in the flat array), first and last window, and whether an equal gram is in one of them too."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        words = [t.split() for t in texts]
        self.starts = np.cumsum([0, *map(len, words)])
        self.flat = hashes([w for ws in words for w in ws])
        self.name, self.text = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.place = self.first = self.last = self.text
        self.twice = np.empty(0, bool)
        grams = shingle_hashes(self.flat, ANCHOR_WORDS)
        width = window - ANCHOR_WORDS + 1
        if len(grams) < width:
            return
        place = np.arange(len(grams))
        own = place - self.starts[np.searchsorted(self.starts, place, "right") - 1]
        low = (grams & ~_TIE) | (mixed(own.astype(np.uint64)) & _TIE)  # equal grams: by a hash of the place, so that runs stay long
        reach, twice = 1, np.zeros(len(grams), bool)
        while reach < width:  # the least of `reach` grams from each place on, doubled until it is of `width`
            step = min(reach, width - reach)
            a, b = low[: len(low) - step], low[step:]
            take = b < a
            twice = np.where(take, twice[step:], twice[: len(twice) - step]) | ((a >> _TIE_BITS == b >> _TIE_BITS) & (place[: len(place) - step] != place[step:]))
            place = np.where(take, place[step:], place[: len(place) - step])
            low = np.where(take, b, a)
            reach += step
        first = np.arange(len(place))
        text = np.searchsorted(self.starts, first, "right") - 1
        good = first + window <= self.starts[text + 1]
        first, place, text, low, twice = first[good], place[good], text[good], low[good], twice[good]
        at = runs(place, text)
        self.name, self.text, self.place, self.first = mixed(low[at] >> _TIE_BITS), text[at], place[at], first[at]
        self.last = first[np.append(at[1:], len(first)) - 1] if len(at) else first
        self.twice = np.logical_or.reduceat(twice, at) if len(at) else twice


_TIE_BITS = np.uint64(16)
_TIE = np.uint64((1 << 16) - 1)
#: What crosses the shuffles: an anchor; a repeated place of a document; a window of a hot anchor; a covered span.
ANCHOR = np.dtype([("name", "<u4"), ("key", "<i8"), ("place", "<u4")])
PLACE = np.dtype([("key", "<i8"), ("place", "<u4")])
SEEN = np.dtype([("window", "<u8"), ("key", "<i8"), ("copy", "<i4"), ("start", "<u4")])
SPAN = np.dtype([("key", "<i8"), ("copy", "<i4"), ("from", "<u4"), ("to", "<u4")])


def record(dtype: np.dtype, *columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns[0]), dtype)
    for name, c in zip(dtype.names, columns, strict=True):
        out[name] = c
    return out


def joined(seen: np.ndarray, window: int) -> np.ndarray:
    """SPAN records of the words that SEEN windows cover; windows that start one word after another are one span."""
    if not len(seen):
        return np.empty(0, SPAN)
    seen = seen[np.lexsort((seen["start"], seen["copy"], seen["key"]))]
    start = seen["start"].astype(np.int64)
    first = runs(seen["key"], seen["copy"], start - np.arange(len(seen)))
    last = np.append(first[1:], len(seen)) - 1
    return record(SPAN, seen["key"][first], seen["copy"][first], start[first], start[last] + window)


def copy_of(text: bytes) -> int:
    """Tells texts of equal doc_id apart."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "big", signed=True)


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, key (doc_id, or the least integer for null) and text."""
    return documents.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "text")


def _by_key(dtype: np.dtype, column: str):
    """Of PACKED records with a key, one row a key: all its records without the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [n for n in dtype.names if n != "key"]
        for records in unpacked(batches, dtype):
            records = records[np.argsort(records["key"], kind="stable")]
            first = runs(records["key"])
            own = record(np.dtype([(n, dtype[n]) for n in rest]), *(records[n] for n in rest))
            yield pa.record_batch([pa.array(records["key"][first]), pa.array([x.tobytes() for x in np.split(own, first[1:])], pa.binary())], ["key", column])

    return run


def repeated_anchors(documents: DataFrame, window: int, hot: int) -> DataFrame:
    """key, places: where in each document repeated anchors are (words from its start; the highest bit is set for a hot anchor)."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, often = parts * 4, min(hot, OFTEN)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            name, key, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(name, kind="stable")
            name, key, place = name[order], key[order], place[order]
            first = runs(name)
            sizes = np.diff(np.append(first, len(name)))
            frequent = np.repeat(sizes > often, sizes)
            if frequent.any():  # known to be hot: places pass by under a name of their own, a mark of each anchor goes to its bucket
                direct = record(ANCHOR, np.zeros(frequent.sum()), key[frequent], place[frequent] | _HOT)
                yield from packed(direct, np.uint64(buckets) + slot_of(direct["key"], buckets), 2 * buckets)
                marks = first[sizes > often]
                name, key, place = np.concatenate((name[~frequent], name[marks])), np.concatenate((key[~frequent], key[marks])), np.concatenate((place[~frequent], np.full(len(marks), _HOT)))
            slot = ((name >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            yield from packed(record(ANCHOR, name & np.uint64(0xFFFFFFFF), key, place), slot, buckets)

        for batch in slices(batches):
            a = Anchors(texts_as_bytes(batch.column("text")), window)
            times = 1 + a.twice  # an anchor that is in its windows more than once counts as repeated
            held.append(tuple(np.repeat(x, times) for x in (a.name, batch.column("key").to_numpy()[a.text], (a.place - a.starts[a.text]).astype(np.uint32))))
            count += len(a.text)
            if count > HELD_ANCHORS:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def count(records: np.ndarray) -> np.ndarray:
            records = records[np.argsort(records["name"], kind="stable")]
            first = runs(records["name"])
            sizes = np.diff(np.append(first, len(records)))
            marked = np.maximum.reduceat(records["place"], first) >= _HOT
            keep = np.repeat((sizes > 1) | marked, sizes) & (records["place"] < _HOT)
            frequent = np.repeat((sizes > hot) | marked, sizes)
            return record(PLACE, records["key"], records["place"] | np.where(frequent, _HOT, np.uint32(0)))[keep]

        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                direct = np.array(batch.column("bucket").to_numpy() >= buckets)
                for x in batch.filter(pa.array(direct)).column("records").to_pylist():
                    r = np.frombuffer(x, ANCHOR)
                    found.append(record(PLACE, r["key"], r["place"]))
                yield batch.filter(pa.array(~direct))

        for records in unpacked(passed(batches), ANCHOR):
            found.append(count(records))
        if found:
            every = np.concatenate(found)
            yield from packed(every, slot_of(every["key"], buckets), buckets)

    met = keyed(documents).drop("doc_id").transform(in_arrow, deal, PACKED).repartition(parts, "bucket").mapInArrow(meet, PACKED)
    return met.repartition(parts, "bucket").transform(in_arrow, _by_key(PLACE, "places"), "key long, places binary")


#: kind 0: a piece's words (WORD_BYTES each); 1: SEEN records of a bucket to be compared; 2: SPAN records known to be covered.
PIECE = "kind int, anchor long, key long, start int, copy int, words binary"


def pieces(documents: DataFrame, repeated: DataFrame, window: int, buckets: int) -> DataFrame:
    """PIECE rows of the windows that repeated anchors stand for."""
    names = [x.split()[0] for x in PIECE.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def blocks(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zero = np.zeros(b.num_rows, np.int64)
            yield pa.record_batch([pa.array(c, t) for c, t in zip((zero + kind, b.column("bucket").to_numpy(), zero, zero, zero, b.column("records").to_pylist()), kinds, strict=True)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            seen = np.concatenate(held)
            seen = seen[np.lexsort((seen["copy"], seen["start"], seen["key"], seen["window"]))]
            first = runs(seen["window"])
            least = np.repeat(seen[first], np.diff(np.append(first, len(seen))))
            later = (seen["key"] != least["key"]) | (seen["start"] != least["start"]) | (seen["copy"] != least["copy"])
            covered = joined(seen[later], window)
            yield from blocks(packed(covered, slot_of(covered["key"], buckets), buckets), 2)
            yield from blocks(packed(seen[~later], slot_of(seen["window"][~later].view(np.int64), buckets), buckets), 1)

        for batch in slices(batches, 256):
            texts = texts_as_bytes(batch.column("text"))
            a = Anchors(texts, window)
            marks = [np.frombuffer(p, np.uint32) for p in batch.column("places").to_pylist()]
            at = np.concatenate([np.minimum((m & ~_HOT).astype(np.int64) + s, len(a.flat)) for m, s in zip(marks, a.starts, strict=False)])
            state = np.zeros(len(a.flat) + 1, np.int8)
            state[at] = 1
            state[at[np.concatenate(marks) >= _HOT]] = 2
            keys, copies = batch.column("key").to_numpy(), np.array([copy_of(t) for t in texts], np.int32)
            small = a.flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
            cold = np.flatnonzero(state[a.place] == 1)
            text, first, last = a.text[cold], a.first[cold], a.last[cold]
            words = [small[x : y + window].tobytes() for x, y in zip(first.tolist(), last.tolist(), strict=True)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip((np.zeros(len(cold)), a.name[cold].view(np.int64), keys[text], first - a.starts[text], copies[text], words), kinds, strict=True)], names)
            frequent = np.flatnonzero(state[a.place] == 2)
            if len(frequent):
                sizes = a.last[frequent] - a.first[frequent] + 1
                start = np.repeat(a.first[frequent] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                text = np.repeat(a.text[frequent], sizes)
                total = np.zeros(len(start), np.uint64)
                for k in range(window):
                    total = mixed(total + a.flat[start + k] + np.uint64(k + 1))
                held.append(record(SEEN, total, keys[text], copies[text], start - a.starts[text]))
                if sum(map(len, held)) > HELD_ANCHORS:
                    yield from flush()
                    held.clear()
        if held:
            yield from flush()

    return keyed(documents).join(repeated, "key").transform(in_arrow, cut, PIECE)  # the same rows by key as those that the result is joined with: one shuffle


def covered_spans(found: DataFrame, window: int, parts: int, buckets: int) -> DataFrame:
    """key, spans: SPAN records without the key, of each document that loses words."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, current, before = None, None, None
        to_compare: dict[int, list[bytes]] = defaultdict(list)
        held: list[np.ndarray] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held)
            yield from packed(every, slot_of(every["key"], buckets), buckets)
            held.clear()

        for batch in slices(batches, 8192):
            out = []
            for kind, anchor, key, start, copy, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 1:
                    to_compare[anchor].append(piece)
                    continue
                if kind == 2:
                    held.append(np.frombuffer(piece, SPAN))
                    continue
                if anchor != current:
                    shard, current, before = Shard(window), anchor, None
                if before is None or before[0] != (key, start, copy):  # else a row that is there twice
                    before = (key, start, copy), shard.take(piece)
                out += [(key, copy, start + a, start + b) for a, b in before[1]]
            if out:
                held.append(record(SPAN, *np.array(out, np.int64).T))
            count = sum(map(len, held))
            if count > HELD_ANCHORS:
                yield from flush()
        while to_compare:
            seen = np.frombuffer(b"".join(to_compare.popitem()[1]), SEEN)
            seen = seen[np.lexsort((seen["copy"], seen["start"], seen["key"], seen["window"]))]
            first = runs(seen["window"])
            least = np.repeat(seen[first], np.diff(np.append(first, len(seen))))
            held.append(joined(seen[(seen["key"] != least["key"]) | (seen["start"] != least["start"]) | (seen["copy"] != least["copy"])], window))
        if held:
            yield from flush()

    ordered = found.repartition(parts, "anchor").sortWithinPartitions("kind", "anchor", "key", "start", "copy")
    return ordered.transform(in_arrow, stream, PACKED).repartition(parts, "bucket").mapInArrow(_by_key(SPAN, "spans"), "key long, spans binary")


def _kept(text: bytes, mask: np.ndarray) -> bytes:
    """The text without the words that the mask has, each with the white space before it."""
    out, at = [], 0
    for gone, word in zip(mask.tolist(), _WORD.finditer(text), strict=True):
        if not gone:
            out.append(text[at : word.end()])
        at = word.end()
    return b"".join([*out, text[at:]]).lstrip() if out else b""


def _spans_of(documents: DataFrame, window: int, hot: int) -> DataFrame:
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return covered_spans(pieces(documents, repeated_anchors(documents, window, hot), window, parts * 4), window, parts, parts * 4)


def _gone(text: bytes, words: list[bytes], found: bytes | None) -> np.ndarray | None:
    """Which words the spans cover; None if none."""
    if not found:
        return None
    pairs = np.frombuffer(found, [(n, SPAN[n]) for n in SPAN.names if n != "key"])
    pairs = pairs[pairs["copy"] == copy_of(text)]
    if not len(pairs):
        return None
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, pairs["from"], 1)
    np.add.at(step, pairs["to"], -1)
    return np.cumsum(step[:-1]) > 0


def deduplicated(documents: DataFrame, window: int = WINDOW, hot: int = HOT_ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of the kept words joined by a blank."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = []
            for text, found in zip(texts_as_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                gone = _gone(text, words, found)
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return keyed(documents).join(_spans_of(documents, window, hot), "key", "left").transform(in_arrow, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def replaced(documents: DataFrame, window: int = WINDOW, hot: int = HOT_ANCHOR) -> DataFrame:
    """The documents (doc_id, text, n_chars and any more columns) with what is left of their texts, spacing and all.

    A text that loses all its words goes with its row; one that had none, or is null, stays.
    """
    spans = _spans_of(documents, window, hot).withColumnRenamed("key", "_key").withColumnRenamed("spans", "_spans")
    both = documents.join(spans, F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("_key"), "left").drop("_key")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts, keep, changed = batch.column("text").to_pylist(), np.ones(batch.num_rows, bool), False
            for k, found in enumerate(batch.column("_spans").to_pylist()):
                if found:
                    data = texts[k].encode()
                    gone = _gone(data, data.split(), found)
                    if gone is not None:
                        texts[k], keep[k], changed = _kept(data, gone).decode(), not gone.all(), True
            out = batch.select(documents_columns)
            if changed:
                out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
                if "n_chars" in documents_columns:
                    out = out.set_column(out.schema.get_field_index("n_chars"), "n_chars", pa.array([None if t is None else len(t) for t in texts], pa.int64()))
            yield out.filter(pa.array(keep))

    documents_columns = documents.columns
    return both.transform(in_arrow, finish, documents.schema)


def op8(documents: DataFrame) -> DataFrame:
    return deduplicated(documents)
