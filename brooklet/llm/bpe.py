"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut before white space where a rolling hash of the eight bytes before it has its lowest bits zero, so equal
passages in different documents give equal chunks. A chunk that a Python worker has met is not encoded again. Each
join of two chunks is then checked: the last word of the left one and the first of the right one are encoded
together; unless the result is the end of the left ids followed by the start of the right ids, the two chunks are
joined and encoded anew, and the next join is checked against that, until all agree. For pre-tokenizers that split at
white space, which all the public ones do, agreement there is agreement with encoding the whole text.

Defined results: null texts count as empty and have no ids; equal texts give equal rows; a text without white space
is one chunk; extra columns are ignored; a special token written in a text is that token, as in the library.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import caching, in_arrow, mixed, slices, texts_as_bytes, use_cache
from .tokens import default_path, described, encoded, loaded

#: One white space in CUT_ONE_IN ends a chunk.
CUT_ONE_IN = 64
#: Bytes of chunks that a Python worker remembers at most; then it starts afresh. Results do not depend on it.
MEMORY_BYTES = 10_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def chunks(text: bytes) -> list[bytes]:
    """The chunks of a UTF-8 text; joined they are the text."""
    data = np.frombuffer(text, np.uint8)
    space = _SPACE[data]
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    at = at[at >= 8]
    if len(at):
        h = np.zeros(len(at), np.uint64)
        for k in range(8):
            h = (h << np.uint64(8)) | data[at - 8 + k]
        at = at[mixed(h) % np.uint64(CUT_ONE_IN) == 0]
    ends = [0, *at.tolist(), len(text)]
    return [text[a:b] for a, b in zip(ends, ends[1:], strict=False) if a < b]


def first_word(chunk: bytes) -> bytes:
    """The first word of a chunk with the white space before it."""
    return chunk[: len(chunk) - len((chunk.split(None, 1) + [b"", b""])[1])].rstrip()


def last_word(chunk: bytes) -> bytes:
    return (chunk.rsplit(None, 1) or [b""])[-1]


class Entry(NamedTuple):
    """Ids of a chunk (little-endian, 32 bits each), the same in decimal, and the decoded text."""

    ids: bytes
    numbers: str
    decoded: str


class ChunkEncoder:
    """Encodes texts, remembering the entries of chunks."""

    def __init__(self, path: str) -> None:
        self.path, self.tokenizer = path, loaded(path)
        self.plain_decoding = described(path)[1]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [self.tokenizer.id_to_token(k) or "" for k in range(size)]
        self.numbers = [str(k) for k in range(size)]
        self.memory: dict[bytes, Entry] = {}
        self.held = 0

    def _entries(self, texts: list[bytes]) -> Iterator[Entry]:
        for data in encoded(texts, self.path):
            ids = memoryview(data).cast("I").tolist()
            yield Entry(data, " ".join([self.numbers[k] for k in ids]), " ".join([self.names[k] for k in ids]) if self.plain_decoding else "")

    @staticmethod
    def agrees(left: bytes, right: bytes, both: bytes) -> bool:
        """Whether both are an end of left and a start of right, whole ids each."""
        n = len(both)
        return any(left.endswith(both[:k]) and right.startswith(both[k:]) for k in range(0, min(n, len(left)) + 1, 4) if n - k <= len(right))

    def encode(self, texts: list[bytes]) -> list[tuple[list[Entry], int]]:
        """For each text its entries, whose ids one after another are the text's, and the number of repaired joins."""
        found = [chunks(t) for t in texts]
        if self.held > MEMORY_BYTES:
            self.memory.clear()
            self.held = 0
        new = list({c for cs in found for c in cs if c not in self.memory})
        self.memory.update(zip(new, self._entries(new), strict=True))
        self.held += sum(map(len, new))
        windows = list({last_word(a) + first_word(b) for cs in found for a, b in pairwise(cs)})
        whole = self.tokenizer.encode_batch_fast([w.decode() for w in windows], add_special_tokens=False)  # by the library alone
        joins = {w: array("I", e.ids).tobytes() for w, e in zip(windows, whole, strict=True)}
        out = []
        for cs in found:
            entries: list[Entry] = []
            repaired, left = 0, b""
            for chunk in cs:
                entry = self.memory[chunk]
                if left and not self.agrees(entries[-1].ids, entry.ids, joins[last_word(left) + first_word(chunk)]):
                    chunk = left + chunk
                    entry = next(self._entries([chunk]))
                    entries.pop()
                    repaired += 1
                entries.append(entry)
                left = chunk
            out.append((entries, repaired))
        return out

    def decoded(self, entries: list[Entry]) -> str:
        if self.plain_decoding:
            return " ".join([e.decoded for e in entries if e.ids])
        return self.tokenizer.decode(np.frombuffer(b"".join([e.ids for e in entries]), np.uint32).tolist(), skip_special_tokens=False)


_encoders: dict[str, ChunkEncoder] = {}
caching("chunks", _encoders.clear)


def encoder(path: str) -> ChunkEncoder:
    use_cache("word ids", "chunks")
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def encode_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string, repaired joins: the operator's own output."""
    vocabulary = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in slices(batches, 128):
            got = own.encode(texts_as_bytes(batch.column("text")))
            ids = pa.array([np.frombuffer(b"".join([e.ids for e in entries]), np.int32) for entries, _ in got], pa.list_(pa.int32()))
            yield pa.record_batch([batch.column("doc_id"), ids, pa.array([own.decoded(entries) for entries, _ in got], pa.string()), pa.array([r for _, r in got], pa.int64())], ["doc_id", "ids", "decoded", "repaired_joins"])

    return documents.select("doc_id", "text").transform(in_arrow, run, "doc_id long, ids array<int>, decoded string, repaired_joins long")


def op4(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, repaired_joins; ids and decoded texts are digested where they are made."""
    vocabulary = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in slices(batches, 128):
            rows = []
            for entries, repaired in own.encode(texts_as_bytes(batch.column("text"))):
                ids = " ".join([e.numbers for e in entries if e.ids])
                rows.append((sum(len(e.ids) for e in entries) // 4, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(own.decoded(entries).encode()).hexdigest(), repaired))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "repaired_joins"])

    return documents.select("doc_id", "text").transform(in_arrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, repaired_joins long")
