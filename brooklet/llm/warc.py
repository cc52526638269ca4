"""WARC archives: written with revisit records, and read in splits by boundary-chain verification.

Writing: one record a page, each a gzip member of its own (or plain). Of pages with equal payloads the one with the
smallest page_id is a `response`, the others are `revisit` records of it without a payload. A member carries its
length in the extra field SL, so a reader can step from record to record without inflating them. A file is
written under another name and moved, so a repeated task only replaces equal bytes.

Reading: files are cut into splits. The task of a split finds every place that looks like a record's start, true or
not, and the place its successor would have; it follows these inside the split and emits, for each candidate, where its
chain leaves the split. Pointer jumping from offset 0 of each file (the pointers double in reach each round) then marks
the places where the true chain enters each split; what only looks like a record, such as a magic number inside a
payload, lies on no chain from the start. A last pass reads the records of each split along the true chain. Archives of
other writers are read too: any version, gzip members without a length (these are inflated to find their end), records of any type.

Defined results: null and empty html is an empty payload; rows with equal page_id and payload are records of their own
of the same type; a null page_id never is the smallest, unless no other page has the payload; a record of other writers
without a digest gets that of its payload, one without a page number a null page_id, one whose payload isn't there and
isn't told a null payload_bytes; a file whose chain doesn't end at its end, or a record whose payload contradicts its SHA-1,
raises ValueError; an empty table gives no file and no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, in_arrow, scratch, slices, stored
from .token_files import filesystem

#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT_BYTES = 0
FILE_BYTES, SPLIT_BYTES, LEVEL = 64 << 20, 8 << 20, 3
#: Header bytes of a plain record that are read at once, and the longest header that it may have; a longer one breaks the chain.
HEADER_BYTES, MOST_HEADER_BYTES = 1 << 16, 16 << 20
#: Where repeated payloads are too many to be broadcast, each digest is dealt out so many ways.
SALTS = 32
DATE = "2000-01-01T00:00:00Z"
_HEAD = struct.Struct("<4sIBBH2sHII")
_HEAD_BYTES = _HEAD.size
_MEMBER = re.compile(rb"\x1f\x8b\x08[\x00-\x1f].{6}", re.DOTALL)
_SIZED = re.compile(rb"\x1f\x8b\x08\x04.{6}\x0c\x00SL\x08\x00", re.DOTALL)
_PLAIN = re.compile(rb"WARC/\d\.\d\r\n")
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*(?=\r\n)", re.IGNORECASE)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    name = lambda x: f"<urn:x-page:{'none' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member whose SL field has the lengths of the member and of its content."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = _HEAD.size + len(body) + 8
    return _HEAD.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"SL", 8, size, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Window:
    """Bytes of a file from a place on; reads on when more are asked for."""

    def __init__(self, path: str, begin: int, end: int, size: int) -> None:
        files, name = filesystem(path)
        self.file, self.begin, self.size, self.plain = files.open_input_file(name), begin, size, not path.endswith(".gz")
        self.data = self.file.read_at(end - begin, begin)

    def bytes(self, at: int, n: int) -> bytes:
        """n bytes from a place on, fewer at the end of the file."""
        low = at - self.begin
        return self.data[low : low + n] if low + n <= len(self.data) else self.file.read_at(min(n, self.size - at), at)

    def successor(self, at: int) -> int | None:
        """Where the record that starts here, if one does, has its successor."""
        following = self._plain_end(at) if self.plain else self._member_end(at)
        return following if following is not None and at < following <= self.size else None

    def _plain_end(self, at: int) -> int | None:
        n = HEADER_BYTES
        while True:
            head = self.bytes(at, n)
            stop = head.find(b"\r\n\r\n")
            if stop >= 0 or len(head) < n or n >= MOST_HEADER_BYTES:
                break
            n *= 4
        length = _LENGTH.search(head, 0, stop + 2) if stop >= 0 else None
        return at + stop + 8 + int(length[1]) if length else None

    def _member_end(self, at: int) -> int | None:
        head = self.bytes(at, _HEAD.size)
        if len(head) == _HEAD.size and _SIZED.match(head):
            return at + _HEAD.unpack(head)[7]
        inflate, place = zlib.decompressobj(31), at
        try:
            while not inflate.eof and place < self.size:
                data = self.bytes(place, HEADER_BYTES)
                place += len(data)
                while data and not inflate.eof:  # a bounded piece of the content at a time
                    inflate.decompress(data, 1 << 20)
                    data = inflate.unconsumed_tail
        except zlib.error:
            return None
        return place - len(inflate.unused_data) if inflate.eof else None


def http_length(http: bytes) -> int | None:
    found = _LENGTH.search(b"\r\n" + http + b"\r\n")
    return int(found[1]) if found else None


def candidates(window: Window, end: int) -> dict[int, int]:
    """Offset -> offset of the successor, of whatever looks like a record that starts in the window before end."""
    out = {}
    for m in (_PLAIN if window.plain else _MEMBER).finditer(window.data):
        at = window.begin + m.start()
        if at >= end:
            break
        following = window.successor(at)
        if following is not None:
            out[at] = following
    return out


def exits(found: dict[int, int], end: int) -> dict[int, int]:
    """Offset -> where its chain leaves the split; chains that break inside it are left out."""
    out: dict[int, int] = {}
    for at in sorted(found, reverse=True):
        following = found[at]
        leaves = following if following >= end else out.get(following)
        if leaves is not None:
            out[at] = leaves
    return out


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields.get("content-length", len(rest)))]


MANIFEST = "path string, bytes long, records long"


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT_BYTES, plain: bool = False, level: int = LEVEL, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html); returns MANIFEST, stored."""
    spark, payload = pages.sparkSession, F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("digest"))
    long_enough = F.octet_length(payload) >= least
    # only digests that occur twice are met again; the pages themselves are shuffled if these are too many to be broadcast, else not
    counted = rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = stored(counted.select("digest", "first"), "warc-repeated")
    if first.count() <= BROADCAST_ROWS // 4:  # 40 letters each
        joined = rows.join(F.broadcast(first), "digest", "left")
    else:
        salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    revisit = long_enough & F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    marked = joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, made = TaskContext.get().partitionId(), 0, []
        files, top = filesystem(folder)
        out, temporary, size, count = None, "", 0, 0

        def close() -> None:
            nonlocal out, number, size, count
            out.close()
            name = f"part-{part:06d}-{number:04d}.warc" + ("" if plain else ".gz")
            files.move(temporary, f"{top}/{name}")
            made.append((f"{folder}/{name}", size, count))
            out, number, size, count = None, number + 1, 0, 0

        for batch in slices(batches, 256):
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(page_id, url, (html or "").encode(), refers_to, refers_to is not None)
                data = data if plain else member(data, level)
                if out is None:
                    files.create_dir(top, recursive=True)
                    temporary = f"{top}/.{uuid.uuid4().hex}"
                    out = files.open_output_stream(temporary)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    close()
        if out is not None:
            close()
        yield pa.record_batch([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "bytes", "records"])

    return stored(marked.transform(in_arrow, write, MANIFEST), "warc-manifest")


def splits(manifest: DataFrame, split_bytes: int) -> DataFrame:
    """path, bytes, split, begin, end."""
    every = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / split_bytes).cast("int"))).alias("split"))
    begin = F.col("split").cast("long") * split_bytes
    parts = max(2, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return every.select("path", "bytes", "split", begin.alias("begin"), F.least("bytes", begin + split_bytes).alias("end")).repartition(parts, "path", "split")


def record_chain(parts: DataFrame, split_bytes: int) -> DataFrame:
    """path, offset, exit of the places where the true chain enters splits (0 of each file first), and where it leaves them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, _, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = exits(candidates(Window(path, begin, min(size, end + _HEAD_BYTES), size), end), end)
                yield pa.record_batch([pa.array([path] * len(found), pa.string()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["path", "offset", "exit"])

    links = stored(parts.transform(in_arrow, scan, "path string, offset long, exit long"), "warc-links")
    entries = links.select("path", F.col("exit").alias("offset")).distinct().union(links.select("path", F.lit(0).cast("long")).distinct()).distinct()
    jumps = stored(links.join(entries, ["path", "offset"], "left_semi"), "warc-jumps")
    reached = jumps.where("offset = 0").select("path", "offset")
    far = jumps
    # every jump leaves a split, so a chain has as many jumps as its file has splits at most
    longest = parts.agg(F.max("split")).first()[0]
    for _ in range((longest or 0).bit_length()):
        ahead = reached.join(far, ["path", "offset"]).select("path", F.col("exit").alias("offset"))
        reached = stored(reached.union(ahead).distinct(), "warc-reached")
        onward = far.select("path", F.col("offset").alias("exit"), F.col("exit").alias("further"))
        far = stored(far.join(onward, ["path", "exit"]).select("path", "offset", F.col("further").alias("exit")), "warc-jumps")
    return jumps.join(reached, ["path", "offset"], "left_semi")


RECORD = "path string, offset long, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string"


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """RECORD of every record on the true chains of the files in the manifest (path, bytes)."""
    if manifest.isEmpty():
        return manifest.sparkSession.createDataFrame([], RECORD)
    parts = splits(manifest, split_bytes)
    chain = stored(record_chain(parts, split_bytes), "warc-chain")
    broken = manifest.join(chain.groupBy("path").agg(F.max("exit").alias("last")), "path", "left").where("last is null or last <> bytes")
    if (bad := broken.select("path").first()) is not None:
        raise ValueError(f"the chain of records doesn't reach the end of {bad['path']}")

    def number(x: str | None) -> int | None:
        found = re.fullmatch(r"<urn:x-page:(-?\d+)>", x or "")
        return int(found[1]) if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, leaves in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "exit")), strict=True):
                window, rows = Window(path, at, leaves, leaves), []
                while at < leaves:
                    following = window.successor(at)
                    raw = window.bytes(at, following - at)
                    fields, block = parsed(raw if window.plain else zlib.decompress(raw, 31))
                    http, payload = b"", block
                    if fields.get("content-type", "").startswith("application/http"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                    kind, told = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").partition(":")[::2]
                    digest, size = digest_of(payload), len(payload)
                    if kind == "revisit":
                        digest, size = told[1] or None, http_length(http)
                    elif told[0] == "sha1" and len(told[1]) == 32 and told[1].upper() != digest and b"transfer-encoding" not in http.lower():
                        raise ValueError(f"payload and digest differ at {at} of {path}")
                    rows.append((path, at, kind, number(fields.get("warc-record-id")), number(fields.get("warc-refers-to")), size, digest))
                    at = following
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in RECORD.split(", ")])

    n = max(2, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return chain.repartition(n, "path", "offset").transform(in_arrow, read, RECORD)


def op6(pages: DataFrame) -> DataFrame:
    manifest = write_archives(pages, scratch(pages.sparkSession, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.element_at(F.split("path", "/"), -1).alias("file"), "offset")
