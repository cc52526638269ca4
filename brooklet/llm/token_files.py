"""Token-id files: byte planes of fixed-size id blocks, each compressed with zstandard, and a chunk index.

Layout of a file: MAGIC; for each block of BLOCK_IDS ids its four byte planes (all lowest bytes, then the next, ...),
each a zstandard frame; the index, an Arrow stream in a zstandard frame with a row for each block (ids, offset and
length of each plane); the documents, likewise (doc_id, n_tokens); a trailer with the lengths of the two and MAGIC.
A reader takes the trailer, the index and then only the blocks that it wants.

``write_token_files`` deals documents out by ranges of doc_id, a hash of the text and the number of the partition that a row
was read in, so that files in order hold ids in ascending doc_id order and rows of one doc_id, null included, need not meet in one
task; a task holds one block and the (doc_id, n_tokens) of its own range. A file is written under another name and
moved, so that a repeated task only replaces equal bytes.

Defined results: null texts count as empty (the end id only); rows of equal doc_id follow each other in order of
a hash of their text; a null doc_id comes first; an empty table gives no file; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, scratch, slices, stored, texts_as_bytes
from .tokens import default_path, encoded_sparingly

MAGIC, BLOCK_IDS, PLANES, LEVEL = b"PLANES01", 1 << 16, 4, 3
END_ID = 2
TRAILER = struct.Struct("<QQ8s")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Any store that Arrow reaches by a URI; a plain path is a local one."""
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pafs.LocalFileSystem(), path)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.compress(sink.getvalue().to_pybytes(), LEVEL)


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_all()


class Writer:
    def __init__(self, out) -> None:
        self.out, self.at, self.index, self.docs = out, len(MAGIC), [], []
        #: Ids that fill no block yet.
        self.rest: list[bytes] = []
        self.waiting = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.rest.append(ids)
        self.waiting += len(ids)
        size = BLOCK_IDS * 4
        if self.waiting >= size:
            joined = b"".join(self.rest)
            whole = self.waiting // size * size
            for at in range(0, whole, size):
                self._block(joined[at : at + size])
            self.rest, self.waiting = [joined[whole:]], self.waiting - whole

    def _block(self, ids: bytes) -> None:
        planes = np.frombuffer(ids, np.uint8).reshape(-1, PLANES).T
        row = [len(ids) // 4]
        for plane in planes:
            data = zstandard.compress(np.ascontiguousarray(plane).tobytes(), LEVEL)
            self.out.write(data)
            row += [self.at, len(data)]
            self.at += len(data)
        self.index.append(row)

    def close(self) -> None:
        if self.waiting:
            self._block(b"".join(self.rest))
        names = ["ids", *(f"{what}{k}" for k in range(PLANES) for what in ("offset", "length"))]
        columns = list(zip(*self.index, strict=True)) if self.index else [[]] * len(names)
        index = _packed(pa.record_batch([pa.array(c, pa.int64()) for c in columns], names))
        docs = _packed(pa.record_batch([pa.array([d[k] for d in self.docs], pa.int64()) for k in (0, 1)], ["doc_id", "n_tokens"]))
        self.out.write(index + docs + TRAILER.pack(len(index), len(docs), MAGIC))


class Reader:
    """Random access to a file: documents(), and ids of any block."""

    def __init__(self, path: str) -> None:
        files, name = filesystem(path)
        self.file = files.open_input_file(name)
        size = self.file.size()
        index, docs, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"no token file: {path}")
        end = size - TRAILER.size
        self.index = _unpacked(self.file.read_at(index, end - docs - index)).to_pydict()
        self.table = _unpacked(self.file.read_at(docs, end - docs))

    def block(self, k: int) -> bytes:
        planes = [np.frombuffer(zstandard.decompress(self.file.read_at(self.index[f"length{p}"][k], self.index[f"offset{p}"][k])), np.uint8) for p in range(PLANES)]
        return np.stack(planes, 1).tobytes()

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """doc_id, n_tokens and ids, in the file's order, one block in memory besides the document."""
        rest, k = b"", 0
        for doc_id, n in zip(self.table["doc_id"].to_pylist(), self.table["n_tokens"].to_pylist(), strict=True):
            parts, have = [rest], len(rest)
            while have < 4 * n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            joined = b"".join(parts)
            yield doc_id, n, joined[: 4 * n]
            rest = joined[4 * n :]


MANIFEST = "part int, path string, n_docs long, n_tokens long"


def write_token_files(documents: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files into the folder; returns MANIFEST with a row for each, stored."""
    spark = documents.sparkSession
    vocabulary = vocabulary or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, top = filesystem(folder)
        path, temporary = f"{top}/part-{part:06d}.ids", f"{top}/.part-{part:06d}-{uuid.uuid4().hex}"
        end, writer, total, out = np.array([end_id], "<u4").tobytes(), None, 0, None
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            if writer is None:
                files.create_dir(top, recursive=True)
                out = files.open_output_stream(temporary)
                writer = Writer(out)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded_sparingly(texts_as_bytes(batch.column("text")), vocabulary), strict=True):
                writer.add(doc_id, ids + end)
                total += len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            files.move(temporary, path)
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([f"{folder}/part-{part:06d}.ids"]), pa.array([len(writer.docs)], pa.int64()), pa.array([total], pa.int64())], ["part", "path", "n_docs", "n_tokens"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("doc_id", "_hash", "_part")
    rows = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), F.spark_partition_id().alias("_part"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return stored(ordered.transform(in_arrow, write, MANIFEST), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files.

    The manifest has one row a file, so the driver can add up where each file starts.
    """
    files, at = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((row["path"], at))
        at += row["n_tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for doc_id, n, ids in Reader(path).documents():
                    rows.append((doc_id, start, n, zlib.crc32(ids)))
                    start += n
                yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # As an Arrow table: a list of tuples would go through Python workers of another kind, which stay beside those of mapInArrow.
    rows = pa.table({"path": [f[0] for f in files], "start": pa.array([f[1] for f in files], pa.int64())})
    listed = spark.createDataFrame(rows).repartitionByRange(len(files), "start")
    return listed.transform(in_arrow, read, schema)


def op2(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    spark = documents.sparkSession
    return read_token_files(spark, write_token_files(documents, scratch(spark, "token-files"), vocabulary))
