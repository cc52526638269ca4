"""What the operators of this subpackage share: tables, shared storage, Arrow batches, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from tempfile import mkdtemp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a slice handed to numpy at once; bounds the memory of a task, whatever the Arrow batch size is.
SLICE_ROWS = 512
#: Rows of an Arrow batch between the JVM and a Python worker.
BATCH_ROWS = 1024
#: Words that a Python worker keeps in a cache at most. A full cache takes no more words; results stay the same.
CACHE_WORDS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme: spark.checkpoint.dir, or (local runs only) one made here.

    A path without a scheme lies in Hadoop's default file system, for Arrow's writers as for Spark's.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(mkdtemp(prefix="brooklet-"))
        found = context.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return re.sub(r"^file:/(?!/)", "file:///", whole)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as a table in the shared folder and read again: its lineage is cut, and a lost executor loses none of it."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Deletes the files of a table made by stored(), once nothing reads it any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if root.split(":", 1)[-1].lstrip("/") in folder:
            path.getFileSystem(hadoop).delete(path, True)


class Tables:
    """Tables stored on the way to a result."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(stored(df, name))
        return self.made[-1]

    def release(self, *some: DataFrame) -> None:
        """Deletes the files of some, or of all."""
        for df in some or tuple(self.made):
            released(df)
            self.made = [x for x in self.made if x is not df]


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_arrow(rows: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with batches of BATCH_ROWS rows, which bounds what the JVM and a worker hold of long texts.

    The size is a setting of the session, read when a plan runs; a session that has its own, smaller or larger, keeps it.
    """
    conf = rows.sparkSession.conf
    if conf.get(ARROW_ROWS) == _SPARK_ARROW_ROWS:
        conf.set(ARROW_ROWS, BATCH_ROWS)
    return rows.mapInArrow(function, schema)


_SPARK_ARROW_ROWS = "10000"


def texts_as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null gives b''."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_clearing: dict[str, Callable[[], None]] = {}
_using = [""]


def caching(name: str, clear: Callable[[], None]) -> None:
    """Names a cache of this process, and what empties it."""
    _clearing[name] = clear


def use_cache(*names: str) -> None:
    """Empties every other cache: a Python worker lives on from one operator to the next, and holds the caches of one at a time."""
    if _using[0] != names:
        _using[0] = names
        for name, clear in _clearing.items():
            if name not in names:
                clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)  # glibc only: gives freed memory back to the system


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered for up to CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS and len(word) < 64:
            self[word] = value
        return value


WORDS = WordHashes()
caching("words", WORDS.clear)


def hashes(words: list[bytes]) -> np.ndarray:
    use_cache("words")
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes, in order; empty if there are fewer words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out + h[k : k + len(out)] + np.uint64(k + 1))
    return out


PACKED = "bucket int, records binary"


def packed(records: np.ndarray, slot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """PACKED rows of the records of each slot (a bucket's number): many small records cross a shuffle as few arrays."""
    slot = slot.astype(np.int64)
    order = np.argsort(slot, kind="stable")
    records, ends = records[order], np.searchsorted(slot[order], np.arange(buckets + 1))
    full = np.flatnonzero(ends[1:] > ends[:-1]).tolist()
    for at in range(0, len(full), 64):
        some = full[at : at + 64]
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array([records[ends[k] : ends[k + 1]].tobytes() for k in some], pa.binary())], ["bucket", "records"])


def unpacked(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[np.ndarray]:
    """All records of one bucket after another, of those whose PACKED rows came to this task."""
    got: dict[int, list[bytes]] = defaultdict(list)
    for batch in batches:
        for bucket, records in zip(batch.column("bucket").to_pylist(), batch.column("records").to_pylist(), strict=True):
            got[bucket].append(records)
    while got:
        yield np.frombuffer(b"".join(got.popitem()[1]), dtype)


def slot_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return mixed(keys.astype(np.int64).view(np.uint64)) % np.uint64(buckets)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


#: Rows of a few numbers that may be broadcast: 16 MB or so. Every broadcast of such rows is behind a count; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(rows: DataFrame, count: int) -> DataFrame:
    return F.broadcast(rows) if count <= BROADCAST_ROWS else rows


#: Bits of a Bloom filter at most (8 MB): a bound on what is sent to the driver and to each task, whatever the number of keys.
BLOOM_BITS = 1 << 26


def bloom_hash(key: str) -> Column:
    return F.xxhash64(key)


def bloom_filter(keys: DataFrame, key: str, count: int) -> np.ndarray:
    """A Bloom filter of the hashes of a column, with two bits a key in sixteen or more, up to BLOOM_BITS. Beyond that it lets more pass that it shouldn't."""
    bits = min(BLOOM_BITS, max(1 << 12, 1 << (16 * count).bit_length()))
    h = keys.select(bloom_hash(key).alias("h"))
    places = h.select(F.explode(F.array(F.pmod("h", F.lit(bits)), F.pmod(F.shiftright("h", 32), F.lit(bits)))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("m")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return out.view(np.uint64)


def in_bloom(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes (signed 64 bits) may be in the filter."""
    bits = np.int64(len(bloom) * 64)
    test = lambda p: (bloom[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) > 0
    return test(h % bits) & test((h >> np.int64(32)) % bits)
