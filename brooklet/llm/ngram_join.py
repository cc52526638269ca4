"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, as connected components.

1. Each document gives the sorted 64-bit hashes of its distinct shingles; a hash of that set is its node, so that exact
   copies are one node from the start, however many there are.
2. Tiles. Sizes are cut into bands; the level of a band holds the sets of the band and those just above it that a set of
   the band may link with. Linked sets of a level differ in H shingles at most, so if the space of hashes is cut into
   k > H cells, at least k - H cells hold the same shingles in both. Each set gives a signature for each cell that isn't
   empty. Two linked sets share one, unless all the equal cells are empty in both, so that both have k - H empty cells or
   more. Sets with so many give the signatures of a second, independent cut besides, those again with too many in that of
   a third, and so on for TURNS cuts, after which a set would give a common signature (no set is known to get there: each
   cut leaves a fiftieth of the sets or less to the next). k is such that this costs least. Sets that share a signature meet in a tile; no
   linked pair is missed, and no tile gathers sets for having empty cells only. Signatures go through the shuffle as packed
   arrays, twelve bytes each.
3. Each tile is a star at first: its leader (the member that meets most others over all tiles, so the origin of near
   copies rather than one of them) is held against the members of other components. A hashed bitmap of each set bounds
   their overlap from above, and what remains is intersected exactly as sorted arrays. Components of the links follow
   (large star, small star).
4. Tiles still in several components are compared in full: cut into blocks of TILE_SETS sets, each pair of blocks one task's matter;
   bitmaps bound the overlap of pairs from different components, and exact intersections decide. So copies and near
   copies cost a few comparisons each, never all pairs of a group.

Shingles are compared by 64-bit hashes, nodes too: two sets of different shingles count as equal with a probability of
about the square of their number over 2^65.

Defined results: null texts, empty texts and texts of white space have no shingle, no link, and themselves as
component; rows with equal doc_id are rows of their own; rows without doc_id link and bridge like any other, but give no
component its name: a component of such rows only has a null name; extra columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import BROADCAST_ROWS, Tables, bloom_filter, bloom_hash, broadcast_if_small, hashes, in_arrow, in_bloom, mixed, shingle_hashes, slices, stored, texts_as_bytes

#: Growth of the size bands; any value of at least 1 / threshold gives the same links.
BAND_GROWTH = 1.5
#: Sets of a block in step 4, and signatures that a task holds before it passes them on.
TILE_SETS, HELD_SIGNATURES = 1024, 1_000_000
#: Independent cuts into cells at most.
TURNS = 24
_LOW = np.uint64(0xFFFFFFFF)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: ASCII letters in lower case, words cut at ASCII white space."""
    words = [t.lower().split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = hashes([x for w in words for x in w])
    every = shingle_hashes(flat, n)
    out, at = [], 0
    for size in lengths.tolist():
        if size >= n:
            out.append(np.unique(every[at : at + size - n + 1]))
        elif size:
            out.append(mixed(shingle_hashes(flat[at : at + size], size) + np.uint64(size)))
        else:
            out.append(np.empty(0, np.uint64))
        at += size
    return out


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    total = mixed(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


class Levels:
    """Bands of set sizes, and the cells of each level, for the threshold num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        if not (0 < num <= den and BAND_GROWTH * num >= den):
            raise ValueError("the threshold must be at least 1 / BAND_GROWTH and at most 1")
        self.edges = [1, 8]

    def edge(self, band: int) -> int:
        while len(self.edges) <= band:
            self.edges.append(int(self.edges[-1] * BAND_GROWTH))
        return self.edges[band]

    def band(self, size: int) -> int:
        k = 0
        while self.edge(k + 1) <= size:
            k += 1
        return k

    def differing(self, a: int, b: int) -> int:
        """The largest symmetric difference of linked sets of a and b shingles."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    @lru_cache(maxsize=None)  # noqa: B019
    def cells(self, level: int) -> tuple[int, int]:
        """Cells and the largest difference H of linked sets of a level; the smaller one is in the level's band."""
        a = self.edge(level + 1) - 1
        most = self.differing(a, a * self.den // self.num)
        n = max(self.edge(level), 4)  # the smallest sets have the most empty cells

        def signatures_of(k: int) -> float:
            """Expected of a set of n, with those of further cuts: n shingles leave k * share cells empty."""
            share = (1 - 1 / k) ** n
            spread = k * share + k * (k - 1) * (1 - 2 / k) ** n - (k * share) ** 2
            again = erfc((k - k * share - most - 0.5) / sqrt(2 * max(spread, 1e-9))) / 2
            return (k - k * share) / max(1 - again, 1e-6)

        few = max(2, most + 1)
        return min({*range(few, few + 40), *(few + few * x // 50 for x in range(600))}, key=lambda k: (signatures_of(k), k)), most

    @lru_cache(maxsize=100_000)  # noqa: B019
    def of(self, size: int) -> tuple[int, ...]:
        """The levels in which a set of this size looks for others."""
        if not size or not self.differing(size, size + 1):  # only equal sets link, and they are one node already
            return ()
        band = self.band(size)
        below = band and -(-size * self.num // self.den) < self.edge(band)
        return (band - 1, band) if below else (band,)


def signatures(shingles: np.ndarray, levels: Levels) -> np.ndarray:
    out = []
    for level in levels.of(len(shingles)):
        k, most = levels.cells(level)
        for turn in range(TURNS):
            name = np.uint64((level + 1 << 40) + (turn << 32))
            own = mixed(shingles + name) if turn else shingles
            cell = ((own >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            if turn:
                order = np.argsort(cell, kind="stable")
                own, cell = own[order], cell[order]
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            out.append(mixed(np.add.reduceat(mixed(own), first) + mixed(cell[first] + name)))
            if len(first) > most:
                break
        else:
            out.append(mixed(np.array([(level + 1 << 40) - 1], np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_nodes(documents: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, node (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(texts_as_bytes(batch.column("text")), n)
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), nodes], ["doc_id", "n_shingles", "node"])

    return documents.select("doc_id", "text").transform(in_arrow, run, "doc_id long, n_shingles long, node long")


def tiles(documents: DataFrame, n: int, levels: Levels) -> DataFrame:
    """tile, size, node: members of the tiles with at least two nodes; tiles of equal members met in a task are one."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * 4

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, count = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            sig, node = np.concatenate(held), np.concatenate(nodes)
            bucket = ((sig >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            sig, node, bucket = (sig[order] & _LOW).astype(np.uint32), node[order], bucket[order]
            ends = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            full = [k for k in range(buckets) if ends[k] < ends[k + 1]]
            for at in range(0, len(full), 64):
                some = full[at : at + 64]
                yield pa.record_batch([pa.array(some, pa.int32()), *(pa.array([x[ends[k] : ends[k + 1]].tobytes() for k in some], pa.binary()) for x in (sig, node))], ["bucket", "sigs", "nodes"])

        for batch in slices(batches):
            seen = {}
            for s in shingle_sets(texts_as_bytes(batch.column("text")), n):
                if levels.of(len(s)) and (name := node_of(s)) not in seen:
                    seen[name] = s
            for name, s in seen.items():
                sig = signatures(s, levels)
                held.append(sig)
                nodes.append(np.full(len(sig), name, np.int64))
                count += len(sig)
            if count > HELD_SIGNATURES:
                yield from flush()
                held, nodes, count = [], [], 0
        if count:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = defaultdict(list)
        for batch in batches:
            for bucket, sig, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got[bucket].append((sig, node))
        known: set[int] = set()
        while got:
            _, blobs = got.popitem()
            sig = np.concatenate([np.frombuffer(x, np.uint32) for x, _ in blobs])
            node = np.concatenate([np.frombuffer(x, np.int64) for _, x in blobs])
            order = np.argsort(sig, kind="stable")
            sig, node = sig[order], node[order]
            several = np.zeros(len(sig), bool)
            equal = sig[1:] == sig[:-1]
            several[1:] |= equal
            several[:-1] |= equal
            sig, node = sig[several], node[several]
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            if len(sig):
                fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
                sig, node = sig[fresh], node[fresh]
                first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
                sizes = np.diff(np.append(first, len(sig)))
                names = mixed(np.add.reduceat(mixed(node.view(np.uint64)), first) + sizes.astype(np.uint64)).view(np.int64)
                keep = (sizes > 1) & ~np.isin(names, np.fromiter(known, np.int64, len(known)))
                once = np.zeros(len(names), bool)
                once[np.unique(names, return_index=True)[1]] = True
                keep &= once
                known.update(names[keep].tolist())
                rows = np.repeat(keep, sizes)
                if rows.any():
                    yield pa.record_batch([pa.array(np.repeat(names, sizes)[rows]), pa.array(np.repeat(sizes, sizes)[rows]), pa.array(node[rows])], ["tile", "size", "node"])

    dealt = documents.select("text").transform(in_arrow, deal, "bucket int, sigs binary, nodes binary")
    return dealt.repartition(parts, "bucket").transform(in_arrow, meet, "tile long, size long, node long")


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each hash modulo the smallest power of two that is at least four times the size."""
    bits = max(64, 1 << (4 * len(shingles) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """The bitmaps as rows of 64-bit words, all folded to the shortest length."""
    short = min(map(len, maps))
    out = np.empty((len(maps), short // 8), np.uint64)
    for k, x in enumerate(maps):
        out[k] = np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, short // 8), 0)
    return out


def overlap_bound(a: np.ndarray, b: np.ndarray, size_a, size_b) -> np.ndarray:
    """No overlap can be larger: each bit of only one bitmap is a shingle that the other set lacks."""
    return np.minimum(size_a - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), size_b - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))


def set_table(documents: DataFrame, members: DataFrame, classes: DataFrame, n: int, tables: Tables) -> DataFrame:
    """node, size, bitmap, shingles of the nodes in members, from one document each.

    Few wanted documents are picked by a broadcast of their ids. Many pass a Bloom filter of bounded size, and what it
    lets through besides goes by a join of the sets. Nodes whose rows all lack an id take their sets from those rows, by
    node. No text is shuffled.
    """
    wanted = tables.stored(members.select("node").distinct().join(classes.select("node", F.col("representative").alias("doc_id")), "node"), "wanted")
    count, named = wanted.agg(F.count("*"), F.count("doc_id")).first()
    small = count <= BROADCAST_ROWS
    every = documents.select("doc_id", "text")
    rows = every.where("doc_id is not null")
    if small:
        bloom = None
        rows = rows.join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi")
    else:
        bloom = documents.sparkSession.sparkContext.broadcast(bloom_filter(wanted, "doc_id", count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            if bloom is not None and "h" in batch.schema.names:
                batch = batch.filter(pa.array(in_bloom(bloom.value, batch.column("h").to_numpy())))
            found = [(d, s) for d, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(texts_as_bytes(batch.column("text")), n), strict=True) if len(s)]
            yield pa.record_batch([
                pa.array([d for d, _ in found], pa.int64()), pa.array([node_of(s) for _, s in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()),
                pa.array([bitmap(s) for _, s in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary()),
            ], ["doc_id", "node", "size", "bitmap", "shingles"])

    schema = "doc_id long, node long, size long, bitmap binary, shingles binary"
    sets = rows.withColumn("h", bloom_hash("doc_id")).transform(in_arrow, run, schema)
    sets = sets.join(broadcast_if_small(wanted, count), ["node", "doc_id"], "left_semi").drop("doc_id")
    if named == count:
        return sets
    nameless = wanted.where("doc_id is null").select("node")
    own = every.where("doc_id is null").transform(in_arrow, run, schema).drop("doc_id")
    return sets.unionByName(own.join(broadcast_if_small(nameless, count - named), "node", "left_semi").dropDuplicates(["node"]))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, tables: Tables, bounded: bool = False) -> DataFrame:
    """The pairs a, b that link, stored: bounded by bitmaps first, unless they are already; the arrays of those that are left are intersected."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            keep = []
            for size_a, map_a, size_b, map_b in zip(*(batch.column(c).to_pylist() for c in ("size_a", "bitmap_a", "size_b", "bitmap_b")), strict=True):
                a, b = folded([map_a, map_b])
                most = int(overlap_bound(a, b, size_a, size_b))
                keep.append(den * most >= num * (size_a + size_b - most))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            keep = []
            for set_a, set_b in zip(*(batch.column(c).to_pylist() for c in ("shingles_a", "shingles_b")), strict=True):
                both = np.sort(np.concatenate((np.frombuffer(set_a, np.uint64), np.frombuffer(set_b, np.uint64))), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared >= num * (len(both) - shared))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def with_sides(p: DataFrame, count: int, *columns: str) -> DataFrame:
        side = lambda x: sets.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
        return side("a").join(broadcast_if_small(p, count), "a").join(side("b"), "b")

    own = Tables()
    left = own.stored(pairs, "pairs")
    count = left.count()
    if not bounded:
        left = own.stored(with_sides(left, count, "size", "bitmap").transform(in_arrow, bound, "a long, b long"), "bounded")
        count = left.count()
    if count <= BROADCAST_ROWS:  # only the sets of these pairs are read on
        nodes = F.broadcast(left.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        sets = own.stored(sets.join(nodes, "node", "left_semi"), "sets")
    links = tables.stored(with_sides(left, count, "shingles").transform(in_arrow, intersect, "a long, b long"), "links")
    own.release()
    return links


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """node, root of every node in links (a, b), stored: the smallest node of its component, by large-star and small-star rounds."""
    own = Tables()
    edges = own.stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, edges = edges, own.stored(small, "edges")
        own.release(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")))
    roots = tables.stored(both.distinct(), "roots")
    own.release()
    return roots


def stars(members: DataFrame) -> DataFrame:
    """a, b: the leader of each tile with each other member. It is the member that meets most others over all its tiles."""
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    leaders = members.join(weight, "node").groupBy("tile").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    pairs = members.join(leaders, "tile").where("node <> leader")
    return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def unresolved(members: DataFrame, roots: DataFrame) -> DataFrame:
    """tile, size, node, root of the tiles with three members or more that lie in several components."""
    known = members.where("size > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_tiles = known.groupBy("tile").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return known.join(open_tiles.select("tile"), "tile").select("tile", "size", "node", "root")


def block_pairs(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: pairs of open tiles that bitmaps let through, of different components."""
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / TILE_SETS).cast("int"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    own = rows.withColumn("block", block).join(sets.select("node", F.col("size").alias("n"), "bitmap"), "node")
    every = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = every.select("tile", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "n", "bitmap")

    def compare(key, t):
        i, j = key[1].as_py(), key[2].as_py()
        node, root, size, block = (t.column(c).to_numpy() for c in ("node", "root", "n", "block"))
        maps = folded(t.column("bitmap").to_pylist())
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found_a, found_b = [], []
        for x in left.tolist():
            ys = right[right > x] if i == j else right
            ys = ys[root[ys] != root[x]]
            if len(ys):
                bound = overlap_bound(maps[x], maps[ys], size[x], size[ys])
                ys = ys[den * bound >= num * (size[x] + size[ys] - bound)]
                found_a.append(np.full(len(ys), node[x]))
                found_b.append(node[ys])
        a, b = (np.concatenate(f) if f else np.empty(0, np.int64) for f in (found_a, found_b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return placed.groupBy("tile", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def with_nodes(documents: DataFrame, n: int) -> DataFrame:
    """The rows with the node of each (null for an empty set) as _node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            nodes = pa.array([node_of(s) if len(s) else None for s in shingle_sets(texts_as_bytes(batch.column("text")), n)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], [*batch.schema.names, "_node"])

    return documents.transform(in_arrow, run, StructType([*documents.schema.fields, StructField("_node", LongType())]))


def labelled(documents: DataFrame, shingle: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, node of every row; and node, root, component_id (the least doc_id of its component) of every node."""
    levels = Levels(num, den)
    nodes = stored(shingle_nodes(documents, shingle), "nodes")
    classes = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("representative"))
    tables, ends = Tables(), Tables()
    members = tables.stored(tiles(documents, shingle, levels).distinct(), "tiles")
    sets = tables.stored(set_table(documents, members, classes, shingle, tables), "sets")
    links = verified(stars(members), sets, num, den, tables)
    roots = components(links, ends)
    more = verified(block_pairs(tables.stored(unresolved(members, roots), "open"), sets, num, den), sets, num, den, tables, bounded=True)
    if not more.isEmpty():
        roots = components(links.union(more), ends)
    tables.release()  # everything from here on reads nodes and roots
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("representative").alias("component_id"))
    return nodes, named.join(least, "root").select("node", "root", "component_id")


def components_of(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of what labelled() gives."""
    labels = labels.select("node", "component_id")
    return nodes.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(documents: DataFrame, shingle: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; documents link if den * |A and B| >= num * |A or B|."""
    return components_of(*labelled(documents, shingle, num, den))
