"""An append-only event log in Parquet, its fold, what is derived from it, and the tools on it.

Every mutation writes one commit, a folder of events; a commit counts once its marker file is there, so a reader never
sees half of one. The current state of a memory is its insert and the fold of the marks after it. Commits that insert
also write what is derived from the texts: postings and lengths for keyword search, vectors, entities, each sorted for
the reads that follow; these folders are written before the events, so a failing embedder stores nothing. Reads are
pure; `now` is always a parameter. compacted() rewrites the log and its derived tables as one base; it comes by itself
after `compact_every` commits.

One writer at a time: a mutation holds a file that is created exclusively (on a store whose create is atomic, such as
HDFS or a local disk) from its first read to its commit; another waits, and takes over a file older than LEASE seconds.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce, wraps

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import checkpointed
from ..functions.embedders import embedder
from ..operators import consolidate as near
from ..operators import history as versions
from ..operators import ingest, reads, retention, search
from ..schema import MEMORY, EmbeddingError, NotFoundError, StoreError, checked_tier
from ..sources import files

#: An event: what happened to a memory; inserts carry the whole memory.
EVENT = T.StructType([T.StructField("seq", T.LongType()), T.StructField("ts", T.DoubleType()), T.StructField("op", T.StringType()), T.StructField("target", T.LongType()), T.StructField("value", T.LongType()), T.StructField("memory", MEMORY)])


def fold(events: DataFrame) -> DataFrame:
    """MEMORY rows from EVENT rows, one insert a memory.

    Only marks are aggregated (partially before their shuffle); inserts pass by as they are, so columns that a read
    doesn't want are never read, and a small set of marks is broadcast to them.
    """
    when = lambda value, *ops: F.when(F.col("op").isin(*ops), value)
    by = lambda value, *ops: F.max_by(when(value, *ops), when(F.col("seq"), *ops))
    marks = events.where("op <> 'insert'").groupBy("target").agg(
        by(F.col("op") == "archive", "archive", "unarchive").alias("_archived"),
        F.max(F.when(F.col("op").isin("touch", "archive", "unarchive", "link") & (F.col("ts") > 0), F.struct("seq", "ts"))).alias("_updated"),  # the last write counts, whatever its clock
        F.max(when(F.lit(True), "link")).alias("_linked"), by(F.col("value"), "link").alias("_link"),
        F.sum(when(F.col("value"), "access")).alias("_count"), F.max(when(F.col("ts"), "access")).alias("_access"),
    )
    inserts = events.where("op = 'insert'").select("target", *(F.col(f"memory.{f.name}").alias(f.name) for f in MEMORY))
    changed = {
        "archived": F.coalesce("_archived", "archived"), "updated_at": F.coalesce("_updated.ts", "updated_at"), "supersedes": F.when(F.col("_linked"), F.col("_link")).otherwise(F.col("supersedes")),
        "access_count": F.col("access_count") + F.coalesce("_count", F.lit(0)), "last_accessed": F.greatest("last_accessed", "_access"),
    }
    return inserts.join(marks, "target", "left").select(*(changed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in MEMORY))


#: What is derived from texts: schema, and the columns that its files are sorted by.
DERIVED = {
    "postings": ("token string, id long, dl int, column int, place int", ("token", "id", "column", "place")), "lengths": ("id long, dl int", ("id",)),
    "vectors": ("id long, embedding array<float>", ("id",)), "entities": ("key string, name string, type string, memory_id long, position int", ("key", "memory_id", "position")),
}
#: Rows of a batch whose derived tables are one file each.
FEW_ROWS = 1000
#: Seconds after which a writer's file counts as left behind, and that another writer waits for it.
LEASE, PATIENCE = 3600.0, 120.0


def _writing(tool):
    """A tool that reads and then writes, in one turn."""

    @wraps(tool)
    def run(self, *args, **named):
        with self._turn():
            return tool(self, *args, **named)

    return run


class Store:
    """Tools over a log at a path. Each mutating tool makes one commit."""

    def __init__(
        self, spark: SparkSession, path: str, dim: int = 128, recency_weight: float = 0.1, decay_rate: float = 0.01, embed: Callable[[DataFrame], DataFrame] | str | None = "hash", compact_every: int = 1000,
    ) -> None:
        self.spark, self.path, self.recency_weight, self.decay_rate, self.compact_every = spark, path.rstrip("/"), recency_weight, decay_rate, compact_every
        #: From (id, content) to (id, embedding), a name of an embedder, or None: keyword search only.
        self.embed = embedder(embed, dim) if isinstance(embed, str) else embed
        self.dim = getattr(self.embed, "dim", dim) if self.embed else 0
        self._turns = 0

    # the log
    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    @contextmanager
    def _turn(self):
        """The right to write, from the first read of a mutation to its commit. Turns inside a turn are the same turn."""
        fs, path = self._fs(f"{self.path}/_writer")
        began = time.monotonic()
        while not self._turns:
            try:
                fs.create(path, False).close()
                break
            except Py4JJavaError as e:
                if not fs.exists(path):
                    if "FileAlreadyExists" not in str(e.java_exception):
                        raise
                elif time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > LEASE:
                    fs.delete(path, False)
                elif time.monotonic() - began > PATIENCE:
                    raise StoreError(f"another writer holds {self.path}/_writer") from e
                else:
                    time.sleep(0.2)
        self._turns += 1
        try:
            yield
        finally:
            self._turns -= 1
            if not self._turns:
                fs.delete(path, False)

    def _exists(self, name: str) -> bool:
        fs, path = self._fs(f"{self.path}/{name}")
        return fs.exists(path)

    def _names(self) -> set[str]:
        fs, path = self._fs(self.path)
        return {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()

    def _done(self, names: set[str], kind: str) -> list[int]:
        return sorted(int(n[-9:]) for n in names if n.startswith(f"{kind}-") and len(n) == len(kind) + 10 and self._exists(f"{n}/_SUCCESS"))

    def _commits(self, names: set[str] | None = None) -> list[int]:
        """The base (-1: none) and the commits after it."""
        names = self._names() if names is None else names
        start = max(self._done(names, "base"), default=-1)
        return [start, *(n for n in self._done({n for n in names if n[-9:].isdigit() and int(n[-9:]) > start}, "commit"))]

    def _table(self, schema, folder: str, base_folder: str) -> DataFrame:
        names = self._names()
        base, *commits = self._commits(names)
        wanted = [f"{base_folder}-{base:09d}"] * (base >= 0) + [f"{folder}-{n:09d}" for n in commits]
        paths = [f"{self.path}/{n}" for n in wanted if n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        return self._table(EVENT, "commit", "base")

    def memories(self) -> DataFrame:
        return fold(self.events())

    def derived(self, kind: str) -> DataFrame:
        """A table of DERIVED, of all memories ever inserted."""
        return self._table(DERIVED[kind][0], kind, f"{kind}-base")

    def entities(self) -> DataFrame:
        return self.derived("entities")

    def _write(self, kind: str, rows: DataFrame, name: str, few: bool = False, placed: bool = False) -> None:
        """A table of DERIVED, sorted over all its files; few rows go into one file, and rows whose partitions are ranges already (placed) stay there, without a shuffle."""
        schema, order = DERIVED[kind]
        columns = [c.split()[0] for c in schema.split(", ")]
        typed = rows.select(*(F.col(c.split()[0]).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in schema.split(", "))).select(*columns)
        (typed.coalesce(1) if few else typed if placed else typed.repartitionByRange(*order[:2])).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def commit(self, *events: DataFrame, inserted: DataFrame | None = None, few: bool = False) -> None:
        """Events (op, target, value, ts, memory) as one commit; Spark's committer writes the marker last. inserted: MEMORY rows whose texts are new, partitions as numbered() leaves them; few: FEW_ROWS at most."""
        with self._turn():
            names = self._names()
            number = max((int(n[-9:]) for n in names if n[-9:].isdigit()), default=-1) + 1  # no number is used twice, not even one of a commit that failed
            if inserted is not None:
                index = search.indexed(inserted)
                self._write("postings", index.postings, f"postings-{number:09d}", few)
                self._write("lengths", index.lengths, f"lengths-{number:09d}", few, True)
                self._write("entities", reads.memory_entities(inserted), f"entities-{number:09d}", few)
                if self.embed:
                    try:
                        self._write("vectors", self.embed(inserted.select("id", "content")), f"vectors-{number:09d}", few, True)
                    except Exception as e:
                        raise EmbeddingError(f"nothing was stored, as the embedder failed: {e}") from e
            rows = reduce(DataFrame.unionByName, events).withColumn("seq", F.lit(number).cast("long"))
            rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT)).write.mode("overwrite").parquet(f"{self.path}/commit-{number:09d}")
            if self.compact_every and len(self._commits()) > self.compact_every:
                self.compacted()

    def compacted(self) -> None:
        """The log as one base of inserts, and one folder of each derived table: what a checkpoint is to a write-ahead log."""
        with self._turn():
            _, *commits = self._commits()
            if not commits:
                return
            last = commits[-1]
            for kind in DERIVED:
                self._write(kind, self.derived(kind), f"{kind}-base-{last:09d}")
            rows = self._inserts(self.memories()).withColumn("seq", F.lit(last).cast("long"))
            rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT)).write.mode("overwrite").parquet(f"{self.path}/base-{last:09d}")

    def vacuum(self) -> int:
        """Deletes folders that the base replaces, and those of commits that failed; returns how many. For when no reader is older than the base."""
        with self._turn():
            names = self._names()
            base, *commits = self._commits(names)
            live = {f"{k}base-{base:09d}" for k in ("", *(f"{k}-" for k in DERIVED))} | {f"{k}-{n:09d}" for k in ("commit", *DERIVED) for n in commits}
            gone = [n for n in names if n[-9:].isdigit() and n not in live]
            for n in gone:
                fs, path = self._fs(f"{self.path}/{n}")
                fs.delete(path, True)
            return len(gone)

    @staticmethod
    def _inserts(memories: DataFrame) -> DataFrame:
        return memories.select(F.lit("insert").alias("op"), F.col("id").alias("target"), F.lit(None).cast("long").alias("value"), F.col("created_at").alias("ts"), F.struct(*(f.name for f in MEMORY)).alias("memory"))

    @staticmethod
    def _marks(op: str, ids: DataFrame, ts: float, value=None) -> DataFrame:
        """ids: a column id."""
        return ids.select(F.lit(op).alias("op"), F.col("id").alias("target"), (F.lit(None) if value is None else value).cast("long").alias("value"), F.lit(float(ts)).alias("ts"), F.lit(None).cast(MEMORY).alias("memory"))

    def _ids(self, *ids: int) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id long")

    def _one(self, memory_id: int):
        row = self.memories().where(F.col("id") == memory_id).first()
        if row is None:
            raise NotFoundError(f"memory {memory_id} not found")
        return row

    # writing tools
    @_writing
    def remember_batch(self, items: DataFrame, now: float, namespace: str = "") -> dict:
        """Items (content and any of position, tier, source, tags, namespace, supersedes); of equal ones in a namespace the first, if no active memory has it."""
        before = self.memories()
        prepared = checkpointed(ingest.prepared(items, namespace, score=False))
        new = checkpointed(ingest.scored(ingest.new_items(prepared, before)))
        total, imported = prepared.count(), new.count()
        if imported:
            first = (before.agg(F.max("id")).first()[0] or 0) + 1
            few = imported <= FEW_ROWS
            rows = checkpointed(ingest.numbered(new, first, now, few))
            gone = rows.where("supersedes is not null").select(F.col("supersedes").alias("id")).distinct()
            self.commit(self._inserts(rows), self._marks("archive", gone, now), inserted=rows, few=few)
        return {"imported": imported, "deduplicated": total - imported, "embedded": imported if self.embed else 0}

    @_writing
    def remember(self, content: str, now: float, tier: str = "learned", tags: list[str] | None = None, source: str = "", namespace: str = "", supersedes: int | None = None) -> dict:
        if not (content or "").strip():
            raise ValueError("content is blank")
        checked_tier(tier)
        items = self.spark.createDataFrame([(0, content, tier, source, tags or [], namespace, supersedes)], "position long, content string, tier string, source string, tags array<string>, namespace string, supersedes long")
        same = lambda: self.memories().where((F.col("content_hash") == F.substring(F.sha2(F.lit(content), 256), 1, 16)) & (F.col("namespace") == namespace) & ~F.col("archived")).select("id", "tier").first()
        if (row := same()) is not None:
            self.commit(self._marks("touch", self._ids(row["id"]), now))
            return {"id": row["id"], "tier": row["tier"], "embedded": self.embed is not None, "deduplicated": True}
        self.remember_batch(items, now, namespace)
        return {"id": same()["id"], "tier": tier, "embedded": self.embed is not None, "deduplicated": False}

    def add_procedure(self, rule: str, now: float, tags: list[str] | None = None, namespace: str = "") -> dict:
        return self.remember(rule, now, "procedural", tags, "", namespace)

    @_writing
    def update_memory(self, old_id: int, content: str, now: float, tier: str | None = None, tags: list[str] | None = None, namespace: str | None = None) -> dict:
        old = self._one(old_id)
        kept = self.remember(content, now, tier or old["tier"], old["tags"] if tags is None else tags, "", old["namespace"] if namespace is None else namespace, old_id)
        if kept["deduplicated"] and kept["id"] != old_id:
            self.commit(self._marks("archive", self._ids(old_id), now), self._marks("link", self._ids(kept["id"]), now, F.lit(old_id)))
        return {"id": kept["id"], "supersedes": old_id}

    @_writing
    def save_state(self, state: str, now: float, namespace: str = "") -> dict:
        rows = self.memories().where("tier = 'working' and not archived")
        self.commit(self._marks("archive", (rows.where(F.col("namespace") == namespace) if namespace else rows).select("id"), now))
        return {"saved": True, "id": self.remember(state, now, "working", ["state"], "save_state", namespace)["id"]}

    @_writing
    def forget(self, memory_id: int, now: float, namespace: str | None = None) -> dict:
        row = self._one(memory_id)
        if namespace is not None and row["namespace"] != namespace and not row["namespace"].startswith(namespace + "/"):
            return {"forgotten": False, "id": memory_id, "reason": "namespace mismatch"}
        self.commit(self._marks("archive", self._ids(memory_id), now))
        return {"forgotten": True, "id": memory_id}

    @_writing
    def unarchive(self, memory_id: int, now: float) -> dict:
        if not self._one(memory_id)["archived"]:
            return {"unarchived": False, "id": memory_id, "reason": "not archived"}
        self.commit(self._marks("unarchive", self._ids(memory_id), now))
        return {"unarchived": True, "id": memory_id}

    @_writing
    def _archived(self, rows: DataFrame, dry_run: bool = False) -> int:
        ids = checkpointed(rows.select("id"))
        n = ids.count()
        if n and not dry_run:
            self.commit(self._marks("archive", ids, 0))  # retention leaves updated_at as it was
        return n

    @_writing
    def compact(self, now: float, max_age_days: float = 90, min_access: int = 0, tier: str | None = None, namespace: str | None = None, dry_run: bool = False) -> dict:
        return {"archived": self._archived(retention.compactable(self.memories(), now, max_age_days, min_access, tier and checked_tier(tier), namespace), dry_run), "dry_run": dry_run}

    @_writing
    def cleanup_working(self, now: float) -> int:
        return self._archived(retention.expired_working(self.memories(), now))

    @_writing
    def consolidate(self, now: float, threshold: float = 0.85, namespace: str | None = None, tier: str | None = None, merge: Callable[[list[dict]], str] | None = None, dry_run: bool = False, exact_up_to: int = 100) -> dict:
        """Archives near duplicates. merge: an optional function from the members of a group to one text that supersedes them."""
        chosen = checkpointed(search.selected(self.memories(), tier and checked_tier(tier), namespace))
        n = chosen.count()
        if n < 2:
            return {"groups": 0, "archived": 0, "dry_run": dry_run, "details": []}
        if not self.embed:
            raise EmbeddingError("consolidation needs an embedder")
        vectors = checkpointed(self.derived("vectors").join(chosen.select("id"), "id", "left_semi"))
        pairs = near.exact_pairs(vectors, threshold, True) if n <= exact_up_to else near.lsh_pairs(vectors, threshold, self.dim)
        rows = checkpointed(near.groups(chosen, near.components(pairs)))
        counted = rows.agg(F.countDistinct("root"), F.count_if(~F.col("kept"))).first()
        if not dry_run and counted[0]:
            if merge is None:
                first = rows.where("not kept").groupBy("kept_id").agg(F.min("id").alias("value"))
                links = first.join(chosen.where("supersedes is null").select(F.col("id").alias("kept_id")), "kept_id").select(F.col("kept_id").alias("id"), "value")
                self.commit(self._marks("archive", rows.where("not kept").select("id"), now), self._marks("link", links, now, F.col("value")))
            else:
                members = rows.join(chosen, "id").groupBy("root", "kept_id").agg(F.collect_list(F.struct(*chosen.columns)).alias("m"))
                self.commit(self._marks("archive", rows.select("id"), now))
                for g in members.toLocalIterator():  # the function is the caller's, on the driver
                    kept = next(m for m in g["m"] if m["id"] == g["kept_id"])
                    self.remember(merge([m.asDict() for m in g["m"]]), now, kept["tier"], kept["tags"], kept["source"], kept["namespace"], g["kept_id"])
        details = rows.groupBy("kept_id").agg(F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("id")))).alias("archived_ids"), F.collect_list("preview").alias("contents_preview")).orderBy("kept_id")
        return {"groups": counted[0], "archived": counted[1], "dry_run": dry_run, "details": details}

    @_writing
    def process_conversation(self, messages: DataFrame, now: float, namespace: str = "", source: str = "conversation") -> dict:
        """messages: message, content. Ids are those of the memories really inserted (quirk 13)."""
        rows = checkpointed(ingest.conversation_items(messages.select(F.lit(0).alias("run"), "message", "content")))
        by_type = {r["type"]: r["count"] for r in rows.groupBy("type").count().collect()}
        before = self.memories().agg(F.max("id")).first()[0] or 0
        order = F.col("message") * (1 << 32) + F.col("pattern") * (1 << 24) + F.col("match")
        self.remember_batch(rows.select(order.alias("position"), F.col("text").alias("content"), "tier", F.array("type", F.lit("auto-extracted")).alias("tags"), F.lit(source).alias("source")), now, namespace)
        return {"extracted": sum(by_type.values()), "by_type": by_type, "memories": self.memories().where(F.col("id") > before).select("id").orderBy("id")}

    @_writing
    def import_markdown(self, path: str, now: float, tier: str = "learned", namespace: str = "") -> dict:
        fs, where = self._fs(path)
        if not fs.exists(where):
            return {"file": path, "chunks": 0, "imported": 0, "deduplicated": 0, "error": f"file not found: {path}"}
        rows = files.markdown(self.spark, path).withColumn("tier", F.lit(checked_tier(tier)))
        done = self.remember_batch(files.placed(rows), now, namespace)
        return {"file": path, "chunks": done["imported"] + done["deduplicated"], **done}

    # reading tools
    def recall(self, queries: dict[int, str], now: float, **options) -> DataFrame:
        """Hybrid search over the stored index and vectors; the queries' vectors come from the store's own embedder."""
        queries = search.translated(queries, options.pop("translate", None))
        stored = {"index": search.Index(self.derived("postings"), self.derived("lengths")), "keyword_only": self.embed is None}
        if self.embed and not options.get("keyword_only"):
            asked = self.spark.createDataFrame(sorted(queries.items()), "id long, content string")
            stored |= {"vectors": self.derived("vectors"), "query_vectors": self.embed(asked).select(F.col("id").alias("query"), F.col("embedding").alias("vector"))}
        return search.recall(self.memories(), queries, now, **{"recency_weight": self.recency_weight, "decay_rate": self.decay_rate, **stored, **options})

    @_writing
    def note_access(self, recalled: DataFrame, now: float) -> None:
        counts = recalled.groupBy("id").agg(F.count("*").alias("value"))
        self.commit(self._marks("access", counts, now, F.col("value")))

    def today(self, now: float, namespace: str | None = None) -> DataFrame:
        return reads.today(self.memories(), now, namespace)

    def stats(self, namespace: str | None = None) -> DataFrame:
        fs, path = self._fs(self.path)
        return reads.stats(self.memories(), namespace, self.dim, stored_bytes=fs.getContentSummary(path).getLength() if fs.exists(path) else 0)

    def history(self, memory_id: int) -> DataFrame:
        return versions.history(self.memories(), self.spark.createDataFrame([(0, memory_id)], "query long, id long")).orderBy("position").drop("query", "position")

    def related(self, name: str, kind: str | None = None, limit: int = 10, namespace: str | None = None) -> DataFrame:
        return reads.related(self.entities(), self.memories(), name, kind, limit, namespace)

    def entity_counts(self, kind: str | None = None, limit: int = 50) -> DataFrame:
        return reads.entity_counts(self.entities(), self.memories(), kind, limit)

    def get_procedures(self, namespace: str | None = None) -> str:
        return reads.procedures(self.memories(), namespace).first()["text"]

    def export_markdown(self, tier: str | None = None) -> DataFrame:
        return reads.export_markdown(self.memories(), tier and checked_tier(tier))

    def dispatch(self, tool: str, arguments: dict):
        """A tool by its name, as the front ends call it; unknown names raise."""
        if tool.startswith("_") or tool not in TOOLS:
            raise StoreError(f"unknown tool {tool!r}; tools: {', '.join(TOOLS)}")
        return getattr(self, TOOLS[tool])(**arguments)


#: Tool -> method.
TOOLS = {t: t for t in "recall remember remember_batch save_state today forget stats compact unarchive update_memory history consolidate related get_procedures add_procedure process_conversation import_markdown export_markdown cleanup_working".split()} | {"entities": "entity_counts", "checkpoint": "compacted"}
