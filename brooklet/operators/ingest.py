"""New memories: de-duplication against the store and within a batch, derived columns; conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.entities import entities
from ..functions.extraction import extractions
from ..functions.importance import importance
from ..functions.text import NS, content_hash
from ..schema import DEFAULT_TIER, MEMORY, TIERS


#: A column of new items, no part of MEMORY, so that reads.memory_entities needs not search again.
ENTITIES = "_entities"


def prepared(items: DataFrame, namespace: str = "", checked: bool = True, score: bool = True) -> DataFrame:
    """Items (content and any of position, tier, source, tags, namespace, supersedes) with defaults, hash and importance (score: whether it's wanted yet, see scored()).

    checked: blank contents and unknown tiers stop the job, as they must before anything is stored; without, they are rows like others.
    """
    have = set(items.columns)
    column = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
    rows = items.select(
        F.col("position").cast("long").alias("position") if "position" in have else F.monotonically_increasing_id().alias("position"), F.col("content"),
        column("tier", F.lit(DEFAULT_TIER)).alias("tier"), column("source", F.lit("")).alias("source"), column("tags", F.array().cast("array<string>")).alias("tags"),
        column("namespace", F.lit(namespace)).alias("namespace"), (F.col("supersedes").cast("long") if "supersedes" in have else F.lit(None).cast("long")).alias("supersedes"),
    )
    if checked:
        rows = rows.withColumn("content", _valid())
    hashed = rows.withColumn("content_hash", content_hash(F.col("content")))
    return hashed.withColumn("importance", _importance()) if score else hashed


def _importance() -> Column:
    return importance(F.col("content"), F.col("tier"), F.size(entities(F.col("content"))))


def scored(items: DataFrame) -> DataFrame:
    """Prepared items with importance and entities, for which Python reads each text once: so after the known ones are gone."""
    return items.withColumns({"importance": _importance(), ENTITIES: entities(F.col("content"))})


def _valid() -> Column:
    """The content of an item that may be stored."""
    ok = F.coalesce("content", F.lit("")).rlike(NS) & F.col("tier").isin(*TIERS)
    return F.when(ok, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("blank content or unknown tier: "), F.coalesce("tier", F.lit("null")))))


def new_items(items: DataFrame, memories: DataFrame) -> DataFrame:
    """Of prepared items those whose (hash, namespace) no active memory has; the first of equals. One shuffle by that key."""
    first = Window.partitionBy("content_hash", "namespace").orderBy("position")
    once = items.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.join(memories.where("not archived").select("content_hash", "namespace"), ["content_hash", "namespace"], "left_anti")


def numbered(items: DataFrame, first_id: int, now: float, few: bool = False) -> DataFrame:
    """New items as MEMORY rows (and ENTITIES, if they have it), each partition in the order of ids, ids without gaps from first_id in the order of position (and of hash, among equal ones).

    Ranges of position are checkpointed with the place of each row in its range, so that counting and numbering see the
    same ranges; no task sorts more than its own. few: the caller knows that one task is enough.
    """
    order = ("position", "content_hash", "namespace")
    fixed = {"created_at": F.lit(now), "updated_at": F.lit(now), "archived": F.lit(False), "access_count": F.lit(0), "last_accessed": F.lit(None)}
    columns = [*(F.col(f.name).cast(f.dataType).alias(f.name) for f in MEMORY), *(c for c in items.columns if c == ENTITIES)]
    if few:
        return items.coalesce(1).sortWithinPartitions(*order).withColumns(fixed | {"id": F.lit(first_id) + F.monotonically_increasing_id()}).select(*columns)
    ranged = items.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(ranged.withColumn("_at", F.monotonically_increasing_id()))  # the partition in the upper bits, the place in the lower 33
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a partition
    base, total = [], first_id
    for row in counts:
        base.append((row["part"], total))
        total += row["n"]
    bases = placed.sparkSession.createDataFrame(base, "_part int, _base long")
    rows = placed.withColumn("_part", part.cast("int")).join(F.broadcast(bases), "_part")
    return rows.withColumns(fixed | {"id": F.col("_base") + place}).select(*columns)


#: Bytes of messages a task takes, and in how many tasks; larger inputs have SPREAD_MOST bytes a task. What messages say takes some twenty times their bytes while it is sorted.
SPREAD, SPREAD_TASKS, SPREAD_MOST = 8 << 20, 200, 32 << 20


def _spread(messages: DataFrame) -> DataFrame:
    """Messages over tasks by their size: a small file of rows that compress well would be one task, with all that it says.

    Up to SPREAD_TASKS the shuffle writes to a file a task, without keeping rows in memory.
    """
    size = messages.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    tasks = max(min(SPREAD_TASKS, -(-size // SPREAD)), -(-size // SPREAD_MOST))
    return messages.repartition(tasks, "run", "message", "content") if tasks > 1 else messages


def conversation_items(messages: DataFrame) -> DataFrame:
    """run, message, pattern, match, text, type, tier of what messages (run, message, content) say; of equal texts in a run (any case) the first."""
    some = _spread(messages.where("content is not null and content <> ''").select("run", "message", "content"))
    found = some.select("run", "message", F.explode(extractions(F.col("content"))).alias("x"))
    rows = found.select("run", "message", "x.pattern", "x.match", "x.text", "x.type", "x.tier").where("text <> ''")
    first = Window.partitionBy("run", F.lower("text")).orderBy("message", "pattern", "match")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
