"""Tools that read: today, stats, related, entities, procedures, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.entities import entities as entities_of
from ..functions.text import ascii_lower, human_size
from ..schema import DAY, DEFAULT_IMPORTANCE, in_namespace, tier_code
from .ingest import ENTITIES
from .search import selected


def today(memories: DataFrame, now: float, namespace: str | None = None) -> DataFrame:
    """Active memories since the last UTC midnight, in the order of created_at."""
    midnight = now - now % DAY
    return selected(memories, None, namespace).where(F.col("created_at") >= midnight).select("id", "content", "tier", "source", "created_at").orderBy("created_at", "id")


def stats(memories: DataFrame, namespace: str | None = None, dim: int = 128, quantised: bool = False, stored_bytes: int = 0) -> DataFrame:
    """One row: counts, counts by tier, newest, mean importance, sizes. One pass over the table."""
    rows = memories.where(in_namespace(F.col("namespace"), namespace))
    active = ~F.col("archived")
    by_tier = rows.groupBy("tier").agg(F.count_if(active).alias("n"), F.count_if(~active).alias("gone"), F.max(F.when(active, F.col("created_at"))).alias("latest"), F.sum(F.when(active, F.col("importance"))).alias("s"), F.count(F.when(active, F.col("importance"))).alias("c"))
    total = by_tier.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("gone"), F.lit(0)).alias("archived"), F.max("latest").alias("latest"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("tier", "n"))))).alias("by_tier"),
        F.coalesce(F.round(F.sum("s") / F.sum("c"), 4), F.lit(DEFAULT_IMPORTANCE)).alias("avg_importance"),
    )
    return total.withColumns({"bytes_per_vector": F.lit(8 + dim if quantised else 4 * dim), "stored_size": human_size(F.lit(float(stored_bytes)))})


def tagged(memories: DataFrame, tag: str) -> DataFrame:
    """Active memories with the tag."""
    return selected(memories).where(F.array_contains("tags", tag))


def memory_entities(memories: DataFrame) -> DataFrame:
    """key (the name in lower-case ASCII letters), name, type, memory_id, position of every entity in every memory; those that a column ENTITIES has aren't searched again."""
    found = F.col(ENTITIES) if ENTITIES in memories.columns else entities_of(F.col("content"))
    rows = memories.select(F.col("id").alias("memory_id"), F.posexplode(found).alias("position", "e"))
    return rows.select(ascii_lower(F.col("e.name")).alias("key"), "e.name", "e.type", "memory_id", "position")


def entity_counts(entities: DataFrame, memories: DataFrame, kind: str | None = None, limit: int | None = 50) -> DataFrame:
    """name, type, memory_count over active memories, most frequent first. Of a name's spellings the first stands (quirk 4)."""
    rows = entities.where(F.lit(True) if kind is None else F.col("type") == kind).join(memories.where("not archived").select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    out = rows.groupBy("key", "type").agg(F.countDistinct("memory_id").alias("memory_count"), F.min_by("name", F.struct("memory_id", "position")).alias("name"))
    out = out.select("name", "type", "memory_count").orderBy(F.desc("memory_count"), "name", "type")
    return out if limit is None else out.limit(limit)


def related(entities: DataFrame, memories: DataFrame, name: str, kind: str | None = None, limit: int | None = 10, namespace: str | None = None) -> DataFrame:
    """Active memories with the entity (any case of ASCII letters), newest first."""
    hits = entities.where((F.col("key") == ascii_lower(F.lit(name))) & (F.lit(True) if kind is None else F.col("type") == kind))
    rows = hits.join(selected(memories, None, namespace), hits["memory_id"] == memories["id"])
    out = rows.select("id", "content", "tier", rows["source"], F.col("name").alias("entity_name"), F.col("type").alias("entity_type"), "created_at").distinct()
    out = out.orderBy(F.desc("created_at"), "id", "entity_name")
    return out if limit is None else out.limit(limit)


def procedures(memories: DataFrame, namespace: str | None = None) -> DataFrame:
    """One row, text: the active rules, oldest first, as lines under a heading; '' if there are none. They become one text, so they meet in one place."""
    rules = selected(memories, "procedural", namespace).agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "content"))).alias("r"))
    lines = F.transform("r", lambda x: F.concat(F.lit("- "), x["content"]))
    return rules.select(F.when(F.size("r") == 0, "").otherwise(F.array_join(F.concat(F.array(F.lit("## Agent Rules (from memory)")), lines), "\n")).alias("text"))


def export_markdown(memories: DataFrame, tier: str | None = None) -> DataFrame:
    """tier_order, created_at, id, text: blocks of the export, a heading before the first of each tier; sorted they are the document.

    Written with write_markdown each partition of the sorted blocks is one part of the document; nothing is gathered.
    """
    rows = selected(memories, tier).withColumn("tier_order", tier_code(F.col("tier")))
    first = rows.groupBy("tier_order").agg(F.min(F.struct("created_at", "id")).alias("first"))
    block = F.concat(
        F.when(F.struct("created_at", "id") == F.col("first"), F.concat(F.lit("\n## "), F.initcap("tier"), F.lit("\n\n"))).otherwise(""),
        F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit("<!-- source: "), F.col("source"), F.lit(" -->\n"))).otherwise(""), F.col("content"), F.lit("\n"),
    )
    return rows.join(F.broadcast(first), "tier_order").select("tier_order", "created_at", "id", block.alias("text")).orderBy("tier_order", "created_at", "id")
