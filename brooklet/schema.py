"""Schemas, codes and word lists of the text store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tiers by code.
TIERS = ("core", "learned", "episodic", "working", "procedural")
DEFAULT_TIER, DEFAULT_IMPORTANCE = "learned", 0.5
WORKING_TTL_SECONDS = 86_400
DAY = 86_400
EMBEDDING_DIM = 128

MEMORY = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("content", T.StringType()), T.StructField("tier", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("namespace", T.StringType()),
    T.StructField("created_at", T.DoubleType()), T.StructField("updated_at", T.DoubleType()), T.StructField("archived", T.BooleanType()),
    T.StructField("content_hash", T.StringType()), T.StructField("access_count", T.LongType()), T.StructField("last_accessed", T.DoubleType()),
    T.StructField("supersedes", T.LongType()), T.StructField("importance", T.DoubleType()),
])
ENTITY = "id long, name string, type string, memory_id long"

#: Word lists.
EN_STOP = "a all am an and any are as at be been but by can did do for from got had has have he i if in is it its may me my no not of on or she so than that the them then they this to up us was we were will with you".split()
RU_STOP = "без бы был в вот все вы где да для до его ей ещё её же за и из или им их как кто ли мы на над не нет ни но об он она они от по под при с так то тут ты уже что это я".split()
QUESTION_WORDS = "describe explain how show tell what when where which who why где зачем как какая какие какое какой когда кто объясни покажи почему расскажи чем чему что".split()
TECH_TERMS = "api bash bot cache cli client config cron database deploy dns docker endpoint env git http https index ip json log mcp node npm pip port proxy python query request response sdk server sqlite ssh ssl tcp token toml url webhook yaml".split()
ACTION_WORDS = "always never must should important critical todo fixme password token key secret".split()


class StoreError(Exception):
    """Any error of the store."""


class NotFoundError(StoreError):
    pass


class InvalidTierError(StoreError, ValueError):
    pass


class EmbeddingError(StoreError):
    pass


def checked_tier(tier: str) -> str:
    if tier not in TIERS:
        raise InvalidTierError(f"unknown tier {tier!r}; valid tiers: {', '.join(TIERS)}")
    return tier


def tier_code(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier).cast("int") - 1


def tier_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), code.cast("int") + 1)


def in_namespace(namespace: Column, wanted: str | None) -> Column:
    """Equal, or below it in the /-separated hierarchy; None: any. Case-sensitive on every path (quirk 1)."""
    return F.lit(True) if wanted is None else (namespace == wanted) | namespace.startswith(wanted + "/")


def decoded_tags(tags: Column) -> Column:
    """A list from its text form: a JSON array, or parts separated by commas."""
    listed = F.when(F.ltrim(tags).startswith("["), F.from_json(tags, "array<string>")).otherwise(F.split(tags, ","))
    return F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def encoded_tags(tags: Column) -> Column:
    return F.array_join(tags, ",")


def normalize_legacy(rows: DataFrame) -> DataFrame:
    """Rows of an older layout (tier as name or code, tags as text, missing columns) as MEMORY."""
    have = dict(rows.dtypes)
    tier = F.col("tier") if have.get("tier") == "string" else tier_name(F.col("tier")) if "tier" in have else F.lit(DEFAULT_TIER)
    tags = F.col("tags") if have.get("tags", "").startswith("array") else decoded_tags(F.coalesce("tags", F.lit(""))) if "tags" in have else F.array().cast("array<string>")
    defaults = {"source": F.lit(""), "namespace": F.lit(""), "archived": F.lit(False), "access_count": F.lit(0), "importance": F.lit(DEFAULT_IMPORTANCE), "content_hash": F.substring(F.sha2("content", 256), 1, 16)}
    out = rows.withColumns({"tier": tier, "tags": tags, **{c: x for c, x in defaults.items() if c not in have}})
    out = out.withColumn("content_hash", F.substring(F.sha2("content", 256), 1, 16))
    missing = {f.name: F.lit(None) for f in MEMORY if f.name not in out.columns}
    return out.withColumns(missing).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in MEMORY))
