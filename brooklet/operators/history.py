"""Version chains along `supersedes`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed


def _walk(memories: DataFrame, start: DataFrame, forward: bool) -> DataFrame:
    """query, id, depth: the versions before (or after, one superseder a step: the smallest id) each start, depth 0 first.

    Pointer jumping in checkpointed rounds: what each start reaches in fewer than 2^k steps, joined with the links of 2^k
    steps, until a round reaches nothing new. So chains may have any length, and cycles end.
    """
    links = memories.where("supersedes is not null").select("id", "supersedes")
    if forward:
        links = links.groupBy("supersedes").agg(F.min("id").alias("to")).select(F.col("supersedes").alias("from"), "to")
    else:
        links = links.join(memories.select(F.col("id").alias("supersedes")), "supersedes").select(F.col("id").alias("from"), F.col("supersedes").alias("to"))
    jumps = checkpointed(links.distinct())
    reached = checkpointed(start.select("query", F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct())
    count, steps = reached.count(), 1
    while True:
        further = reached.join(jumps, F.col("id") == F.col("from")).select("query", "start", F.col("to").alias("id"), (F.col("depth") + steps).alias("depth"))
        reached = checkpointed(reached.union(further).groupBy("query", "start", "id").agg(F.min("depth").alias("depth")))
        before, count = count, reached.count()
        if count == before:
            return reached.select("query", "id", "depth")
        second = jumps.select(F.col("from").alias("to"), F.col("to").alias("end"))
        jumps = checkpointed(jumps.join(second, "to").select("from", F.col("end").alias("to")).distinct())
        steps *= 2


def chain_members(memories: DataFrame, start: DataFrame) -> DataFrame:
    """query, id: all versions that belong to the starts (query, id)."""
    return _walk(memories, start, False).select("query", "id").union(_walk(memories, start, True).select("query", "id")).distinct()


def history(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """query, position, id, content, created_at, archived of the chain of each id (query, id), newest first; unknown ids have none."""
    known = ids.join(memories.select("id"), "id", "left_semi").select("query", "id")
    back = _walk(memories, known, False).select("query", "id", (-F.col("depth")).alias("age"))
    ahead = _walk(memories, known, True).where("depth > 0").select("query", "id", F.col("depth").alias("age"))
    chain = back.union(ahead).groupBy("query", "id").agg(F.max("age").alias("age"))
    newest = chain.groupBy("query").agg(F.max("age").alias("newest"))
    return chain.join(newest, "query").join(memories, "id").select("query", (F.col("newest") - F.col("age")).cast("long").alias("position"), "id", "content", "created_at", "archived")
