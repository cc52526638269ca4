"""What is to be archived by age."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DAY, WORKING_TTL_SECONDS
from .search import selected


def compactable(memories: DataFrame, now: float, max_age_days: float = 90, min_access: int = 0, tier: str | None = None, namespace: str | None = None) -> DataFrame:
    """Active memories older than max_age_days, read min_access times at most; never core or procedural ones."""
    old = (F.col("created_at") < now - max_age_days * DAY) & (F.col("access_count") <= min_access)
    return selected(memories, tier, namespace).where(old & ~F.col("tier").isin("core", "procedural"))


def expired_working(memories: DataFrame, now: float, ttl: float = WORKING_TTL_SECONDS) -> DataFrame:
    return selected(memories, "working").where(F.col("created_at") < now - ttl)
