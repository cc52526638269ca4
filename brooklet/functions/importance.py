"""Importance of a text: a weighted sum of five heuristics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ACTION_WORDS
from .text import NS, S, W, python_pattern

#: Weights of tiers, structure patterns, weights of the five parts.
TIER_WEIGHTS = {"core": 1.0, "procedural": 0.9, "learned": 0.6, "episodic": 0.4, "working": 0.2}
STRUCTURE = (r"(?m)^- ", r"(?m)^\* ", r"(?m)^[0-9]+\. ", rf"{W}+:{S}+{NS}", rf"{W}+={NS}", "```")
ASSIGNMENT = rf"[A-Z_]{{3,}}={NS}"
PARTS = (0.30, 0.20, 0.20, 0.15, 0.15)


_STRUCTURE, _ASSIGNMENT = tuple(map(python_pattern, STRUCTURE)), python_pattern(ASSIGNMENT)


def _points(count: int) -> float:
    """A fifth for each test that holds, one at most."""
    return min(1.0, round(count * 0.2, 1))


def points(text: str) -> tuple[float, float]:
    """Of structure, and of words that ask for action."""
    lowered = text.lower()
    action = sum(w in lowered for w in ACTION_WORDS) + ("=" in text and _ASSIGNMENT.search(text) is not None)
    return _points(sum(p.search(text) is not None for p in _STRUCTURE)), _points(action)


def importance(text: Column, tier: Column, n_entities: Column) -> Column:
    n = F.length(text)
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in TIER_WEIGHTS.items() for x in kv])[tier], F.lit(0.5))
    length = F.when(n < 30, 0.2).when(n < 100, 0.2 + 0.8 * (n - 30) / F.lit(70.0)).when(n <= 500, 1.0).when(n <= 800, 1.0 - 0.3 * (n - 500) / F.lit(300.0)).otherwise(0.7)
    named = F.least(F.lit(1.0), n_entities / F.lit(5.0))
    from .facts import facts

    structure, action = facts(text)["structure"], facts(text)["action"]
    a, b, c, d, e = PARTS
    return F.round(a * weight + b * length + c * named + d * structure + e * action, 4)
