"""The tools as a service: names and types of their arguments, results as plain values; what every front end calls."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from .plans.store import Store
from .schema import TIERS, EmbeddingError, InvalidTierError, NotFoundError, StoreError

REQUIRED = object()


@dataclass(frozen=True)
class Argument:
    """name: in a request; to: what the store calls it."""

    name: str
    kind: str
    text: str
    default: Any = None
    to: str = ""

    def schema(self) -> dict:
        out: dict = {"type": self.kind, "description": self.text}
        if self.name == "tier":
            out["enum"] = list(TIERS)
        if self.kind == "array":
            out["items"] = {"type": "object" if self.name == "messages" else "string"}
        if self.default is not REQUIRED and self.default is not None:
            out["default"] = self.default
        return out

    def checked(self, value: Any) -> Any:
        """The value as its kind; numbers and flags may come as text, as in the query of an address."""
        try:
            if value is None:
                return None
            if self.kind == "integer":
                if isinstance(value, float) and value != int(value):
                    raise ValueError
                return int(value)
            if self.kind == "number":
                return float(value)
            if self.kind == "boolean":
                return value.lower() not in ("false", "0", "no", "") if isinstance(value, str) else bool(value)
        except (TypeError, ValueError) as e:
            raise ValueError(f"{self.name} must be of type {self.kind}: {value!r}") from e
        if self.kind == "array" and not isinstance(value, list) or self.kind == "string" and not isinstance(value, str):
            raise ValueError(f"{self.name} must be of type {self.kind}: {value!r}")
        return value


def _namespace(default: str | None = None) -> Argument:
    return Argument("namespace", "string", "A namespace and what lies below it." if default is None else "The namespace to store in.", default)


_TIER = Argument("tier", "string", "Only this tier.")
_ID = Argument("memory_id", "integer", "The id of a memory.", REQUIRED)
_DRY = Argument("dry_run", "boolean", "Count only, change nothing.", False)
#: Tool -> what it does, its arguments, and whether it takes the time.
TOOLS: dict[str, tuple[str, tuple[Argument, ...], bool]] = {
    "recall": ("Hybrid search by keywords and vectors, best first.", (
        Argument("query", "string", "Words, a phrase or a question.", REQUIRED), Argument("limit", "integer", "Results at most.", 5), _TIER, Argument("recency_weight", "number", "Share of recency in the score, 0 to 1."), _namespace(),
        Argument("current_only", "boolean", "Leave out versions that others supersede.", True)), True),
    "remember": ("Stores a text once a namespace.", (
        Argument("content", "string", "The text.", REQUIRED), Argument("tier", "string", "The tier to store in.", "learned"), Argument("tags", "array", "Labels."), Argument("source", "string", "Where it comes from.", ""), _namespace("")), True),
    "save_state": ("Replaces the working state.", (Argument("state", "string", "The state.", REQUIRED), _namespace("")), True),
    "today": ("Memories since midnight, UTC.", (_namespace(),), True),
    "forget": ("Archives a memory.", (_ID, _namespace()), True),
    "stats": ("Counts and sizes.", (_namespace(),), False),
    "compact": ("Archives old memories that are rarely read.", (Argument("max_age_days", "number", "Age in days.", 90), Argument("min_access", "integer", "Reads at most.", 0), _TIER, _namespace(), _DRY), True),
    "unarchive": ("Brings an archived memory back.", (_ID,), True),
    "update_memory": ("Stores a new version of a memory.", (
        Argument("old_id", "integer", "The id of the old version.", REQUIRED), Argument("new_content", "string", "The new text.", REQUIRED, "content"), Argument("tier", "string", "Another tier."), Argument("tags", "array", "Other labels."), _namespace()), True),
    "history": ("All versions of a memory, newest first.", (_ID,), False),
    "consolidate": ("Archives near duplicates.", (Argument("similarity_threshold", "number", "Least cosine.", 0.85, "threshold"), _namespace(), _TIER, _DRY), True),
    "related": ("Memories with an entity, newest first.", (Argument("entity", "string", "Its name.", REQUIRED, "name"), Argument("entity_type", "string", "Its kind.", None, "kind"), Argument("limit", "integer", "Results at most.", 10), _namespace()), False),
    "entities": ("Entities by the number of their memories.", (Argument("entity_type", "string", "One kind only.", None, "kind"), Argument("limit", "integer", "Results at most.", 50)), False),
    "get_procedures": ("The rules, as lines.", (_namespace(),), False),
    "add_procedure": ("Stores a rule.", (Argument("rule", "string", "The rule.", REQUIRED), Argument("tags", "array", "Labels."), _namespace("")), True),
    "process_conversation": ("Stores what a conversation says.", (Argument("messages", "array", "Objects with role and content, in order.", REQUIRED), _namespace(""), Argument("source", "string", "Where it comes from.", "conversation")), True),
}
HINTS = {NotFoundError: "recall finds the ids of memories", InvalidTierError: f"tiers: {', '.join(TIERS)}", EmbeddingError: "is the embedder set up?"}


def schemas() -> list[dict]:
    """Each tool with the JSON schema of its arguments."""
    out = []
    for name, (text, arguments, _) in TOOLS.items():
        out.append({"name": name, "description": text, "inputSchema": {"type": "object", "properties": {a.name: a.schema() for a in arguments}, "required": [a.name for a in arguments if a.default is REQUIRED]}})
    return out


def plain(value: Any) -> Any:
    """Rows as dictionaries; a result that a front end shows is small, as its tool limits it."""
    if isinstance(value, DataFrame):
        return [r.asDict(recursive=True) for r in value.collect()]
    return {k: plain(v) for k, v in value.items()} if isinstance(value, dict) else value


class Service:
    """Calls tools of a store; now: a clock."""

    def __init__(self, store: Store, now: Callable[[], float] = time.time) -> None:
        self.store, self.now = store, now

    def call(self, tool: str, given: dict) -> Any:
        """The result of a tool as plain values. Unknown tools raise KeyError, wrong arguments ValueError, the store's own errors as they are."""
        _, arguments, timed = TOOLS[tool]
        if unknown := set(given) - {a.name for a in arguments}:
            raise ValueError(f"unknown arguments: {', '.join(sorted(unknown))}")
        named: dict[str, Any] = {}
        for a in arguments:
            value = a.checked(given.get(a.name, None if a.default is REQUIRED else a.default))
            if a.default is REQUIRED and (value is None or value == ""):
                raise ValueError(f"missing argument: {a.name}")
            named[a.to or a.name] = value
        if timed:
            named["now"] = self.now()
        return getattr(self, f"_{tool}", lambda **x: plain(self.store.dispatch(tool, x)))(**named)

    def _recall(self, query: str, recency_weight: float | None, **options) -> list[dict]:
        if recency_weight is not None:
            options["recency_weight"] = recency_weight
        found = plain(self.store.recall({0: query}, **options))
        if found:  # what was read counts as read
            self.store.note_access(self.store.spark.createDataFrame([(r["id"],) for r in found], "id long"), options["now"])
        return [{k: v for k, v in r.items() if k != "query"} for r in found]

    def _stats(self, namespace: str | None) -> dict:
        return plain(self.store.stats(namespace))[0]

    def _process_conversation(self, messages: list, **named) -> dict:
        rows = [(k, m.get("content")) for k, m in enumerate(messages) if isinstance(m, dict) and isinstance(m.get("content"), str)]
        out = plain(self.store.process_conversation(self.store.spark.createDataFrame(rows, "message int, content string"), **named))
        return out | {"memories": [r["id"] for r in out["memories"]]}


def hint(error: Exception) -> str | None:
    return next((text for kind, text in HINTS.items() if isinstance(error, kind)), None)


__all__ = ["REQUIRED", "TOOLS", "Argument", "Service", "StoreError", "hint", "plain", "schemas"]
