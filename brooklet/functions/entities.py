"""Entities in a text: ten kinds, each a regular expression."""

from __future__ import annotations

from pyspark.sql import Column

from .text import B0, B1, NS, S, W, python_pattern

#: Kind, pattern and its group, in the order that decides which spelling comes first.
PATTERNS = (
    ("email", rf"(?<!{NS}){NS}+@{NS}+\.{NS}+", 0),  # it always begins with its word: no other start is tried
    ("url", rf"https?://{NS}+", 0),
    ("mention", rf"(?<![^ \t\n,;(\[])@{W}+", 0),
    ("hashtag", rf"#{W}+", 0),
    ("ip", rf"{B0}[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}{B1}", 0),
    ("port", rf":([0-9]{{4,5}}){B1}", 0),
    ("path", rf"(?:^|(?<=\n)|{S})([~/]{NS}+)", 1),
    ("money", r"\$[0-9][0-9,]*", 0),
    ("number_unit", rf"{B0}[0-9]+(?:\.[0-9]+)?(?:MB|GB|KB|TB|ms|s|min|hr|h){B1}", 0),
    ("env_var", rf"{B0}[A-Z][A-Z0-9_]{{2,}}{B1}", 0),
)
#: What a text must hold for a pattern to be searched at all.
_NEEDED = {"email": "@", "url": "://", "mention": "@", "hashtag": "#", "ip": ".", "port": ":", "path": "/", "money": "$"}
_SEARCHES = tuple((kind, python_pattern(pattern), group, _NEEDED.get(kind, "")) for kind, pattern, group in PATTERNS)


def found(text: str) -> list[tuple[str, str]]:
    """(name, kind): of each kind and name (any case) the first spelling, kinds in the order of PATTERNS."""
    out = []
    for kind, pattern, group, needed in _SEARCHES:
        if needed not in text:
            continue
        seen = set()
        for m in pattern.finditer(text):
            name = m[group]
            if kind == "url":
                name = name.rstrip(".,;)")
            elif kind == "path" and len(name) <= 2:
                continue
            elif kind == "env_var" and "_" not in name and len(name) < 4:
                continue
            lowered = name.lower()
            if lowered not in seen:
                seen.add(lowered)
                out.append((name, kind))
    return out


def entities(text: Column) -> Column:
    """array<struct<name, type>> as found() has them; of a null text empty."""
    from .facts import facts

    return facts(text)["entities"]
