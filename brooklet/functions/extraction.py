"""What a conversation's messages say: seven families of patterns."""

from __future__ import annotations

from pyspark.sql import Column

from .text import NS, S, W, python_pattern

I = "(?iu)"  # noqa: E741
REST, LINE = r"([^.!]+[.!]?)", r"([^\n]+)"
#: Family, tier, pattern, the group whose length counts, that length must be over, whether a last full stop of the group counts.
#: Families, and patterns in a family, are in the order in which the first of equal texts wins.
PATTERNS = (
    ("important", "core", rf"{I}(?:important|note|NB|critical|warning|caution|attention){S}*:{S}*{LINE}", 1, 5, True),
    ("config", "core", rf"([A-Z][A-Z0-9_]{{2,}}){S}*={S}*({NS}+)", None, 0, True),
    ("config", "core", rf"{I}(?:set|change|update){S}+({W}+){S}+to{S}+([^.!,]+)", 0, 5, True),
    ("config", "core", rf"{I}(?:port|host|url|endpoint|key|token|path){S}*(?:is|:|=){S}*({NS}+)", 0, 5, True),
    ("decisions", "episodic", rf"{I}(?:I|we|I've|we've){S}+decided{S}+(?:to{S}+)?{REST}", 1, 5, False),
    ("decisions", "episodic", rf"{I}(?:decision|decided|conclusion){S}*:{S}*{LINE}", 1, 5, False),
    ("decisions", "episodic", rf"{I}let'?s{S}+(?:go{S}+with|use|do|try){S}+{REST}", 1, 5, False),
    ("decisions", "episodic", rf"{I}going{S}+(?:to|with){S}+{REST}", 1, 5, False),
    ("learnings", "learned", rf"{I}(?:TIL|today I learned|learned that|turns out|found out|discovered){S}*:?{S}*([^\n.!]+[.!]?)", 1, 5, True),
    ("learnings", "learned", rf"{I}(?:the{S}+(?:trick|solution|fix|answer|key){S}+(?:is|was)){S}+{REST}", 1, 5, True),
    ("preferences", "procedural", rf"{I}(?:always|never|must always|must never|should always|should never){S}+{REST}", 0, 5, True),
    ("preferences", "procedural", rf"{I}(?:I|we){S}+(?:prefer|like|want|need){S}+{REST}", 0, 5, True),
    ("preferences", "procedural", rf"{I}(?:don'?t|do not){S}+(?:ever{S}+)?(?:use|do|like|want){S}+{REST}", 0, 5, True),
    ("todos", "working", rf"{I}(?:TODO|FIXME|HACK|XXX){S}*:?{S}*{LINE}", 1, 3, True),
    ("todos", "working", rf"{I}(?:need to|needs to|should|must|have to|gotta){S}+{REST}", 1, 3, True),
    ("todos", "working", rf"{I}(?:remember to|don'?t forget){S}+{REST}", 1, 3, True),
    ("facts", "learned", rf"(?:^|(?<=\n)|\.{S}+)([A-Z][^.]*?{S}+(?:is|are|was|were){S}+[^.]+\.)", None, 10, True),
    ("facts", "learned", rf"({W}[{W[1:-1]}{S[1:-1]}]{{1,30}}?){S}*[:=]{S}*({NS}[^\n]{{5,}})", None, 10, True),
)
LONGEST = 500


#: Of the patterns that begin with letters in any case: words of which a text must hold one for a pattern to be searched.
_NEEDED = {
    0: ("important", "note", "nb", "critical", "warning", "caution", "attention"), 1: ("=",), 2: ("set", "change", "update"), 3: ("port", "host", "url", "endpoint", "key", "token", "path"), 4: ("decided",), 5: ("decision", "decided", "conclusion"),
    6: ("let",), 7: ("going",), 8: ("til", "learned", "turns", "found", "discovered"), 9: ("trick", "solution", "fix", "answer", "key"), 10: ("always", "never"), 11: ("prefer", "like", "want", "need"), 12: ("don", "do not"),
    13: ("todo", "fixme", "hack", "xxx"), 14: ("need", "should", "must", "have", "gotta"), 15: ("remember", "forget"), 16: ("is", "are", "was", "were"), 17: (":", "="),
}
#: Letters that match s, k and i in any case, besides these.
_FOLDED = str.maketrans("\u017f\u212a\u0131", "ski")
_SEARCHES = tuple(python_pattern(p[2]) for p in PATTERNS)


def found(content: str) -> list[tuple[int, int, str, str, str]]:
    """(pattern, match, text, type, tier): what a message says, in the order of PATTERNS and of the text."""
    out, lowered = [], content.replace("\u0130", "i").lower().translate(_FOLDED)
    for number, (family, tier, _, group, over, stop) in enumerate(PATTERNS):
        if not any(w in lowered for w in _NEEDED[number]):
            continue
        match = 0
        for m in _SEARCHES[number].finditer(content):
            if group is not None:
                said, sized = m[0].strip(), m[group].strip()
            elif m.re.groups == 1:
                said = sized = m[1].strip()
            else:
                said = sized = m[1].strip() + ("=" if family == "config" else ": ") + m[2].strip()
            if not stop:
                sized = sized.rstrip(".")
            if over < len(sized) < LONGEST:
                out.append((number, match, said, family, tier))
                match += 1
    return out


def extractions(text: Column) -> Column:
    from .facts import extractions as column

    return column(text)
