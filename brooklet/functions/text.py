"""Scalar text functions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and its opposite, and letters, digits and underscore, written out so that every regex dialect agrees.
SPACE = r"\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
S, NS, W, NW = f"[{SPACE}]", f"[^{SPACE}]", r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
#: Word boundaries.
B0, B1 = rf"(?<!{W})", rf"(?!{W})"


def python_pattern(pattern: str) -> re.Pattern:
    """A pattern of the classes above for Python, whose own classes of white space and words are the same ones."""
    return re.compile(pattern.replace(SPACE, r"\s").replace(r"\p{L}\p{N}_", r"\w").replace(r"\z", r"\Z"))


@lru_cache(maxsize=1)
def accent_tables() -> tuple[str, str]:
    """Letters with a diacritic (Latin-1, Latin Extended-A, Additional), and what they are without it."""
    marked = [chr(c) for c in (*range(0xC0, 0x180), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.translate(text, *accent_tables()))


def search_tokens(text: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def content_hash(text: Column) -> Column:
    """The first 64 bits of SHA-256, in hexadecimal."""
    return F.substring(F.sha2(text, 256), 1, 16)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{S}+|{S}+\z", "")


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB with one decimal."""
    out = F.format_string("%.1f TB", size / F.lit(1024.0**4))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", size / F.lit(1024.0**power))).otherwise(out)
    return out
