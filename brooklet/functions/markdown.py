"""Markdown chunks: a table function, as the line machine has no form in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST, MOST = 30, 800
FENCE = "`" * 3


def _sections(text: str) -> Iterator[tuple[str, list[str]]]:
    """(header, lines) of every part between second-level headers; (title, None) for a title before the first."""
    header, lines = "", []
    for line in text.split("\n"):
        if line.startswith("## "):
            if header or lines:
                yield header, lines
            header, lines = line.strip(), []
        elif line.startswith("# ") and not header:
            yield line.strip(), None
        else:
            lines.append(line)
    if header or lines:
        yield header, lines


def _paragraphs(lines: list[str]) -> list[str]:
    """Runs of lines between blank ones; a fenced block is one, whatever is in it."""
    out, held, fenced = [], [], False
    for line in lines:
        fence = line.strip().startswith(FENCE)
        if held and not fenced and (fence or not line.strip()):
            out.append("\n".join(held))
            held = []
        if fence or fenced or line.strip():
            held.append(line)
        if fence and fenced:
            out.append("\n".join(held))
            held = []
        fenced ^= fence
    return [*out, "\n".join(held)] if held else out


def _bullets(paragraph: str) -> list[list[str]]:
    """Lines before the first top-level bullet, then each such bullet with the lines below it."""
    out: list[list[str]] = []
    for line in paragraph.split("\n"):
        top = line[:1] in ("-", "*") and line[1:2].isspace()
        if top or not out:
            out.append([line])
        else:
            out[-1].append(line)
    if out and not (out[0][0][:1] in ("-", "*") and out[0][0][1:2].isspace()):
        out[0] = ["\n".join(out[0])]
    return out


def _fitting(head: str, lines: list[str], most: int) -> list[str]:
    """Lines in groups, as many as fit under the head; a line that alone doesn't fit is a group."""
    groups: list[list[str]] = []
    for line in lines:
        if groups and len("\n".join([head, *groups[-1], line]).strip()) <= most:
            groups[-1].append(line)
        else:
            groups.append([line])
    return ["\n".join([head, *g]).strip() for g in groups]


def chunks(text: str | None, least: int = LEAST, most: int = MOST) -> list[str]:
    """Chunks that stand for themselves: each under its header, of at least `least` characters and, where bullets allow, at most `most`."""
    out: list[str] = []
    for header, lines in _sections(text or ""):
        if lines is None:
            out.append(header)
            continue
        prefix = header + "\n" if header else ""
        for paragraph in _paragraphs(lines):
            whole = (prefix + paragraph).strip()
            if len(whole) <= most:
                out.append(whole)
                continue
            for first, *below in _bullets(paragraph):
                block = (prefix + "\n".join([first, *below])).strip()
                if len(block) <= most or not below:
                    out.append(block)
                else:
                    groups = [g for g in _fitting(prefix + first, below, most) if len(g) >= least]
                    out += groups or [(prefix + first).strip()]
    return [c for c in out if len(c) >= least]


def _chunked(texts: pd.Series) -> pd.Series:
    return texts.map(chunks)


def markdown_chunks(text: Column) -> Column:
    return F.pandas_udf(_chunked, "array<string>")(text)
