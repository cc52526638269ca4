"""The kind of a search query, as weights of keyword and vector search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EN_STOP, QUESTION_WORDS, RU_STOP, TECH_TERMS
from .text import B0, B1, NS, W, stripped


def _words(query: Column) -> Column:
    return F.regexp_extract_all(F.lower(query), F.lit(rf"({W}+)"), F.lit(1))


def real_words(query: Column) -> Column:
    stop = F.array(*map(F.lit, sorted({*EN_STOP, *RU_STOP})))
    return F.filter(_words(query), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def weights(query: Column) -> Column:
    """struct<fts_w, vec_w>; the first rule that holds decides."""
    real = real_words(query)
    letters = F.regexp_count(query, F.lit(r"\p{L}"))
    foreign = F.regexp_count(query, F.lit(r"[\p{L}&&[^\x{00}-\x{024F}]]"))
    pair = lambda a, b: F.struct(F.lit(a).alias("fts_w"), F.lit(b).alias("vec_w"))
    return (
        F.when(query.rlike('"[^"]+"'), pair(0.9, 0.1))
        .when(query.rlike(rf"@{W}+|https?://{NS}+|www\.{NS}+"), pair(0.8, 0.2))
        .when(query.rlike(rf"{B0}[0-9]{{3,}}{B1}|{B0}[0-9a-fA-F]{{6,}}{B1}"), pair(0.8, 0.2))
        .when((letters > 0) & (foreign * 2 > letters), pair(0.7, 0.3))
        .when((F.size(real) > 0) & (F.element_at(real, 1).isin(QUESTION_WORDS) | stripped(query).endswith("?")), pair(0.3, 0.7))
        .when(F.size(real) >= 5, pair(0.3, 0.7))
        .when(F.size(real) <= 2, pair(0.6, 0.4))
        .when(F.arrays_overlap(real, F.array(*map(F.lit, TECH_TERMS))), pair(0.5, 0.5))
        .otherwise(pair(0.4, 0.6))
    )


def mostly_foreign(query: Column) -> Column:
    """Whether half of the letters or more aren't ASCII: what a translator, if one is given, would be asked for."""
    letters, other = F.regexp_count(query, F.lit(r"\p{L}")), F.regexp_count(query, F.lit(r"[\p{L}&&[^\x{00}-\x{7F}]]"))
    return (letters > 0) & (other * 2 >= letters)
