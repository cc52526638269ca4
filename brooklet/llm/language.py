"""Language identification by rank-order profiles (out-of-place distance of the most frequent letter n-grams).

A profile holds the PROFILE_GRAMS most frequent one-, two- and three-letter sequences of a language, most frequent
first; word boundaries count as a letter, but no sequence reaches across one. A document is ranked the same way and
compared with each profile: a sequence costs the difference of its two ranks, or PROFILE_GRAMS if the profile lacks it.

Profiles are fitted on a bounded sample of labelled rows: SAMPLE_ROWS of each language at most in expectation, taken by a
hash of doc_id. Predictions see nothing but the text.

Defined results: null texts and texts without a letter get `und` and score 0; rows without lang are not learned from;
ties of rank go by code points, ties of distance by the name of the language; without a row to learn from, every
document is `und`; equal texts get equal results; repeated rows give a row each; an empty table gives no rows; extra
columns, whatever their names, are ignored (`identified`) or kept (`filtered`, which drops und).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, slices, use_cache

PROFILE_GRAMS = 400
#: Rows of each language to learn from; a documented bound of the fit.
SAMPLE_ROWS = 3000
#: Languages at most: their profiles are sent to every task, seven kilobytes each. More labels than that are no languages, and raise.
MOST_LANGUAGES = 20_000
#: How fast the share of a language falls with its distance (in profile lengths), for the score.
SHARPNESS = 40.0
#: filtered() drops documents less like any learned language than this (0: no common sequence, 1: the same ranking). Of the
#: given tables no text lies below 0.41; hexadecimal digits lie at 0.14, random letters and Base64 at 0.2, Finnish against
#: profiles of English, German, French and Spanish at 0.25, other scripts at 0.
LEAST_SIMILARITY = 0.3
UNDETERMINED = "und"
_EDGE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """The one- to three-letter sequences of a text, 21 bits a letter; 32 stands for a word's edge."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate(([_EDGE], np.where(_letters()[codes], codes, _EDGE), [_EDGE])).astype(np.uint64)
    edge = codes == _EDGE
    keep = np.concatenate(([True], ~(edge[1:] & edge[:-1])))
    codes, edge = codes[keep], edge[keep]
    if len(codes) < 3:
        return np.empty(0, np.uint64)
    shift = np.uint64(21)
    two = (codes[:-1] << shift) | codes[1:]
    three = ((codes[:-2] << shift | codes[1:-1]) << shift) | codes[2:]
    return np.concatenate((codes[~edge], two, three[~edge[1:-1]]))


def ranking(found: np.ndarray, most: int = PROFILE_GRAMS) -> np.ndarray:
    """The most frequent sequences, most frequent first, equals by code points."""
    names, counts = np.unique(found, return_counts=True)
    return names[np.argsort(-counts, kind="stable")[:most]]


class Profiles:
    """ranked: for each language its sequences, most frequent first."""

    def __init__(self, ranked: dict[str, list[int]], most: int = PROFILE_GRAMS) -> None:
        self.languages, self.most = sorted(ranked), most
        gram = np.array([g for x in self.languages for g in ranked[x]], np.uint64)
        language = np.array([k for k, x in enumerate(self.languages) for _ in ranked[x]], np.int32)
        rank = np.array([r for x in self.languages for r in range(len(ranked[x]))], np.int32)
        order = np.argsort(gram, kind="stable")
        self.names, self.first = np.unique(gram[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(gram)))
        self.language, self.rank = language[order], rank[order]  # of each sequence in names, its languages and ranks

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (the language's share among all, by distance) and similarity (1 - distance / largest distance)."""
        own = ranking(grams(text), self.most) if text and self.languages else ()
        if not len(own):
            return UNDETERMINED, 0.0, 0.0
        at = np.searchsorted(self.names, own)
        at[at == len(self.names)] = 0
        place = np.flatnonzero(self.names[at] == own)
        n = self.count[at[place]]
        rows = np.repeat(self.first[at[place]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        near = self.most - np.abs(self.rank[rows] - np.repeat(place, n))  # what a shared sequence saves
        costs = 1 - np.bincount(self.language[rows], near, len(self.languages)) / (len(own) * self.most)
        best = int(costs.argmin())
        share = np.exp(-SHARPNESS * (costs - costs[best]))
        return self.languages[best], float(1 / share.sum()), float(1 - costs[best])


def fitted(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, most: int = PROFILE_GRAMS) -> Profiles:
    """Profiles of rows (doc_id, text, lang)."""
    rows = rows.where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return Profiles({}, most)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample_rows / n)))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            by: dict[str, list[np.ndarray]] = {}
            for text, language in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by.setdefault(language, []).append(grams(text))
            for language, found in by.items():
                names, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array([language] * len(names), pa.string()), pa.array(names.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    summed = sample.select("text", "lang").transform(in_arrow, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = (F.desc("n"), "gram")
    top = summed.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(32)))
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    ranked: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "rank", "gram").collect()):  # PROFILE_GRAMS a language
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, most)


def identified(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score, similarity."""
    shared = documents.sparkSession.sparkContext.broadcast(profiles)  # at most MOST_LANGUAGES profiles of PROFILE_GRAMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_cache()
        own = shared.value
        for batch in slices(batches):
            got = [own.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64())))], ["doc_id", "lang_pred", "score", "similarity"])

    return documents.select("doc_id", "text").transform(in_arrow, run, "doc_id long, lang_pred string, score double, similarity double")


def filtered(documents: DataFrame, profiles: Profiles, least: float = LEAST_SIMILARITY, languages: list[str] | None = None) -> DataFrame:
    """The documents that resemble a learned language (one of `languages`, if given), their lang set to it; all other columns as they were."""
    shared = documents.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_cache()
        own = shared.value
        for batch in slices(batches):
            got = [own.predict(t) for t in batch.column("text").to_pylist()]
            if "lang" in batch.schema.names:
                batch = batch.set_column(batch.schema.get_field_index("lang"), batch.schema.field("lang"), pa.array([g[0] for g in got], pa.string()))
            yield batch.filter(pa.array([g[0] != UNDETERMINED and g[2] >= least and (languages is None or g[0] in languages) for g in got], pa.bool_()))

    return documents.transform(in_arrow, run, documents.schema)


def remainder(of: int) -> Column:
    """crc32 of doc_id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op3(documents: DataFrame) -> DataFrame:
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    profiles = fitted(documents.where(~held_out).select("doc_id", "text", "lang"))
    return identified(documents, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "similarity")
